"""Symbols and name resolution over extracted classes, by joins in place of a language server.

A simple name is resolved by the file's imports, then its package, then as the only class of that name. A call is
resolved by the type of its receiver (the class itself, a field, parameter or local variable, or a class's name), in that
class or the nearest of its supertypes, an overload by the number of arguments; where the file doesn't tell the type, by
its name if one method only has it. Types of expressions aren't worked out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.filters import project_names
from codestrata.operators import traverse


def symbols(classes: DataFrame) -> DataFrame:
    """One row per full class name, of repeated ones the largest file_id."""
    return classes.groupBy("full_class_name").agg(F.max_by(F.struct("file_id", "package", "class_name", "kind", "is_abstract"), "file_id").alias("s")).select("full_class_name", "s.*")


def resolve_types(refs: DataFrame, table: DataFrame) -> DataFrame:
    """refs (file_id, package, imports, name, ...) with `resolved`, null where no rule finds a class."""
    same = table.select(F.col("package").alias("s_package"), F.col("class_name").alias("s_name"), F.col("full_class_name").alias("near")).groupBy("s_package", "s_name").agg(F.min("near").alias("near"))
    only = table.groupBy(F.col("class_name").alias("o_name")).agg(F.count(F.lit(1)).alias("n"), F.min("full_class_name").alias("only")).where("n = 1").drop("n")
    joined = refs.join(same, (refs["package"] == same["s_package"]) & (refs["name"] == same["s_name"]), "left").join(only, refs["name"] == only["o_name"], "left")
    return joined.withColumn("resolved", F.coalesce(F.try_element_at("imports", "name"), "near", "only")).drop("s_package", "s_name", "near", "o_name", "only")


def used_types(classes: DataFrame, table: DataFrame) -> DataFrame:
    """(full_class_name, used) pairs of classes and the project types they use, resolved."""
    method_types = F.flatten(F.transform("methods", lambda m: m["used_types"]))
    refs = classes.select("file_id", "full_class_name", "package", "imports", F.explode(project_names(F.array_union("used_types", method_types))).alias("name"))
    return resolve_types(refs, table).where("resolved is not null and resolved <> full_class_name").select("full_class_name", F.col("resolved").alias("used")).distinct()


def known_calls(classes: DataFrame) -> DataFrame:
    """(caller_class, caller, callee) of calls whose simple name some class declares."""
    names = classes.select(F.explode("methods").alias("m")).select(F.col("m.name").alias("callee")).distinct()
    calls = classes.select("full_class_name", F.explode("methods").alias("m")).select(F.col("full_class_name").alias("caller_class"), F.col("m.signature").alias("caller"), F.explode("m.calls").alias("c"))
    return calls.select("caller_class", "caller", F.col("c.name").alias("callee")).distinct().join(names, "callee", "left_semi")


def implementations(classes: DataFrame, table: DataFrame) -> DataFrame:
    """(implementor, supertype) pairs, resolved."""
    refs = classes.select("file_id", "full_class_name", "package", "imports", F.explode("supertypes").alias("name"))
    return resolve_types(refs, table).where("resolved is not null").select(F.col("full_class_name").alias("implementor"), F.col("resolved").alias("supertype")).distinct()


def supertypes(direct: DataFrame) -> DataFrame:
    """(implementor, supertype, distance) over any number of steps, out of direct pairs (implementor, supertype)."""
    rels = direct.select(F.col("implementor").alias("src"), F.col("supertype").alias("dst"), F.lit("EXTEND").alias("type"))
    above = traverse.closure(direct.select(F.col("implementor").alias("node_id")), rels, "EXTEND>", max_level=64)
    return above.where("seed <> node").select(F.col("seed").alias("implementor"), F.col("node").alias("supertype"), F.col("depth").alias("distance"))


def methods_of(classes: DataFrame) -> DataFrame:
    """(owner, at, name, full_name, parameters, is_abstract): a row per method, `at` its place in its class."""
    m = classes.select("file_id", F.col("full_class_name").alias("owner"), F.posexplode("methods").alias("at", "m"))
    return m.select("file_id", "owner", "at", F.col("m.name").alias("name"), F.concat("owner", F.lit("."), "m.signature").alias("full_name"), F.col("m.parameters").alias("parameters"), F.col("m.is_abstract").alias("is_abstract"))


def resolved_calls(classes: DataFrame, table: DataFrame, above: DataFrame) -> DataFrame:
    """(file_id, full_class_name, at, callee) of calls whose method is found, once per method and callee."""
    methods = methods_of(classes)
    key = ["file_id", "full_class_name", "at"]
    calls = classes.select("file_id", "full_class_name", "package", "imports", F.posexplode("methods").alias("at", "m")).select("file_id", "full_class_name", "package", "imports", "at", F.explode(F.array_distinct("m.calls")).alias("c"))
    calls = calls.select(*key, "package", "imports", F.col("c.name").alias("called"), F.col("c.arguments").alias("given"), F.col("c.type").alias("name"), (F.col("c.receiver").isNull() | F.col("c.receiver").isin("this", "super")).alias("inner"))
    typed = resolve_types(calls.where("name is not null"), table).withColumn("owner", F.when(F.col("inner"), F.col("full_class_name")).otherwise(F.col("resolved"))).where("owner is not null")
    up = above.select(F.col("implementor").alias("owner"), F.col("supertype").alias("holder"), "distance")
    asked = typed.select(*key, "called", "given", "owner")
    own = asked.withColumn("holder", F.col("owner")).withColumn("distance", F.lit(0))
    holders = own.unionByName(asked.join(up, "owner"))
    held = methods.select(F.col("owner").alias("holder"), F.col("name").alias("called"), "full_name", F.size("parameters").alias("takes"))
    best = F.min(F.struct((F.col("takes") != F.col("given")).alias("other"), "distance", "full_name")).alias("best")
    found = holders.join(held, ["holder", "called"]).groupBy(*key, "called", "given", "owner").agg(best).select(*key, F.col("best.full_name").alias("callee"))
    only = methods.groupBy(F.col("name").alias("called")).agg(F.count_distinct("full_name").alias("n"), F.min("full_name").alias("callee")).where("n = 1").drop("n")
    untold = calls.where("name is null").join(only, "called").select(*key, "callee")
    return found.unionByName(untold).distinct()


def method_implementations(classes: DataFrame, above: DataFrame) -> DataFrame:
    """(full_name, implementation): methods without a body, and those of subtypes that have the same name and simple parameter types."""
    methods = methods_of(classes)
    kept = methods.where(~F.col("is_abstract")).select(F.col("owner").alias("implementor"), "name", "parameters", F.col("full_name").alias("implementation"))
    return methods.where("is_abstract").withColumnRenamed("owner", "supertype").join(above, "supertype").join(kept, ["implementor", "name", "parameters"]).select("full_name", "implementation").distinct()


def document_symbols(classes: DataFrame) -> DataFrame:
    """(file_id, container, name, kind, line) of everything a file declares."""
    own = classes.select("file_id", F.col("parent_class").alias("container"), F.col("class_name").alias("name"), "kind", F.lit(None).cast("int").alias("line"))
    methods = classes.select("file_id", F.col("full_class_name").alias("container"), F.explode("methods").alias("m")).select("file_id", "container", F.col("m.name").alias("name"), F.lit("method").alias("kind"), F.col("m.line").alias("line"))
    return own.unionByName(methods)


def workspace_symbols(classes: DataFrame, text: str) -> DataFrame:
    """Declared names that contain a text, letter case aside."""
    return document_symbols(classes).where(F.contains(F.lower("name"), F.lit(text.lower())))


def references(classes: DataFrame) -> DataFrame:
    """(callee, caller_class, caller): where a simple name that some class declares is called; the reverse of resolution."""
    return known_calls(classes).select("callee", "caller_class", "caller")


def class_counts(classes: DataFrame) -> DataFrame:
    """(file_id, class_count) of files that declare classes."""
    return classes.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("class_count"))


def method_at(places: DataFrame, classes: DataFrame) -> DataFrame:
    """places (file_id, line, column) with the method whose name stands there: equal file and line, column within the name."""
    m = classes.select("file_id", "full_class_name", F.explode("methods").alias("m")).select("file_id", "full_class_name", F.col("m.signature").alias("signature"), F.col("m.line").alias("line"), F.col("m.column_start").alias("a"), F.col("m.column_end").alias("b"))
    return places.join(m, ["file_id", "line"]).where((F.col("column") >= F.col("a")) & (F.col("column") <= F.col("b"))).drop("a", "b")


def hover(places: DataFrame, classes: DataFrame) -> DataFrame:
    """places (file_id, line, column) with what is declared there: its return type, class and signature as one text."""
    m = classes.select("file_id", "full_class_name", F.explode("methods").alias("m")).select("file_id", "full_class_name", F.col("m.signature").alias("signature"), F.col("m.return_type").alias("return_type"))
    text = F.concat("return_type", F.lit(" "), "full_class_name", F.lit("."), "signature")
    return method_at(places, classes).join(m, ["file_id", "full_class_name", "signature"]).withColumn("text", text).drop("return_type")
