"""Chunks out of extracted classes: names resolved, endpoints read, implementors listed.

Calls, types and fields that no rule of `symbols` resolves are dropped. A chunk's arrays hold what its own source refers
to; `implements` lists the classes below it over any number of steps, a method's `inheritance_info` what implements it.
Facts are written once, and every part reads them from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import endpoints, filters
from codestrata.operators import symbols
from codestrata.schema import CHUNK
from codestrata.session import cut

#: Advice on methods that carry an annotation.
ADVICE = r"@(?:Around|Before|After)\s*\(\s*(?:value\s*=\s*)?\"@annotation\(([\w.]+)\)"
_TEXTS = "cast(array() as array<string>)"


def _set(column: str):
    return F.sort_array(F.collect_set(column))


def _known(name, imports: str = "imports"):
    """A simple name by the imports; dotted and other names stay."""
    return F.coalesce(F.try_element_at(F.col(imports), name), name)


def _annotation_names(texts: str):
    """Full names of annotations, those of frameworks left out."""
    full = F.transform(texts, lambda a: _known(F.regexp_extract(a, r"^@([\w.]+)", 1)))
    return F.filter(full, lambda n: ~filters.is_framework(n))


def build(facts: DataFrame, project_id: str | int, branch: str, sources: DataFrame | None = None) -> DataFrame:
    """Chunk rows of class facts (java_facts.extract); `sources` (file_id, file_path, content) gives paths and texts."""
    classes = cut(facts)
    names = cut(symbols.symbols(classes))
    used = symbols.used_types(classes, names).groupBy("full_class_name").agg(_set("used").alias("class_used"))
    above = cut(symbols.supertypes(cut(symbols.implementations(classes, names))))
    implementors = above.groupBy(F.col("supertype").alias("full_class_name")).agg(_set("implementor").alias("implements"))
    class_text = F.concat_ws(" ", "annotations")
    m = classes.select("file_id", "full_class_name", "package", "imports", class_text.alias("class_text"), F.posexplode("methods").alias("at", "m"))
    m = m.withColumn("full_name", F.concat("full_class_name", F.lit("."), "m.signature"))
    calls = symbols.resolved_calls(classes, names, above).groupBy("file_id", "full_class_name", "at").agg(_set("callee").alias("calls"))
    fields = m.select("file_id", "full_class_name", "package", "imports", "at", F.explode("m.field_access").alias("field")).withColumn("name", F.substring_index("field", ".", 1))
    fields = symbols.resolve_types(fields, names).where("resolved is not null").withColumn("field", F.concat("resolved", F.lit("."), F.substring_index("field", ".", -1)))
    fields = fields.groupBy("file_id", "full_class_name", "at").agg(_set("field").alias("fields"))
    bodies = symbols.method_implementations(classes, above).groupBy("full_name").agg(_set("implementation").alias("implemented"))
    types = m.select("file_id", "full_class_name", "package", "imports", "at", F.explode(filters.project_names(F.col("m.used_types"))).alias("name"))
    types = symbols.resolve_types(types, names).where("resolved is not null").groupBy("file_id", "full_class_name", "at").agg(_set("resolved").alias("types"))
    key = ["file_id", "full_class_name", "at"]
    found = F.flatten(F.transform("m.annotations", lambda a: endpoints.endpoints(a, F.col("class_text"), F.concat_ws(" ", "m.annotations"), F.col("m.return_type"), F.regexp_extract("m.signature", r"(\(.*)$", 1))))
    method = F.struct(
        F.col("m.signature").alias("name"), "full_name", F.coalesce("m.body", F.lit("")).alias("body"), F.col("m.shape").alias("ast_hash"),
        F.transform(F.coalesce("calls", F.expr(_TEXTS)), lambda c: F.struct(c.alias("name"), F.expr("cast(array() as array<struct<type:string,value:string>>)").alias("params"))).alias("method_calls"),
        F.coalesce("types", F.expr(_TEXTS)).alias("used_types"), F.coalesce("fields", F.expr(_TEXTS)).alias("field_access"), F.coalesce("implemented", F.expr(_TEXTS)).alias("inheritance_info"), F.col("found").alias("endpoint"),
        F.when(F.size("found") > 0, "rest_endpoint").otherwise("regular").alias("type"), F.lit(str(project_id)).alias("project_id"), F.lit(branch).alias("branch"), _known(F.nullif(F.regexp_extract(F.concat_ws(" ", "m.annotations"), ADVICE, 1), F.lit(""))).alias("handles_annotation"),
        _annotation_names("m.annotations").alias("annotations"),
    )
    methods = m.withColumn("found", found).join(calls, key, "left").join(types, key, "left").join(fields, key, "left").join(bodies, "full_name", "left").groupBy("file_id", "full_class_name").agg(F.sort_array(F.collect_list(F.struct("at", method.alias("method")))).alias("ms"))
    texts = sources.select("file_id", "file_path", "content").dropDuplicates(["file_id"]) if sources is not None else facts.sparkSession.createDataFrame([], "file_id long, file_path string, content string")
    rows = classes.join(texts, "file_id", "left").join(methods, ["file_id", "full_class_name"], "left").join(used, "full_class_name", "left").join(implementors, "full_class_name", "left")
    none = F.expr(_TEXTS)
    out = rows.select(
        "package", "class_name", "full_class_name", "file_path", "content", F.col("shape").alias("ast_hash"), F.when(F.col("is_abstract"), F.coalesce("implements", none)).otherwise(none).alias("implements"),
        F.coalesce(F.transform("ms", lambda x: x["method"]), F.array().cast(CHUNK["methods"].dataType)).alias("methods"), "parent_class", F.lit(str(project_id)).alias("project_id"), F.lit(branch).alias("branch"),
        F.coalesce("class_used", none).alias("used_types"), "is_nested", F.when(filters.is_configuration(F.col("annotations"), F.col("supertypes")), "configuration").otherwise("regular").alias("type"),
        (F.col("kind") == "annotation").alias("is_annotation"), _known(F.col("handles")).alias("handles_annotation"), _annotation_names("annotations").alias("annotations"),
    )
    return out.select(*CHUNK.names)
