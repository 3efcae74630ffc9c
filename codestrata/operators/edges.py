"""Edge requests out of chunks, their resolution to nodes, and edge sets.

A request has kind, project_id, branch, source_class, source_method, target_class, target_method. Resolved edges are
sets; requests with an end that has no node give no edge. A null class or method never matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST = ["kind", "project_id", "branch", "source_class", "source_method", "target_class", "target_method"]


def requests(chunks: DataFrame, handler_method: bool = True) -> DataFrame:
    """All edge requests of chunks, as a bag.

    `handler_method` links a method that handles an annotation from the annotation to the method; False to its class.
    """
    null = F.lit(None).cast("string")
    ident = [F.col("project_id").cast("string").alias("project_id"), F.col("branch")]

    def row(kind: str, source_class, source_method, target_class, target_method) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.col("project_id"), F.col("branch"), source_class.alias("source_class"), source_method.alias("source_method"), target_class.alias("target_class"), target_method.alias("target_method")]

    c = chunks.select(*ident, "full_class_name", "implements", "used_types", "annotations", "handles_annotation", "methods")
    m = c.select("project_id", "branch", "full_class_name", F.explode("methods").alias("m"))
    each = lambda column: c.select("project_id", "branch", "full_class_name", F.explode(column).alias("x"))
    own = lambda column: m.select("project_id", "branch", "full_class_name", F.col("m.full_name").alias("method"), F.explode(column).alias("x"))
    cls, method, x = F.col("full_class_name"), F.col("method"), F.col("x")
    parts = [
        each("used_types").select(*row("USE", cls, null, x, null)),
        each("implements").select(*row("IMPLEMENT", x, null, cls, null)),
        each("annotations").select(*row("USE", cls, null, x, null)),
        c.where("handles_annotation is not null").select(*row("USE", F.col("handles_annotation"), null, cls, null)),
        own("m.method_calls").select(*row("CALL", cls, method, null, F.col("x.name"))),
        # a method's name carries its class: both ends of an implemented method are told by it
        own("m.inheritance_info").select(*row("IMPLEMENT", null, x, cls, method)),
        own("m.used_types").select(*row("USE", cls, method, x, null)),
        own("m.annotations").select(*row("USE", cls, method, x, null)),
        m.where("m.handles_annotation is not null").select(*row("USE", F.col("m.handles_annotation"), null, cls, F.col("m.full_name") if handler_method else null)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _end(nodes: DataFrame, prefix: str, by_method: bool) -> DataFrame:
    rows = nodes.where(F.col("method_name").isNotNull() if by_method else F.col("method_name").isNull())
    return rows.select(F.col("node_id").alias(prefix), F.col("project_id").alias(f"{prefix}_project"), F.col("branch").alias(f"{prefix}_branch"), F.col("class_name").alias(f"{prefix}_class"), F.col("method_name").alias(f"{prefix}_method"))


def _match(prefix: str, on: dict[str, str]) -> Column:
    out = F.col(f"{prefix}_project") == F.col("project_id")
    for column, wanted in on.items():
        out = out & (F.col(f"{prefix}_{column}") == F.col(wanted))
    return out


def _find(asked: DataFrame, nodes: DataFrame, prefix: str, on: dict[str, str], branches: list[str]) -> DataFrame:
    """Joins the nodes of one end. Of several branch columns the first with a match counts: one join, then the best rank."""
    by_method = "method" in on
    end = _end(nodes, prefix, by_method)
    if len(branches) == 1:
        return asked.join(end, _match(prefix, on) & (F.col(f"{prefix}_branch") == F.col(branches[0])))
    near = F.array(*[F.col(b) for b in branches])
    found = asked.join(end, _match(prefix, on) & F.array_contains(near, F.col(f"{prefix}_branch")))
    rank = F.array_position(near, F.col(f"{prefix}_branch"))
    best = Window.partitionBy(*asked.columns)
    return found.withColumn("rank", rank).withColumn("best", F.min("rank").over(best)).where("rank = best").drop("rank", "best")


def resolve(asked: DataFrame, nodes: DataFrame, source: dict[str, str], target: dict[str, str], source_branches: list[str], target_branches: list[str]) -> DataFrame:
    """Edges (src, dst, type) of requests. `source` and `target` map node columns to request columns."""
    used = ["kind", "project_id", *dict.fromkeys([*source.values(), *target.values(), *source_branches, *target_branches])]
    asked = asked.select(*used).distinct()
    both = _find(_find(asked, nodes, "src", source, source_branches), nodes, "dst", target, target_branches)
    return both.select("src", "dst", F.col("kind").alias("type")).distinct()


BY_CLASS, BY_METHOD, BY_BOTH = {"class": "{}_class"}, {"method": "{}_method"}, {"class": "{}_class", "method": "{}_method"}
#: By edge: columns that tell the source, those that tell the target, and whether a fallback holds for the source too.
RULES = {
    "call": (BY_BOTH, BY_METHOD, False), "implement_class": (BY_CLASS, BY_CLASS, True), "implement_method": (BY_METHOD, BY_BOTH, True),
    "use_class": (BY_CLASS, BY_CLASS, False), "use_method": (BY_BOTH, BY_CLASS, False), "use_handler": (BY_CLASS, BY_BOTH, False),
}


def resolve_rule(asked: DataFrame, nodes: DataFrame, rule: str, policy: str = "same") -> DataFrame:
    """Edges of one rule. Policies: 'same' branch, 'fallback' from base_branch to main_branch, 'main' for the target."""
    source, target, source_too = RULES[rule]
    name = lambda side, on: {k: v.format(side) for k, v in on.items()}
    branches = {"same": ["branch"], "fallback": ["base_branch", "main_branch"], "main": ["main_branch"]}[policy]
    return resolve(asked, nodes, name("source", source), name("target", target), branches if source_too and policy == "fallback" else ["branch"], branches)


def resolve_all(asked: DataFrame, nodes: DataFrame, policy: str = "same") -> DataFrame:
    """Edges of all requests, each kind by its rule."""
    method_source, method_target = F.col("source_method").isNotNull(), F.col("target_method").isNotNull()
    kinds = {
        "call": F.col("kind") == "CALL", "implement_class": (F.col("kind") == "IMPLEMENT") & ~method_source, "implement_method": (F.col("kind") == "IMPLEMENT") & method_source,
        "use_class": (F.col("kind") == "USE") & ~method_source & ~method_target, "use_method": (F.col("kind") == "USE") & method_source, "use_handler": (F.col("kind") == "USE") & ~method_source & method_target,
    }
    out = None
    for rule, condition in kinds.items():
        fit = "same" if policy == "main" and rule != "call" else policy
        part = resolve_rule(asked.where(condition), nodes, rule, fit)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def without_duplicates(rels: DataFrame) -> DataFrame:
    """Edges, one of each type between two ends."""
    return rels.dropDuplicates(["src", "dst", "type"])


def merge(rels: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones put in where there is none of that type between the ends yet."""
    return without_duplicates(rels.unionByName(new))


def duplicate_groups(rels: DataFrame) -> DataFrame:
    """(src, dst, type, copies) of edges there more than once."""
    return rels.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Node ids beyond the smallest of each (project, branch, class, method), rows of pull requests aside; nulls are one value."""
    plain = nodes.where(F.col("pull_request_id").isNull())
    first = plain.groupBy("project_id", "branch", "class_name", "method_name").agg(F.min("node_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = [plain[c].eqNullSafe(first[c]) for c in ("project_id", "branch", "class_name", "method_name")]
    return plain.join(first, same[0] & same[1] & same[2] & same[3]).where(F.col("node_id") != F.col("first")).select("node_id")


def degrees(rels: DataFrame, kind: str, limit: int) -> DataFrame:
    """The `limit` nodes called by most edges of a type, ties by id."""
    return rels.where(F.col("type") == kind).groupBy("dst").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "dst").limit(limit)
