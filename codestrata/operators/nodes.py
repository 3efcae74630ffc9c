"""Node rows: projections of chunks and methods, defaults, tombstones, and what of them is new.

Comparisons follow the property graph's rules: a null equals nothing, so class-level rows (null method) never match in
the delta by `=`; `null_safe=True` compares them as equal instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import escape_text
from codestrata.schema import CLASS_NODE, CONFIGURATION, CONFIGURATION_NODE, ENDPOINT_NODE, ENDPOINT_TYPE, METHOD_NODE


def class_label(kind: Column) -> Column:
    """Label of a class by its chunk type."""
    return F.when(kind == CONFIGURATION, CONFIGURATION_NODE).otherwise(CLASS_NODE)


def method_label(kind: Column) -> Column:
    """Label of a method by its chunk type."""
    return F.when(kind == CONFIGURATION, CONFIGURATION_NODE).when(kind == ENDPOINT_TYPE, ENDPOINT_NODE).otherwise(METHOD_NODE)


def version_or_default(version: Column) -> Column:
    """The version; 'unknown' for null and ''."""
    return F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown"))


def status_or_default(status: Column, base_branch: Column, base_version: Column) -> Column:
    """The status where a base branch and version are given; 'ACTIVE' otherwise and for null."""
    given = (F.coalesce(base_branch, F.lit("")) != "") & (F.coalesce(base_version, F.lit("")) != "")
    return F.when(given, F.coalesce(status, F.lit("ACTIVE"))).otherwise(F.lit("ACTIVE"))


def request_tag(pull_request_id: Column, branch: Column, main_branch: Column) -> Column:
    """The pull request, if the branch isn't the main one."""
    return F.when(pull_request_id.isNotNull() & ~branch.eqNullSafe(main_branch), pull_request_id)


def _common(main: str | None, base: str | None, request: str | None, version: str | None, base_version: str | None) -> list[Column]:
    text = lambda v: F.lit(v).cast("string")
    return [
        version_or_default(text(version)).alias("version"), F.lit("ACTIVE").alias("status"), text(base).alias("base_branch"), text(base_version).alias("base_version"),
        request_tag(text(request), F.col("branch"), text(main)).alias("pull_request_id"),
    ]


def class_nodes(chunks: DataFrame, main: str | None = None, base: str | None = None, request: str | None = None, version: str | None = None, base_version: str | None = None, escape: bool = True) -> DataFrame:
    """One node row per chunk."""
    content = escape_text(F.col("content")) if escape else F.col("content")
    return chunks.select(
        class_label(F.col("type")).alias("label"), F.col("class_name").alias("name"), F.col("full_class_name").alias("class_name"), F.lit(None).cast("string").alias("method_name"),
        "file_path", content.alias("content"), "ast_hash", F.col("project_id").cast("string").alias("project_id"), "branch", *_common(main, base, request, version, base_version), F.lit(None).cast("string").alias("endpoint"),
    )


def method_nodes(chunks: DataFrame, main: str | None = None, base: str | None = None, request: str | None = None, version: str | None = None, base_version: str | None = None, escape: bool = True) -> DataFrame:
    """One node row per chunk and method; endpoints as JSON, null where there are none."""
    m = chunks.select("full_class_name", "file_path", F.col("project_id").cast("string").alias("project_id"), "branch", F.explode("methods").alias("m"))
    body = escape_text(F.col("m.body")) if escape else F.coalesce("m.body", F.lit(""))
    content = F.concat(body, F.lit(" "), F.coalesce(F.to_json("m.field_access"), F.lit("[]")))
    return m.select(
        method_label(F.col("m.type")).alias("label"), F.coalesce("m.name", "m.full_name").alias("name"), F.col("full_class_name").alias("class_name"), F.col("m.full_name").alias("method_name"),
        "file_path", content.alias("content"), F.col("m.ast_hash").alias("ast_hash"), "project_id", "branch", *_common(main, base, request, version, base_version),
        F.when(F.size("m.endpoint") > 0, F.to_json("m.endpoint")).alias("endpoint"),
    )


def tombstone_nodes(deleted: DataFrame) -> DataFrame:
    """Node rows of deleted nodes (name, class_name, method_name, node_type, ast_hash, project_id, branch)."""
    kind = F.coalesce("node_type", F.when(F.col("method_name").isNotNull(), METHOD_NODE).otherwise(CLASS_NODE))
    key = F.when(F.col("method_name").isNotNull(), F.concat("class_name", F.lit("."), "method_name")).otherwise(F.col("class_name"))
    return deleted.select(kind.alias("label"), "name", "class_name", "method_name", F.concat(F.lit("[DELETED] "), key).alias("content"), "ast_hash", "project_id", "branch", F.lit("DELETED").alias("status"))


def _side(nodes: DataFrame, branch: str, prefix: str) -> DataFrame:
    return nodes.select(
        F.col("project_id").alias(f"{prefix}_project"), F.col("branch").alias(f"{prefix}_on"), F.col("class_name").alias(f"{prefix}_class"), F.col("method_name").alias(f"{prefix}_method"),
        F.col("ast_hash").alias(f"{prefix}_hash"), F.lit(True).alias(f"{prefix}_there"),
    )


def _same(prefix: str, branch: str, null_safe: bool) -> Column:
    method = F.col("method_name").eqNullSafe(F.col(f"{prefix}_method")) if null_safe else F.col("method_name") == F.col(f"{prefix}_method")
    return (F.col("project_id") == F.col(f"{prefix}_project")) & (F.col(branch) == F.col(f"{prefix}_on")) & (F.col("class_name") == F.col(f"{prefix}_class")) & method


def delta(requests: DataFrame, nodes: DataFrame, main: str = "main_branch", base: str = "base_branch", null_safe: bool = False) -> DataFrame:
    """Requested node rows that differ from their base row, else from their main row, or have neither.

    `main` and `base` name columns of the requests. A row stays once per pair of matching rows, as a bag.
    """
    both = requests.join(_side(nodes, base, "b"), _same("b", base, null_safe), "left").join(_side(nodes, main, "m"), _same("m", main, null_safe), "left")
    here = F.col("b_there").isNotNull()
    there = F.col("m_there").isNotNull()
    new = (here & (F.col("ast_hash") != F.col("b_hash"))) | (~here & there & (F.col("ast_hash") != F.col("m_hash"))) | (~here & ~there)
    return both.where(new).select(requests["*"])


def against_main(requests: DataFrame, nodes: DataFrame, main: str = "main_branch", null_safe: bool = False) -> DataFrame:
    """Requested node rows, once per main row of another hash, at least once."""
    return requests.join(_side(nodes, main, "m"), _same("m", main, null_safe) & (F.col("m_hash") != F.col("ast_hash")), "left").select(requests["*"])


def without_replaced(nodes: DataFrame, rels: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges less those that `keys` (project_id, branch, class_name, method_name) replace, rows of pull requests aside."""
    k = keys.select(*[F.col(c).alias(f"k_{c}") for c in ("project_id", "branch", "class_name", "method_name")]).distinct()
    same = (
        F.col("pull_request_id").isNull() & (F.col("project_id") == F.col("k_project_id")) & (F.col("branch") == F.col("k_branch"))
        & (F.col("class_name") == F.col("k_class_name")) & F.col("method_name").eqNullSafe(F.col("k_method_name"))
    )
    gone = nodes.join(k, same, "left_semi").select("node_id")
    return nodes.join(gone, "node_id", "left_anti"), detach(rels, gone)


def detach(rels: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is among `gone` (node_id)."""
    return rels.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
