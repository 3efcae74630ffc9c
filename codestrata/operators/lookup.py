"""Looking up nodes by properties, specs and patterns. Null conditions filter nothing; null properties match no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.schema import CONFIGURATION_NODE


def nodes_by_condition(nodes: DataFrame, project_id: str | int, branch: str, pull_request_id: str | None = None, class_name: str | None = None, method_name: str | None = None) -> DataFrame:
    """Nodes with the given properties; the filters reach the scan."""
    wanted = {"project_id": str(project_id), "branch": branch, "pull_request_id": pull_request_id, "class_name": class_name, "method_name": method_name}
    for name, value in wanted.items():
        if value is not None:
            nodes = nodes.where(F.col(name) == value)
    return nodes


def config_nodes(nodes: DataFrame, project_id: str | int, branch: str) -> DataFrame:
    """Configuration nodes of a branch by class and method, nulls last."""
    found = nodes.where((F.col("label") == CONFIGURATION_NODE) & (F.col("project_id") == str(project_id)) & (F.col("branch") == branch))
    return found.orderBy(F.asc_nulls_last("class_name"), F.asc_nulls_last("method_name"))


def nodes_by_specs(nodes: DataFrame, specs: DataFrame) -> DataFrame:
    """Nodes of each spec (project_id, branch, class_name, method_name, pull_request_id); a null method or request takes all of the class."""
    s = specs.select(*[F.col(c).alias(f"s_{c}") for c in ("project_id", "branch", "class_name", "method_name", "pull_request_id")])
    match = (
        (F.col("project_id") == F.col("s_project_id")) & (F.col("branch") == F.col("s_branch")) & (F.col("class_name") == F.col("s_class_name"))
        & (F.col("s_method_name").isNull() | (F.col("method_name") == F.col("s_method_name")))
        & (F.col("s_pull_request_id").isNull() | (F.col("pull_request_id") == F.col("s_pull_request_id")))
    )
    return s.join(nodes, match).select(nodes["*"])


def one_hop(nodes: DataFrame, rels: DataFrame, kind: str, source: Column | None = None, target: Column | None = None) -> DataFrame:
    """(src, dst, src_class, src_method, dst_class, dst_method) of edges of a type whose ends meet conditions on node columns."""
    def side(condition: Column | None, prefix: str) -> DataFrame:
        chosen = nodes if condition is None else nodes.where(condition)
        return chosen.select(F.col("node_id").alias(prefix), F.col("class_name").alias(f"{prefix}_class"), F.col("method_name").alias(f"{prefix}_method"))

    return rels.where(F.col("type") == kind).select("src", "dst").join(side(source, "src"), "src").join(side(target, "dst"), "dst")
