"""Copying a branch, deleting one, and keeping the edges across what an import replaces.

Copies get ids from a hash of the branch and the old id, so a rerun gives the same ids. Only rows without a pull
request are copied; keys in `changed` are copied only where their hash is as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import hashed_id, node_key
from codestrata.operators.nodes import detach
from codestrata.session import cut


def changed_keys(chunks: DataFrame) -> DataFrame:
    """(project_id, key, hash) of the classes and methods of chunks; of a repeated key the largest hash counts."""
    classes = chunks.select(F.col("project_id").cast("string").alias("project_id"), F.col("full_class_name").alias("key"), F.col("ast_hash").alias("hash"))
    methods = chunks.select(F.col("project_id").cast("string").alias("project_id"), "full_class_name", F.explode("methods").alias("m")).select("project_id", node_key(F.col("full_class_name"), F.col("m.full_name")).alias("key"), F.col("m.ast_hash").alias("hash"))
    return classes.unionByName(methods).groupBy("project_id", "key").agg(F.max("hash").alias("hash"))


def copied_id(branch: Column, old: Column) -> Column:
    """The id of a node's copy on a branch: positive, and repeatable."""
    return hashed_id(branch, old)


def mapping(nodes: DataFrame, changed: DataFrame, main: str = "main_branch", to: str = "to_branch") -> DataFrame:
    """(project_id, old_id, new_id, to_branch) of main nodes to copy. `nodes` has columns `main` and `to` beside its own."""
    keyed = nodes.where((F.col("branch") == F.col(main)) & F.col("pull_request_id").isNull()).withColumn("key", node_key(F.col("class_name"), F.col("method_name")))
    c = changed.select(F.col("project_id").alias("c_project"), F.col("key").alias("c_key"), F.col("hash").alias("c_hash"), F.lit(True).alias("listed"))
    kept = keyed.join(c, (F.col("project_id") == F.col("c_project")) & (F.col("key") == F.col("c_key")), "left").where(F.col("listed").isNull() | (F.col("ast_hash") == F.col("c_hash")))
    return kept.select("project_id", F.col("node_id").alias("old_id"), copied_id(F.col(to), F.col("node_id")).alias("new_id"), F.col(to).alias("to_branch"))


def copy_nodes(nodes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Copies of the mapped nodes on their new branch."""
    own = [c for c in nodes.columns if c not in ("node_id", "branch", "main_branch", "to_branch")]
    return nodes.select("node_id", *own).join(mapped.select(F.col("old_id").alias("node_id"), "new_id", "to_branch"), "node_id").select(F.col("new_id").alias("node_id"), *own, F.col("to_branch").alias("branch"))


def copy_internal(rels: DataFrame, mapped: DataFrame) -> DataFrame:
    """Edges between copies, of edges whose ends were both copied."""
    s = mapped.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    d = mapped.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return rels.join(s, "src").join(d, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "type")


def copy_cross(rels: DataFrame, nodes: DataFrame, mapped: DataFrame, reverse: bool = False) -> DataFrame:
    """Edges between copies and the new branch's own rows, of edges with one end copied; `reverse`: with the target copied.

    The other end is told anew on the new branch by class and (null-safe) method.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    m = mapped.select(F.col("old_id").alias(near), F.col("new_id").alias("new_near"), "project_id", "to_branch")
    ids = mapped.select(F.col("old_id").alias(far))
    names = nodes.where(F.col("pull_request_id").isNull()).select(F.col("node_id").alias(far), F.col("class_name").alias("far_class"), F.col("method_name").alias("far_method"))
    open_ends = rels.join(m, near).join(ids, far, "left_anti").join(names, far)
    here = nodes.select(F.col("node_id").alias("new_far"), F.col("project_id").alias("h_project"), F.col("branch").alias("h_branch"), F.col("class_name").alias("h_class"), F.col("method_name").alias("h_method"))
    same = (F.col("project_id") == F.col("h_project")) & (F.col("to_branch") == F.col("h_branch")) & (F.col("far_class") == F.col("h_class")) & F.col("far_method").eqNullSafe(F.col("h_method"))
    src, dst = ("new_far", "new_near") if reverse else ("new_near", "new_far")
    return open_ends.join(here, same).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "type")


def orphan_mappings(mapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mappings of which neither id is a node's."""
    ids = nodes.select("node_id").distinct()
    return mapped.join(ids.withColumnRenamed("node_id", "old_id"), "old_id", "left_anti").join(ids.withColumnRenamed("node_id", "new_id"), "new_id", "left_anti")


def copy_branch(nodes: DataFrame, rels: DataFrame, changed: DataFrame, main: str, to: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping) with the rows of branch `main` copied onto branch `to`, less those that changed.

    Edges inside the copy, from it to the new branch's own rows and from those into it are put in; each edge counts
    once. Rows that were copied before aren't copied again. The mapping (project_id, old_id, new_id, to_branch) has
    every node that the copy stands for.
    """
    mapped = cut(mapping(nodes.withColumn("main_branch", F.lit(main)).withColumn("to_branch", F.lit(to)), changed))
    fresh = mapped.join(nodes.select(F.col("node_id").alias("new_id")), "new_id", "left_anti")
    all_nodes = nodes.unionByName(copy_nodes(nodes, fresh), allowMissingColumns=True)
    new = copy_internal(rels, mapped).unionByName(copy_cross(rels, nodes, mapped)).unionByName(copy_cross(rels, nodes, mapped, reverse=True))
    return all_nodes, rels.unionByName(new).dropDuplicates(["src", "dst", "type"]), mapped


def delete_branch(nodes: DataFrame, rels: DataFrame, project_id: str | int, branch: str, pull_request_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes left, edges left, ids deleted) without a branch, or without a pull request's rows on it."""
    gone = (F.col("project_id") == str(project_id)) & (F.col("branch") == branch)
    if pull_request_id is not None:
        gone = gone & (F.col("pull_request_id") == pull_request_id)
    gone = F.coalesce(gone, F.lit(False))
    ids = nodes.where(gone).select("node_id")
    return nodes.where(~gone), detach(rels, ids), ids


def save_boundary(nodes: DataFrame, rels: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges from unchanged to changed nodes of one branch, told by names, as a bag. `changed`: (project_id, branch, key)."""
    plain = nodes.where(F.col("pull_request_id").isNull())
    keyed = plain.select("node_id", "project_id", "branch", "class_name", "method_name", node_key(F.col("class_name"), F.col("method_name")).alias("key")).where(F.col("key").isNotNull())
    keys = changed.select("project_id", "branch", "key").distinct()
    inside = keyed.join(keys, ["project_id", "branch", "key"], "left_semi")
    outside = keyed.join(keys, ["project_id", "branch", "key"], "left_anti")
    side = lambda df, p: df.select(F.col("node_id").alias(p), F.col("project_id").alias(f"{p}_project"), F.col("branch").alias(f"{p}_branch"), F.col("class_name").alias(f"{p}_class"), F.col("method_name").alias(f"{p}_method"))
    both = rels.join(side(outside, "src"), "src").join(side(inside, "dst"), "dst").where((F.col("src_project") == F.col("dst_project")) & (F.col("src_branch") == F.col("dst_branch")))
    return both.select(F.col("src_project").alias("project_id"), F.col("src_branch").alias("branch"), "src_class", "src_method", "type", "dst_class", "dst_method")


def restore_boundary(nodes: DataFrame, saved: DataFrame) -> DataFrame:
    """Edges of saved names, found anew on their branch; one per pair of matching rows."""
    plain = nodes.where(F.col("pull_request_id").isNull())

    def side(p: str) -> DataFrame:
        return plain.select(F.col("node_id").alias(p), F.col("project_id").alias(f"n{p}_project"), F.col("branch").alias(f"n{p}_branch"), F.col("class_name").alias(f"n{p}_class"), F.col("method_name").alias(f"n{p}_method"))

    def same(p: str) -> Column:
        return (
            (F.col("project_id") == F.col(f"n{p}_project")) & (F.col("branch") == F.col(f"n{p}_branch"))
            & (F.col(f"{p}_class") == F.col(f"n{p}_class")) & F.col(f"{p}_method").eqNullSafe(F.col(f"n{p}_method"))
        )

    return saved.join(side("src"), same("src")).join(side("dst"), same("dst")).select("src", "dst", "type")
