"""Importing chunks into a store of nodes and edges; a store is never changed, a new one is returned.

Each half of an import ends in a checkpoint: the next reads its rows instead of planning it anew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import hashed_id, node_key
from codestrata.operators import branches, edges, nodes
from codestrata.schema import NODE_COLUMNS
from codestrata.session import cut


@dataclass(frozen=True)
class Options:
    """What an import is told beside its chunks."""

    main_branch: str | None = None
    base_branch: str | None = None
    pull_request_id: str | None = None
    version: str | None = None
    base_version: str | None = None
    null_safe: bool = False
    handler_method: bool = True
    own_base: bool = False  #: every chunk's own branch is its base


@dataclass(frozen=True)
class Store:
    """Nodes (node_id and the node columns) and edges (src, dst, type); after an import also its counts (what, rows)."""

    nodes: DataFrame
    rels: DataFrame
    counts: DataFrame | None = None


def counted(**frames: DataFrame) -> DataFrame:
    """(what, rows) of frames by name; nothing is counted before it is read."""
    out = None
    for what, rows in frames.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _with_ids(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows with ids from what they say, so that a rerun gives the same ids, and apart from those of `kept` rows.

    Rows alike in place and name are told apart by their number, and from rows of that name that stay in the store by the
    largest id of those.
    """
    place = F.concat_ws("\u0001", "project_id", "branch", F.coalesce("pull_request_id", F.lit("\u0002")), "class_name", F.coalesce("method_name", F.lit("\u0002")))
    last = kept.select(place.alias("place"), "node_id").groupBy("place").agg(F.max("node_id").alias("last"))
    same = Window.partitionBy("place").orderBy("ast_hash", "content")
    numbered = rows.withColumn("place", place).withColumn("nth", F.row_number().over(same)).join(last, "place", "left")
    return numbered.withColumn("node_id", hashed_id(F.col("place"), F.col("nth"), F.coalesce("last", F.lit(-1)))).drop("place", "nth", "last")


def _requested(chunks: DataFrame, o: Options) -> DataFrame:
    given = (o.main_branch, o.base_branch, o.pull_request_id, o.version, o.base_version)
    asked = nodes.class_nodes(chunks, *given).unionByName(nodes.method_nodes(chunks, *given))
    return asked.withColumn("base_branch", F.col("branch")) if o.own_base else asked


def import_nodes(store: Store, chunks: DataFrame, o: Options, deleted: DataFrame | None = None) -> Store:
    """The store with the chunks' nodes in place of those they replace, and tombstones of deleted nodes."""
    asked = _requested(chunks, o)
    left_nodes, left_rels = nodes.without_replaced(store.nodes, store.rels, asked)
    if o.main_branch and (o.base_branch or o.own_base):
        named = asked.withColumn("main_on", F.lit(o.main_branch)).withColumn("base_on", F.col("base_branch"))
        new = nodes.delta(named, left_nodes, "main_on", "base_on", o.null_safe)
    elif o.main_branch:
        new = nodes.against_main(asked.withColumn("main_on", F.lit(o.main_branch)), left_nodes, "main_on", o.null_safe)
    else:
        new = asked
    rows = new.select(*NODE_COLUMNS)
    if deleted is not None:
        rows = rows.unionByName(nodes.tombstone_nodes(deleted), allowMissingColumns=True)
    left = cut(left_nodes)
    made = cut(_with_ids(rows, left))
    gone = store.nodes.select("node_id").join(left.select("node_id"), "node_id", "left_anti")
    return Store(left.unionByName(made, allowMissingColumns=True), cut(left_rels), counted(created=made, replaced=gone))


def import_edges(store: Store, chunks: DataFrame, o: Options) -> Store:
    """The store with the chunks' edges put in."""
    asked = edges.requests(chunks, o.handler_method).withColumn("base_branch", F.col("branch") if o.own_base else F.lit(o.base_branch).cast("string")).withColumn("main_branch", F.lit(o.main_branch).cast("string"))
    policy = "fallback" if o.main_branch and (o.base_branch or o.own_base) else "main" if o.main_branch else "same"
    resolved = cut(edges.resolve_all(asked, store.nodes, policy))
    counts = counted(resolved=resolved)
    return Store(store.nodes, cut(edges.merge(store.rels, resolved)), counts if store.counts is None else store.counts.unionByName(counts))


def import_simple(store: Store, chunks: DataFrame, o: Options = Options(), deleted: DataFrame | None = None) -> Store:
    """Nodes, then edges; edges from others into replaced nodes are lost."""
    return import_edges(import_nodes(store, chunks, o, deleted), chunks, o)


def import_incremental(store: Store, chunks: DataFrame, o: Options = Options(), deleted: DataFrame | None = None) -> Store:
    """Nodes and edges with the edges of unchanged nodes into replaced ones kept, and each edge once.

    Without a base branch each chunk's own branch is its base.
    """
    if o.base_branch is None and o.main_branch is not None:
        o = replace(o, own_base=True)
    classes = chunks.select(F.col("project_id").cast("string").alias("project_id"), "branch", F.col("full_class_name").alias("key"))
    methods = chunks.select(F.col("project_id").cast("string").alias("project_id"), "branch", "full_class_name", F.explode("methods").alias("m")).select("project_id", "branch", node_key(F.col("full_class_name"), F.col("m.full_name")).alias("key"))
    saved = cut(branches.save_boundary(store.nodes, store.rels, classes.unionByName(methods)))
    with_nodes = import_nodes(store, chunks, o, deleted)
    back = cut(branches.restore_boundary(with_nodes.nodes, saved))
    restored = Store(with_nodes.nodes, with_nodes.rels.unionByName(back), with_nodes.counts.unionByName(counted(saved=saved, restored=back)))
    done = import_edges(restored, chunks, o)
    return Store(done.nodes, edges.without_duplicates(done.rels), done.counts)


def copy_branch(store: Store, chunks: DataFrame, main: str, to: str) -> Store:
    """The store with branch `main` copied onto `to`, less the classes and methods that the chunks say changed; counts as an import's."""
    all_nodes, all_rels, mapped = branches.copy_branch(store.nodes, store.rels, branches.changed_keys(chunks), main, to)
    kept_nodes, kept_rels = cut(all_nodes), cut(all_rels)
    copied = kept_nodes.select("node_id").join(store.nodes.select("node_id"), "node_id", "left_anti")
    return Store(kept_nodes, kept_rels, counted(copied=copied, mapped=mapped))
