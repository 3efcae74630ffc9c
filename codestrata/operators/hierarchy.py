"""Parent-child links of unknown depth as full hierarchies.

A deterministic hash picks splitters among the nodes. Every node walks to the next splitter or root above it (hops are
doubled, but never past a splitter), then only the splitters, joined by those walks, are solved among themselves,
and each node's path is its own walk followed by its splitter's. A walk that never ends is in, or leads into, a cycle
without splitters; a round that ends no further walk proves that all walks left do so, since distances to an end take
every value below their largest.

Null ends are no links; repeated links count once; of several parents of a child the smallest counts; a link to itself
is a cycle. An empty table gives an empty result. Tables are joined by (h, v), so a hot parent is split by adaptive
skew joins; the other side has one row per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

SPLITTER_ONE_IN = 8


def _splitter(h: str, v: str) -> Column:
    return F.pmod(F.xxhash64(h, v), F.lit(SPLITTER_ONE_IN)) == 0


def _double(walks: DataFrame) -> tuple[DataFrame, int]:
    """Walks (h, v, ptr, d, path, stop) with hops doubled until no further one ends; and how many never end."""
    left = walks.where(~F.col("stop")).count()
    while left:
        on = walks.where(~F.col("stop")).alias("a")
        by = walks.select("h", F.col("v").alias("ptr"), F.col("ptr").alias("nptr"), F.col("d").alias("nd"), F.col("path").alias("npath"), F.col("stop").alias("nstop"))
        hopped = on.join(by, ["h", "ptr"]).select("h", "v", F.col("nptr").alias("ptr"), (F.col("d") + F.col("nd")).alias("d"), F.concat("path", "npath").alias("path"), F.col("nstop").alias("stop"))
        walks = cut(walks.where("stop").unionByName(hopped))
        now = walks.where(~F.col("stop")).count()
        if now == left:
            break
        left = now
    return walks, left


def solve(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Of links (h, child, parent): one row (h, v, root, depth, path) per child.

    depth is the number of links to the root; root and depth are -1 where the chain enters a cycle. path holds the
    ancestors from the parent to the root if `with_path`, else it is empty (and null where there is a cycle).
    """
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("h", "child").agg(F.min("parent").alias("parent"))
    links = cut(links)
    children = links.select("h", F.col("child").alias("parent"), F.lit(True).alias("inner"))
    empty = F.expr("cast(array() as array<bigint>)")
    step = links.join(children, ["h", "parent"], "left").select(
        "h", F.col("child").alias("v"), F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("d"),
        (F.array("parent") if with_path else empty).alias("path"), F.col("inner").isNull().alias("at_root"),
    )
    first = cut(step.withColumn("stop", F.col("at_root") | _splitter("h", "ptr")).drop("at_root"))
    walks, _ = _double(first)
    inner = links.select("h", F.col("child").alias("ptr"), F.lit(True).alias("inner"))
    walks = cut(walks.join(inner, ["h", "ptr"], "left").withColumn("at_root", F.col("stop") & F.col("inner").isNull()).drop("inner"))
    # the reduced graph: splitters with a parent; a walk that never ends makes a self-loop, which nothing ends
    reduced = walks.where(_splitter("h", "v")).select("h", "v", F.when(F.col("stop"), F.col("ptr")).otherwise(F.col("v")).alias("ptr"), "d", F.when(F.col("stop"), F.col("path")).otherwise(empty).alias("path"), F.col("at_root").alias("stop"))
    solved, _ = _double(cut(reduced))
    top = solved.where("stop").select("h", F.col("v").alias("ptr"), F.col("ptr").alias("top"), F.col("d").alias("td"), F.col("path").alias("tpath"))
    done = walks.join(top, ["h", "ptr"], "left")
    good = F.col("at_root") | (F.col("stop") & F.col("top").isNotNull())
    return done.select(
        "h", "v",
        F.when(F.col("at_root"), F.col("ptr")).when(good, F.col("top")).otherwise(F.lit(-1)).cast("long").alias("root"),
        F.when(F.col("at_root"), F.col("d")).when(good, F.col("d") + F.col("td")).otherwise(F.lit(-1)).cast("long").alias("depth"),
        F.when(F.col("at_root"), F.col("path")).when(good, F.concat("path", "tpath")).alias("path"),
    )


def cycles(links: DataFrame, solved: DataFrame) -> DataFrame:
    """Of the nodes without a root: (h, v, cycle, on_cycle); `cycle` is the smallest id on the cycle entered."""
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("h", "child").agg(F.min("parent").alias("parent"))
    lost = solved.where("root = -1").select("h", "v")
    jump = cut(links.withColumnRenamed("child", "v").join(lost, ["h", "v"], "left_semi").select("h", "v", F.col("parent").alias("ptr"), F.least("v", "parent").alias("low")))
    total, hops = jump.count(), 1
    while hops < total:  # after as many hops as there are nodes, every pointer is on its cycle
        by = jump.select("h", F.col("v").alias("ptr"), F.col("ptr").alias("nptr"), F.col("low").alias("nlow"))
        jump = cut(jump.join(by, ["h", "ptr"]).select("h", "v", F.col("nptr").alias("ptr"), F.least("low", "nlow").alias("low")))
        hops *= 2
    ring = jump.select("h", F.col("ptr").alias("v")).distinct()
    labels = jump.join(ring, ["h", "v"]).select("h", F.col("v").alias("ptr"), F.col("low").alias("cycle"))
    return jump.join(labels, ["h", "ptr"]).join(ring.withColumn("on_cycle", F.lit(True)), ["h", "v"], "left").select("h", "v", "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def descendants(solved: DataFrame) -> DataFrame:
    """Pairs (h, ancestor, descendant, distance) of a solution with paths; nothing is gathered per ancestor."""
    return solved.where("root <> -1").select("h", F.col("v").alias("descendant"), F.posexplode("path").alias("pos", "ancestor")).select("h", "ancestor", "descendant", (F.col("pos") + 1).cast("long").alias("distance"))


def spare_links(links: DataFrame) -> DataFrame:
    """Distinct links (h, child, parent) that `solve` leaves out, since the child has a smaller parent."""
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("h", "child", "parent").distinct()
    first = links.groupBy("h", "child").agg(F.min("parent").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return links.join(first, ["h", "child"]).where("parent <> first").select("h", "child", "parent")


def clean_parent(name: Column) -> Column:
    """The name of an enclosing class out of its spellings: blanks, `$` between classes, a one-element tuple; null if absent."""
    bare = F.regexp_replace(name, r"[\s ]+", "")
    bare = F.regexp_replace(bare, r"^\(?['\"]?|['\"]?,?\)?$", "")
    bare = F.regexp_replace(bare, r"[$/]", ".")
    return F.when(F.lower(bare).isin("", "none", "null", "nan"), None).otherwise(bare)


def nesting_links(class_contexts: DataFrame) -> DataFrame:
    """Links (h='nesting', child, parent) between ctx_ids: latest row per ctx_id, parents by name in project and branch.

    Of several rows of one class the smallest ctx_id is the parent. Names are unique per project and branch in
    practice; a repeated one is aggregated before the join, so no key multiplies.
    """
    last = class_contexts.where(F.col("ctx_id").isNotNull()).groupBy("ctx_id").agg(
        F.max_by(F.struct("project_id", "branch", "full_class_name", "parent_class"), F.struct("loaded_at", F.xxhash64("project_id", "branch", "full_class_name", "parent_class"))).alias("r")
    ).select("ctx_id", F.coalesce("r.project_id", F.lit("\u0002")).alias("project_id"), F.coalesce("r.branch", F.lit("\u0002")).alias("branch"), clean_parent(F.col("r.full_class_name")).alias("name"), clean_parent(F.col("r.parent_class")).alias("parent_name"))
    rows = last.where(F.col("name").isNotNull()).groupBy("project_id", "branch", F.col("name").alias("parent_name")).agg(F.min("ctx_id").alias("parent"))
    return last.where(F.col("parent_name").isNotNull()).join(rows, ["project_id", "branch", "parent_name"]).select(F.lit("nesting").alias("h"), F.col("ctx_id").alias("child"), "parent")


def inheritance_links(relationships: DataFrame, nodes: DataFrame, framework_nodes: DataFrame) -> DataFrame:
    """Links (h='inheritance', child, parent) between node ids: relationships that say EXTEND, whose parent has a row."""
    says = F.upper(F.regexp_replace("type", r"[^A-Za-z]", "")).isin("EXTEND", "EXTENDS")
    links = relationships.where(says & F.col("start_node").isNotNull() & F.col("end_node").isNotNull()).select(F.col("start_node").alias("child"), F.col("end_node").alias("parent")).distinct()
    there = nodes.select(F.col("id").alias("parent")).unionByName(framework_nodes.select(F.col("node_id").alias("parent"))).distinct()
    return links.join(there, "parent", "left_semi").select(F.lit("inheritance").alias("h"), "child", "parent")
