"""References whose target does not exist at the time of the reference.

Parent keys are integers: node ids, or for names the number of a scoped name among its block's sorted names. Keys with
their lives are points and stretches of one line, ordered by key, then time, and are compressed into runs that lives
cover without a gap. Every reference is a point of the line; it is matched as of the run that starts at or before it and
is an orphan if it lies beyond that run's end, be it that its key is in no run or that the time is before or after the
key's lives. Runs and references of a block of keys meet in one shuffle and one sort; nothing is joined.

Null and empty values: a null or blank target is no reference; a null `recorded_at` is live only for framework
targets, and a null `created_at` never starts a life, as comparisons with null don't hold. Repeated rows give one row.
Empty tables give an empty result (without parents, every reference is an orphan). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.skew import hot_keys, spread

BLOCK_KEYS = 1 << 12  # keys of a block, about: what one sort holds beside the references to them
_BLANKS = " \t\n\x0b\f\r\u00a0"


def without_blanks(name: Column) -> Column:
    """The name with every blank taken out."""
    return F.translate(name, _BLANKS, "")


def type_name(name: Column) -> Column:
    """A type's name without blanks, generic arguments and array brackets."""
    return without_blanks(F.substring_index(F.substring_index(name, "<", 1), "[", 1))


def is_project_type(name: Column) -> Column:
    """Whether the name may be a reference: it has a dot and isn't of the Java library."""
    return name.contains(".") & ~name.startswith("java.") & ~name.startswith("javax.")


def on_line(refs: DataFrame, parents: DataFrame, blocks: int | None = None) -> DataFrame:
    """Points and run stretches of one line: (block, salt, k, t, asks, end, row); a null end is none.

    refs (key, at, ...) ask; parents (key, born, died) are stretches from born to died. Integer keys are their own
    numbers, in blocks of consecutive ones; names are put into `blocks` blocks by hash and numbered there in sorted
    order, known and asked ones together, so that only equal names have one number. References to hot keys are spread
    over salts, which repeat those keys' stretches.
    """
    refs = refs.withColumn("row", F.struct(*refs.columns)).select("key", "at", "row")
    left, right = spread(refs, parents, "key", hot_keys(refs, "key"))
    asks = left.select("key", "salt", F.col("at").alias("t"), F.lit(True).alias("asks"), "row")
    starts = right.where(F.col("key").isNotNull() & F.col("born").isNotNull()).select("key", "salt", F.col("born").alias("t"), F.lit(False).alias("asks"), F.col("died").alias("end"))
    line = starts.unionByName(asks, allowMissingColumns=True)
    if blocks is None:
        return line.withColumn("block", F.floor(F.col("key") / BLOCK_KEYS)).withColumnRenamed("key", "k")
    line = line.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    number = F.dense_rank().over(Window.partitionBy("block", "salt").orderBy("key"))
    # sorted once for the numbers and the runs
    return line.repartition("block", "salt").sortWithinPartitions("block", "salt", "key", "t", "asks").withColumn("k", number)


def beyond_runs(line: DataFrame) -> DataFrame:
    """Rows of a line that ask and lie beyond the end of the run that starts at or before them, or before any.

    Going up the line, the furthest end seen so far, as (key, time), is the end of the run that is open there: a
    stretch that starts within it lengthens it, one that starts beyond it opens the next run.
    """
    upto = Window.partitionBy("block", "salt").orderBy("k", "t", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~F.col("asks"), F.struct("k", F.col("end").isNull().alias("endless"), "end"))).over(upto)
    matched = line.withColumn("reach", reach).where("asks")
    inside = (F.col("reach.k") == F.col("k")) & F.col("t").isNotNull() & (F.col("reach.endless") | (F.col("reach.end") > F.col("t")))
    return matched.where(~F.coalesce(inside, F.lit(False))).select("row.*")


def lives(parents: DataFrame) -> DataFrame:
    """Lives (key, born, died) of parent keys; those with one end are folded into the earliest start, before any shuffle."""
    return parents.groupBy("key", "died").agg(F.min("born").alias("born"))


def orphan_references(relationships: DataFrame, method_deps: DataFrame, nodes: DataFrame, tombstones: DataFrame, framework_nodes: DataFrame) -> DataFrame:
    """Orphans (table_name, field_name, row_id, target, recorded_at) of the code graph's tables, distinct.

    `framework_nodes` is a fixed table of known rows, always live; it alone is broadcast, under the session's limit.
    """
    dead = tombstones.where(F.col("deleted_at").isNotNull() & F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("deleted_at").alias("died"))
    lived = nodes.where(F.col("id").isNotNull()).select("id", "project_id", "class_name", "method_name", F.col("created_at").alias("born")).join(dead, F.col("id") == F.col("node_id"), "left")

    by_id = lived.select(F.col("id").alias("key"), "born", "died")
    links = relationships.where(F.col("end_node").isNotNull()).select(F.col("end_node").alias("key"), F.col("recorded_at").alias("at"), F.col("id").alias("row_id"))
    links = links.join(framework_nodes.select(F.col("node_id").alias("key")).distinct(), "key", "left_anti")
    orphan_links = beyond_runs(on_line(links, by_id)).select(F.lit("relationships").alias("table_name"), F.lit("end_node").alias("field_name"), "row_id", F.col("key").cast("string").alias("target"), F.col("at").alias("recorded_at"))

    def scoped(kind: Column, project: Column, name: Column) -> Column:
        return F.concat_ws("\u0001", kind, project, name)

    method, owner = without_blanks(F.col("method_name")), without_blanks(F.col("class_name"))
    named = lived.where(F.col("project_id").isNotNull()).select(
        F.when(F.col("method_name").isNotNull(), scoped(F.lit("method_calls"), F.col("project_id"), method)).otherwise(scoped(F.lit("used_types"), F.col("project_id"), owner)).alias("key"), "born", "died"
    )
    deps = method_deps.select("dep_id", "project_id", F.col("recorded_at").alias("at"), "method_calls", "used_types")
    each = deps.select(
        "dep_id", "project_id", "at",
        F.explode(F.array(
            F.struct(F.lit("method_calls").alias("field"), F.array_distinct(F.transform("method_calls", without_blanks)).alias("names")),
            F.struct(F.lit("used_types").alias("field"), F.array_distinct(F.filter(F.transform("used_types", type_name), is_project_type)).alias("names")),
        )).alias("part"),
    ).select("dep_id", "project_id", "at", F.col("part.field").alias("field"), F.explode("part.names").alias("target")).where(F.col("target") != "")
    known = framework_nodes.select(F.lit("used_types").alias("field"), owner.alias("target")).unionByName(framework_nodes.select(F.lit("method_calls").alias("field"), method.alias("target"))).where(F.col("target").isNotNull()).distinct()
    asked = each.join(known, ["field", "target"], "left_anti").select(scoped(F.col("field"), F.coalesce(F.col("project_id"), F.lit("\u0002")), F.col("target")).alias("key"), "at", F.col("dep_id").alias("row_id"), "field", "target")
    blocks = nodes.count() // BLOCK_KEYS + int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orphan_names = beyond_runs(on_line(asked, lives(named), blocks)).select(F.lit("method_deps").alias("table_name"), F.col("field").alias("field_name"), "row_id", "target", F.col("at").alias("recorded_at"))
    return orphan_links.unionByName(orphan_names).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month of `recorded_at` (a null time counts as month '')."""
    month = F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit("")).alias("month")
    return found.groupBy("table_name", "field_name", month).agg(F.count(F.lit(1)).alias("orphans"))
