"""What was added, removed or changed between full snapshots.

Rows of a snapshot are sorted by key within hash buckets of the key (the order is the same in every snapshot) and cut
into chunks where the key's own content says so, hence at the same keys in every snapshot that holds them. Chunks whose digest equals
that of the snapshot before are discarded; rows of the rest are joined by key and classified.

Nulls: absent key fields are ''; a null hash is a value of its own. Rows repeated inside a delivery count once; of
several hashes of one key in a delivery the largest counts. Deliveries superseded or not in the log don't count. A
snapshot in the log without rows is empty: it removes everything. The first snapshot of a project gives no case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000
CHUNK_ROWS = 64
KEY = ("branch", "pull_request_id", "class_name", "method_name")


def current_deliveries(log: DataFrame) -> DataFrame:
    """(project_id, snap_no, delivery_no, prev_snap, next_snap) of the deliveries that count. The log is a fixed, small table."""
    kept = log.where(F.col("snap_no").isNotNull()).groupBy("project_id", "snap_no").agg(F.max("delivery_no").alias("delivery_no"))
    order = Window.partitionBy("project_id").orderBy("snap_no")
    return kept.withColumn("prev_snap", F.lag("snap_no").over(order)).withColumn("next_snap", F.lead("snap_no").over(order))


def _digest(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *KEY, F.coalesce("hash", F.lit("\u0002")))


def changes(snapshots: DataFrame, log: DataFrame, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(snap_no, project_id, branch, pull_request_id, class_name, method_name, change) against the snapshot before.

    One shuffle, by (project, hash bucket of the key): duplicates, chunks, digests and the join all reuse it. A project
    has as many buckets as its rows fill at `bucket_rows` each, so that one with most of the rows is spread over many
    tasks and a small one isn't cut to pieces. Projects are counted before, one row each, as many as the log has at most.
    """
    sizes = snapshots.groupBy("project_id").agg((F.floor(F.count(F.lit(1)) / bucket_rows) + 1).alias("buckets"))
    keep = current_deliveries(log).where(F.col("prev_snap").isNotNull() | F.col("next_snap").isNotNull()).join(sizes, "project_id")
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY]
    rows = snapshots.select("project_id", "snap_no", "delivery_no", *fields, F.lower("ast_hash").alias("hash"))
    rows = rows.join(F.broadcast(keep), ["project_id", "snap_no", "delivery_no"]).drop("delivery_no")  # the log's rows, a fixed table
    rows = rows.withColumn("project_id", F.coalesce("project_id", F.lit(""))).withColumn("kh", F.xxhash64("project_id", *KEY))
    rows = rows.withColumn("bucket", F.pmod("kh", "buckets")).repartition("project_id", "bucket")
    rows = rows.groupBy("project_id", "bucket", "snap_no", "prev_snap", "next_snap", "kh", *KEY).agg(F.max("hash").alias("hash"))
    # the same row is the new side against the snapshot before and the old side of the one after
    new = F.when(F.col("prev_snap").isNotNull(), F.struct(F.col("snap_no").alias("pair"), F.lit(True).alias("new")))
    old = F.when(F.col("next_snap").isNotNull(), F.struct(F.col("next_snap").alias("pair"), F.lit(False).alias("new")))
    sides = rows.select("project_id", "bucket", "kh", *KEY, "hash", F.explode(F.filter(F.array(new, old), lambda x: x.isNotNull())).alias("s")).select("project_id", "bucket", "kh", *KEY, "hash", "s.pair", "s.new")
    ordered = Window.partitionBy("project_id", "bucket", "pair").orderBy(*KEY).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.pmod(F.shiftright("kh", 17), F.lit(chunk_rows)) == 0, F.struct(*KEY))
    chunked = sides.withColumn("chunk", F.last(edge, ignorenulls=True).over(ordered))
    chunk = Window.partitionBy("project_id", "bucket", "pair", "chunk")
    side = lambda new, seed: F.bit_xor(F.when(F.col("new") == F.lit(new), _digest(seed)).otherwise(F.lit(0).cast("long"))).over(chunk)
    same = (side(True, 1) == side(False, 1)) & (side(True, 2) == side(False, 2)) & (F.sum(F.when(F.col("new"), 1).otherwise(-1)).over(chunk) == 0)
    open_rows = chunked.withColumn("same", same).where(~F.col("same"))
    by_key = open_rows.groupBy("project_id", "bucket", "pair", *KEY).agg(
        F.max("new").alias("has_new"), F.min("new").alias("all_new"),
        F.max(F.when(F.col("new"), F.struct("hash"))).alias("n"), F.max(F.when(~F.col("new"), F.struct("hash"))).alias("o"),
    )
    change = F.when(F.col("all_new"), "added").when(~F.col("has_new"), "removed").when(~F.col("n.hash").eqNullSafe(F.col("o.hash")), "changed")
    return by_key.withColumn("change", change).where(F.col("change").isNotNull()).select(F.col("pair").alias("snap_no"), "project_id", *KEY, "change")
