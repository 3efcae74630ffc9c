"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.02) -> list:
    """Values of `key` that hold more than `share` of the rows: at most 1/share of them, so the list is bounded.

    Counts are combined before the shuffle. Null keys never match and are left out. An empty table gives [].
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = counts.join(F.broadcast(total), F.col("n") > F.greatest(F.col("total") * share, F.lit(1000.0))).select(key)
    return [r[0] for r in rows.collect()]


def spread(left: DataFrame, right: DataFrame, key: str, hot: list, ways: int = 16) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `salt`: rows of hot keys are spread `ways` ways on the left and repeated on the right.

    Joining on (key, salt) gives what joining on key gives. Only the rows of hot keys are repeated, so the right
    side grows by at most `ways` times the rows it has of those (at most 1/share) keys.
    """
    if not hot:
        return left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    is_hot = F.col(key).isin(hot)
    left = left.withColumn("salt", F.when(is_hot, F.pmod(F.hash(*[F.col(c) for c in left.columns]), F.lit(ways))).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return left, right.withColumn("salt", F.explode(salts))
