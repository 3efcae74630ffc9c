"""Stores as immutable snapshot folders with a pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators.importing import Store
from codestrata.schema import NODE, REL


def _current(spark: SparkSession, root: str) -> int:
    try:
        return spark.read.text(f"{root}/current").agg({"value": "max"}).head()[0] or 0
    except Exception as fault:  # no snapshot yet
        if "PATH_NOT_FOUND" in str(fault):
            return 0
        raise


def load(spark: SparkSession, root: str) -> Store:
    """The current snapshot's nodes and edges."""
    version = int(_current(spark, root))
    return Store(spark.read.schema(NODE).parquet(f"{root}/v{version}/nodes"), spark.read.schema(REL).parquet(f"{root}/v{version}/rels"))


def save(spark: SparkSession, store: Store, root: str) -> int:
    """Writes a new snapshot, sorted by project, branch and class, and makes it the current one.

    A branch with most of the rows is split over tasks by size. Of two writers that take one number the later fails, since
    a snapshot's folder is never overwritten.
    """
    version = int(_current(spark, root)) + 1
    nodes: DataFrame = store.nodes.hint("rebalance", "project_id", "branch").sortWithinPartitions("project_id", "branch", "class_name")
    nodes.write.partitionBy("project_id", "branch").parquet(f"{root}/v{version}/nodes")
    store.rels.write.parquet(f"{root}/v{version}/rels")
    spark.createDataFrame([(f"{version:08d}",)], "value string").coalesce(1).write.mode("append").text(f"{root}/current")
    return version
