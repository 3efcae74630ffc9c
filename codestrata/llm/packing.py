"""Filling containers of fixed capacity with documents, by best-two-fit.

A bin is filled greedily with the largest documents that still fit; then its smallest document is taken out again if
two unpacked documents fill the wider gap more tightly. A document larger than the capacity is cut into full pieces,
each a bin of its own, and a rest, which is packed like a document; no other is split. Documents without tokens take
no room and go with the bin that is open.

Documents are packed within shards by hash, of about SHARD_DOCUMENTS each at any corpus size, so no task's input grows
with the corpus; the price is one poorly filled bin per shard. Ties go to the smaller doc_id. Repeated rows are items
of their own. Containers without a positive capacity are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_DOCUMENTS = 20_000


class _Pool:
    """Unpacked items by size."""

    def __init__(self, items: list[tuple[int, tuple]]):
        self.by_size: dict[int, list[tuple]] = {}
        for size, item in sorted(items, key=lambda x: (x[0], x[1]), reverse=True):
            self.by_size.setdefault(size, []).append(item)
        self.sizes = sorted(self.by_size)

    def largest(self, room: int) -> int:
        """The largest size that fits into `room`; -1 if none does."""
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else -1

    def take(self, size: int) -> tuple:
        left = self.by_size[size]
        item = left.pop()
        if not left:
            del self.by_size[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return item

    def give(self, size: int, item: tuple) -> None:
        if size not in self.by_size:
            insort(self.sizes, size)
            self.by_size[size] = []
        self.by_size[size].append(item)

    def best_two(self, room: int, least: int) -> tuple[int, int] | None:
        """Sizes of the two items that fill `room` best and more than `least`; None if none do."""
        sizes, best, pair = self.sizes, least, None
        high, low = bisect_right(sizes, room) - 1, 0
        while low <= high:
            a, b = sizes[high], sizes[low]
            if low == high and len(self.by_size[a]) < 2:
                break
            total = a + b
            if total > room:
                high -= 1
                continue
            if total > best:
                best, pair = total, (a, b)
                if total == room:
                    break
            low += 1
        return pair


def pack(items: list[tuple[int, tuple]], capacity: int) -> list[list[tuple[int, tuple]]]:
    """Bins of (size, item); every size is within the capacity."""
    pool, bins = _Pool([x for x in items if x[0]]), []
    empty = [x for x in items if not x[0]]
    while pool.sizes:
        inside, gap = [], capacity
        while gap and (size := pool.largest(gap)) > 0:
            inside.append((size, pool.take(size)))
            gap -= size
        if gap:
            size, item = inside[-1]
            pair = pool.best_two(gap + size, size)
            if pair:
                inside[-1:] = [(s, pool.take(s)) for s in pair]
                pool.give(size, item)
        bins.append(inside)
    if empty:
        if bins:
            bins[-1].extend(empty)
        else:
            bins.append(empty)
    return bins


def fill(sizes: DataFrame, containers: DataFrame, documents: int, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(container, bin_id, doc_id, part_no, tokens) for every document of `sizes` (doc_id, tokens) and every container.

    `containers` (container, capacity) is a fixed table of a few rows; it is broadcast. `documents` is the number of
    rows of `sizes`: the caller counts them before they are encoded.
    """
    n = documents
    shards = max(1, -(-n // shard_documents))
    kinds = containers.where(F.col("capacity") > 0).select("container", F.col("capacity").cast("long")).distinct()
    parts = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)  # packing is work, however small its rows are: shards aren't put together
    items = sizes.select("doc_id", "tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).join(F.broadcast(kinds)).repartition(parts, "container", "capacity", "shard")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity, name, shard = int(group["capacity"].iat[0]), group["container"].iat[0], int(group["shard"].iat[0])
        small, rows, number = [], [], 0
        for row, (doc, tokens) in enumerate(zip(group["doc_id"].tolist(), group["tokens"].tolist())):
            full, rest = divmod(tokens, capacity)
            for part in range(full):
                rows.append((f"{shard}-{number}", doc, part, capacity))
                number += 1
            if rest or not full:
                small.append((rest, (doc, full, row)))
        for inside in pack(small, capacity):
            rows.extend((f"{shard}-{number}", item[0], item[1], size) for size, item in inside)
            number += 1
        out = pd.DataFrame(rows, columns=["bin_id", "doc_id", "part_no", "tokens"])
        out.insert(0, "container", name)
        return out

    return items.groupBy("container", "capacity", "shard").applyInPandas(run, "container string, bin_id string, doc_id long, part_no int, tokens long")


def usage(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: bins, tokens and the share of the bins' room that is used."""
    bins = filled.groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens")).groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    return bins.join(F.broadcast(containers.select("container", "capacity").distinct()), "container").select("container", "capacity", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("used"))
