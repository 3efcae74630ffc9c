"""Near-duplicate records: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Each text becomes its set of runs of three consecutive words. Equal sets form a class, known by a digest; a class is
compared once, however many records it has. Classes that share a band of their MinHash signature are candidates.
Signature batches of a candidate are compared one after another, and it is dropped as soon as the posterior
probability of its reaching the threshold falls under `miss`; the similarity of those left is computed from the texts.

A candidate of similarity J is missed by the bands with probability (1 - J^ROWS)^BANDS, 0.06 % at the threshold 0.6.
Buckets with more than BUCKET classes aren't paired but split by an exact prefix filter over the sets of their
classes, so no bucket is capped and none is paired in one task; the largest are told by a sample of the classes before
they are shuffled, the others while they stream by. Both ways give the same pairs.

Nulls and texts of fewer than `least` words have no partners; a row with a null id is left out. Repeated rows of one id
count once. Texts are whole, of any length. Other columns pass unused. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

ROWS, BANDS = 4, 54
COMPARED, BATCH = 128, 32  # values of a signature that are kept for comparison (8 bits of each), and of one batch
BUCKET = 64
SAMPLE, HEAVY = 64, 500  # one class in SAMPLE is counted; a key with HEAVY of those is kept out of the shuffle
RUN, LEAST_WORDS, THRESHOLD, MISS = 3, 20, 0.6, 0.0005
_WORDS = re.compile("[a-z0-9_]+").findall
_MASK = (1 << 64) - 1


def _odd(seed: int) -> int:
    return xxhash.xxh64_intdigest(str(seed).encode(), seed=7) | 1


_A = np.array([_odd(k) for k in range(ROWS * BANDS)], dtype=np.uint64)
_B = np.array([_odd(k + 1000) for k in range(ROWS * BANDS)], dtype=np.uint64)
_C = [np.uint64(_odd(k + 5000)) for k in range(8)]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def run_set(text: str | None, hashes: dict, least: int = LEAST_WORDS) -> np.ndarray | None:
    """Sorted hashes of the distinct runs of three words; None for fewer than `least` words."""
    if not text:
        return None
    words = _WORDS(text.lower())
    if len(words) < max(least, RUN):
        return None
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    x = w[:-2] * _C[0] + (w[1:-1] ^ (w[1:-1] >> np.uint64(29))) * _C[1] + (w[2:] ^ (w[2:] >> np.uint64(31))) * _C[2]
    x ^= x >> np.uint64(32)
    x *= _C[3]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _signed(x: np.ndarray | int) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x ROWS*BANDS, 32 bits each)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((ROWS * BANDS, len(sets)), dtype=np.uint32)
    for k in range(ROWS * BANDS):
        out[k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out.T


def sign(records: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, d1, d2, bands, sig) of records (id, content) with enough words.

    bands and sig are null on later records of a class within a task, which combines copies before any shuffle.
    """
    schema = "id long, d1 long, d2 long, bands array<int>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            ids, contents = batch.column("id"), batch.column("content")
            for at in range(0, len(ids), 512):
                chosen, sets = [], []
                for k in range(at, min(at + 512, len(ids))):
                    s = run_set(contents[k].as_py(), hashes, least)
                    if s is not None:
                        chosen.append(ids[k].as_py())
                        sets.append(s)
                if not sets:
                    continue
                d1 = [int((s ^ (s >> np.uint64(30))).sum(dtype=np.uint64)) * int(_C[4]) & _MASK for s in sets]
                d2 = [int(((s * _C[5]) >> np.uint64(7)).sum(dtype=np.uint64) ^ np.uint64(len(s))) for s in sets]
                fresh = []
                for k, key in enumerate(zip(d1, d2)):
                    if key not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(key)
                        fresh.append(k)
                bands: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if fresh:
                    values = _signatures([sets[k] for k in fresh])
                    parts = values.reshape(len(fresh), BANDS, ROWS).astype(np.uint64)
                    mixed = parts[:, :, 0] * _C[0] ^ parts[:, :, 1] * _C[1] ^ parts[:, :, 2] * _C[2] ^ parts[:, :, 3] * _C[3]
                    keys = ((mixed * _C[6]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    short = (values[:, :COMPARED] & 255).astype(np.uint8)
                    for n, k in enumerate(fresh):
                        bands[k], sigs[k] = keys[n], short[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen, pa.int64()), pa.array(_signed(d1)), pa.array(_signed(d2)), pa.array(bands, pa.list_(pa.int32())), pa.array(sigs, pa.binary())],
                    names=["id", "d1", "d2", "bands", "sig"],
                )

    return records.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content").mapInArrow(run, schema)


def _pairs_of_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: pairs (a, b) of runs of at most `limit` distinct classes; (a, null) for each of longer ones.

    A run that goes on into the next batch is carried along only up to the limit; beyond it its rows pass by.
    """
    carry_key, carry, long_key = np.empty(0, np.int64), np.empty(0, np.int64), None

    def record(a: list[np.ndarray], b: list[np.ndarray], single: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, y in zip(a, b):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        for x in single:
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64())], names=["a", "b"])

    def emit(keys: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(edges)
        a, b, single = [], [], []
        for k in np.flatnonzero(sizes > 1):
            members = classes[edges[k] : edges[k + 1]]
            if sizes[k] <= limit:
                i, j = np.triu_indices(len(members), 1)
                a.append(members[i])
                b.append(members[j])
            else:
                single.append(members)
        yield from record([np.concatenate(a)] if a else [], [np.concatenate(b)] if b else [], single)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([carry_key, batch.column(0).to_numpy(zero_copy_only=False)])
        classes = np.concatenate([carry, batch.column(1).to_numpy(zero_copy_only=False)])
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[keep], classes[keep]
        if long_key is not None:
            end = int(np.searchsorted(keys, long_key, "right"))
            yield from record([], [], [classes[:end]])
            keys, classes = keys[end:], classes[end:]
            if len(keys):
                long_key = None
            carry_key, carry = keys, classes
            if not len(keys):
                continue
        cutoff = int(np.searchsorted(keys, keys[-1]))
        if len(keys) - cutoff > limit:
            long_key = keys[-1]
            yield from record([], [], [classes[cutoff:]])
            carry_key, carry = keys[:0], classes[:0]
        else:
            carry_key, carry = keys[cutoff:], classes[cutoff:]
        yield from emit(keys[:cutoff], classes[:cutoff])
    yield from emit(carry_key, carry)


def blocked_pairs(members: DataFrame, group: list[str], item: str, block: int = 256, keep: list[str] | None = None, fits: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs (group..., a, b), a < b, of each group's distinct items, by blocks of about `block` of them.

    A group is cut into hash blocks and pairs of blocks are joined, so that even a group with most of the rows is
    spread over tasks of at most block^2 pairs. Groups of one item give nothing. `fits` may tell by the columns `keep`
    of both sides, named with the prefixes it is given, which pairs are wanted; others don't leave the join.
    """
    keep = keep or []
    members = members.select(*group, item, *keep).distinct()
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = members.join(sizes, group).withColumn("at", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    low = placed.select(*group, F.col(item).alias("a"), *[F.col(c).alias(f"a_{c}") for c in keep], F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    high = placed.select(*group, F.col(item).alias("b"), *[F.col(c).alias(f"b_{c}") for c in keep], F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), "at")).alias("i"))
    pairs = low.join(high, [*group, "i", "j"]).where((F.col("i") != F.col("j")) | (F.col("a") < F.col("b")))
    if fits:
        pairs = pairs.where(fits("a_", "b_"))
    return pairs.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _prefix_pairs(hot: DataFrame, heads: DataFrame, records: DataFrame, threshold: float, least: int, limit: int) -> DataFrame:
    """Candidate pairs among the classes (d1) of hot buckets, exactly.

    Runs are ordered by how many of these classes have them. Classes that share none of their rarest runs can't reach
    the threshold, nor can those whose sizes differ too much or that have too few runs left behind the first shared one.
    """
    first = heads.join(hot.distinct(), "d1", "left_semi").select("d1", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [run_set(c.as_py(), hashes, least) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("d1"), pa.array([None if s is None else _signed(s) for s in sets], pa.list_(pa.int64()))], names=["d1", "runs"])

    runs = first.join(records.groupBy("id").agg(F.max("content").alias("content")), "id").select("d1", "content").mapInArrow(run, "d1 long, runs array<long>")
    tokens = cut(runs.select("d1", F.size("runs").alias("size"), F.explode("runs").alias("token")))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("d1").orderBy("df", "token")
    ranked = tokens.join(common, "token").withColumn("rank", F.row_number().over(rarest))
    prefix = ranked.where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1) & (F.col("df") > 1))

    def fits(x: str, y: str) -> Column:
        left, right = F.col(f"{x}size"), F.col(f"{y}size")
        behind = F.least(left - F.col(f"{x}rank"), right - F.col(f"{y}rank")) + 1
        return (F.least(left, right) >= F.greatest(left, right) * threshold - 1e-6) & (behind >= (left + right) * (threshold / (1 + threshold)) - 1e-6)

    return blocked_pairs(prefix, ["token"], "d1", max(limit, 16), ["size", "rank"], fits).select("a", "b").distinct()


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer matches the posterior of reaching the threshold is under `miss`.

    With a uniform prior the collision rate after m of n matches is Beta(m+1, n-m+1), whose tail beyond t is the
    probability that Binomial(n+1, t) is at most m. Eight bits of a value collide by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, COMPARED + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(batches: Iterator[pa.RecordBatch], needed: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(-1, COMPARED)
        right = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(-1, COMPARED)
        alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
        for n, m in needed:
            matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            keep = matches >= m
            alive, matches, done = alive[keep], matches[keep], n
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, least: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        good = []
        for k in range(batch.num_rows):
            a, b = run_set(batch.column("ca")[k].as_py(), hashes, least), run_set(batch.column("cb")[k].as_py(), hashes, least)
            shared = 0 if a is None or b is None else len(np.intersect1d(a, b, assume_unique=True))
            # exact integers: shared / union >= threshold, the threshold taken as a fraction of 10^6
            good.append(shared > 0 and shared * 1_000_000 >= round(threshold * 1_000_000) * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def class_pairs(records: DataFrame, signed: DataFrame, heads: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, least: int = LEAST_WORDS, bucket: int = BUCKET, heavy: int = HEAVY) -> DataFrame:
    """Pairs (a, b) of classes whose similarity is at least the threshold."""
    fresh = signed.where(F.col("bands").isNotNull())
    rows = fresh.select("d1", F.posexplode("bands").alias("band", "value")).select((F.col("value").cast("long") * BANDS + F.col("band")).alias("key"), "d1")
    counted = rows.where(F.pmod(F.xxhash64("d1"), F.lit(SAMPLE)) == 0).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= heavy).select("key")
    large = cut(counted)
    hot = None
    if large.take(1):
        hot = rows.join(large, "key", "left_semi").select("d1").distinct()
        rows = rows.join(large, "key", "left_anti")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "d1")
    found = cut(sorted_rows.mapInArrow(lambda it: _pairs_of_runs(it, bucket), "a long, b long").distinct())
    candidates = found.where(F.col("b").isNotNull())
    single = found.where(F.col("b").isNull()).select(F.col("a").alias("d1"))
    hot = single if hot is None else hot.unionByName(single)
    if hot.take(1):
        candidates = candidates.unionByName(_prefix_pairs(hot, heads, records, threshold, least, bucket)).distinct()
    sigs = fresh.groupBy("d1").agg(F.first("sig").alias("sig"))
    compared = candidates.join(sigs.select(F.col("d1").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("d1").alias("b"), F.col("sig").alias("sb")), "b")
    needed = least_matches(threshold, miss)
    left = cut(compared.select("a", "b", "sa", "sb").mapInArrow(lambda it: _prune(it, needed), "a long, b long"))
    # texts of the survivors' first records only: one row per class and side
    wanted = left.select(F.col("a").alias("d1")).unionByName(left.select(F.col("b").alias("d1"))).distinct()
    first = heads.join(wanted, "d1", "left_semi").select("d1", "id")
    texts = cut(records.select("id", "content").join(first, "id").groupBy("d1").agg(F.max("content").alias("content")))
    both = left.join(texts.select(F.col("d1").alias("a"), F.col("content").alias("ca")), "a").join(texts.select(F.col("d1").alias("b"), F.col("content").alias("cb")), "b")
    return both.select("a", "b", "ca", "cb").mapInArrow(lambda it: _verify(it, threshold, least), "a long, b long")


def _heads(signed: DataFrame) -> DataFrame:
    return cut(signed.groupBy("d1").agg(F.min("id").alias("id"), F.min("d2").alias("low"), F.max("d2").alias("high")))


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, least: int = LEAST_WORDS, bucket: int = BUCKET, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Membership (id, d1) of the classes and the pairs (a, b) of similar classes of records (id, content).

    A class is known by its digest d1; should two classes have one, a second digest keeps them apart.
    """
    records = records.select("id", "content")
    signed = cut(sign(records, least))
    heads = _heads(signed)
    clash = heads.where("low <> high").select("d1", "low")
    if clash.take(1):
        own = F.when(F.col("low").isNotNull() & (F.col("d2") != F.col("low")), F.xxhash64("d1", "d2")).otherwise(F.col("d1"))
        signed = cut(signed.join(clash, "d1", "left").select("id", own.alias("d1"), "d2", "bands", "sig"))
        heads = _heads(signed)
    pairs = cut(class_pairs(records, signed, heads, threshold, miss, least, bucket, heavy))
    return signed.select("id", "d1").distinct(), pairs


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of records: those of similar classes, and those within a class."""
    across = pairs.join(members.select(F.col("d1").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("d1").alias("b"), F.col("id").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = blocked_pairs(members, ["d1"], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return across.unionByName(within).distinct()


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id) of records with a partner: group_id is the smallest id linked through similar pairs.

    Labels of classes sink to the smallest among neighbours and are then followed to their own label, until none moves.
    """
    classes = members.groupBy("d1").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    edges = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(classes.select("d1", F.col("d1").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("d1", "b"), "b").groupBy(F.col("a").alias("d1")).agg(F.min("label").alias("near"))
        sunk = labels.join(near, "d1", "left").select("d1", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = sunk.select(F.col("d1").alias("label"), F.col("label").alias("far"))
        moved = cut(sunk.join(jump, "label").select("d1", "old", F.least("label", "far").alias("label")))
        labels = moved.select("d1", "label")
        if not moved.where("old <> label").take(1):
            break
    lows = classes.join(labels, "d1").groupBy("label").agg(F.min("low").alias("group_id"), F.sum("n").alias("records"))
    return members.select("id", "d1").join(labels, "d1").join(lows.where("records > 1"), "label").select("id", "group_id").distinct()
