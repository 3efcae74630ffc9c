"""Near-duplicates against brute force, with hot buckets forced."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from codestrata.llm import nearduplicates as nd


def grams(text):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def brute(rows):
    seen = {i: g for i, t in rows if i is not None and (g := grams(t))}
    return {(a, b) for a, b in itertools.combinations(sorted(seen), 2) if 10 * len(seen[a] & seen[b]) >= 6 * len(seen[a] | seen[b])}


def corpus():
    random.seed(7)
    words = [f"w{k}" for k in range(900)]
    common = [f"c{k}" for k in range(30)]
    rows = [(1, None), (2, ""), (3, "few words only"), (None, " ".join(words[:50]))]
    for k in range(60):
        base = common + random.sample(words, 60)
        for j in range(4):
            edited = [random.choice(words) if random.random() < 0.03 * j else w for w in base]
            if j == 3:
                edited = edited[20:] + edited[:20]
            rows.append((100 + 10 * k + j, " ".join(edited).upper() if j == 1 else "; ".join(edited)))
    rows += [(5000 + k, " ".join(words[:40])) for k in range(30)]  # a group of copies
    rows.append((9000, " ".join(random.choice(words) for _ in range(30_000))))
    rows += rows[5:8]
    return rows


@pytest.mark.parametrize("bucket,heavy", [(64, 500), (2, 500), (2, 1), (64, 1)])
def test_pairs_and_groups(spark, monkeypatch, bucket, heavy):
    monkeypatch.setattr(nd, "SAMPLE", nd.SAMPLE if heavy > 1 else 2)
    rows = corpus()
    records = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, content string, d1 int")
    members, pairs = nd.near_duplicates(records, bucket=bucket, heavy=heavy)
    got = [tuple(r) for r in nd.record_pairs(members, pairs).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in want:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert {r.id: r.group_id for r in nd.groups(members, pairs).collect()} == {x: find(x) for x in root}


def _batches(rows, size):
    import pyarrow as pa

    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([c for _, c in part], pa.int64())], names=["key", "d1"])


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_of_keys(size):
    rows = sorted([(-1, 5), (-1, 6), (-1, 7), (-1, 8), (2, 1), (2, 1), (2, 9), (3, 4)] + [(9, k) for k in range(50)] + [(10, 1), (10, 2)])
    out = [tuple(r.values()) for b in nd._pairs_of_runs(_batches(rows, size), 3) for r in b.to_pylist()]
    assert {p for p in out if p[1] is not None} == {(1, 9), (1, 2)}
    assert {a for a, b in out if b is None} == {5, 6, 7, 8} | set(range(50))


def test_a_band_with_most_classes(spark):
    """50,000 classes that share a key: each task passes on what it reads and none pairs them."""
    random.seed(9)
    heads = spark.range(50_000).selectExpr("id as d1", "id")
    common = " ".join(f"c{k}" for k in range(9))
    text = spark.range(50_000).selectExpr("id", f"concat('{common} ', array_join(transform(sequence(1, 30), k -> concat('x', id div 2, '_', k)), ' ')) as content")
    got = nd._prefix_pairs(heads.select("d1"), heads, text, 0.6, 20, 64)
    assert got.count() == 25_000 and got.where("b = a + 1 and a % 2 = 0").count() == 25_000


def test_classes_with_one_digest(spark, monkeypatch):
    rows = corpus()
    plain = nd.sign
    monkeypatch.setattr(nd, "sign", lambda records, least: plain(records, least).withColumn("d1", F.lit(7).cast("long") + F.pmod("d1", F.lit(5))))
    members, pairs = nd.near_duplicates(spark.createDataFrame(rows, "id long, content string"))
    assert {tuple(r) for r in nd.record_pairs(members, pairs).collect()} == brute(rows)


def test_nothing(spark):
    members, pairs = nd.near_duplicates(spark.createDataFrame([], "id long, content string"))
    assert nd.record_pairs(members, pairs).count() == 0 and nd.groups(members, pairs).count() == 0


def test_bounds_grow_with_evidence():
    bounds = nd.least_matches(0.6, 0.0005)
    assert [n for n, _ in bounds] == [32, 64, 96, 128]
    assert all(m / n < 0.6 for n, m in bounds) and all(a[1] / a[0] < b[1] / b[0] for a, b in zip(bounds, bounds[1:]))


def test_blocked_pairs(spark):
    rows = [("g", k) for k in range(40)] + [("h", 1)] + [("g", 3)]
    out = nd.blocked_pairs(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", block=4)
    assert sorted((r.a, r.b) for r in out.collect()) == sorted(itertools.combinations(range(40), 2))
