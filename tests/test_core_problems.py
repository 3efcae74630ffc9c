"""Orphan references, hierarchies and snapshot changes against brute force, with nulls, repeats, ties and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import hierarchy, references, skew, snapshots

T = lambda d: dt.datetime(2025, 1, d)
RELS = "id long, type string, start_node long, end_node long, recorded_at timestamp, k string, extra int"
DEPS = "dep_id long, project_id string, method_calls array<string>, used_types array<string>, recorded_at timestamp, name string"
NODES = "id long, project_id string, class_name string, method_name string, created_at timestamp, born string, k int"
TOMBS = "node_id long, deleted_at timestamp, died int"
FRAME = "node_id long, class_name string, method_name string"


def orphans(spark, rels=(), deps=(), nodes=(), tombs=(), frame=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = references.orphan_references(make(rels, RELS), make(deps, DEPS), make(nodes, NODES), make(tombs, TOMBS), make(frame, FRAME))
    return sorted((r.field_name, r.row_id, r.target) for r in out.collect())


def test_orphans_of_ids(spark):
    nodes = [(k, "1", f"a.C{k}", None, T(5), None, None) for k in (1, 2, 3, 10, 11)] + [(None, "1", "a.N", None, T(5), None, None)]
    rels = [(k, "CALL", 1, end, when, None, None) for k, (end, when) in enumerate([(1, T(6)), (1, T(4)), (4, T(6)), (9, T(6)), (11, T(6)), (12, T(6)), (2, T(8)), (2, T(7)), (2, T(6)), (None, T(6)), (99, T(1)), (3, None)])]
    rels.append(rels[2])
    found = orphans(spark, rels, nodes=nodes, tombs=[(2, T(7), 0), (2, T(9), 0), (None, T(1), 0), (3, None, 0)], frame=[(99, "f.F", None)])
    assert found == [("end_node", k, t) for k, t in ((1, "1"), (2, "4"), (3, "9"), (5, "12"), (6, "2"), (7, "2"), (11, "3"))]


def test_orphans_of_names(spark):
    nodes = [(1, "1", "a.C", None, T(1), None, None), (2, "1", "a.C", "a.C.m(int, String)", T(1), None, None), (3, "2", "a.D", None, T(1), None, None)]
    deps = [(1, "1", [" a.C.m(int,String)", "a.C.x()", None, ""], ["a.C<T>", "a.C[]", "a.D", "java.util.List<a.D>", "int", None, " ", "f.F"], T(2), None), (2, "1", None, None, T(2), None), (3, None, ["a.C.m(int,String)"], [], T(2), None)]
    found = orphans(spark, deps=deps + deps[:1], nodes=nodes, frame=[(9, "f.F", "f.F.g()")])
    assert found == [("method_calls", 1, "a.C.x()"), ("method_calls", 3, "a.C.m(int,String)"), ("used_types", 1, "a.D")]


def test_orphans_of_empty_tables(spark):
    assert orphans(spark) == []
    assert orphans(spark, rels=[(1, "CALL", 1, 7, T(1), None, None)]) == [("end_node", 1, "7")]


@pytest.mark.parametrize("named", [False, True])
def test_line_against_lives_with_hot_keys(spark, named):
    random.seed(3)
    at = lambda k: None if k is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=k)
    key = (lambda k: f"n{k}") if named else (lambda k: k)
    parents = [(random.choice((random.randrange(-9000, 9000), random.randrange(100, 160))), random.randrange(90), random.choice((None, 20, 40, 60, 80))) for _ in range(600)] + [(150, 30, 50), (150, 45, 70), (None, 1, None), (7, None, None)]
    asked = [(random.choice((random.choice(parents)[0] or 0, random.randrange(90, 170))) + random.choice((0, 0, 1)), random.choice((None, *range(100)))) for _ in range(900)] + [(150, k % 100) for k in range(3000)] + [(-20_000, 5)] * 2000
    make = lambda rows, schema: spark.createDataFrame([(None if k is None else key(k), *map(at, rest)) for k, *rest in rows], f"key {'string' if named else 'long'}, {schema}")
    refs = make(asked, "at timestamp").withColumn("row_id", F.monotonically_increasing_id())
    spans = references.lives(make(parents, "born timestamp, died timestamp"))
    assert sorted(skew.hot_keys(refs, "key"), key=str) == sorted((key(150), key(-20_000)), key=str)
    line = references.on_line(refs, spans, 3 if named else None)
    assert line.where("asks").count() == len(asked)
    live = lambda k, t: t is not None and any(p == k and b is not None and b <= t and (d is None or d > t) for p, b, d in parents)
    want = sorted((str(key(k)), str(at(t))) for k, t in asked if not live(k, t))
    assert sorted((str(r.key), str(r.at)) for r in references.beyond_runs(line).collect()) == want


def test_spread_keeps_rows(spark):
    left = spark.createDataFrame([(1, k) for k in range(3000)] + [(2, 0), (3, 0)], "k long, n int")
    right = spark.createDataFrame([(1,), (3,)], "k long")
    a, b = skew.spread(left, right, "k", skew.hot_keys(left, "k"))
    assert a.join(b, ["k", "salt"]).count() == 3001


def walk(parent, v):
    seen, at, path = {v}, v, []
    while at in parent:
        at = parent[at]
        path.append(at)
        if at in seen:
            return -1, -1, None
        seen.add(at)
    return at, len(path), path


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_walking(spark, seed):
    random.seed(seed)
    parent = {v: random.randrange(max(0, v - 3), v) for v in range(1, 150)}
    parent |= {v: v - 1 for v in range(1001, 1090)}  # a deep chain
    parent |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 2004: 2003, 3000: 3000}
    rows = [("x", c, p) for c, p in parent.items()] + [("x", 5, parent[5]), ("x", None, 1), ("x", 1, None), ("y", 7, 8)]
    links = spark.createDataFrame(rows, "h string, child long, parent long")
    solved = hierarchy.solve(links, with_path=True)
    got = {(r.h, r.v): (r.root, r.depth, r.path) for r in solved.collect()}
    assert got == {("x", v): walk(parent, v) for v in parent} | {("y", 7): (8, 1, [8])}
    named = {r.v: (r.cycle, r.on_cycle) for r in hierarchy.cycles(links, solved).collect()}
    assert named == {2000: (2000, True), 2001: (2000, True), 2002: (2000, True), 2003: (2000, False), 2004: (2000, False), 3000: (3000, True)}
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(solved).where("h = 'x'").collect()}
    assert pairs == {(a, v, k + 1) for v in parent for k, a in enumerate(walk(parent, v)[2] or [])}


def test_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "h string, child long, parent long")
    assert hierarchy.solve(empty).count() == 0
    assert hierarchy.cycles(empty, hierarchy.solve(empty)).count() == 0


def test_spare_links(spark):
    links = spark.createDataFrame([("x", 1, 5), ("x", 1, 3), ("x", 1, 3), ("x", 2, 9), ("y", 1, 7), ("x", 1, None), ("x", None, 1)], "h string, child long, parent long")
    assert [tuple(r) for r in hierarchy.spare_links(links).collect()] == [("x", 1, 5)]
    assert {(r.h, r.v, r.root) for r in hierarchy.solve(links).collect()} == {("x", 1, 3), ("x", 2, 9), ("y", 1, 7)}


def test_parent_spellings(spark):
    names = ["a.B", " a.B ", "('a.B',)", "a$B", "", "(None,)", "None", None, "a.Gone"]
    rows = [(1, "1", "main", "a.B", None, T(1))] + [(k, "1", "main", f"a.B.C{k}", n, T(1)) for k, n in enumerate(names, 2)] + [(2, "1", "main", "a.B.C2", "a.Old", T(0 + 1)), (50, "1", "dev", "a.Z", "a.B", T(1)), (2, "1", "main", "a.B.C2", "a.B", T(9))]
    contexts = spark.createDataFrame(rows, "ctx_id long, project_id string, branch string, full_class_name string, parent_class string, loaded_at timestamp")
    assert sorted((r.child, r.parent) for r in hierarchy.nesting_links(contexts).collect()) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_inheritance_spellings(spark):
    rels = spark.createDataFrame([(k, t, k, e, T(1), None, None) for k, (t, e) in enumerate([(" EXTEND", 1), ("extends ", 2), ("Extend", 7), ("CALL", 1), (None, 1), ("EXTENDS", None)], 10)], RELS)
    nodes = spark.createDataFrame([(1, "1", "a", None, T(1), None, None)], NODES)
    links = hierarchy.inheritance_links(rels, nodes, spark.createDataFrame([(2, "f", None)], FRAME))
    assert sorted((r.child, r.parent) for r in links.collect()) == [(10, 1), (11, 2)]


SNAPS = "snap_no int, delivery_no int, project_id string, branch string, pull_request_id string, class_name string, method_name string, ast_hash string, pair int"


@pytest.mark.parametrize("bucket_rows,chunk", [(100_000, 2), (20, 64)])
def test_changes_against_comparison(spark, bucket_rows, chunk):
    random.seed(5)
    log, rows, states = [], [], {}
    for p in ("1", "2"):
        state = {(f"a.C{k}", None if k % 3 else f"m{k}"): f"H{k}" for k in range(60)}
        for s in (1, 2, 4):
            for key in random.sample(sorted(state, key=str), 6):
                state[key] = random.choice([None, "", "new" + str(s), (state[key] or "x").lower()])
            for key in random.sample(sorted(state, key=str), 3):
                del state[key]
            state[(f"a.N{s}", "")] = "n"
            states[p, s] = {(c, m or ""): None if h is None else h.lower() for (c, m), h in state.items()}
            log += [(p, s, 1), (p, s, 2)]
            rows += [(s, 1, p, "main", None, "a.Faulty", None, "zz", 0)]
            rows += [(s, 2, p, "main", random.choice([None, ""]), c, m, h, 0) for (c, m), h in state.items() for _ in range(random.choice([1, 1, 2]))]
    log += [("1", 5, 1)]  # an empty snapshot
    states["1", 5] = {}
    want = set()
    for p, nos in (("1", (1, 2, 4, 5)), ("2", (1, 2, 4))):
        for a, b in zip(nos, nos[1:]):
            old, new = states[p, a], states[p, b]
            want |= {(b, p, "main", "", *k, "added") for k in new.keys() - old.keys()} | {(b, p, "main", "", *k, "removed") for k in old.keys() - new.keys()}
            want |= {(b, p, "main", "", *k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    out = snapshots.changes(spark.createDataFrame(rows, SNAPS), spark.createDataFrame(log, "project_id string, snap_no int, delivery_no int"), bucket_rows, chunk)
    got = [tuple(r[c] for c in ("snap_no", "project_id", "branch", "pull_request_id", "class_name", "method_name", "change")) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_changes_of_nothing(spark):
    empty = spark.createDataFrame([], SNAPS)
    log = spark.createDataFrame([], "project_id string, snap_no int, delivery_no int")
    assert snapshots.changes(empty, log).count() == 0
