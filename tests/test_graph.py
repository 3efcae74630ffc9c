"""Imports, branches, traversal, extraction and names on small fixtures."""

from pyspark.sql import functions as F

from codestrata.functions import comments, endpoints, filters, names
from codestrata.operators import branches, edges, importing, lookup, nodes, traverse
from tests import fixtures
from codestrata.schema import NODE, REL
from codestrata.sources import files, java_facts, store


def empty_store(spark):
    return importing.Store(spark.createDataFrame([], NODE), spark.createDataFrame([], REL))


def state(s):
    n = {r.node_id: (r.class_name, r.method_name) for r in s.nodes.collect()}
    return sorted(((*n[r.src], r.type, *n[r.dst]) for r in s.rels.collect()), key=str)


OPTIONS = importing.Options(main_branch="main", base_branch="develop")
CALL = ("p.ClassA", "methodA", "CALL", "p.ClassB", "methodB")
USE = ("p.ClassB", "methodB", "USE", "p.ClassC", None)


def test_first_import(spark):
    s = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST))
    assert s.nodes.count() == 5 and CALL in state(s) and USE in state(s)


def test_incremental_keeps_edges_and_simple_loses_them(spark):
    first = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST), OPTIONS)
    second = fixtures.chunks(spark, fixtures.SECOND)
    kept = importing.import_incremental(first, second, OPTIONS)
    assert [e for e in state(kept) if e in (CALL, USE)] == [CALL, USE]
    assert {r.ast_hash for r in kept.nodes.where("method_name = 'methodB'").collect()} == {"mb2"}
    assert CALL not in state(importing.import_simple(first, second, OPTIONS))


def test_save_and_restore(spark):
    s = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST))
    keys = spark.createDataFrame([("1", "develop", "p.ClassB"), ("1", "develop", "p.ClassB.methodB")], "project_id string, branch string, key string")
    saved = branches.save_boundary(s.nodes, s.rels, keys)
    assert [tuple(r)[2:] for r in saved.collect()] == [CALL]
    assert branches.restore_boundary(s.nodes, saved).count() == 1


def test_annotations(spark):
    s = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.ANNOTATED))
    got = state(s)
    for edge in (("p.UserService", None, "USE", "p.Validation", None), ("p.UserService", None, "USE", "p.NotNull", None), ("p.UserService", "createUser", "USE", "p.Validation", None), ("p.Validation", None, "USE", "p.ValidationHandler", None), ("p.Validation", None, "USE", "p.ValidationHandler", "isValid")):
        assert edge in got


def test_empty_import(spark):
    s = importing.import_incremental(empty_store(spark), fixtures.chunks(spark, []), importing.Options(main_branch="main"))
    assert s.nodes.count() == 0 and s.rels.count() == 0


def test_tombstones_and_duplicates(spark):
    gone = spark.createDataFrame([("n", "a.B", None, None, "h", "1", "main"), ("m", "a.B", "m()", "EndpointNode", "h", "1", "main")], "name string, class_name string, method_name string, node_type string, ast_hash string, project_id string, branch string")
    assert sorted((r.label, r.content, r.status) for r in nodes.tombstone_nodes(gone).collect()) == [("ClassNode", "[DELETED] a.B", "DELETED"), ("EndpointNode", "[DELETED] a.B.m()", "DELETED")]
    rels = spark.createDataFrame([(1, 2, "CALL")] * 3 + [(1, 2, "USE")], "src long, dst long, type string")
    assert [tuple(r) for r in edges.duplicate_groups(rels).collect()] == [(1, 2, "CALL", 3)]
    assert edges.merge(rels, rels).count() == 2


def graph(spark):
    n = spark.createDataFrame([(k, "1", "main", f"c{k}", None if k % 2 else f"m{k}", None, f"h{k}") for k in range(1, 8)], "node_id long, project_id string, branch string, class_name string, method_name string, pull_request_id string, ast_hash string")
    r = spark.createDataFrame([(1, 2, "CALL"), (2, 3, "USE"), (3, 1, "CALL"), (5, 3, "IMPLEMENT"), (2, 6, "CALL"), (None, 2, "CALL")], "src long, dst long, type string")
    return n, r


def test_closure_depth_paths_and_cycles(spark):
    n, r = graph(spark)
    seeds = n.where("node_id = 1").select("node_id")
    down = traverse.closure(seeds, r, with_path=True)
    assert {(x.node, x.depth) for x in down.collect()} == {(2, 1), (3, 2), (6, 2), (5, 3)}
    assert [x.node for x in traverse.ordered(down).collect()] == [2, 3, 6, 5]
    assert {(x.node, x.depth) for x in traverse.closure(seeds, r, max_level=1).collect()} == {(2, 1)}
    assert {x.node for x in traverse.closure(seeds, r, min_level=0, max_level=0).collect()} == {1}
    assert {(x.node, x.depth) for x in traverse.closure(seeds, r, traverse.UPSTREAM).collect()} == {(3, 1), (2, 2)}
    assert {r.summary for r in traverse.summary(down).where("node = 5").collect()} == {"CALL:2 USE:3 IMPLEMENT:5"}
    assert {(x.node, x.step, x.visited) for x in traverse.visited(down, n).where("node = 5").collect()} == {(5, 0, 2), (5, 1, 3), (5, 2, 5)}
    assert traverse.closure(n.where("false").select("node_id"), r).count() == 0


def test_branch_copy_and_delete(spark):
    n, r = graph(spark)
    own = spark.createDataFrame([(20, "1", "dev", "c2", "m2", None, "other")], n.schema)
    all_nodes = n.unionByName(own)
    changed = spark.createDataFrame([("1", "c2.m2", "other")], "project_id string, key string, hash string")
    with_main = all_nodes.withColumn("main_branch", F.lit("main")).withColumn("to_branch", F.lit("dev"))
    mapped = branches.mapping(with_main, changed)
    assert mapped.count() == 6
    assert branches.copy_internal(r, mapped).count() == 2
    assert {x.dst for x in branches.copy_cross(r, all_nodes, mapped).collect()} == {20}
    assert {x.src for x in branches.copy_cross(r, all_nodes, mapped, reverse=True).collect()} == {20}
    left, rels, gone = branches.delete_branch(all_nodes, r.where("src is not null"), 1, "dev")
    assert left.count() == 7 and rels.count() == 5 and gone.count() == 1


def test_lookups(spark):
    n, _ = graph(spark)
    specs = spark.createDataFrame([("1", "main", "c2", None, None), ("1", "main", "c4", "m4", None), ("1", "main", "c4", "no", None)], "project_id string, branch string, class_name string, method_name string, pull_request_id string")
    assert sorted(x.node_id for x in lookup.nodes_by_specs(n, specs).collect()) == [2, 4]
    assert lookup.nodes_by_condition(n, 1, "main", method_name="m2").count() == 1


def test_every_extractor_says_nothing_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("", "", "", "", "")], "t string, c string, m string, r string, p string")
    assert [x[0] for x in df.select(endpoints.endpoints(*(F.col(c) for c in "tcmrp"))).collect()] == [[], []]
    found = fixtures.annotations(spark).select("key", F.size(endpoints.endpoints(F.col("text"), F.col("class_text"), F.col("method_text"), F.col("return_type"), F.col("params"))).alias("n"))
    assert {r.key: r.n for r in found.collect() if r.n == 0} == {"hidden": 0, "none": 0}


def test_names(spark):
    df = spark.createDataFrame([("src/main/java/com/x/A.java", "a.b.C", "D", "/v1/", "/x")], "path string, found string, t string, a string, b string")
    row = df.select(names.package_of_path(F.col("path")), names.adjust_name(F.col("found"), F.col("t")), names.merge_paths(F.col("a"), F.col("b")), names.declaring_class(F.lit("public List<X> com.y.Z.run(int a)")), names.normalize_whitespace(F.lit(" f( a ,  Map< K > )"))).head()
    assert tuple(row) == ("com.x.A", "a.b.D", "/v1/x", "com.y.Z", "f(a , Map<K>)")
    kept = spark.range(1).select(filters.project_names(F.array(*[F.lit(x) for x in ("String", "a.B", "java.util.List", None, "a.B", "List<T>")]))).head()[0]
    assert kept == ["a.B"]


COMMENTED = [
    ("a // b\n/* x\ny */ c\nd /* e */ f", "a \n\n c\nd         f"), ("a /* x // y */ b\nc */ d", "a \n d"), ('s = "http://x";', 's = "http:'), ("/**\n * doc\n */ x / y", "\n      \n x / y"), ("a /* b */ c /* d\ne", "a         c \n "), ("a /* b", "a "), ("", ""), ("a/b*c", "a/b*c"), (None, None), ("x" * 50_000 + "// y", "x" * 50_000),
]


def test_comments(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(COMMENTED)], "k int, t string")
    got = {r.k: r.u for r in df.select("k", comments.without_comments(F.col("t")).alias("u")).collect()}
    assert got == {k: b for k, (_, b) in enumerate(COMMENTED)}


def test_marked_lines(spark):
    row = spark.range(1).select(filters.marked_lines(F.lit("a\n@Data\nclass X {\n @Getter int y;"), filters.LOMBOK_MARKERS)).head()
    assert row[0] == [1, 3]


ARGUMENTS = [
    ('@KafkaListener(id = "x", topics = {"a", B.C, \'d\'})', ["a", "B.C", "d"]), ('@KafkaListener(topics = "a")', ["a"]), ("@KafkaListener({T.A, T.B})", ["T.A", "T.B"]), ('@KafkaListener(topicPattern = "a.*", id = "topics = b")', ["PATTERN:a.*"]),
    ('@KafkaListener(groupId = "g")', []), ("@KafkaListener", []), ('@KafkaListener(topics = "a(b)", x = f(1))', ["a(b)"]),
]


def test_places_and_paths(spark):
    row = spark.range(1).select(
        names.relative_path(F.lit("a\\\\b\\\\C.java".replace("\\\\", "\\")), "a/b"), names.relative_path(F.lit("x/C.java"), "a"), names.as_list(F.lit(None).cast("string")), names.as_list(F.lit("x")),
        names.hover_text(F.lit('{"contents": {"value": "v"}}')), names.hover_text(F.lit('{"contents": [{"value": "w"}]}')), names.hover_text(F.lit('{"contents": "u"}')), names.hover_text(F.lit("{}")),
        names.after_insert(F.lit(3), F.lit(4), F.lit("ab")), names.after_insert(F.lit(3), F.lit(4), F.lit("a\nbc")),
    ).head()
    assert list(row)[:8] == ["C.java", None, [], ["x"], "v", "w", "u", None] and tuple(row[8]) == (3, 6) and tuple(row[9]) == (4, 2)


def test_arguments_of_listeners(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(ARGUMENTS)], "k int, t string")
    got = {r.k: [e.consumes for e in r.e] for r in df.select("k", endpoints.kafka(F.col("t")).alias("e")).collect()}
    assert got == {k: b for k, (_, b) in enumerate(ARGUMENTS)}


JAVA = """package p.q;
import x.Y;
@Service("s") public abstract class Outer<T extends Y> extends Base<T> implements Runnable, I {
  private final Y y = new Y() { void hidden() {} };
  static { init(); }
  Outer() { super(); }
  @GetMapping("/a") public List<Y> get( int a, String b ) { // comment }
    y.call(a); String s = "}"; return other(new Z()); }
  abstract void later();
  enum E { A(1) { int f() { return 1; } }, B; int g() { return 2; } }
  record R(int a, Y b) { R { check(a); } }
  @interface N { int value() default 1; }
}
"""


def test_java_facts():
    found = {c["full_class_name"]: c for c in java_facts.facts(JAVA)}
    outer = found["p.q.Outer"]
    assert set(found) == {"p.q.Outer", "p.q.Outer.E", "p.q.Outer.R", "p.q.Outer.N"}
    assert [m["signature"] for m in outer["methods"]] == ["get(int a, String b)", "later()"]
    assert outer["supertypes"] == ["Base", "Runnable", "I"] and outer["imports"] == {"Y": "x.Y"} and outer["is_abstract"]
    assert [(c["receiver"], c["name"], c["type"], c["arguments"]) for c in outer["methods"][0]["calls"]] == [("y", "call", "Y", 1), (None, "other", "Outer", 1)] and outer["methods"][1]["is_abstract"]
    assert outer["methods"][0]["used_types"] == ["List", "Y", "String"] and outer["methods"][0]["parameters"] == ["int", "String"] and outer["fields"] == [{"name": "y", "type": "Y"}]
    assert [m["name"] for m in found["p.q.Outer.E"]["methods"]] == ["g"]
    same = java_facts.facts(JAVA.replace("// comment }", "").replace("get(", "fetch("))[0]
    assert same["methods"][0]["shape"] == outer["methods"][0]["shape"]
    assert java_facts.facts("class {{{") == [] and java_facts.facts(None) == [] and java_facts.facts("") == []


SHOP = [
    (1, "package a; public interface Base { int total(Item i); void end(); }"),
    (2, "package a; public class Item { public long id; public long key() { return id; } public long key(int k) { return k; } static Item of() { return null; } }"),
    (3, "package a; public abstract class Half implements Base { public void end() { this.stop(); } void stop() { } }"),
    (4, """package b; import a.Half; import a.Item;
public class Shop extends Half {
  private final Item kept = Item.of();
  // int total(Base b) { }
  public int total(Item i) { long x = i.key(3) + kept.key() + i.id + Other.LIMIT; stop(); Unknown u = null; u.key(); chain().key(); only(); return MAX_VALUE; }
  Item chain() { return kept; }
  class Inner { void in() { kept.key(); } }
}"""),
    (5, "package c; class Other { static int LIMIT; void only() { } void key() { } }"),
]


def test_calls_fields_and_implementations(spark):
    from codestrata.operators import chunks, symbols

    sources = spark.createDataFrame(SHOP, "file_id long, content string").withColumn("file_path", F.concat(F.lit("f"), "file_id"))
    built = {r.full_class_name: r for r in chunks.build(java_facts.extract(sources), 1, "main", sources).collect()}
    shop = {m.name: m for m in built["b.Shop"].methods}["total(Item i)"]
    assert [c.name for c in shop.method_calls] == ["a.Half.stop()", "a.Item.key()", "a.Item.key(int k)", "b.Shop.chain()"]
    assert shop.field_access == ["a.Item.id", "c.Other.LIMIT"] and shop.used_types == ["a.Item"] and shop.body.startswith("long x = i.key(3)")
    assert [c.name for c in built["b.Shop.Inner"].methods[0].method_calls] == ["a.Item.key()"]
    assert built["a.Base"].implements == ["a.Half", "b.Shop"] and built["b.Shop"].file_path == "f4" and built["b.Shop"].content == SHOP[3][1]
    assert {m.name: m.inheritance_info for m in built["a.Base"].methods} == {"total(Item i)": ["b.Shop.total(Item i)"], "end()": ["a.Half.end()"]}
    assert [c.name for c in built["a.Half"].methods[0].method_calls] == ["a.Half.stop()"]
    s = importing.import_simple(empty_store(spark), chunks.build(java_facts.extract(sources), 1, "main", sources))
    got = state(s)
    assert ("b.Shop", "b.Shop.total(Item i)", "IMPLEMENT", "a.Base", "a.Base.total(Item i)") in got and ("b.Shop", None, "IMPLEMENT", "a.Base", None) in got
    body = {r.method_name: r.content for r in s.nodes.collect()}["b.Shop.total(Item i)"]
    assert body.startswith("long x") and body.endswith('["a.Item.id","c.Other.LIMIT"]')
    empty = java_facts.extract(sources.where("false"))
    assert chunks.build(empty, 1, "main").count() == 0 and symbols.supertypes(symbols.implementations(empty, symbols.symbols(empty))).count() == 0


def test_java_facts_of_broken_sources():
    def got(text):
        return {c["full_class_name"]: [m["signature"] for m in c["methods"]] for c in java_facts.facts(text)}

    start = "package p; import a.B; class A { void f() { g(); } "
    assert got(start + "void h(int x) { if (x > 0) { f();") == {"p.A": ["f()", "h(int x)"]}  # cut off in a body
    assert got(start + "void h(int x, ") == {"p.A": ["f()"]} and got(start + "class C { int k() { return 1; } void") == {"p.A": ["f()"], "p.A.C": ["k()"]}
    assert got(start + "void h(int a { f(); } void i() { } }") == {"p.A": ["f()", "i()"]}
    both = got(start + "void h() { if (x) { y(); public void i() { } @N(1) int j() { return 1; } }\nclass D { void k() { } }")
    assert both == {"p.A": ["f()", "h()", "i()", "j()"], "p.D": ["k()"]}
    assert got(start + "} } public void i() { } }") == {"p.A": ["f()", "i()"]}
    assert got(start + "int x = 3 void i() { } }") == {"p.A": ["f()", "i()"]} and got("class A extends B interface C { void f(); }") == {"C": ["f()"]}
    assert got(start + "\n<<<<<<< HEAD\n  void h(int a) {\n=======\n  void h(long a) {\n>>>>>>> other\n    f(); }\n  void i() { new T() { public void run() { } }; }\n}\n") == {"p.A": ["f()", "h(int a)", "h(long a)", "i()"]}
    assert java_facts.facts("import a.B\nclass A { }")[0]["imports"] == {"B": "a.B"}
    for k in range(len(JAVA)):
        java_facts.facts(JAVA[:k]), java_facts.facts(JAVA[k:])


def test_files_and_store(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_bytes("class X { } // \xe9".encode("latin-1"))
    (tmp_path / "a" / "Y.java").write_text("class Y { } // é", encoding="utf-8")
    (tmp_path / "a" / "Z.txt").write_text("no")
    read = files.source_files(spark, str(tmp_path / "a"))
    assert {r.content[-1] for r in read.collect()} == {"é"}
    assert files.only_targets(read, ["a\\X.java"]).count() == 1
    s = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST))
    root = str(tmp_path / "store")
    assert store.save(spark, s, root) == 1
    again = store.load(spark, root)
    assert again.nodes.count() == 5 and state(importing.Store(again.nodes, again.rels)) == state(s)
    assert store.save(spark, again, root) == 2
    files.write_chunks(fixtures.chunks(spark, fixtures.FIRST), str(tmp_path / "chunks"))
    want = sorted(fixtures.chunks(spark, fixtures.FIRST).collect())
    assert sorted(files.read_chunks(spark, str(tmp_path / "chunks")).collect()) == want
    assert files.write_chunk_array(fixtures.chunks(spark, fixtures.FIRST), str(tmp_path / "chunks.json")) == 3
    assert sorted(files.read_chunk_arrays(spark, str(tmp_path / "chunks.json")).collect()) == want
    assert files.write_chunk_array(fixtures.chunks(spark, []), str(tmp_path / "none.json")) == 0 and not (tmp_path / "none.json").exists()


def test_ids_over_imports(spark):
    request = importing.Options(pull_request_id="7")
    twice = importing.import_simple(importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST), request), fixtures.chunks(spark, fixtures.FIRST), request)
    ids = [r.node_id for r in twice.nodes.collect()]
    assert len(ids) == 10 and len(set(ids)) == 10 and min(ids) >= 0
    again = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST))
    assert {r.node_id for r in again.nodes.collect()} == {r.node_id for r in importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST)).nodes.collect()}


def test_every_chunk_has_its_own_base(spark):
    rows = [dict(r, branch=b, methods=[dict(m, branch=b) for m in r["methods"]]) for b in ("develop", "other") for r in fixtures.FIRST]
    s = importing.import_incremental(empty_store(spark), fixtures.chunks(spark, rows), importing.Options(main_branch="main"))
    assert {(r.branch, r.base_branch) for r in s.nodes.collect()} == {("develop", "develop"), ("other", "other")}
    n = {r.node_id: r.branch for r in s.nodes.collect()}
    assert sorted((n[r.src], n[r.dst], r.type) for r in s.rels.collect()) == [(b, b, t) for b in ("develop", "other") for t in ("CALL", "USE")]


def test_copying_and_walking_an_imported_store(spark):
    s = importing.import_simple(empty_store(spark), fixtures.chunks(spark, fixtures.FIRST))
    copied = importing.copy_branch(s, fixtures.chunks(spark, [dict(fixtures.SECOND[0], branch="new")]), "develop", "new")
    assert {r.what: r.rows for r in copied.counts.collect()} == {"copied": 3, "mapped": 3}
    n = {r.node_id: (r.branch, r.class_name, r.method_name) for r in copied.nodes.collect()}
    assert sorted((k[1:] for k in n.values() if k[0] == "new"), key=str) == sorted([("p.ClassA", None), ("p.ClassA", "methodA"), ("p.ClassC", None)], key=str)
    seeds = copied.nodes.where("method_name = 'methodA' and branch = 'develop'").select("node_id")
    found = traverse.closure(seeds, copied.rels, with_path=True).collect()
    assert {(n[r.node][1], r.depth, "".join(p.type for p in r.path)) for r in found} == {("p.ClassB", 1, "CALL"), ("p.ClassC", 2, "CALLUSE")}
    named = traverse.seeds(copied.nodes, spark.createDataFrame([("1", "p.ClassA", "methodA")], "project_id string, class_name string, method_name string"))
    assert named.count() == 2


def test_closure_with_text_ids_and_ties(spark):
    rels = spark.createDataFrame([("a", "b", "USE"), ("a", "c", "CALL"), ("b", "d", "CALL"), ("c", "d", "CALL"), ("d", "a", "CALL"), ("d", "d", "CALL"), ("a", "b", "USE")], "src string, dst string, type string")
    seeds = spark.createDataFrame([(x,) for x in ("a", "a", "z", None)] + [(f"s{k}",) for k in range(200)], "node_id string")
    out = {(r.seed, r.node): (r.depth, [tuple(p) for p in r.path]) for r in traverse.closure(seeds, rels, min_level=0, with_path=True).collect()}
    assert len(out) == 205 and out["z", "z"] == (0, []) and out["a", "b"] == (1, [("b", "USE")])
    assert out["a", "d"] == (2, [("b", "USE"), ("d", "CALL")])  # of two ways the smallest (type, predecessor)


def wide(spark):
    """150 seeds and a hub of 300 steps each way, chains out of it with ties and loops; (seeds, rels, nodes with an id twice)."""
    rels = [(k, 1000, "CALL") for k in range(300)] + [(1000, 2000 + k, ("USE", "CALL", "IMPLEMENT")[k % 3]) for k in range(300)]
    rels += [(2000 + k, 2000 + (k * 7 + 1) % 300, "CALL") for k in range(300)] + [(2000 + k, 3000 + k % 5, "USE") for k in range(300)] + [(3000, 3001, "CALL"), (3000, 3001, "USE"), (3001, 3001, "CALL"), (3002, 5, "EXTEND")]
    rels += [(None, 1, "CALL"), (1, None, "CALL"), (5, 6, None), (6, 7, "OTHER")]
    r = spark.createDataFrame(rels, "src long, dst long, type string")
    n = spark.createDataFrame([(k, None if k % 2 else f"m{k}", ("main", "develop", None)[k % 3]) for k in [*range(300), 1000, *range(2000, 2300), *range(3000, 3004), 2004]], "node_id long, method_name string, branch string")
    return spark.createDataFrame([(k,) for k in [*range(0, 300, 2), 9999]], "node_id long"), r, n


def heaviest(spark, run):
    """What run() returns, collected, and the rows of the largest checkpoint that it made."""
    rows, kept = [], traverse.cut

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    traverse.cut = counted
    try:
        return sorted(map(tuple, run().collect()), key=str), max(rows)
    finally:
        traverse.cut = kept


def test_summaries_keep_nothing_per_pair(spark):
    seeds, rels, _ = wide(spark)
    found, rows = heaviest(spark, lambda: traverse.summaries(seeds, rels, max_level=6))
    steps = traverse.directed(rels, traverse.DOWNSTREAM)
    joined = traverse.summary(traverse._by_levels(seeds, steps, 1, 6, True))
    assert found == sorted(map(tuple, joined.collect()), key=str) and len(found) > 20_000 and rows < 3_000
    out = traverse.summaries(seeds, rels, min_level=0, max_level=1).where("seed in (0, 9999)").collect()
    assert sorted((r.seed, r.node, r.total_length, r.summary) for r in out) == [(0, 0, 0, ""), (0, 1000, 1, "CALL:1000"), (9999, 9999, 0, "")]
    paths, rows = heaviest(spark, lambda: traverse.closure(seeds, rels, traverse.UPSTREAM, 0, 6, with_path=True))
    assert paths == sorted(map(tuple, traverse._by_levels(seeds, traverse.directed(rels, traverse.UPSTREAM), 0, 6, True).collect()), key=str) and rows < 3_000


def test_visits_keep_nothing_per_pair(spark):
    seeds, rels, nodes = wide(spark)
    nodes = nodes.where("node_id <> 2010")  # a step into a node without a row doesn't count
    found, rows = heaviest(spark, lambda: traverse.visits(seeds, rels, nodes, max_level=6))
    joined = traverse.visited(traverse._by_levels(seeds, traverse.directed(rels, traverse.DOWNSTREAM), 1, 6, True), nodes)
    assert found == sorted(map(tuple, joined.collect()), key=str) and len(found) > 20_000 and rows < 3_000


def test_downstream_closure_keeps_nothing_per_pair(spark):
    _, rels, nodes = wide(spark)
    seeds = nodes.select("node_id")
    found, rows = heaviest(spark, lambda: traverse.closure(seeds, rels, min_level=0, max_level=6))
    assert found == sorted(map(tuple, traverse._by_levels(seeds, traverse.directed(rels, traverse.DOWNSTREAM), 0, 6, False).collect()), key=str)
    assert len(found) > 20_000 and rows < 1_600  # the steps; by levels it was a row per node and 64 seeds


def test_upstream_closure_keeps_nothing_per_pair(spark):
    _, rels, nodes = wide(spark)
    seeds = nodes.select("node_id")
    found, rows = heaviest(spark, lambda: traverse.closure(seeds, rels, traverse.UPSTREAM, max_level=6))
    assert found == sorted(map(tuple, traverse._by_levels(seeds, traverse.directed(rels, traverse.UPSTREAM), 1, 6, False).collect()), key=str)
    assert len(found) > 20_000 and rows < 1_600


def test_stream(spark, tmp_path):
    from codestrata.streaming.imports import import_stream, stream_chunks

    files.write_chunks(fixtures.chunks(spark, fixtures.FIRST).coalesce(1), str(tmp_path / "in"))
    kept = [empty_store(spark)]
    q = import_stream(stream_chunks(spark, str(tmp_path / "in")), lambda: kept[-1], lambda s, n: kept.append(s), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert kept[-1].nodes.count() == 5
    late = import_stream(stream_chunks(spark, str(tmp_path / "in")), lambda: kept[-1], lambda s, n: kept.append(s), str(tmp_path / "ck2"), last_saved=lambda: 0)
    late.awaitTermination(120)
    assert len(kept) == 2


def test_symbols_and_positions(spark):
    from codestrata.operators import chunks, symbols

    sources = [(1, JAVA), (2, 'package v; import p.q.Mark;\nclass Check implements ConstraintValidator<Mark, String> { @Around("@annotation(Mark)") Object wrap() { return other(); } void other() {} }')]
    classes = java_facts.extract(spark.createDataFrame(sources, "file_id long, content string"))
    assert {(r.kind, r.name) for r in symbols.document_symbols(classes).where("file_id = 2").collect()} == {("class", "Check"), ("method", "wrap"), ("method", "other")}
    assert symbols.workspace_symbols(classes, "OUT").count() == 1
    assert {(r.callee, r.caller) for r in symbols.references(classes).collect()} >= {("other", "wrap()"), ("other", "get(int a, String b)")}
    line = sources[1][1].split("\n")[1]
    places = spark.createDataFrame([(2, 1, line.index("wrap") + 1), (2, 1, 0)], "file_id long, line int, column int")
    assert [r.signature for r in symbols.method_at(places, classes).collect()] == ["wrap()"]
    assert [r.text for r in symbols.hover(places, classes).collect()] == ["Object v.Check.wrap()"]
    assert {r.file_id: r.class_count for r in symbols.class_counts(classes).collect()} == {1: 4, 2: 1}
    built = {r.full_class_name: r for r in chunks.build(classes, 1, "main").collect()}
    assert built["v.Check"].handles_annotation == "p.q.Mark" and built["v.Check"].methods[0].handles_annotation == "p.q.Mark"
    row = spark.range(1).select(names.path_of_uri(F.lit("file:///a%20b/C+.java")), names.position_of(F.lit("ab\ncd"), F.lit(4)), names.index_of(F.lit("ab\ncd"), F.lit(1), F.lit(1))).head()
    assert row[0] == "/a b/C+.java" and tuple(row[1]) == (1, 1) and row[2] == 4
