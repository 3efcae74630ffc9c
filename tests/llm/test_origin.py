"""Origins of files by path, notice and shape, and what must not count."""

import pytest

from codestrata.llm import origin

PATHS = [
    ("vendor/org/lib/A.java", "third-party"), ("src/main/java/com/own/vendor/A.java", None), ("vendor/com/own/A.java", None), ("src/main/java/org/other/A.java", "third-party"), ("src/main/java/com/own/shaded/org/lib/A.java", "third-party"),
    ("target/generated-sources/com/own/A.java", "generated"), ("src/main/java/com/own/generated/A.java", None), ("web/x.min.js", "minified"), ("web/x-min.js", None), ("yarn.lock", "generated"), ("a_pb2.py", "generated"), ("src\\main\\java\\com\\own\\A.java", None),
]


@pytest.mark.parametrize("path,kind", PATHS)
def test_paths(path, kind):
    assert origin.path_kind(path.replace("\\", "/"), None, None, "com.own") == kind


NOTICES = [
    ("// Generated by X. DO NOT EDIT!", "generated"), ("/* Erzeugt mit X - nicht von Hand ändern */", "generated"), ("// Not generated any more: kept by hand since.", None), ("// Replaces the old generated stub; please edit freely.", None),
    ("// TODO: have X write this for us one day", None), ("/* upstream: lib v1 (local copy, unchanged) */", "third-party"), ("/*\n * Copyright (c) 2004 The Lib Authors\n */", "third-party"), ("/*\n * Copyright (c) 2025 Own Works\n */", None), ("/** Sends the order. */", None), ("", None),
    ("// 0dfb29c5 - written by the build, see build.xml", "generated"), ("// Written by the sales team.", None), ("// end of generated code, checksum 1", "generated"), ("// @@generated-tail 12", "generated"), ("// <auto-generated> x </auto-generated>", "generated"),
    ("// Copied from lib-core 1.2, do not modify; fixes go upstream.", "third-party"), ("// Copied from the order form's fields.", None), ("// Imported verbatim: lib 2.1", "third-party"), ("// Regenerated only when asked for.", None), ("// changes will be lost", "generated"), ("# généré par X", "generated"),
]


@pytest.mark.parametrize("text,kind", NOTICES)
def test_notices(text, kind):
    assert origin.notice(text, "Own Works") == kind


OUTLINES = [
    ("package a.b;\n\nimport c.D;\n/** Doc. */\n@Deprecated\n@Generated(value = \"x(\", date = \"1\")\npublic final class A {\n // inside\n}\n\n// last\n", "java", ("/** Doc. */", "// last\n", ["@Deprecated", '@Generated(value = "x(", date = "1")'], "a.b")),
    ('class A {\n  String s = "// Generated by X. DO NOT EDIT";\n}', "java", ("", "", [], None)), ("@Generated void run() {}", "java", ("", "", [], None)), ("# one\n# two\na: 1\n# three", "yml", ("# one\n\n# two", "# three", [], None)),
    ("<?xml version='1.0'?>\n<!-- x -->\n<a/>\n<!-- y -->", "xml", ("<!-- x -->", "<!-- y -->", [], None)), ("-- one\nselect 1;\n", "sql", ("-- one", "", [], None)), ("/* open", "java", ("/* open", "", [], None)), ("class A {}\n/* a\n * b\n */", "java", ("", "/* a\n * b\n */", [], None)),
]


@pytest.mark.parametrize("text,extension,parts", OUTLINES)
def test_outline(text, extension, parts):
    assert origin.outline(text, extension) == parts


def test_annotations():
    assert origin.annotated(["@Generated"]) and origin.annotated(['@javax.annotation.processing.Generated("x")']) and origin.annotated(["@Deprecated", '@GeneratedCode(tool = "x")'])
    assert not origin.annotated(["@GeneratedValue", "@NotGenerated", "@Generator", '@Named("Generated")'])


def _states(n):
    return "final class T {\n static int next(int s, int c) {\n  switch (s) {\n" + "".join(f"   case {k}: return s{k * 77}(c, {k * 931});\n" for k in range(n)) + "  }\n }\n}"


def test_machine_made_tables():
    named = "class E {\n" + "".join(f"  static final int {w} = 1{k};\n" for k, w in enumerate("ALPHA BETA GAMMA DELTA EPSILON ZETA ETA THETA IOTA KAPPA LAMBDA MU NU XI OMICRON PI RHO SIGMA TAU UPSILON PHI CHI PSI OMEGA".split())) + "}"
    blob = 'class B {\n String s = ""\n' + "".join(f'  + "dg21juP826G4pdcue1OS9KNQpJosleOBdkpfHjBf{k}"\n' for k in range(9)) + ";\n}"
    assert [origin.shape_kind(t, "java") for t in (_states(40), _states(5), named, blob, "class C { int a = 1; }")] == ["generated", None, None, "data", None]
    assert origin.shape_kind("\n".join(f"ALTER TABLE t ADD COLUMN c{k} INT;" for k in range(30)), "sql") is None


def test_shapes():
    table = "\n".join(f"{k};name{k};{k}.5;ok" for k in range(30))
    data = "class T {\n static final byte[] t = {\n" + "0x46, 28, 0xd0, -53, 63,\n" * 30 + "};\n}"
    mini = "final class A{" + "".join(f"static int f{k}(int a,long b){{return a*{k}+g{k}(a,b-9);}}" for k in range(40)) + "}"
    plain = "class A {\n" + "    int total = countOrders(customer, 12);\n" * 30 + "}"
    query = 'class A {\n  String q = "' + "select a.first, b.second from orders " * 30 + '";\n' + "  void run() { send(q); }\n" * 12 + "}"
    got = [origin.shape_kind(t, e) for t, e in ((table, "xml"), (data, "java"), (mini, "java"), (plain, "java"), (query, "java"), ("[" + '{"a":1.5},' * 60 + '{"a":1}]', "yml"), ("x", "java"), ("7" * 200_000, "java"))]
    assert got[:6] == ["data", "data", "minified", None, None, "data"]


def test_files(spark):
    nodes = spark.createDataFrame(
        [("1", "main", "vendor/org/l/A.java", None, None, "o"), ("1", "main", "vendor/org/l/A.java", "org.l.A", "", "o"), ("1", None, "src/main/java/com/own/A.java", "com.own.A", "// Generated by X\nclass A {}", "o"), ("9", "main", "src/main/java/any/A.java", "any.A", "class A {}", "o"), (None, "main", None, None, "x", "o"), ("1", "main", "src/main/java/com/own/B.java", None, None, "o")],
        "project_id string, branch string, file_path string, class_name string, content string, owner string",
    )
    projects = spark.createDataFrame([("1", "com.own", "Own Works"), (None, "x", "y")], "project_id string, package_root string, owner string")
    found = origin.not_handwritten(nodes, projects)
    assert sorted((r.branch or "", r.file_path, r.kind) for r in found.collect()) == [("", "src/main/java/com/own/A.java", "generated"), ("main", "vendor/org/l/A.java", "third-party")]
    assert sorted(r.file_path for r in origin.handwritten(nodes, found).collect()) == ["src/main/java/any/A.java", "src/main/java/com/own/B.java"]
    assert origin.not_handwritten(nodes.where("false"), projects).count() == 0
