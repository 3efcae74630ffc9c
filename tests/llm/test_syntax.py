"""Parsers against the languages' own rules on hand-written cases."""

import ast
import xml.parsers.expat

import pytest

from codestrata.llm import syntax
from codestrata.llm.parsing import lr

JAVA_GOOD = [
    "", "package a;\nimport static b.C.*;\nclass X {}", "class X { int[] a = {1, 2,}; List<Map<String, int[]>> m = new HashMap<>(); }", "class X { void f() { a.b(c -> d, E::new, int[]::new, (x, y) -> { return x >> 2 >>> 1; }); } }",
    "record P(int x, String... y) implements A { P { check(); } }", "sealed interface S permits A, B {} non-sealed class A implements S {}", "enum E { A(1) { void g() {} }, B; E(int i) {} }",
    "class X { int f(Object o) { return o instanceof String s && s.length() > 1 ? switch (k) { case 1, 2 -> 3; default -> { yield 4; } } : (int) -x; } }", 'class X { String t = """\n a "b" \\""" c\n """; char c = \'\\u0041\'; }',
    "@interface A { int v() default 1; } @A(v = {1}) class B<T extends C & D> { <U> U g() throws E { try (R r = o()) { } catch (F | G e) { } finally { } label: for (;;) { break label; } return null; } }",
    "class X { void f() { if (a) if (b) c(); else d(); int var = 0; var record = 1; Outer.Inner<T> i = o.new Inner<>(); this.<T>g(); X.super.h(); } }", "module m { requires transitive a.b; exports c to d; }",
    "class X { void f() { (a) = 1; a.b[c] += 2; this.x = y; new A().b = c; super.d >>>= 1; X.super.e = 2; int $é_1 = 0x1.8p-3f + 1e+5 - 0xE+1 + 1_0L + .5d + 5.f; List<List<List<A>>> l = a >= b ? c >> d : e >>> f; } }", "class X { int a = 0; } // no end", "class X { String s = \"\\u005c\\t\\0\"; int f(int... a) { return a[0]-1; } }", "",
]
JAVA_BAD = ["class X {", "class X { void f() { int a = 1 } }", "<<<<<<< HEAD\nclass X {}\n=======", "class X { void f() { x; } }", 'class X { String s = "a; }', "class X } ", "def f(): pass", "class X { int 1a; }", "class X { void f() [ } }", "class X { List&lt;A&gt; a; }", "class X { void f() { try { } } }", "class X { int a = 09; }", "/* open", "class X { void f() { a(b; } }", "class X { void f() { 1 = a; } }", "class X { void f() { this = a; } }", "class X { void f() { f() += 1; } }", "class X { int a = 1__; }", "class X { int a = 0x; }", 'class X { String s = "\\q"; }', "class X { char c = ''; }", "class X { int a = 1.e.f; }", "class X { int \xa0a; }", "class X { int a#b; }"]
PY = [
    "", "x = 1\n", "if a:\n  b\nelse:\n  c", "def f(a, /, b=1, *c, d, **e) -> int: return a", "match x:\n  case [1, *_] if y: pass\n  case {'a': A(b=1) | None}: pass\n", "match = 1\nmatch[0] = case\ntype X[T: int = str] = list[T]\n", 'f"{x!r:>{w}} {{}} {y["k"]=}"', "try:\n  a\nexcept* E as e:\n  b\n",
    "with (open(a) as f, b,):\n  pass", "print(*a, **b, c=1)", "lambda *a, b=1: (yield)", "[x async for x in y if z]", "a = b = yield c\n", "x: int = 3\n", "del (a, b[0]), c.d\n", "@d\nasync def f():\n  await g()\n", "class A[T](B, m=C): ...\n", "x = 1 if a else 2\n", "global a, b\n", "'a' \"b\" f'c'\n", "if a:\n\tb\n\tc\n", "\\\nx = 1", "x = (1 # c\n + 2)\n", "return 1\n", "0x_f + 1_0.0e-1j\n",
    "print 'a'", "if a\n  b", "x = (1", "x = 1)", "  x", "if a:\nb", "if a:\n  b\n c", "f() = 1", "f(a=1, b)", "def f(a=1, b): pass", "'a", "x = “a”", "1a", "a b", "f'{x'", "f'{}'", "<<<<<<< HEAD\n", "try:\n  a\n", "x = 01", "for x in y z:\n  pass", "del f()", "if a:\n\tb\n        c\n", "'\\N{no such name}'", "a +=", "class A:\n", "'a' b'b'", "b'a' rb'c'", "\\\n  x = 1", "  \\\n x", "if a:\n  b\n\\\n  c\n", "if a:\n  \\\n b\n  c\n", "\\\n\nx", "x = \\\n 1", "f'a' b'b'", "import a.b as c.d", "from . import *, a", "lambda: = 1", "x = y = z += 1",
]
XML = ["<a/>", "<?xml version='1.0' encoding='utf-8'?><a b=\"c\"><!-- x --><![CDATA[<&]]>&amp;&#65;</a> ", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", "<a><b></a></b>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a>& </a>", "<a", "", "<a/><b/>", "text", "<a b=c/>", "<a>]]></a>", "<a><!-- -- --></a>", "<A></a>", "<a>\x01</a>", "<a b='<'/>", " <?xml version='1.0'?><a/>"]
YAML_GOOD = ["", "# c\n", "a: 1\nb: [x, {y: z}]\n", "- a\n- b: c\n  d: |\n   e\n   f\n- >-\n  g\n", "? k\n: v\n", "a: &x !!str b\nc: *x\n", "--- a\n...\n%YAML 1.1\n---\nb\n", "a: 'it''s'\nb: \"\\x41\n  c\"\n", "a:\n- b\n- c\nd: e f\n  g\n", "url: http://x:80/#y\n", "{a, b: , c}\n"]
YAML_BAD = ["a: b: c\n", "a:\n\tb: 1\n", "- a\nb: 1\n", "a: [1\nb: 2\n", 'a: "x\n', "{a: 1", "a: 1\n b: 2\n", "a: @x\n", "a: b\n- c\n", "a: *\n", "<<<<<<< HEAD\na: 1\n=======\n"]


@pytest.mark.parametrize("text", JAVA_GOOD)
def test_java_good(text):
    assert syntax.first_error("java", text) is None


@pytest.mark.parametrize("text", JAVA_BAD)
def test_java_bad(text):
    assert syntax.first_error("java", text) is not None


@pytest.mark.parametrize("text", PY)
def test_python_as_the_language_has_it(text):
    try:
        ast.parse(text)
        good = True
    except SyntaxError:
        good = False
    assert (syntax.first_error("python", text) is None) == good


@pytest.mark.parametrize("text", XML)
def test_xml_as_expat_has_it(text):
    try:
        xml.parsers.expat.ParserCreate().Parse(text.encode(), True)
        good = True
    except xml.parsers.expat.ExpatError:
        good = text == ""
    assert (syntax.first_error("xml", text) is None) == good


def test_yaml():
    assert [t for t in YAML_GOOD if syntax.first_error("yaml", t) is not None] == []
    assert [t for t in YAML_BAD if syntax.first_error("yaml", t) is None] == []


def test_ambiguous_grammar():
    tables = lr.build("e: e '+' e | 'x' ;")
    x, plus = tables.terminals["x"], tables.terminals["+"]
    assert lr.recognise(tables, [x, plus, x, plus, x, plus, x, 0]) is None
    assert lr.recognise(tables, [x, plus, plus, 0]) == 2


def test_ambiguous_words_share_their_stacks():
    tables = lr.build("s: item* ; item: A B 'x' | A C 'y' | '(' s ')' ;")
    a, b, c, x, y, left, right = (tables.terminals[k] for k in ("A", "B", "C", "x", "y", "(", ")"))
    either = (b, c)
    good = [a, either, x, left, a, either, y, right] * 200 + [0]
    assert lr.recognise(tables, good) is None and lr.recognise(tables, good[:-2] + [0]) == len(good) - 2
    size = len(tables.store.below)
    assert lr.recognise(tables, good * 1) is None and len(tables.store.below) == size
    assert lr.recognise(tables, [lr.Several((left, left)), right, right, 0]) is None and lr.recognise(tables, [lr.Several((left, right)), right, 0]) == 1


def test_stacks_are_forgotten(monkeypatch):
    monkeypatch.setattr(lr._Store, "LIMIT", 50)
    tables = lr.build("s: '(' s ')' | 'x' ;")
    left, right, x = (tables.terminals[k] for k in ("(", ")", "x"))
    n = 70_000
    assert lr.recognise(tables, [left] * n + [x] + [right] * n + [0]) is None
    assert lr.recognise(tables, [left] * n + [x] + [right] * (n - 1) + [0]) == 2 * n


def test_places_of_errors():
    assert syntax.first_error("java", "class X {\n  int a = §;\n}") == 20 and syntax.first_error("java", "/* a */ class X { int 1a; }") == 22
    assert syntax.first_error("java", "class X {") == 9 and syntax.first_error("java", "class X { } }") == 12


def test_long_text():
    assert syntax.first_error("java", "class X { void f() {" + " a(b + c);" * 20_000 + " } }") is None
    assert syntax.first_error("python", "x = [" + "1, " * 20_000 + "]\n") is None


SCHEMA = "file_id long, project_id string, lang string, file_path string, content string, loaded_at timestamp, language string, parsable string"


def test_files(spark):
    rows = [
        (1, "1", None, "a\\B.JAVA", "class B {", None, "x", "y"), (1, "1", None, "a\\B.JAVA", "class B {", None, "x", "y"), (2, "1", "java", "a.py", "x = 1", None, None, None), (3, "1", "java", "a.txt", "x = (", None, None, None),
        (4, None, None, "a.yml", None, None, None, None), (5, "1", None, None, "x", None, None, None), (6, "2", None, "a.java", "", None, None, None), (None, "2", None, "a.xml", "<a>", None, None, None),
    ]
    judged = syntax.judge_files(spark.createDataFrame(rows, SCHEMA))
    got = {r.file_id: (r.language, r.parsable, r.error_line) for r in judged.collect()}
    assert got == {1: ("java", False, 1), 2: ("python", True, None), 3: (None, None, None), 4: ("yaml", None, None), 5: (None, None, None), 6: ("java", True, None), None: ("xml", False, 1)}
    assert {(r.project_id, r.language): (r.files, r.unparsable) for r in syntax.rates(judged).collect()} == {("1", "java"): (1, 1), ("1", "python"): (1, 0), ("2", "java"): (1, 0), ("2", "xml"): (1, 1)}
    assert syntax.judge_files(spark.createDataFrame([], SCHEMA)).count() == 0
