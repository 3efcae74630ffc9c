"""A small project from source files to the graph's edges."""

import pytest

from codestrata import api, settings
from codestrata.cli import main
from codestrata.sources import files, store

SOURCES = {
    "a/Base.java": "package a; public interface Base { int total(Item i); }",
    "a/Item.java": "package a; public class Item { private long id; public long key() { return id; } }",
    "b/Shop.java": 'package b; import a.Base; import a.Item;\n@RestController public class Shop implements Base { @GetMapping("/t") public int total(Item i) { return (int) i.key(); } }',
    "b/Broken.java": "package b; class {",
}


def test_analyze(spark, tmp_path):
    for name, text in SOURCES.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert main(["analyze", str(tmp_path / "src"), "-p", "7", "-o", str(tmp_path / "out"), "--store", str(tmp_path / "g")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    s = store.load(spark, str(tmp_path / "g"))
    names = {r.node_id: (r.class_name, r.method_name, r.label) for r in s.nodes.collect()}
    edges = {(names[r.src][0], names[r.src][1], r.type, names[r.dst][0], names[r.dst][1]) for r in s.rels.collect()}
    assert ("b.Shop", None, "IMPLEMENT", "a.Base", None) in edges
    assert ("b.Shop", "b.Shop.total(Item i)", "CALL", "a.Item", "a.Item.key()") in edges
    assert ("b.Shop", None, "USE", "a.Item", None) in edges
    assert ("b.Shop", "b.Shop.total(Item i)", "EndpointNode") in names.values()


def test_configurations_and_options(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A { }")
    (tmp_path / "src" / "b.YML").write_bytes("\ufeffa: é".encode())
    (tmp_path / "src" / "c.yml").write_bytes("a: é".encode("utf-16"))
    (tmp_path / "src" / "d.sql").write_text("select 1")
    assert main(["analyze", str(tmp_path / "src"), "-p", "7", "-o", str(tmp_path / "out"), "--configurations", "--skip-store", "--store", str(tmp_path / "g"), "--batch-size", "1", "-v"]) == 0
    read = {r.class_name: (r.content, r.type) for r in files.read_chunks(spark, str(tmp_path / "out")).collect()}
    assert read == {"A": ("class A { }", "regular"), "c.yml": ("a: é", "configuration"), "d.sql": ("select 1", "configuration")} and not (tmp_path / "g").exists()
    assert main(["analyze", str(tmp_path / "none"), "-p", "7", "-o", "x"]) == 2 and main(["analyze", str(tmp_path / "src"), "-p", "7"]) == 2
    assert files.source_files(spark, str(tmp_path / "src"), "*.YML").head().content == "a: é"


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# x\nCODESTRATA_STORE='s'\nexport CODESTRATA_BATCH_SIZE=5\nOTHER=1\nbroken\n")
    assert settings.read(str(env), {}) == settings.Settings("s", None, None, 5)
    assert settings.read(str(env), {"CODESTRATA_STORE": "t", "CODESTRATA_MAIN_BRANCH": "m"}) == settings.Settings("t", "m", None, 5)
    assert settings.read(None, {}) == settings.Settings()
    with pytest.raises(ValueError):
        settings.read(None, {"CODESTRATA_BATCH_SIZE": "many"})


def test_analyzers():
    assert api.analyzer("Java").pattern == "*.java" and all(hasattr(api, n) for n in api.__all__)
    with pytest.raises(ValueError):
        api.analyzer("cobol")
