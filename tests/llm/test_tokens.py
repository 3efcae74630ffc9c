"""Encoding against the tokenizer's own library, the transducer, and packing."""

import random

import pytest

from codestrata.llm import bpe, packing, tokens
from codestrata.llm.lexicon import Lexicon, compile_lexicon

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", None, " ", "a", "Hello  world\n\n x", "don't  'll", "Straße 漢字 🙂 é", "\x1c\x85\xa0 a\t b", "<|endoftext|>", "x" * 50_000, "ab " * 5_000, "12345 6,7", "\u2028 \u200b"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids(spark, library):
    random.seed(2)
    texts = TEXTS + ["".join(random.choice("abAB 'st\u00e9\u00df\n\t01!?-. ") for _ in range(random.randint(0, 60))) for _ in range(300)]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {k: library(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.where("false")).count() == 0


def test_lexicon_round_trip(tmp_path):
    random.seed(4)
    entries = {"".join(random.choice("abcé") for _ in range(random.randint(1, 7))).encode(): [random.randrange(9)] * random.randint(0, 3) for _ in range(500)}
    data = compile_lexicon(entries)
    (tmp_path / "x").write_bytes(data)
    lexicon = Lexicon(str(tmp_path / "x"))
    assert {w: list(lexicon.get(w)) for w in entries} == entries
    assert all(lexicon.get(w) is None for w in (b"", b"zz", b"a" * 40) if w not in entries)
    assert len(compile_lexicon({f"{a}tion".encode(): [1] for a in "abcdefgh"})) < len(compile_lexicon({f"{a}{k}".encode() * 3: [1] for k, a in enumerate("abcdefgh")}))
    assert Lexicon(data=compile_lexicon({})).get(b"a") is None


def test_pack_is_whole_and_tight():
    random.seed(6)
    items = [(random.randint(0, 500), (k, 0, k)) for k in range(3_000)]
    bins = packing.pack(items, 512)
    assert sorted(x for b in bins for x in b) == sorted(items)
    assert max(sum(s for s, _ in b) for b in bins) <= 512
    assert sum(s for s, _ in items) / (512 * len(bins)) > 0.97
    assert packing.pack([], 10) == [] and packing.pack([(0, (1, 0, 0))], 10) == [[(0, (1, 0, 0))]]


def test_two_replace_the_smallest():
    bins = packing.pack([(60, ("a",)), (30, ("b",)), (22, ("c",)), (18, ("d",)), (90, ("e",))], 100)
    assert sorted(s for s, _ in bins[1]) == [18, 22, 60]


def test_fill(spark):
    sizes = spark.createDataFrame([(1, 1_300, 0), (2, 0, 0), (3, 212, 0), (3, 212, 0), (4, 512, 0)], "doc_id long, tokens long, capacity int")
    containers = spark.createDataFrame([("s", 512, "t"), ("z", 0, "t")], "container string, capacity int, tokenizer string")
    rows = packing.fill(sizes, containers, 5).collect()
    total = {}
    for r in rows:
        total[r.bin_id] = total.get(r.bin_id, 0) + r.tokens
    assert max(total.values()) <= 512 and sum(total.values()) == 2_236
    parts = sorted((r.doc_id, r.part_no, r.tokens) for r in rows)
    assert parts == [(1, 0, 512), (1, 1, 512), (1, 2, 276), (2, 0, 0), (3, 0, 212), (3, 0, 212), (4, 1 - 1, 512)]
    assert packing.fill(sizes.where("false"), containers, 0).count() == 0
    assert packing.usage(packing.fill(sizes, containers, 5), containers).head().tokens == 2_236
