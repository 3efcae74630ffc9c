"""Encoding of a corpus by a public tokenizer.

The corpus's most frequent words, counted over all documents, are compiled with their ids into a transducer that
every executor maps into memory; a chunk that it hasn't got is merged by the ranks, exactly. The lexicon decides only speed, never ids.

Null and empty texts have no tokens: ids [] and 0 tokens. Texts are whole, special tokens' names are ordinary text.
Repeated rows are encoded like others, other columns pass unused, an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import itertools
import os
import pathlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe
from codestrata.llm.lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 16_384
WORD_BYTES = 48
WORD_SHARE = 7e-7
#: Chunks that a worker keeps with their ids; beyond, it starts anew.
MEMO = 400_000


def frequent_words(documents: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The `limit` most frequent words between blanks, of at most WORD_BYTES bytes: counts are combined before the shuffle.

    Only words that occur once in 1/WORD_SHARE of the corpus's characters are candidates: with their blanks they take
    two characters at least, so there are at most 1/(2 WORD_SHARE) of them at any size.
    """
    words = documents.select(F.explode(F.split("text", "[ \n\r\t]")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(documents.agg(F.sum(F.length("text")).alias("total")))
    often = counts.join(total, F.col("n") > F.greatest(F.col("total") * WORD_SHARE, F.lit(1.0)))
    often = often.where((F.col("word") != "") & (F.octet_length("word") <= WORD_BYTES))
    return [r[0] for r in often.orderBy(F.desc("n"), "word").limit(limit).select("word").collect()]


def publish_lexicon(spark: SparkSession, documents: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Compiles the corpus's lexicon and hands it to all executors, late ones too; gives the file's name.

    Its size is bounded by LEXICON_WORDS and WORD_BYTES: at most a few MB.
    """
    merges = bpe.load(tokenizer, folder)
    chunk = re.compile(bpe.CHUNK)
    entries = {}
    for word in frequent_words(documents):
        for form in (word, " " + word):
            if chunk.fullmatch(form):
                entries[form.encode("utf-8")] = merges.chunk(form)
    data = compile_lexicon(entries)
    name = f"lexicon-{tokenizer}-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = os.path.join(tempfile.gettempdir(), name)  # the driver's own copy, from which Spark serves it
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as file:
        file.write(data)
    os.replace(file.name, path)
    atexit.register(functools.partial(pathlib.Path.unlink, pathlib.Path(path), missing_ok=True))
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Encodes texts: memo of chunks, then the mapped lexicon, then exact merges."""

    def __init__(self, tokenizer: str, folder: str | None, lexicon: Lexicon | None):
        self.merges = bpe.load(tokenizer, folder)
        self.lexicon = lexicon
        self.chunks = re.compile(bpe.CHUNK).findall
        encoder = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> tuple[int, ...]:
                found = encoder.lexicon.get(chunk.encode("utf-8")) if encoder.lexicon else None
                ids = tuple(encoder.merges.chunk(chunk)) if found is None else found
                if len(self) >= MEMO:
                    self.clear()
                if len(chunk) <= 4 * WORD_BYTES:
                    self[chunk] = ids
                return ids

        self.memo = Memo()

    def ids(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids of a text, by chunk."""
        return map(self.memo.__getitem__, self.chunks(text)) if text else iter(())


@functools.cache
def _encoder(tokenizer: str, folder: str | None, lexicon: str) -> Encoder:
    return Encoder(tokenizer, folder, Lexicon(SparkFiles.get(lexicon)))


def _texts(column: pa.Array) -> Iterator[str | None]:
    for k in range(len(column)):  # one text at a time: long ones needn't be in memory together
        yield column[k].as_py()


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    lexicon = publish_lexicon(documents.sparkSession, documents, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, folder, lexicon)
        for batch in batches:
            flat, ends = [], [0]
            for text in _texts(batch.column("text")):
                flat.append(np.fromiter(itertools.chain.from_iterable(encoder.ids(text)), dtype=np.int32))
                ends.append(ends[-1] + len(flat[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row."""
    lexicon = publish_lexicon(documents.sparkSession, documents, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, folder, lexicon)
        for batch in batches:
            counts = [sum(map(len, encoder.ids(text))) for text in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")
