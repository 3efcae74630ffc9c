"""Source files that do not parse.

Words of each file are fed to a table-driven parser of its extension's language, whose tables are built from the
bundled grammars (once per Python worker). Files are parsed where they are read, without a shuffle; only verdicts
are shuffled, to reduce repeated deliveries to one row per file.

Null or empty content: an empty file is valid; null content and files of other extensions, or without a path, have no
verdict (`parsable` null). Of several rows of a file the latest `loaded_at` counts (then a bad verdict before a good
one). Other columns pass unused. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.parsing import java, lr, python, xml, yaml

# fixed values: languages by extension
LANGUAGES = {"java": "java", "py": "python", "xml": "xml", "yml": "yaml", "yaml": "yaml"}
_PARTS = {"java": (java, "java17.gram", ("else",)), "python": (python, "python313.gram", ()), "xml": (xml, "xml10.gram", ()), "yaml": (yaml, "yaml11.gram", ())}


def language_of(path: Column) -> Column:
    """The language that a path's extension names, in any letter case; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    out = F.lit(None).cast("string")
    for ext, language in LANGUAGES.items():
        out = F.when(extension == ext, language).otherwise(out)
    return out


@functools.cache
def tables(language: str) -> lr.Tables:
    """The parser tables of a language."""
    _, grammar, shifts = _PARTS[language]
    return lr.build(resources.files("codestrata.llm.parsing").joinpath("grammars", grammar).read_text(encoding="utf-8"), shifts)


def first_error(language: str, text: str) -> int | None:
    """Place of the first error that the parser can't go on from; None if the text parses."""
    if language != "yaml" and language != "xml" and not text.strip():
        return None
    if not text:
        return None
    parser = tables(language)
    words, places, fault = _PARTS[language][0].words(text, parser.terminals)
    stop = lr.recognise(parser, words)
    if fault is not None:
        return min(fault, places[stop]) if stop is not None and stop < len(places) else fault
    return None if stop is None else places[min(stop, len(places) - 1)]


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, int], int | None] = {}  # faults of contents that came before in this task
    for batch in batches:
        lines: list[int | None] = []
        columns: list[int | None] = []
        good: list[bool | None] = []
        for language, text in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist()):
            if language is None or text is None:
                fault, judged = None, None
            else:
                key = (language, xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass")))
                if key not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[key] = first_error(language, text)
                fault = known[key]
                judged = fault is None
            good.append(judged)
            lines.append(None if fault is None else text.count("\n", 0, fault) + 1)
            columns.append(None if fault is None else fault - text.rfind("\n", 0, fault))
        keep = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(good, pa.bool_()), pa.array(lines, pa.int32()), pa.array(columns, pa.int32())],
            names=[*keep, "parsable", "error_line", "error_column"],
        )


def judge_files(files: DataFrame) -> DataFrame:
    """(file_id, project_id, language, parsable, error_line, error_column): one row per file."""
    chosen = files.select("file_id", "project_id", "loaded_at", language_of(F.col("file_path")).alias("language"), "content")
    judged = chosen.mapInArrow(_verdicts, "file_id long, project_id string, loaded_at timestamp, language string, parsable boolean, error_line int, error_column int")
    row = F.struct("project_id", "language", "parsable", "error_line", "error_column")
    order = F.struct(F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp")), ~F.coalesce("parsable", F.lit(True)), F.xxhash64("project_id", "language", "error_line", "error_column"))
    return judged.groupBy("file_id").agg(F.max_by(row, order).alias("r")).select("file_id", "r.*")


def rates(judged: DataFrame) -> DataFrame:
    """Files, unparsable files and their rate per project and language, of files with a verdict."""
    counts = judged.where(F.col("parsable").isNotNull()).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum((~F.col("parsable")).cast("long")).alias("unparsable"))
    return counts.withColumn("rate", F.col("unparsable") / F.col("files"))
