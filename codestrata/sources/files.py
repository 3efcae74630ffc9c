"""Scanning source trees, chunk files and text with unknown encoding."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import text_hash
from codestrata.schema import CHUNK, CONFIGURATION


# fixed values: files of configuration
CONFIGURATIONS = ("sql", "yml", "yaml", "xml")


def decode(column: str = "content"):
    """Bytes as UTF-16 where a mark says so, as UTF-8 without its mark where they are valid, else as Latin-1."""
    mark = F.hex(F.substring(F.col(column), 1, 2))
    plain = F.when(F.hex(F.substring(F.col(column), 1, 3)) == "EFBBBF", F.expr(f"substring({column}, 4)")).otherwise(F.col(column))
    return F.when(mark.isin("FEFF", "FFFE"), F.decode(F.col(column), "UTF-16")).otherwise(F.coalesce(F.try_validate_utf8(plain.cast("string")), F.decode(F.col(column), "ISO-8859-1")))


def source_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(file_path, content) of the files below `root`, each read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("file_path"), decode().alias("content"))


def only_targets(files: DataFrame, targets: list[str], parse_all: bool = False) -> DataFrame:
    """Files whose path ends with one of the targets, separators aside; all if there are none or `parse_all`."""
    if parse_all or not targets:
        return files
    flat = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    wanted = F.lit(False)
    for t in targets:
        wanted = wanted | F.endswith(flat, F.lit(t.replace("\\", "/")))
    return files.where(wanted)


def configuration_chunks(files: DataFrame, project_id: str | int, branch: str) -> DataFrame:
    """Chunks of whole configuration files (file_path, content), one each; other files are left out."""
    flat = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    chosen = files.where(F.lower(F.substring_index(flat, ".", -1)).isin(*CONFIGURATIONS) & flat.contains("."))
    given = {
        "class_name": F.substring_index(flat, "/", -1), "full_class_name": flat, "file_path": F.col("file_path"), "content": F.col("content"), "ast_hash": text_hash(F.col("content")), "project_id": F.lit(str(project_id)),
        "branch": F.lit(branch), "is_nested": F.lit(False), "is_annotation": F.lit(False), "type": F.lit(CONFIGURATION),
    }
    empty = lambda f: F.array() if f.dataType.typeName() == "array" else F.lit(None)
    return chosen.select(*[given.get(f.name, empty(f)).cast(f.dataType).alias(f.name) for f in CHUNK.fields])


def as_json(chunks: DataFrame) -> DataFrame:
    """(full_class_name, json): every chunk as one JSON object, nulls included."""
    return chunks.select("full_class_name", F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"}).alias("json"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks out of JSON lines, a file in as many tasks as it is long."""
    return spark.read.schema(CHUNK).json(path)


def read_chunk_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Chunks out of files of one JSON array each; a file is one task."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def write_chunks(chunks: DataFrame, path: str, per_file: int = 0) -> None:
    """Chunks as JSON lines, nulls included, in files of at most `per_file` where that is told."""
    writer = chunks.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).json(path)


def write_chunk_array(chunks: DataFrame, path: str) -> int:
    """Chunks as one indented JSON array in a local file, row by row; none is written without chunks. The number of chunks."""
    count = 0
    rows = chunks.select(F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"})).toLocalIterator()
    for row in rows:
        with open(path, "a" if count else "w", encoding="utf-8") as out:
            text = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            out.write(("," if count else "[") + "\n  " + text)
        count += 1
    if count:
        with open(path, "a", encoding="utf-8") as out:
            out.write("\n]\n")
    return count
