"""Queries of the text problems."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import nearduplicates, origin, packing, syntax, tokens, toxicity
from codestrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.judge_files(table(spark, folder, "source_files")).where(~F.col("parsable")).select("file_id")


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.judge_files(table(spark, folder, "source_files"))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.rates(syntax.judge_files(table(spark, folder, "source_files")))


def _similar(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return nearduplicates.near_duplicates(table(spark, folder, "nodes").select("id", "content"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearduplicates.record_pairs(*_similar(spark, folder))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearduplicates.groups(*_similar(spark, folder))


def _found_files(spark: SparkSession, folder: str) -> DataFrame:
    return origin.not_handwritten(table(spark, folder, "nodes"), table(spark, folder, "projects"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found_files(spark, folder).drop("kind")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return _found_files(spark, folder)


def p4_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    return origin.handwritten(table(spark, folder, "nodes"), _found_files(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    containers = table(spark, folder, "containers")
    documents = table(spark, folder, "documents")
    parts = []
    for name in sorted(r[0] for r in containers.select("tokenizer").distinct().collect()):  # a fixed table of 3 rows
        parts.append(packing.fill(tokens.token_counts(documents, name), containers.where(F.col("tokenizer") == name), documents.count()))
    return functools.reduce(DataFrame.unionByName, parts)


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(spark, folder)


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    return packing.usage(_filled(spark, folder), table(spark, folder, "containers"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("toxic").select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(_scored(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_rates, p2_found, p2_groups, p4_found, p4_kinds, p4_handwritten, p7_ids, p8_bins, p8_usage, p9_found, p9_scores, p9_rates)}
_PAIRS = """WITH RECURSIVE w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS ws FROM nodes WHERE content IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS run FROM w WHERE len(ws) >= 20),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * c >= 6 * (x.n + y.n - c))"""

ORACLE: dict[str, str] = {
    "p2_found": _PAIRS + " SELECT * FROM pairs",
    "p2_groups": _PAIRS + """, ways AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs), reach AS (SELECT a AS id, a AS other FROM ways UNION SELECT r.id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
}
