"""Queries of imports, branch copies and chunk files over chunks of the whole method_deps table, with their SQL.

A chunk is a class of a project's branch; its methods are those of the table, with their calls and types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import names
from codestrata.operators import edges, importing, nodes, symbols
from codestrata.schema import CHUNK, METHOD, NODE, REL
from codestrata.session import cut, ensure_checkpoint_dir
from codestrata.sources import files
from codestrata.sources.tables import table


def _filled(schema, given: dict[str, Column]) -> list[Column]:
    """Columns of a schema: those given, empty arrays, and nulls."""
    out = []
    for field in schema.fields:
        value = given.get(field.name, F.array() if field.dataType.typeName() == "array" else F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return out


def table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of method_deps: rows of one method are put together, repeated and null names left out."""
    deps = table(spark, folder, "method_deps")
    flat = lambda c: F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce(c, F.array()))), lambda x: x.isNotNull())))
    key = ("project_id", "branch", "class_name")
    methods = deps.groupBy(*key, "method_name").agg(flat("method_calls").alias("calls"), flat("used_types").alias("types"), flat("field_access").alias("fields"))
    given = {
        "body": F.col("method_name"), "field_access": F.col("fields"), "name": F.col("method_name"), "full_name": F.col("method_name"), "ast_hash": F.md5(F.concat("branch", F.lit(" "), "method_name")), "type": F.lit("regular"), "project_id": F.col("project_id"), "branch": F.col("branch"),
        "method_calls": F.transform("calls", lambda c: F.struct(c.alias("name"), F.array().cast("array<struct<type:string,value:string>>").alias("params"))), "used_types": F.col("types"),
    }
    classes = methods.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*_filled(METHOD, given)))).alias("methods"))
    given = {
        "class_name": F.substring_index("class_name", ".", -1), "full_class_name": F.col("class_name"), "ast_hash": F.md5(F.concat("branch", F.lit(" "), "class_name")), "methods": F.col("methods"), "project_id": F.col("project_id"),
        "branch": F.col("branch"), "is_nested": F.lit(False), "is_annotation": F.lit(False), "type": F.lit("regular"),
    }
    return classes.select(*_filled(CHUNK, given))


def _empty(spark: SparkSession) -> importing.Store:
    return importing.Store(spark.createDataFrame([], NODE), spark.createDataFrame([], REL))


def _names(store: importing.Store) -> DataFrame:
    """The store's edges, and its nodes as edges to nothing, by names."""
    name = lambda p: store.nodes.select(F.col("node_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("project_id", "branch", "class_name")], F.coalesce("method_name", F.lit("")).alias(f"{p}_method"))
    rows = name("src").select(F.col("src_project_id").alias("project_id"), F.col("src_branch").alias("branch"), "src_class_name", "src_method", F.lit("NODE").alias("type"), F.lit("").alias("dst_class_name"), F.lit("").alias("dst_method"))
    ends = store.rels.join(name("src"), "src").join(name("dst"), "dst")
    return rows.unionByName(ends.select(F.col("src_project_id").alias("project_id"), F.col("src_branch").alias("branch"), "src_class_name", "src_method", "type", "dst_class_name", "dst_method"))


def _again(spark: SparkSession, folder: str, run) -> DataFrame:
    """End state by names after all chunks came in, and those of some classes came in again."""
    chunks = cut(table_chunks(spark, folder))
    first = importing.import_simple(_empty(spark), chunks)
    return _names(run(first, chunks.where("length(full_class_name) % 3 = 0")))


def import_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _again(spark, folder, importing.import_incremental)


def simple_import(spark: SparkSession, folder: str) -> DataFrame:
    """The same without keeping the edges of others into what is replaced."""
    return _again(spark, folder, importing.import_simple)


def create_unconditional(spark: SparkSession, folder: str) -> DataFrame:
    """Rows made by an import without branches to compare with, tombstones included."""
    made = importing.import_nodes(_empty(spark), table_chunks(spark, folder), importing.Options(), table(spark, folder, "tombstones")).nodes
    return made.select("project_id", "branch", "label", "name", "class_name", "method_name", "ast_hash", "status")


def method_node_projection(spark: SparkSession, folder: str) -> DataFrame:
    return nodes.method_nodes(table_chunks(spark, folder)).select("project_id", "branch", "class_name", "method_name", "label", "content")


def class_node_projection(spark: SparkSession, folder: str) -> DataFrame:
    made = nodes.class_nodes(table_chunks(spark, folder), main="main", base="develop", request="7", version="", base_version="1")
    return made.select("project_id", "branch", "class_name", "name", "label", "version", "status", "base_branch", "pull_request_id")


def edge_request_union(spark: SparkSession, folder: str) -> DataFrame:
    asked = edges.requests(table_chunks(spark, folder))
    return asked.select("project_id", "branch", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_class", "source_method", "target_class", "target_method")])


def known_name_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of method_deps whose simple name some method of it has."""
    m = table_chunks(spark, folder).select("project_id", "branch", "full_class_name", F.explode("methods").alias("m"))
    call = lambda c: F.struct(names.simple_method_name(c["name"]).alias("name"))
    method = F.struct(names.simple_method_name(F.col("m.full_name")).alias("name"), F.col("m.full_name").alias("signature"), F.transform("m.method_calls", call).alias("calls"))
    return symbols.known_calls(m.select("full_class_name", F.array(method).alias("methods")))


def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What an import of the chunks of branch main into a store of all others counts."""
    chunks = cut(table_chunks(spark, folder))
    first = importing.import_simple(_empty(spark), chunks)
    return importing.import_incremental(first, chunks.where("branch = 'main'")).counts


def request_import_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and ids after all chunks came in twice for one pull request, whose rows stay."""
    chunks = cut(table_chunks(spark, folder))
    given = importing.Options(pull_request_id="7")
    twice = importing.import_simple(importing.import_simple(_empty(spark), chunks, given), chunks, given)
    return twice.nodes.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("node_id").alias("ids"))


def copy_branch(spark: SparkSession, folder: str) -> DataFrame:
    """End state by names after branch main is copied onto branch develop, whose own classes and methods differ; a second copy adds nothing."""
    chunks = cut(table_chunks(spark, folder))
    store = importing.import_simple(_empty(spark), chunks)
    for _ in range(2):
        store = importing.copy_branch(store, chunks.where("branch = 'develop'"), "main", "develop")
    return _names(store)


def chunk_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Methods, calls and types of chunks that were written as JSON lines and read again."""
    place = f"{ensure_checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    files.write_chunks(table_chunks(spark, folder).repartition(4), place)
    m = files.read_chunks(spark, place).select("project_id", "branch", "full_class_name", F.explode("methods").alias("m"))
    return m.select("project_id", "branch", "full_class_name", F.col("m.full_name").alias("method"), F.array_join("m.method_calls.name", "|").alias("calls"), F.array_join("m.used_types", "|").alias("types"))


QUERIES = {f.__name__: f for f in (import_tables, simple_import, create_unconditional, method_node_projection, class_node_projection, edge_request_union, known_name_semi_join, import_counts, request_import_ids, copy_branch, chunk_round_trip)}

_EDGES = """
WITH calls AS (SELECT DISTINCT project_id, branch, class_name, method_name, unnest(method_calls) AS t FROM method_deps),
types AS (SELECT DISTINCT project_id, branch, class_name, method_name, unnest(used_types) AS t FROM method_deps),
methods AS (SELECT DISTINCT project_id, branch, class_name, method_name FROM method_deps), classes AS (SELECT DISTINCT project_id, branch, class_name FROM method_deps),
nodes_ AS (SELECT project_id, branch, class_name, '' AS method FROM classes UNION ALL SELECT project_id, branch, class_name, method_name FROM methods),
edges AS (SELECT c.project_id, c.branch, c.class_name AS src_class_name, c.method_name AS src_method, 'CALL' AS type, m.class_name AS dst_class_name, m.method_name AS dst_method
    FROM calls c JOIN methods m ON m.project_id = c.project_id AND m.branch = c.branch AND m.method_name = c.t
  UNION SELECT t.project_id, t.branch, t.class_name, t.method_name, 'USE', k.class_name, '' FROM types t JOIN classes k ON k.project_id = t.project_id AND k.branch = t.branch AND k.class_name = t.t)
"""
_STATE = "SELECT project_id, branch, class_name AS src_class_name, method AS src_method, 'NODE' AS type, '' AS dst_class_name, '' AS dst_method FROM nodes_ UNION ALL SELECT * FROM edges"

ORACLE = {
    "import_tables": _EDGES + _STATE,
    "simple_import": _EDGES + _STATE + " WHERE length(src_class_name) % 3 = 0 OR length(dst_class_name) % 3 <> 0",
    "create_unconditional": _EDGES + """SELECT project_id, branch, CASE WHEN method = '' THEN 'ClassNode' ELSE 'MethodNode' END AS label, CASE WHEN method = '' THEN split_part(class_name, '.', -1) ELSE method END AS name, class_name, nullif(method, '') AS method_name,
  md5(branch || ' ' || CASE WHEN method = '' THEN class_name ELSE method END) AS ast_hash, 'ACTIVE' AS status FROM nodes_
UNION ALL SELECT project_id, branch, coalesce(node_type, CASE WHEN method_name IS NULL THEN 'ClassNode' ELSE 'MethodNode' END), name, class_name, method_name, ast_hash, 'DELETED' FROM tombstones""",
    "method_node_projection": """WITH f AS (SELECT project_id, branch, class_name, method_name, coalesce(list_sort(list_distinct(flatten(list(field_access)))), []) AS fields FROM method_deps GROUP BY ALL)
SELECT project_id, branch, class_name, method_name, 'MethodNode' AS label, replace(replace(method_name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || ' ' || CAST(to_json(fields) AS VARCHAR) AS content FROM f""",
    "class_node_projection": "SELECT DISTINCT project_id, branch, class_name, split_part(class_name, '.', -1) AS name, 'ClassNode' AS label, 'unknown' AS version, 'ACTIVE' AS status, 'develop' AS base_branch, CASE WHEN branch <> 'main' THEN '7' END AS pull_request_id FROM method_deps",
    "edge_request_union": _EDGES + "SELECT project_id, branch, 'CALL' AS kind, class_name AS source_class, method_name AS source_method, '' AS target_class, t AS target_method FROM calls WHERE t IS NOT NULL UNION ALL SELECT project_id, branch, 'USE', class_name, method_name, t, '' FROM types WHERE t IS NOT NULL",
    "known_name_semi_join": """WITH c AS (SELECT DISTINCT class_name AS caller_class, method_name AS caller, split_part(split_part(t, '(', 1), '.', -1) AS callee FROM (SELECT class_name, method_name, unnest(method_calls) AS t FROM method_deps) WHERE t IS NOT NULL)
SELECT * FROM c WHERE callee IN (SELECT split_part(split_part(method_name, '(', 1), '.', -1) FROM method_deps)""",
    "import_counts": _EDGES + """, main AS (SELECT * FROM nodes_ WHERE branch = 'main'), inner_edges AS (SELECT * FROM edges WHERE branch = 'main')
SELECT 'created' AS what, count(*) AS rows FROM main UNION ALL SELECT 'replaced', count(*) FROM main UNION ALL SELECT 'saved', 0 UNION ALL SELECT 'restored', 0 UNION ALL SELECT 'resolved', count(*) FROM inner_edges""",
    "request_import_ids": _EDGES + "SELECT 2 * count(*) AS rows, 2 * count(*) AS ids FROM nodes_",
    "copy_branch": _EDGES + f""", taken AS (SELECT project_id, class_name, method FROM nodes_ WHERE branch = 'develop'),
copied AS (SELECT n.* REPLACE ('develop' AS branch) FROM nodes_ n WHERE n.branch = 'main' AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.project_id = n.project_id AND t.class_name = n.class_name AND t.method = n.method)),
moved AS (SELECT e.* REPLACE ('develop' AS branch) FROM edges e WHERE e.branch = 'main' AND EXISTS (SELECT 1 FROM copied c WHERE c.project_id = e.project_id
  AND (c.class_name = e.src_class_name AND c.method = e.src_method OR c.class_name = e.dst_class_name AND c.method = e.dst_method)))
{_STATE} UNION ALL SELECT project_id, branch, class_name, method, 'NODE', '', '' FROM copied UNION ALL SELECT * FROM moved""",
    "chunk_round_trip": """SELECT project_id, branch, class_name AS full_class_name, method_name AS method,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(method_calls)))), '|'), '') AS calls, coalesce(array_to_string(list_sort(list_distinct(flatten(list(used_types)))), '|'), '') AS types
FROM method_deps GROUP BY ALL""",
}
