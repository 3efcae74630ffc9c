"""Queries of the code graph's own operators over the tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import comments, endpoints, filters, names
from codestrata.operators import branches, chunks, edges, importing, lookup, nodes, symbols, traverse
from codestrata.schema import NODE, REL
from codestrata.session import cut
from codestrata.sources import files, java_facts
from codestrata.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# ---- inputs ---------------------------------------------------------------------------------------------------------

def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").withColumnRenamed("id", "node_id")


def _kind(column: str) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.col(column))), "^EXTENDS$", "EXTEND")


def _rels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships").where("start_node is not null and end_node is not null").select(F.col("start_node").alias("src"), F.col("end_node").alias("dst"), _kind("type").alias("type"))


def _main(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(table(spark, d, "projects").select("project_id", "main_branch"))  # fixed table of 40 rows


_N = "nodes_ AS (SELECT id AS node_id, * EXCLUDE (id) FROM nodes)"
_R = "rels AS (SELECT start_node AS src, end_node AS dst, regexp_replace(upper(trim(type)), '^EXTENDS$', 'EXTEND') AS type FROM relationships WHERE start_node IS NOT NULL AND end_node IS NOT NULL)"


def _asked(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Requests out of the tables: calls and uses of method_deps, implementations of relationships."""
    if kind in ("call", "use_method", "use_class"):
        deps = table(spark, d, "method_deps")
        array = "method_calls" if kind == "call" else "used_types"
        rows = deps.select("project_id", "branch", F.col("class_name").alias("source_class"), F.col("method_name").alias("source_method"), F.explode(array).alias("target"))
        target = [F.lit(None).cast("string").alias("target_class"), F.col("target").alias("target_method")] if kind == "call" else [F.col("target").alias("target_class"), F.lit(None).cast("string").alias("target_method")]
        rows = rows.select(F.lit("CALL" if kind == "call" else "USE").alias("kind"), "project_id", "branch", "source_class", "source_method", *target)
    else:
        n = _nodes(spark, d)
        side = lambda p: n.select(F.col("node_id").alias(p), F.col("class_name").alias("source_class" if p == "src" else "target_class"), F.col("method_name").alias("source_method" if p == "src" else "target_method"), *(["project_id", "branch"] if p == "src" else []))
        rows = _rels(spark, d).where("type = 'IMPLEMENT'").join(side("src"), "src").join(side("dst"), "dst")
        rows = rows.select(F.lit("IMPLEMENT").alias("kind"), "project_id", "branch", "source_class", "source_method", "target_class", "target_method").where("source_method is null" if kind == "implement_class" else "source_method is not null")
    return rows.distinct().join(_main(spark, d), "project_id").withColumn("base_branch", F.lit("develop"))


_ASKED = {
    "call": "SELECT DISTINCT project_id, branch, class_name AS source_class, method_name AS source_method, NULL AS target_class, t AS target_method FROM (SELECT *, unnest(method_calls) AS t FROM method_deps)",
    "use": "SELECT DISTINCT project_id, branch, class_name AS source_class, method_name AS source_method, t AS target_class, NULL AS target_method FROM (SELECT *, unnest(used_types) AS t FROM method_deps)",
    "implement_class": "SELECT DISTINCT s.project_id, s.branch, s.class_name AS source_class, s.method_name AS source_method, t.class_name AS target_class, t.method_name AS target_method FROM rels r JOIN nodes_ s ON s.node_id = r.src JOIN nodes_ t ON t.node_id = r.dst WHERE r.type = 'IMPLEMENT' AND s.method_name IS NULL",
    "implement_method": "SELECT DISTINCT s.project_id, s.branch, s.class_name AS source_class, s.method_name AS source_method, t.class_name AS target_class, t.method_name AS target_method FROM rels r JOIN nodes_ s ON s.node_id = r.src JOIN nodes_ t ON t.node_id = r.dst WHERE r.type = 'IMPLEMENT' AND s.method_name IS NOT NULL",
}


def _end_sql(alias: str, on: dict, side: str, branch: str) -> str:
    level = f"{alias}.method_name IS NOT NULL" if "method" in on else f"{alias}.method_name IS NULL"
    same = " AND ".join(f"{alias}.{k}_name = a.{side}_{k}" for k in on)
    return f"{alias}.project_id = a.project_id AND {alias}.branch = {branch} AND {same} AND {level}"


def _resolve_sql(rule: str, policy: str) -> str:
    source, target, source_too = edges.RULES[rule]
    asked = _ASKED["use" if rule.startswith("use") else rule]
    kind = rule.split("_")[0].upper()
    head = f"WITH {_N}, {_R}, a AS (SELECT q.*, p.main_branch, 'develop' AS base_branch FROM ({asked}) q JOIN projects p USING (project_id))"
    if policy != "fallback":
        to = "a.branch" if policy == "same" else "a.main_branch"
        return f"{head} SELECT DISTINCT s.node_id AS src, t.node_id AS dst, '{kind}' AS type FROM a JOIN nodes_ s ON {_end_sql('s', source, 'source', 'a.branch')} JOIN nodes_ t ON {_end_sql('t', target, 'target', to)}"
    joins, src = f"JOIN nodes_ s ON {_end_sql('s', source, 'source', 'a.branch')}", "s.node_id"
    if source_too:
        joins = f"LEFT JOIN nodes_ sb ON {_end_sql('sb', source, 'source', 'a.base_branch')} LEFT JOIN nodes_ sm ON {_end_sql('sm', source, 'source', 'a.main_branch')}"
        src = "coalesce(sb.node_id, sm.node_id)"
    joins += f" LEFT JOIN nodes_ tb ON {_end_sql('tb', target, 'target', 'a.base_branch')} LEFT JOIN nodes_ tm ON {_end_sql('tm', target, 'target', 'a.main_branch')}"
    dst = "coalesce(tb.node_id, tm.node_id)"
    return f"{head} SELECT DISTINCT {src} AS src, {dst} AS dst, '{kind}' AS type FROM a {joins} WHERE {src} IS NOT NULL AND {dst} IS NOT NULL"


def _edge_query(name: str, rule: str, policy: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return edges.resolve_rule(_asked(spark, d, rule), _nodes(spark, d), rule, policy)

    run.__name__ = name
    query(_resolve_sql(rule, policy))(run)


for _name, _rule, _policy in (
    ("call_edges_same_branch", "call", "same"), ("call_edges_fallback", "call", "fallback"), ("call_edges_main_only", "call", "main"),
    ("implement_class", "implement_class", "same"), ("implement_class_fallback", "implement_class", "fallback"), ("implement_method", "implement_method", "same"), ("implement_method_fallback", "implement_method", "fallback"),
    ("use_class", "use_class", "same"), ("use_class_fallback", "use_class", "fallback"), ("use_method", "use_method", "same"), ("use_method_fallback", "use_method", "fallback"),
):
    _edge_query(_name, _rule, _policy)


# ---- lookups and projections -----------------------------------------------------------------------------------------

@query("SELECT id AS node_id, class_name, method_name, label FROM nodes WHERE project_id = '101' AND branch = 'main'")
def node_scan_by_property(spark, d):
    return lookup.nodes_by_condition(_nodes(spark, d), 101, "main").select("node_id", "class_name", "method_name", "label")


@query("SELECT id AS node_id, class_name, method_name FROM nodes WHERE project_id = '101' AND branch = 'main' AND class_name = (SELECT min(class_name) FROM nodes WHERE project_id = '101' AND branch = 'main')")
def node_scan_optional_params(spark, d):
    n = _nodes(spark, d)
    first = n.where("project_id = '101' and branch = 'main'").agg(F.min("class_name")).head()[0]
    return lookup.nodes_by_condition(n, "101", "main", class_name=first).select("node_id", "class_name", "method_name")


@query("SELECT id AS node_id, class_name, method_name FROM nodes WHERE label = 'ConfigurationNode' AND project_id = '101' AND branch = 'main'")
def config_nodes_sorted(spark, d):
    return lookup.config_nodes(_nodes(spark, d), 101, "main").select("node_id", "class_name", "method_name")


@query("SELECT n.id AS node_id, n.class_name, n.method_name, n.label FROM (SELECT DISTINCT project_id, branch, class_name, method_name FROM tombstones) s JOIN nodes n ON n.project_id = s.project_id AND n.branch = s.branch AND n.class_name = s.class_name AND (s.method_name IS NULL OR n.method_name = s.method_name)")
def node_spec_lookup(spark, d):
    specs = table(spark, d, "tombstones").select("project_id", "branch", "class_name", "method_name").distinct().withColumn("pull_request_id", F.lit(None).cast("string"))
    return lookup.nodes_by_specs(_nodes(spark, d), specs).select("node_id", "class_name", "method_name", "label")


@query("""SELECT ctx_id, full_class_name AS class_name, NULL AS method_name, CASE WHEN is_config THEN 'ConfigurationNode' ELSE 'ClassNode' END AS label FROM class_contexts
UNION ALL SELECT ctx_id, full_class_name, m, CASE WHEN is_config THEN 'ConfigurationNode' WHEN contains(lower(m), 'endpoint') THEN 'EndpointNode' ELSE 'MethodNode' END FROM (SELECT *, unnest(methods) AS m FROM class_contexts)""")
def node_label_projection(spark, d):
    c = table(spark, d, "class_contexts").withColumn("type", F.when(F.col("is_config"), "configuration").otherwise("regular"))
    classes = c.select("ctx_id", F.col("full_class_name").alias("class_name"), F.lit(None).cast("string").alias("method_name"), nodes.class_label(F.col("type")).alias("label"))
    m = c.select("ctx_id", F.col("full_class_name").alias("class_name"), F.explode("methods").alias("method_name"), "type")
    kind = F.when((F.col("type") == "regular") & F.lower("method_name").contains("endpoint"), "rest_endpoint").otherwise(F.col("type"))
    return classes.unionByName(m.select("ctx_id", "class_name", "method_name", nodes.method_label(kind).alias("label")))


def _escape_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({x}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"


@query(f"SELECT doc_id, {_escape_sql('text')} AS escaped FROM documents")
def cypher_escape_text(spark, d):
    return table(spark, d, "documents").select("doc_id", names.escape_text(F.col("text")).alias("escaped"))


@query("SELECT n.id AS node_id, CASE WHEN n.branch IS DISTINCT FROM p.main_branch THEN n.pull_request_id END AS tag FROM nodes n JOIN projects p USING (project_id)")
def pr_tagging(spark, d):
    return _nodes(spark, d).join(_main(spark, d), "project_id").select("node_id", nodes.request_tag(F.col("pull_request_id"), F.col("branch"), F.col("main_branch")).alias("tag"))


@query("SELECT id AS node_id, coalesce(nullif(version, ''), 'unknown') AS version, CASE WHEN coalesce(base_branch, '') <> '' AND coalesce(base_version, '') <> '' THEN coalesce(status, 'ACTIVE') ELSE 'ACTIVE' END AS status FROM nodes")
def version_status_defaults(spark, d):
    return _nodes(spark, d).select("node_id", nodes.version_or_default(F.col("version")).alias("version"), nodes.status_or_default(F.col("status"), F.col("base_branch"), F.col("base_version")).alias("status"))


@query("SELECT coalesce(node_type, CASE WHEN method_name IS NULL THEN 'ClassNode' ELSE 'MethodNode' END) AS label, name, class_name, method_name, '[DELETED] ' || CASE WHEN method_name IS NULL THEN class_name ELSE class_name || '.' || method_name END AS content, ast_hash, project_id, branch, 'DELETED' AS status FROM tombstones")
def tombstones(spark, d):
    return nodes.tombstone_nodes(table(spark, d, "tombstones"))


@query("SELECT id AS node_id, CASE WHEN method_name IS NULL THEN class_name ELSE class_name || '.' || method_name END AS key FROM nodes")
def node_key(spark, d):
    return _nodes(spark, d).select("node_id", names.node_key(F.col("class_name"), F.col("method_name")).alias("key"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_BUILTIN = f"(list_contains({_list_sql(filters.builtin_names())}, t) OR len(list_filter({_list_sql(filters.BUILTIN_PACKAGES)}, lambda p: t = p OR starts_with(t, p || '.'))) > 0 OR starts_with(t, 'contents'))"


@query(f"WITH r AS (SELECT row_number() OVER () AS k, dep_id, used_types FROM method_deps), x AS (SELECT k, unnest(used_types) AS t, generate_subscripts(used_types, 1) AS i FROM r), f AS (SELECT k, t, min(i) AS i FROM x WHERE t IS NOT NULL AND NOT {_BUILTIN} GROUP BY k, t) SELECT r.dep_id, coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM f WHERE f.k = r.k), '') AS kept FROM r")
def builtin_name_filter(spark, d):
    return table(spark, d, "method_deps").select("dep_id", F.coalesce(F.array_join(filters.project_names(F.col("used_types")), "|"), F.lit("")).alias("kept"))


@query(f"SELECT DISTINCT t AS name, (list_contains({_list_sql(filters.builtin_names())}, t) OR len(list_filter({_list_sql(filters.EXCLUDED_STARTS)}, lambda p: starts_with(t, p))) > 0) AS primitive FROM (SELECT unnest(used_types) AS t FROM method_deps) WHERE t IS NOT NULL")
def primitive_check(spark, d):
    return table(spark, d, "method_deps").select(F.explode("used_types").alias("name")).where("name is not null").distinct().select("name", filters.is_primitive(F.col("name")).alias("primitive"))


@query(f"SELECT DISTINCT t AS name, len(list_filter({_list_sql(filters.FRAMEWORK_STARTS)}, lambda p: starts_with(t, p))) > 0 AS framework FROM (SELECT unnest(used_types) AS t FROM method_deps) WHERE t IS NOT NULL")
def framework_filter(spark, d):
    return table(spark, d, "method_deps").select(F.explode("used_types").alias("name")).where("name is not null").distinct().select("name", filters.is_framework(F.col("name")).alias("framework"))


@query(f"SELECT file_id, len(list_filter({_list_sql(filters.CONFIG_MARKERS)}, lambda m: contains(content, m))) > 0 AS marked, len(list_filter({_list_sql(filters.LOMBOK_MARKERS)}, lambda m: contains(content, m))) > 0 AS lombok FROM source_files")
def config_marker_predicate(spark, d):
    return table(spark, d, "source_files").select("file_id", filters.has_marker(F.col("content"), filters.CONFIG_MARKERS).alias("marked"), filters.has_marker(F.col("content"), filters.LOMBOK_MARKERS).alias("lombok"))


# ---- what is new ------------------------------------------------------------------------------------------------------

def _requested(spark: SparkSession, d: str) -> DataFrame:
    """Rows of branches other than the main one, as if they came in; their base is the branch named in the row."""
    n = _nodes(spark, d).select("node_id", "project_id", "branch", "class_name", "method_name", "ast_hash", F.coalesce("base_branch", F.lit("develop")).alias("base_branch"))
    return n.join(_main(spark, d), "project_id").where("branch <> main_branch")


_REQUESTED = f"{_N}, q AS (SELECT n.node_id, n.project_id, n.branch, n.class_name, n.method_name, n.ast_hash, coalesce(n.base_branch, 'develop') AS base_branch, p.main_branch FROM nodes_ n JOIN projects p USING (project_id) WHERE n.branch <> p.main_branch)"


@query(f"""WITH {_REQUESTED} SELECT q.node_id, q.class_name, q.method_name, q.ast_hash FROM q
LEFT JOIN nodes_ b ON b.project_id = q.project_id AND b.branch = q.base_branch AND b.class_name = q.class_name AND b.method_name = q.method_name
LEFT JOIN nodes_ m ON m.project_id = q.project_id AND m.branch = q.main_branch AND m.class_name = q.class_name AND m.method_name = q.method_name
WHERE (b.node_id IS NOT NULL AND q.ast_hash <> b.ast_hash) OR (b.node_id IS NULL AND m.node_id IS NOT NULL AND q.ast_hash <> m.ast_hash) OR (b.node_id IS NULL AND m.node_id IS NULL)""")
def delta_create_main_base(spark, d):
    return nodes.delta(_requested(spark, d), _nodes(spark, d)).select("node_id", "class_name", "method_name", "ast_hash")


@query(f"""WITH {_REQUESTED} SELECT q.node_id, q.class_name, q.method_name, q.ast_hash FROM q
LEFT JOIN nodes_ m ON m.project_id = q.project_id AND m.branch = q.main_branch AND m.class_name = q.class_name AND m.method_name = q.method_name AND m.ast_hash <> q.ast_hash""")
def delta_create_main_only(spark, d):
    return nodes.against_main(_requested(spark, d), _nodes(spark, d)).select("node_id", "class_name", "method_name", "ast_hash")


_GONE = "gone AS (SELECT n.node_id FROM nodes_ n WHERE n.pull_request_id IS NULL AND EXISTS (SELECT 1 FROM method_deps k WHERE k.project_id = n.project_id AND k.branch = n.branch AND k.class_name = n.class_name AND k.method_name IS NOT DISTINCT FROM n.method_name))"


@query(f"WITH {_N}, {_R}, {_GONE} SELECT 'node' AS what, node_id AS a, -1 AS b, label AS type FROM nodes_ WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL SELECT 'edge', src, dst, type FROM rels WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def replace_delete(spark, d):
    left_nodes, left_rels = nodes.without_replaced(_nodes(spark, d), _rels(spark, d), table(spark, d, "method_deps"))
    kept = left_nodes.select(F.lit("node").alias("what"), F.col("node_id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("label").alias("type"))
    return kept.unionByName(left_rels.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), "type"))


# ---- branches ---------------------------------------------------------------------------------------------------------

def _copying(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and the mapping of each project's main rows onto the first other branch it has rows of."""
    n = _nodes(spark, d)
    to = n.join(_main(spark, d), "project_id").where("branch <> main_branch").groupBy("project_id", "main_branch").agg(F.min("branch").alias("to_branch"))
    with_main = n.join(to, "project_id")
    key = names.node_key(F.col("class_name"), F.col("method_name"))
    changed = with_main.where("branch = to_branch").groupBy("project_id", key.alias("key")).agg(F.max("ast_hash").alias("hash"))
    return n, _rels(spark, d), branches.mapping(with_main, changed)


_MAPPED = f"""{_N}, {_R}, way AS (SELECT n.project_id, p.main_branch, min(n.branch) AS to_branch FROM nodes n JOIN projects p USING (project_id) WHERE n.branch <> p.main_branch GROUP BY ALL),
keyed AS (SELECT n.*, w.main_branch, w.to_branch, CASE WHEN method_name IS NULL THEN class_name ELSE class_name || '.' || method_name END AS key FROM nodes_ n JOIN way w USING (project_id)),
changed AS (SELECT project_id, key, max(ast_hash) AS hash FROM keyed WHERE branch = to_branch GROUP BY ALL),
mapped AS (SELECT k.project_id, k.node_id AS old_id, k.to_branch FROM keyed k LEFT JOIN changed c ON c.project_id = k.project_id AND c.key = k.key
  WHERE k.branch = k.main_branch AND k.pull_request_id IS NULL AND (c.key IS NULL OR k.ast_hash = c.hash))"""


def _old(mapped: DataFrame, end: str) -> DataFrame:
    return mapped.select(F.col("new_id").alias(end), F.col("old_id").alias(f"{end}_of"))


@query(f"WITH {_MAPPED} SELECT n.node_id AS copy_of, n.class_name, n.method_name, n.ast_hash, m.to_branch AS branch FROM mapped m JOIN nodes_ n ON n.node_id = m.old_id")
def copy_nodes(spark, d):
    n, _, mapped = _copying(spark, d)
    copies = branches.copy_nodes(n, mapped)
    return copies.join(_old(mapped, "node_id"), "node_id").select(F.col("node_id_of").alias("copy_of"), "class_name", "method_name", "ast_hash", "branch")


@query(f"WITH {_MAPPED} SELECT r.src AS src_of, r.dst AS dst_of, r.type FROM rels r JOIN mapped s ON s.old_id = r.src JOIN mapped t ON t.old_id = r.dst")
def copy_internal_edges(spark, d):
    _, rels, mapped = _copying(spark, d)
    return branches.copy_internal(rels, mapped).join(_old(mapped, "src"), "src").join(_old(mapped, "dst"), "dst").select("src_of", "dst_of", "type")


def _cross_sql(near: str, far: str) -> str:
    return f"""WITH {_MAPPED} SELECT m.old_id AS {near}_of, h.node_id AS {far}, r.type FROM rels r JOIN mapped m ON m.old_id = r.{near} JOIN nodes_ o ON o.node_id = r.{far} AND o.pull_request_id IS NULL
JOIN nodes_ h ON h.project_id = m.project_id AND h.branch = m.to_branch AND h.class_name = o.class_name AND h.method_name IS NOT DISTINCT FROM o.method_name WHERE r.{far} NOT IN (SELECT old_id FROM mapped)"""


@query(_cross_sql("src", "dst"))
def copy_cross_edges(spark, d):
    n, rels, mapped = _copying(spark, d)
    return branches.copy_cross(rels, n, mapped).join(_old(mapped, "src"), "src").select("src_of", "dst", "type")


@query(_cross_sql("dst", "src"))
def copy_reverse_edges(spark, d):
    n, rels, mapped = _copying(spark, d)
    return branches.copy_cross(rels, n, mapped, reverse=True).join(_old(mapped, "dst"), "dst").select("src", "dst_of", "type")


@query("SELECT DISTINCT node_id AS old_id, node_id + 1 AS new_id FROM tombstones WHERE node_id NOT IN (SELECT id FROM nodes) AND node_id + 1 NOT IN (SELECT id FROM nodes)")
def orphan_mappings(spark, d):
    mapped = table(spark, d, "tombstones").select(F.col("node_id").alias("old_id"), (F.col("node_id") + 1).alias("new_id")).distinct()
    return branches.orphan_mappings(mapped, _nodes(spark, d)).select("old_id", "new_id")


_SAVED = f"""{_N}, {_R}, keyed AS (SELECT *, CASE WHEN method_name IS NULL THEN class_name ELSE class_name || '.' || method_name END AS key FROM nodes_ WHERE pull_request_id IS NULL),
inside AS (SELECT DISTINCT project_id, branch, class_name || '.' || method_name AS key FROM method_deps WHERE method_name IS NOT NULL),
saved AS (SELECT s.project_id, s.branch, s.class_name AS src_class, s.method_name AS src_method, r.type, t.class_name AS dst_class, t.method_name AS dst_method
  FROM rels r JOIN keyed s ON s.node_id = r.src JOIN keyed t ON t.node_id = r.dst AND t.project_id = s.project_id AND t.branch = s.branch
  WHERE EXISTS (SELECT 1 FROM inside i WHERE i.project_id = t.project_id AND i.branch = t.branch AND i.key = t.key) AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.project_id = s.project_id AND i.branch = s.branch AND i.key = s.key))"""


def _saved(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "method_deps").where("method_name is not null").select("project_id", "branch", names.node_key(F.col("class_name"), F.col("method_name")).alias("key"))
    return branches.save_boundary(_nodes(spark, d), _rels(spark, d), changed)


@query(f"WITH {_SAVED} SELECT * FROM saved")
def save_boundary(spark, d):
    return _saved(spark, d)


@query(f"""WITH {_SAVED} SELECT s.node_id AS src, t.node_id AS dst, v.type FROM saved v
JOIN keyed s ON s.project_id = v.project_id AND s.branch = v.branch AND s.class_name = v.src_class AND s.method_name IS NOT DISTINCT FROM v.src_method
JOIN keyed t ON t.project_id = v.project_id AND t.branch = v.branch AND t.class_name = v.dst_class AND t.method_name IS NOT DISTINCT FROM v.dst_method""")
def restore_boundary(spark, d):
    return branches.restore_boundary(_nodes(spark, d), _saved(spark, d))


@query("SELECT id AS node_id FROM (SELECT id, row_number() OVER (PARTITION BY project_id, branch, class_name, method_name ORDER BY id) AS k FROM nodes WHERE pull_request_id IS NULL) WHERE k > 1")
def duplicate_nodes(spark, d):
    return edges.duplicate_nodes(_nodes(spark, d))


@query(f"WITH {_R} SELECT DISTINCT src, dst, type FROM rels")
def duplicate_edges(spark, d):
    return edges.without_duplicates(_rels(spark, d))


@query(f"WITH {_R} SELECT src, dst, type, count(*) AS copies FROM rels GROUP BY ALL HAVING count(*) > 1")
def duplicate_edge_groups(spark, d):
    return edges.duplicate_groups(_rels(spark, d))


@query(f"WITH {_N}, {_R}, e AS ({_resolve_sql('call', 'same').split('JOIN projects p USING (project_id))')[1].replace('FROM a ', 'FROM (' + _ASKED['call'] + ') a ')}) SELECT DISTINCT src, dst, type FROM rels UNION SELECT src, dst, type FROM e")
def edge_union_merge(spark, d):
    return edges.merge(_rels(spark, d), edges.resolve_rule(_asked(spark, d, "call"), _nodes(spark, d), "call"))


@query(f"WITH {_N}, {_R}, gone AS (SELECT node_id FROM nodes_ WHERE project_id = '101' AND branch = 'main') SELECT src, dst, type FROM rels WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def delete_branch(spark, d):
    return branches.delete_branch(_nodes(spark, d), _rels(spark, d), 101, "main")[1]


@query("SELECT id AS node_id, class_name, method_name FROM nodes WHERE NOT coalesce(project_id = '101' AND branch = (SELECT min_by(branch, id) FROM nodes WHERE project_id = '101' AND pull_request_id IS NOT NULL) AND pull_request_id = (SELECT min_by(pull_request_id, id) FROM nodes WHERE project_id = '101' AND pull_request_id IS NOT NULL), false)")
def delete_branch_pr(spark, d):
    n = _nodes(spark, d)
    first = n.where("project_id = '101' and pull_request_id is not null").agg(F.min_by("branch", "node_id"), F.min_by("pull_request_id", "node_id")).head()
    return branches.delete_branch(n, _rels(spark, d), "101", first[0] or "", first[1] or "")[0].select("node_id", "class_name", "method_name")


@query("SELECT count(*) AS deleted FROM nodes WHERE project_id = '101' AND branch = 'main'")
def delete_branch_count(spark, d):
    return branches.delete_branch(_nodes(spark, d), _rels(spark, d), 101, "main")[2].agg(F.count(F.lit(1)).alias("deleted"))


# ---- traversal --------------------------------------------------------------------------------------------------------

def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("node_id % 50 = 0").select("node_id")


def _walk_sql(directions: str) -> str:
    parts = []
    for step in directions.split("|"):
        kind, (a, b) = step.strip("<>"), ("src", "dst") if step.endswith(">") else ("dst", "src")
        parts.append(f"SELECT {a} AS node, {b} AS next, type FROM rels WHERE type = '{kind}'")
    return f"""WITH RECURSIVE {_R}, steps AS ({' UNION '.join(parts)}),
walk AS (SELECT id AS seed, id AS node, 0 AS depth FROM nodes WHERE id % 50 = 0 UNION SELECT w.seed, s.next, w.depth + 1 FROM walk w JOIN steps s ON s.node = w.node WHERE w.depth < 20),
reached AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node)"""


def _closure_sql(directions: str) -> str:
    return _walk_sql(directions) + " SELECT seed, node, depth FROM reached WHERE depth > 0"


_PATHS = _walk_sql(traverse.DOWNSTREAM) + """,
way AS (SELECT r.seed, r.node, r.depth, min({'type': s.type, 'via': s.node}) AS w FROM reached r JOIN steps s ON s.next = r.node JOIN reached v ON v.seed = r.seed AND v.node = s.node AND v.depth = r.depth - 1 GROUP BY ALL),
paths AS (SELECT seed, node, 0 AS depth, [{'node': node, 'type': ''}] AS path FROM reached WHERE depth = 0
  UNION ALL SELECT w.seed, w.node, w.depth, list_append(p.path, {'node': w.node, 'type': w.w.type}) FROM paths p JOIN way w ON w.seed = p.seed AND w.w.via = p.node AND w.depth = p.depth + 1)"""


@query(_closure_sql(traverse.DOWNSTREAM))
def downstream_closure(spark, d):
    return traverse.closure(_seeds(spark, d), _rels(spark, d), traverse.DOWNSTREAM)


@query(_closure_sql(traverse.UPSTREAM))
def upstream_closure(spark, d):
    return traverse.closure(_seeds(spark, d), _rels(spark, d), traverse.UPSTREAM)


@query("SELECT DISTINCT n.id AS node_id FROM nodes n JOIN tombstones t ON t.project_id = n.project_id AND t.branch = n.branch AND t.class_name = n.class_name AND t.method_name IS NOT DISTINCT FROM n.method_name")
def traversal_seeds(spark, d):
    return traverse.seeds(_nodes(spark, d), table(spark, d, "tombstones"))


@query(_PATHS + """, each AS (SELECT seed, node, k - 2 AS step, path[k] AS s, path[k - 1].node AS previous FROM (SELECT *, unnest(range(2, len(path) + 1)) AS k FROM paths))
SELECT e.seed, e.node, CAST(e.step AS INTEGER) AS step, e.s.node AS visited FROM each e JOIN nodes n ON n.id = e.s.node JOIN nodes b ON b.id = e.previous
WHERE (e.s.type = 'CALL' AND n.method_name IS NOT NULL OR e.s.type IN ('IMPLEMENT', 'EXTEND', 'BRANCH') OR e.s.type = 'USE' AND n.method_name IS NULL)
  AND NOT coalesce(e.s.type = 'BRANCH' AND b.branch = 'main' AND n.branch = 'develop', false)""")
def traversal_visited_nodes(spark, d):
    return traverse.visits(_seeds(spark, d), _rels(spark, d), _nodes(spark, d))


@query(_PATHS + " SELECT seed, node, CAST(len(path) - 1 AS INTEGER) AS total_length, array_to_string(list_transform(path[2:], lambda s: s.type || ':' || s.node), ' ') AS summary FROM paths WHERE depth > 0")
def traversal_path_summary(spark, d):
    return traverse.summaries(_seeds(spark, d), _rels(spark, d))


@query(f"WITH {_N}, {_R} SELECT r.src, r.dst, s.class_name AS src_class, s.method_name AS src_method, t.class_name AS dst_class, t.method_name AS dst_method FROM rels r JOIN nodes_ s ON s.node_id = r.src JOIN nodes_ t ON t.node_id = r.dst WHERE r.type = 'CALL' AND s.label = 'EndpointNode'")
def one_hop_pattern(spark, d):
    return lookup.one_hop(_nodes(spark, d), _rels(spark, d), "CALL", source=F.col("label") == "EndpointNode")


@query(f"WITH {_R} SELECT dst, count(*) AS degree FROM rels WHERE type = 'CALL' GROUP BY dst ORDER BY degree DESC, dst LIMIT 10")
def call_degree_topk(spark, d):
    return edges.degrees(_rels(spark, d), "CALL", 10)


# ---- names, texts, endpoints --------------------------------------------------------------------------------------------

_WS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), '\\( +', '(', 'g'), ' +\\)', ')', 'g'), '< +', '<', 'g'), ' +>', '>', 'g')"


@query(f"SELECT doc_id, {_WS.replace('{x}', 'text')} AS text FROM documents")
def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", names.normalize_whitespace(F.col("text")).alias("text"))


@query(r"SELECT id AS node_id, regexp_replace(replace(regexp_replace(replace(file_path, '\', '/'), '\.java$', ''), '/', '.'), '^src\.main\.java\.', '') AS name FROM nodes")
def path_to_package(spark, d):
    return _nodes(spark, d).select("node_id", names.package_of_path(F.col("file_path")).alias("name"))


@query("SELECT id AS node_id, split_part(class_name, '.', -1) AS simple, split_part(split_part(method_name, '(', 1), '.', -1) AS method FROM nodes")
def fqn_and_simple_name(spark, d):
    return _nodes(spark, d).select("node_id", names.simple_name(F.col("class_name")).alias("simple"), names.simple_method_name(F.col("method_name")).alias("method"))


@query("""WITH known AS (SELECT full_class_name, max_by({'p': package, 'c': class_name}, ctx_id) AS s FROM class_contexts GROUP BY full_class_name),
near AS (SELECT s.p AS package, s.c AS name, min(full_class_name) AS near FROM known GROUP BY ALL), lone AS (SELECT s.c AS name, min(full_class_name) AS lone FROM known GROUP BY s.c HAVING count(*) = 1),
refs AS (SELECT ctx_id, package, import_mapping, unnest(list_distinct(list_concat(coalesce(map_keys(import_mapping), []), [class_name]))) AS name FROM class_contexts)
SELECT r.ctx_id, r.name, coalesce(r.import_mapping[r.name], n.near, o.lone) AS found FROM refs r LEFT JOIN near n ON n.package = r.package AND n.name = r.name LEFT JOIN lone o ON o.name = r.name""")
def import_lookup(spark, d):
    c = table(spark, d, "class_contexts").withColumnRenamed("ctx_id", "file_id").withColumn("kind", F.lit("class")).withColumn("is_abstract", F.lit(False))
    own = F.array_distinct(F.concat(F.coalesce(F.map_keys("import_mapping"), F.array().cast("array<string>")), F.array("class_name")))
    refs = c.select("file_id", "package", F.col("import_mapping").alias("imports"), F.explode(own).alias("name"))
    return symbols.resolve_types(refs, symbols.symbols(c)).select(F.col("file_id").alias("ctx_id"), "name", F.col("resolved").alias("found"))


@query(r"""WITH p AS (SELECT id, split_part(replace(file_path, '\', '/'), '/', 1) || '/' AS a, substr(replace(file_path, '\', '/'), length(split_part(replace(file_path, '\', '/'), '/', 1)) + 1) AS b FROM nodes WHERE file_path IS NOT NULL)
SELECT id AS node_id, CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE regexp_replace(a, '/+$', '') || '/' || regexp_replace(b, '^/+', '') END AS path FROM p""")
def merge_paths(spark, d):
    n = _nodes(spark, d).where("file_path is not null").select("node_id", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("f"))
    first = F.substring_index("f", "/", 1)
    return n.select("node_id", names.merge_paths(F.concat(first, F.lit("/")), F.substr("f", F.length(first) + 1)).alias("path"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", names.text_hash(F.col("text")).alias("hash"))


#: Annotations as sources have them, with `~` for a class's name: kind, text, class's annotations, method's annotations, return type, parameters, and the endpoints (type, path, consumes) they stand for.
ANNOTATIONS = [
    ("get", '@GetMapping("/~/{id}")', '@RestController @RequestMapping("/api/")', "", "~", "(int id)", [("GET", "/api/~/{id}", "")]),
    ("request", '@RequestMapping(value = "/r/~", method = RequestMethod.PUT)', "@RestController", "", "Mono<~>", "()", [("PUT_REACTIVE", "/r/~", "")]),
    ("any", '@RequestMapping("~")', "@RestController", "", "void", "()", [("REQUEST", "~", "")]),
    ("hidden", '@PostMapping("/~")', "@Controller", "", "String", "()", []),
    ("body", '@PostMapping("/~")', "@Controller", "@ResponseBody", "String", "()", [("POST", "/~", "")]),
    ("handler", "@ExceptionHandler({~Error.class, Other.class})", "@RestControllerAdvice", "", "void", "()", [("REST_EXCEPTION_HANDLER", "[~Error, Other]", "")]),
    ("handler1", "@ExceptionHandler(~Error.class)", "@ControllerAdvice", "", "void", "()", [("EXCEPTION_HANDLER", "~Error", "")]),
    ("jaxrs", "@GET", '@Path("/~/")', '@GET @Path("/{id}")', "~", "()", [("GET", "/~/{id}", "")]),
    ("kafka", '@KafkaListener(id = "x", topics = {"~.a", "~.b"})', "", "", "void", "()", [("KAFKA_CONSUMER", "", "~.a"), ("KAFKA_CONSUMER", "", "~.b")]),
    ("kafka1", '@KafkaListener("~")', "", "", "void", "()", [("KAFKA_CONSUMER", "", "~")]),
    ("kafkap", '@KafkaListener(topicPattern = "~.*")', "", "", "void", "()", [("KAFKA_CONSUMER", "", "PATTERN:~.*")]),
    ("rabbit", '@RabbitListener(queues = {"~","q2"})', "", "", "void", "()", [("RABBIT_CONSUMER", "", "~"), ("RABBIT_CONSUMER", "", "q2")]),
    ("rabbit1", "@RabbitListener(queues = '~')", "", "", "void", "()", [("RABBIT_CONSUMER", "", "~")]),
    ("event", "@EventListener(classes = {~.class, B.class})", "", "", "void", "()", [("SPRING_EVENT_CONSUMER", "", "~"), ("SPRING_EVENT_CONSUMER", "", "B")]),
    ("event1", "@EventListener", "", "", "void", "(x.y.~ event)", [("SPRING_EVENT_CONSUMER", "", "~")]),
    ("none", "@Override", "", "", "void", "()", []),
]


def _endpoint_query(name: str, build) -> None:
    """Every class of the table with every annotation: what the extractor `name` finds."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        part = lambda text: F.replace(F.lit(text), F.lit("~"), F.col("n"))
        each = F.array(*[F.struct(F.lit(a[0]).alias("kind"), *[part(x).alias(f"x{k}") for k, x in enumerate(a[1:6])]) for a in ANNOTATIONS])
        rows = table(spark, d, "class_contexts").select("ctx_id", F.regexp_replace(F.coalesce("class_name", F.lit("X")), "[^A-Za-z0-9]", "").alias("n")).select("ctx_id", F.explode(each).alias("a"))
        found = build(*[F.col(f"a.x{k}") for k in range(5)])
        return rows.select("ctx_id", F.col("a.kind").alias("kind"), F.explode(found).alias("e")).select("ctx_id", "kind", F.col("e.type").alias("type"), F.col("e.path").alias("path"), F.col("e.consumes").alias("consumes"))

    run.__name__ = name
    of = {"spring_endpoints": ("get", "request", "any", "hidden", "body"), "exception_handlers": ("handler", "handler1"), "jaxrs_endpoints": ("jaxrs",), "kafka_topics": ("kafka", "kafka1", "kafkap"), "rabbit_queues": ("rabbit", "rabbit1"), "event_listeners": ("event", "event1")}
    values = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (a[0], *e)) + ")" for a in ANNOTATIONS if a[0] in of.get(name, [x[0] for x in ANNOTATIONS]) for e in a[6])
    query(f"""WITH c AS (SELECT ctx_id, regexp_replace(coalesce(class_name, 'X'), '[^A-Za-z0-9]', '', 'g') AS n FROM class_contexts)
SELECT ctx_id, kind, replace(type, '~', n) AS type, replace(path, '~', n) AS path, replace(consumes, '~', n) AS consumes FROM c, (VALUES {values}) v(kind, type, path, consumes)""")(run)


_endpoint_query("spring_endpoints", lambda t, c, m, r, p: endpoints.spring_mapping(t, c, m, r))
_endpoint_query("exception_handlers", lambda t, c, m, r, p: endpoints.spring_exception_handler(t, c))
_endpoint_query("jaxrs_endpoints", lambda t, c, m, r, p: endpoints.jaxrs(t, c, m))
_endpoint_query("kafka_topics", lambda t, c, m, r, p: endpoints.kafka(t))
_endpoint_query("rabbit_queues", lambda t, c, m, r, p: endpoints.rabbit(t))
_endpoint_query("event_listeners", lambda t, c, m, r, p: endpoints.spring_event(t, p))
_endpoint_query("all_endpoints", endpoints.endpoints)


# ---- imports and extraction -----------------------------------------------------------------------------------------------

def _end_state(store: importing.Store) -> DataFrame:
    side = lambda p: store.nodes.select(F.col("node_id").alias(p), F.col("class_name").alias(f"{p}_class"), F.coalesce("method_name", F.lit("")).alias(f"{p}_method"), F.col("ast_hash").alias(f"{p}_hash"))
    return store.rels.join(side("src"), "src").join(side("dst"), "dst").select("src_class", "src_method", "type", "dst_class", "dst_method", "dst_hash")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every Java file; of equally late ones that of the smallest hash."""
    files = table(spark, d, "source_files").where(F.lower("file_path").endswith(".java") & F.col("file_id").isNotNull())
    order = F.struct(F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp")), F.xxhash64("file_path", "content"))
    return files.groupBy("file_id").agg(F.max_by(F.struct("file_path", "content"), order).alias("r")).select("file_id", "r.*")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return java_facts.extract(_sources(spark, d))


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts, written once, and their symbols."""
    classes = cut(_classes(spark, d))
    return classes, symbols.symbols(classes)


@query()
def source_chunks(spark, d):
    return chunks.build(_classes(spark, d), 1, "main", _sources(spark, d))


@query()
def source_import(spark, d):
    empty = importing.Store(spark.createDataFrame([], NODE), spark.createDataFrame([], REL))
    return _end_state(importing.import_incremental(empty, cut(source_chunks(spark, d)), importing.Options(main_branch="main")))


@query()
def java_chunks(spark, d):
    return _classes(spark, d).select("file_id", "package", "kind", "full_class_name", "parent_class", "is_nested", F.size("methods").alias("methods"), F.size("imports").alias("imports"))


@query()
def ast_shape_hash(spark, d):
    return _classes(spark, d).select("full_class_name", F.explode("methods").alias("m")).select("full_class_name", F.col("m.signature").alias("signature"), F.col("m.shape").alias("shape"))


@query()
def class_annotations(spark, d):
    return _classes(spark, d).select("full_class_name", F.explode("annotations").alias("annotation"))


@query()
def method_calls(spark, d):
    return symbols.known_calls(_classes(spark, d))


@query()
def class_used_types(spark, d):
    return symbols.used_types(*_facts(spark, d))


@query()
def class_implementations(spark, d):
    return symbols.implementations(*_facts(spark, d))


@query()
def all_implementations(spark, d):
    return symbols.supertypes(symbols.implementations(*_facts(spark, d)))


@query()
def resolved_calls(spark, d):
    classes, names = _facts(spark, d)
    return symbols.resolved_calls(classes, names, symbols.supertypes(symbols.implementations(classes, names))).select("full_class_name", "at", "callee").distinct()


@query()
def method_implementations(spark, d):
    classes, names = _facts(spark, d)
    return symbols.method_implementations(classes, symbols.supertypes(symbols.implementations(classes, names)))


@query()
def method_bodies(spark, d):
    return _classes(spark, d).select("file_id", "full_class_name", F.explode("methods").alias("m")).select("file_id", "full_class_name", F.col("m.signature").alias("signature"), F.sha2("m.body", 256).alias("body"), F.length("m.body").alias("length"))


@query()
def field_access(spark, d):
    return _classes(spark, d).select("file_id", "full_class_name", F.explode("methods").alias("m")).select("file_id", "full_class_name", F.col("m.signature").alias("signature"), F.explode("m.field_access").alias("field"))


@query()
def source_without_comments(spark, d):
    return _sources(spark, d).select("file_id", comments.without_comments(F.col("content")).alias("content"))


@query(f"SELECT file_id, list_filter(range(len(string_split(content, chr(10)))), lambda k: len(list_filter({_list_sql(filters.LOMBOK_MARKERS)}, lambda m: contains(string_split(content, chr(10))[k + 1], m))) > 0)::INTEGER[]::VARCHAR AS lines FROM source_files WHERE content IS NOT NULL")
def lombok_lines(spark, d):
    lines = filters.marked_lines(F.col("content"), filters.LOMBOK_MARKERS)
    return table(spark, d, "source_files").where("content is not null").select("file_id", F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]")).alias("lines"))


@query()
def class_counts(spark, d):
    return symbols.class_counts(_classes(spark, d))


@query(r"""SELECT file_path, split_part(replace(file_path, '\', '/'), '/', -1) AS class_name, sha256(content) AS ast_hash, 'configuration' AS type, '7' AS project_id FROM source_files
WHERE lower(split_part(replace(file_path, '\', '/'), '.', -1)) IN ('sql', 'yml', 'yaml', 'xml')""")
def configuration_chunks(spark, d):
    return files.configuration_chunks(table(spark, d, "source_files"), 7, "main").select("file_path", "class_name", "ast_hash", "type", "project_id")
