"""Queries of the general data problems: orphan references, hierarchies, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import hierarchy, references, snapshots
from codestrata.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_references(*(table(spark, folder, t) for t in ("relationships", "method_deps", "nodes", "tombstones", "framework_nodes")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).drop("recorded_at").distinct()


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, folder))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    nesting = hierarchy.nesting_links(table(spark, folder, "class_contexts"))
    inheritance = hierarchy.inheritance_links(*(table(spark, folder, t) for t in ("relationships", "nodes", "framework_nodes")))
    return nesting.unionByName(inheritance)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    solved = hierarchy.solve(_links(spark, folder))
    return solved.select(F.col("h").alias("hierarchy"), F.col("v").alias("child_id"), F.col("root").alias("root_id"), "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path from the root down to each child, as ids joined by '/', with the smallest id of the cycle entered, -1 without one."""
    links = _links(spark, folder)
    solved = hierarchy.solve(links, with_path=True)
    named = hierarchy.cycles(links, solved)
    path = F.array_join(F.concat(F.reverse("path"), F.array("v")).cast("array<string>"), "/")
    return solved.join(named, ["h", "v"], "left").select(F.col("h").alias("hierarchy"), F.col("v").alias("child_id"), F.col("root").alias("root_id"), "depth", path.alias("path"), F.coalesce("cycle", F.lit(-1)).alias("cycle_id"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.solve(_links(spark, folder), with_path=True))
    return pairs.select(F.col("h").alias("hierarchy"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), "distance")


def p5_spare_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links to further parents of a child, which paths and descendants don't follow."""
    spare = hierarchy.spare_links(_links(spark, folder))
    return spare.select(F.col("h").alias("hierarchy"), F.col("child").alias("child_id"), F.col("parent").alias("parent_id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.changes(table(spark, folder, "node_snapshots"), table(spark, folder, "snapshot_log"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p5_found, p5_paths, p5_descendants, p5_spare_links, p6_found)}

_LIVE = """
WITH dead AS (SELECT node_id, min(deleted_at) AS died FROM tombstones GROUP BY node_id),
lived AS (
  SELECT n.id, n.project_id, replace(n.class_name, ' ', '') AS class_name, replace(n.method_name, ' ', '') AS method_name, n.created_at, d.died
  FROM nodes n LEFT JOIN dead d ON d.node_id = n.id),
named AS (
  SELECT dep_id, project_id, recorded_at, 'method_calls' AS field_name, replace(t, ' ', '') AS target
  FROM (SELECT dep_id, project_id, recorded_at, unnest(method_calls) AS t FROM method_deps)
  UNION
  SELECT dep_id, project_id, recorded_at, 'used_types', regexp_extract(replace(t, ' ', ''), '^[^<\\[]*')
  FROM (SELECT dep_id, project_id, recorded_at, unnest(used_types) AS t FROM method_deps)),
wanted AS (
  SELECT * FROM named WHERE target <> '' AND (field_name = 'method_calls'
    OR (contains(target, '.') AND NOT starts_with(target, 'java.') AND NOT starts_with(target, 'javax.')))),
orphan AS (
  SELECT 'relationships' AS table_name, 'end_node' AS field_name, r.id AS row_id, CAST(r.end_node AS VARCHAR) AS target, r.recorded_at
  FROM relationships r
  WHERE r.end_node IS NOT NULL AND r.end_node NOT IN (SELECT node_id FROM framework_nodes)
    AND NOT EXISTS (SELECT 1 FROM lived l WHERE l.id = r.end_node AND l.created_at <= r.recorded_at AND (l.died IS NULL OR l.died > r.recorded_at))
  UNION
  SELECT 'method_deps', w.field_name, w.dep_id, w.target, w.recorded_at
  FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM framework_nodes f WHERE CASE w.field_name WHEN 'method_calls' THEN replace(f.method_name, ' ', '') ELSE f.class_name END = w.target)
    AND NOT EXISTS (SELECT 1 FROM lived l WHERE l.project_id = w.project_id AND (l.method_name IS NULL) = (w.field_name = 'used_types')
      AND CASE w.field_name WHEN 'method_calls' THEN l.method_name ELSE l.class_name END = w.target
      AND l.created_at <= w.recorded_at AND (l.died IS NULL OR l.died > w.recorded_at)))
"""

_FOREST = r"""
WITH RECURSIVE latest AS (
  SELECT ctx_id, project_id, branch, full_class_name,
    replace(regexp_replace(regexp_replace(trim(parent_class), '^\(?''?', ''), '''?,?\)?$', ''), '$', '.') AS parent_name
  FROM class_contexts QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY loaded_at DESC) = 1),
links AS (
  SELECT 'nesting' AS h, c.ctx_id AS child, min(p.ctx_id) AS parent
  FROM latest c JOIN latest p ON p.project_id = c.project_id AND p.branch = c.branch AND p.full_class_name = c.parent_name
  WHERE c.parent_name NOT IN ('', 'None') GROUP BY c.ctx_id
  UNION ALL
  SELECT 'inheritance', start_node, min(end_node) FROM relationships
  WHERE upper(trim(type)) IN ('EXTEND', 'EXTENDS') AND start_node IS NOT NULL
    AND end_node IN (SELECT id FROM nodes UNION ALL SELECT node_id FROM framework_nodes) GROUP BY start_node),
up AS (
  SELECT h, child, parent AS at, 1 AS depth FROM links
  UNION
  SELECT u.h, u.child, l.parent, u.depth + 1 FROM up u JOIN links l ON l.h = u.h AND l.child = u.at WHERE u.depth < 200),
ended AS (SELECT u.h, u.child, u.at AS root, u.depth FROM up u WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.h = u.h AND l.child = u.at))
"""

ORACLE = {
    "p3_found": _LIVE + "SELECT DISTINCT table_name, field_name, row_id, target FROM orphan",
    "p3_counts": _LIVE + "SELECT table_name, field_name, coalesce(strftime(recorded_at, '%Y-%m'), '') AS month, count(*) AS orphans FROM orphan GROUP BY ALL",
    "p5_found": _FOREST + """SELECT l.h AS hierarchy, l.child AS child_id, coalesce(e.root, -1) AS root_id, CAST(coalesce(e.depth, -1) AS BIGINT) AS depth
FROM links l LEFT JOIN ended e ON e.h = l.h AND e.child = l.child""",
    "p5_paths": _FOREST + """, ring AS (SELECT DISTINCT u.h, u.child FROM up u WHERE u.child = u.at),
entered AS (SELECT u.h, u.child, min(r.child) AS cycle FROM (SELECT v.h, v.child, v.at FROM up v UNION SELECT h, child, child FROM links) u JOIN ring r ON r.h = u.h AND r.child = u.at GROUP BY ALL),
down AS (SELECT u.h, u.child, string_agg(u.at, '/' ORDER BY u.depth DESC) AS path FROM up u JOIN ended e ON e.h = u.h AND e.child = u.child GROUP BY ALL)
SELECT l.h AS hierarchy, l.child AS child_id, coalesce(e.root, -1) AS root_id, CAST(coalesce(e.depth, -1) AS BIGINT) AS depth, d.path || '/' || l.child AS path, coalesce(c.cycle, -1) AS cycle_id, r.child IS NOT NULL AS on_cycle
FROM links l LEFT JOIN ended e ON e.h = l.h AND e.child = l.child LEFT JOIN down d ON d.h = l.h AND d.child = l.child LEFT JOIN entered c ON c.h = l.h AND c.child = l.child LEFT JOIN ring r ON r.h = l.h AND r.child = l.child""",
    "p5_spare_links": """SELECT 'inheritance' AS hierarchy, start_node AS child_id, end_node AS parent_id FROM (SELECT DISTINCT start_node, end_node FROM relationships
WHERE upper(trim(type)) IN ('EXTEND', 'EXTENDS') AND start_node IS NOT NULL AND end_node IN (SELECT id FROM nodes UNION ALL SELECT node_id FROM framework_nodes)) QUALIFY row_number() OVER (PARTITION BY start_node ORDER BY end_node) > 1""",
    "p5_descendants": _FOREST + """SELECT u.h AS hierarchy, u.at AS ancestor_id, u.child AS descendant_id, CAST(u.depth AS BIGINT) AS distance
FROM up u JOIN ended e ON e.h = u.h AND e.child = u.child""",
    "p6_found": """
WITH kept AS (
  SELECT project_id, snap_no, max(delivery_no) AS delivery_no, lag(snap_no) OVER (PARTITION BY project_id ORDER BY snap_no) AS prev
  FROM snapshot_log GROUP BY project_id, snap_no),
rows AS (
  SELECT project_id, snap_no, coalesce(branch, '') AS branch, coalesce(pull_request_id, '') AS pull_request_id, coalesce(class_name, '') AS class_name,
    coalesce(method_name, '') AS method_name, max(lower(ast_hash)) AS hash
  FROM node_snapshots SEMI JOIN kept USING (project_id, snap_no, delivery_no) GROUP BY ALL),
old AS (SELECT r.* REPLACE (k.snap_no AS snap_no) FROM rows r JOIN kept k ON k.project_id = r.project_id AND k.prev = r.snap_no),
new AS (SELECT r.* FROM rows r JOIN kept k ON k.project_id = r.project_id AND k.snap_no = r.snap_no WHERE k.prev IS NOT NULL)
SELECT snap_no, project_id, branch, pull_request_id, class_name, method_name,
  CASE WHEN o.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT *, 1 AS here FROM new) n FULL JOIN (SELECT *, 1 AS here FROM old) o USING (snap_no, project_id, branch, pull_request_id, class_name, method_name)
WHERE o.here IS NULL OR n.here IS NULL OR o.hash IS DISTINCT FROM n.hash""",
}
