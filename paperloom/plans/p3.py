"""Queries of problem 3 over sections and outline_nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import SOUND, descendants, resolve, with_descendant_counts
from paperloom.sources.tables import table

TREE = ["tab", "system", "task"]


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "sections").select(F.lit("section").alias("tab"), F.lit("").alias("system"), "task", "id", "parent")
    outlines = table(spark, folder, "outline_nodes").select(F.lit("outline").alias("tab"), "system", "task", "id", "parent")
    return sections.unionByName(outlines)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve(_nodes(spark, folder), TREE, paths=False)
    return found.where(F.col("kind") != SOUND).select(*TREE, "id", "kind")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    nodes = with_descendant_counts(resolve(_nodes(spark, folder), TREE), TREE)
    return nodes.select(*TREE, "id", "kind", "root", "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(resolve(_nodes(spark, folder), TREE), TREE)


_NODES = """
nodes AS (
  SELECT tab, system, task, id, min(CASE WHEN parent <> '' THEN parent END) AS up FROM (
    SELECT 'section' AS tab, '' AS system, task, id, parent FROM sections
    UNION ALL SELECT 'outline', system, task, id, parent FROM outline_nodes) GROUP BY ALL),
linked AS (
  SELECT n.*, p.id AS link FROM nodes n LEFT JOIN nodes p
    ON n.tab = p.tab AND n.system = p.system AND n.task = p.task AND n.up = p.id),
down AS (
  SELECT tab, system, task, id, id AS root, 0::BIGINT AS depth, [id] AS path, up IS NOT NULL AS lost FROM linked WHERE link IS NULL
  UNION ALL
  SELECT l.tab, l.system, l.task, l.id, d.root, d.depth + 1, list_append(d.path, l.id), false
  FROM down d JOIN linked l ON d.tab = l.tab AND d.system = l.system AND d.task = l.task AND d.id = l.link),
open AS (SELECT l.* FROM linked l ANTI JOIN down d USING (tab, system, task, id)),
walk AS (
  SELECT tab, system, task, id, link AS here FROM open
  UNION
  SELECT w.tab, w.system, w.task, w.id, o.link FROM walk w JOIN open o
    ON w.tab = o.tab AND w.system = o.system AND w.task = o.task AND w.here = o.id),
broken AS (
  SELECT tab, system, task, id, CASE WHEN bool_or(here = id) THEN 'on_cycle' ELSE 'below_cycle' END AS kind FROM walk GROUP BY ALL),
closure AS (
  SELECT tab, system, task, unnest(path[:-2]) AS ancestor, id, unnest(range(depth, 0, -1))::BIGINT AS distance FROM down WHERE depth > 0)
"""

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_NODES} SELECT tab, system, task, id, 'missing_parent' AS kind FROM down WHERE lost UNION ALL SELECT * FROM broken",
    "p3_paths": f"""WITH RECURSIVE {_NODES}
SELECT d.tab, d.system, d.task, d.id, CASE WHEN lost THEN 'missing_parent' ELSE 'sound' END AS kind, root, depth,
  array_to_string(path, '/') AS path, coalesce(n, 0) AS n_descendants
FROM down d LEFT JOIN (SELECT tab, system, task, ancestor, count(*) AS n FROM closure GROUP BY ALL) c
  ON d.tab = c.tab AND d.system = c.system AND d.task = c.task AND d.id = c.ancestor
UNION ALL SELECT tab, system, task, id, kind, NULL, NULL, NULL, NULL FROM broken""",
    "p3_descendants": f"WITH RECURSIVE {_NODES} SELECT * FROM closure",
}
