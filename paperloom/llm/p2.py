"""Queries of problem 2: claims that nearly copy each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.near_duplicates import groups, similar_pairs
from paperloom.sources.tables import table

THRESHOLD = 0.7


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "claims").select("id", "text"), "id", "text", THRESHOLD).select("id_a", "id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups(table(spark, folder, "claims").select("id", "text"), "id", "text", THRESHOLD)


def p2_restatements(spark: SparkSession, folder: str) -> DataFrame:
    """The restatement pairs that units tells of, each once, with whether the texts bear it out."""
    told = table(spark, folder, "units").select(F.explode("restatements").alias("r")).select(
        F.least("r.source_id", "r.target_id").alias("id_a"), F.greatest("r.source_id", "r.target_id").alias("id_b")
    ).where("id_a < id_b").distinct()
    found = p2_found(spark, folder).withColumn("near", F.lit(True))
    return told.join(found, ["id_a", "id_b"], "left").select("id_a", "id_b", F.coalesce("near", F.lit(False)).alias("near"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_restatements": p2_restatements}
_PAIRS = """
c AS (SELECT DISTINCT id, text FROM claims WHERE text IS NOT NULL),
w AS (SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM
      (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM c)),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.k = b.k AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b, c = x.n AND c = y.n AS same FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c / (x.n + y.n - c) >= 0.7)
"""

ORACLE = {
    "p2_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM pairs",
    "p2_restatements": f"""WITH {_PAIRS}, r AS (SELECT unnest(restatements) AS r FROM units),
told AS (SELECT DISTINCT least(r.source_id, r.target_id) AS id_a, greatest(r.source_id, r.target_id) AS id_b FROM r WHERE r.source_id <> r.target_id)
SELECT t.id_a, t.id_b, p.id_a IS NOT NULL AS near FROM told t LEFT JOIN pairs p USING (id_a, id_b)""",
    "p2_groups": f"""WITH RECURSIVE {_PAIRS},
ids AS (SELECT DISTINCT id FROM claims),
e AS (SELECT id_a AS x, id_b AS y FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
g AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
bag AS (SELECT id, string_agg(w, ' ' ORDER BY w) AS bag FROM w GROUP BY id),
links AS (SELECT x, count(DISTINCT bag) AS n FROM
          (SELECT id_a AS x, id_b AS y FROM pairs WHERE NOT same UNION ALL SELECT id_b, id_a FROM pairs WHERE NOT same) JOIN bag ON bag.id = y GROUP BY x)
SELECT i.id, least(i.id, coalesce(g.y, i.id)) AS group_id, coalesce(l.n, 0) AS n_links
FROM ids i LEFT JOIN g ON g.x = i.id LEFT JOIN links l ON l.x = i.id""",
}
