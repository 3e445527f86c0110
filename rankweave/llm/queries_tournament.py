"""op13: centroid clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import centroid_tournament
from rankweave.llm.base import query

FIRST, ROUNDS, DIMS = 8, 10, 64


def _assignment(i: int) -> str:
    """The nearest centroid of every vector under the centroids of round ``i``."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM comp x JOIN c{i} c ON c.dim = x.dim GROUP BY x.r, c.c) GROUP BY r)"""


def _round(i: int) -> str:
    """Round ``i``: assignment, then floors of the means; the remainder is made non-negative first."""
    return f"""{_assignment(i)},
c{i + 1} AS MATERIALIZED (
  SELECT c.c, c.dim, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{i} c LEFT JOIN (
    SELECT a.best.c AS c, x.dim, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM comp x JOIN a{i} a ON a.r = x.r GROUP BY 1, 2) s
  ON s.c = c.c AND s.dim = c.dim)"""


CLUSTER_SQL = f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS}),
parts AS MATERIALIZED (SELECT r, unnest(embedding) AS x, unnest(range({DIMS})) AS dim FROM numbered),
bad AS (SELECT DISTINCT r FROM parts WHERE x IS NULL OR NOT isfinite(x)),
comp AS MATERIALIZED (SELECT r, dim, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts WHERE r NOT IN (SELECT r FROM bad)),
first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), r) - 1 AS c FROM numbered
  WHERE r NOT IN (SELECT r FROM bad) ORDER BY c LIMIT {FIRST}),
c0 AS MATERIALIZED (SELECT first.c, comp.dim, comp.x FROM first JOIN comp USING (r)),
{",".join(_round(i) for i in range(ROUNDS))},
{_assignment(ROUNDS)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT n.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN numbered n USING (r) JOIN digest ON digest.c = a.best.c
"""


@query("op13_centroid_clusters", CLUSTER_SQL)
def op13(spark, sf_dir):
    out, centroids = centroid_tournament.cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMS, FIRST, ROUNDS)
    rows = centroids.collect()  # FIRST of them
    inertia = sum(r["cluster_inertia"] for r in rows)
    facts = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], inertia, centroid_tournament.centroid_digest(r["centroid"])) for r in rows],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", "vec_id").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
