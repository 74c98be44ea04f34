"""Registered query: centroid clustering of ``embeddings``."""

from parasift.sources.tables import read_table

from .centroids import CLUSTERS, DIM, LIMIT, ROUNDS, SCALE, SEED, cluster
from .registry import register


def _oracle() -> str:
    """All rounds written out: assignment by brute force, floored means."""
    steps = [f"""
x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor(greatest(least(CAST(e AS DOUBLE) * {SCALE}, {LIMIT}.0), -{LIMIT}.0)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT x.r, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM x CROSS JOIN c{i})
  GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM (
      SELECT k, p, sum(e) AS s, count(*) AS n FROM (
        SELECT a.k, unnest(range(1, {DIM} + 1)) AS p, unnest(x.v) AS e FROM x JOIN a{i} a USING (r))
      GROUP BY k, p)
    GROUP BY k) m ON m.k = c.k)""")
    return "WITH" + ",".join(steps) + f"""
SELECT x.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM x JOIN a{ROUNDS} a USING (r) JOIN c{ROUNDS} c ON c.k = a.k
"""


@register("op13_centroid_clusters", oracle=_oracle())
def op13_centroid_clusters(spark, sf_dir):
    return cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
