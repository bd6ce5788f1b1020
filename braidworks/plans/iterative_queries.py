"""k-means over the test vectors, as integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidworks.operators import kmeans

from .registry import query, read

CLUSTERS = 10


def _points(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("long")).alias("d"))


def _means(points):
    """The points with the lowest ids."""
    return points.orderBy("vec_id").limit(CLUSTERS).select(F.col("vec_id").cast("int").alias("cluster"), "d")


_SQL = f"""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) AS d FROM embeddings),
m AS (SELECT CAST(vec_id AS INTEGER) AS cluster, d FROM p ORDER BY vec_id LIMIT {CLUSTERS}),
dist AS (SELECT vec_id, cluster, list_sum(list_transform(list_zip(p.d, m.d), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS s FROM p, m),
a AS (SELECT vec_id, CAST(arg_min(cluster, (s, cluster)) AS INTEGER) AS cluster FROM dist GROUP BY 1)
"""


@query(_SQL + "SELECT vec_id, cluster FROM a")
def km_assign(spark, d):
    points = _points(spark, d)
    return kmeans.assign(points, _means(points)).select("vec_id", "cluster")


@query(_SQL + """, x AS (SELECT cluster, unnest(d) AS v, unnest(range(len(d))) AS k FROM p JOIN a USING (vec_id)),
u AS (SELECT cluster, k, CAST(sum(v) // count(*) AS BIGINT) AS v FROM x GROUP BY 1, 2)
SELECT m.cluster, CAST(k AS INTEGER) AS k, coalesce(u.v, o) AS x FROM (SELECT cluster, unnest(d) AS o, unnest(range(len(d))) AS k FROM m) m LEFT JOIN u USING (cluster, k)""")
def km_update(spark, d):
    points = _points(spark, d)
    means = _means(points)
    return kmeans.update(kmeans.assign(points, means), means).select("cluster", F.posexplode("d").alias("k", "x"))


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) AS d FROM embeddings)
SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.d, b.d), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS VARCHAR) AS distance
FROM p a, (SELECT d FROM p WHERE vec_id = 0) b""")
def km_squared_distance(spark, d):
    points = _points(spark, d)
    origin = points.where("vec_id = 0").select(F.col("d").alias("o"))
    return points.crossJoin(F.broadcast(origin)).select("vec_id", kmeans.squared_distance(F.col("d"), F.col("o")).cast("string").alias("distance"))  # one row


#: Rounds that the SQL is spelled out for: more than the means of the test tables take to settle, and a settled mean stays.
ROUNDS = 60


def _rounds() -> str:
    """Rounds of assignment and update as common table expressions m0 to m<ROUNDS>, each of (cluster, d)."""
    start = f"""
WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) AS d FROM embeddings),
m0 AS MATERIALIZED (SELECT CAST(vec_id AS INTEGER) AS cluster, d FROM p ORDER BY vec_id LIMIT {CLUSTERS})"""
    step = """,
a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (s, cluster)) AS cluster FROM (
  SELECT vec_id, cluster, list_sum(list_transform(list_zip(p.d, m.d), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS s FROM p, m{i} m) GROUP BY 1),
u{i} AS MATERIALIZED (SELECT cluster, list(v ORDER BY k) AS d FROM (
  SELECT cluster, k, CAST(sum(v) // count(*) AS BIGINT) AS v FROM (SELECT cluster, unnest(d) AS v, unnest(range(len(d))) AS k FROM p JOIN a{i} USING (vec_id)) GROUP BY 1, 2) GROUP BY 1),
m{j} AS MATERIALIZED (SELECT m.cluster, coalesce(u.d, m.d) AS d FROM m{i} m LEFT JOIN u{i} u USING (cluster))"""
    return start + "".join(step.format(i=i, j=i + 1) for i in range(ROUNDS))


@query(_rounds() + f" SELECT cluster, CAST(unnest(range(len(d))) AS INTEGER) AS k, unnest(d) AS x FROM m{ROUNDS}")
def km_fit(spark, d):
    points = _points(spark, d)
    return kmeans.fit(points, _means(points))[0].select("cluster", F.posexplode("d").alias("k", "x"))


@query(_rounds() + f" SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM a{ROUNDS - 1}")
def km_fit_assigned(spark, d):
    """The second stop rule: until no point changes its cluster."""
    points = _points(spark, d)
    return kmeans.fit_until_settled(points, _means(points))[0].select("vec_id", "cluster")
