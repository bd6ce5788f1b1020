"""Files written and read again, and drawn tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidworks.operators import kmeans
from braidworks.sources import graphs
from braidworks.sources.checkpoints import shared_folder, snapshot_and_drop

from .registry import query, read


def _traces(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start_us"), (F.floor("l_extendedprice").cast("long") % 5000).alias("duration_us"))


def _folder(spark):
    return f"{shared_folder(spark)}/io-{uuid.uuid4()}"


_SUMS = (
    "SELECT count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(t) AS BIGINT) AS durations, CAST(sum(s % 1000 * t) AS BIGINT) AS both_"
    " FROM (SELECT l_orderkey * 10 + l_linenumber AS s, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS t FROM lineitem)"
)


def _sums(traces):
    start, duration = F.col("start_us").cast("long"), F.col("duration_us").cast("long")
    return traces.agg(F.count(F.lit(1)).alias("n"), F.sum(start).alias("starts"), F.sum(duration).alias("durations"), F.sum(start % 1000 * duration).alias("both_"))


@query(_SUMS)
def io_text_traces(spark, d):
    path = _folder(spark)
    graphs.write_traces(_traces(spark, d), path)
    return snapshot_and_drop(_sums(graphs.read_traces(spark, path)), path)


@query(_SUMS)
def pf_trace_dump(spark, d):
    path = _folder(spark)
    graphs.write_trace_dump(_traces(spark, d), path)
    return snapshot_and_drop(_sums(spark.read.csv(path, header=True)), path)


@query("SELECT 'service-' || max(n_name) AS name, CAST(count(*) AS BIGINT) AS port FROM nation")
def io_config(spark, d):
    path = _folder(spark)
    read(spark, d, "nation").agg(F.concat(F.lit("service-"), F.max("n_name")).alias("name"), F.count(F.lit(1)).alias("port")).coalesce(1).write.json(path)
    return snapshot_and_drop(graphs.config(spark, path).select("name", "port"), path)


@query("SELECT CAST(5000 AS BIGINT) AS n, true AS shaped")
def io_synthetic_pairs(spark, d):
    pairs = graphs.synthetic_pairs(spark, 5000)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("key").rlike("^[A-z]{20}$") & F.col("value").rlike("^[A-z]{2}$")).alias("shaped"))


@query("SELECT id, CAST(8 AS INTEGER) AS dimensions, true AS inside FROM range(2000) r(id)")
def km_points(spark, d):
    points = kmeans.points(spark, 2000, 8, 1000)
    return points.select("id", F.size("d").alias("dimensions"), F.forall("d", lambda x: (x >= 0) & (x < 1000)).alias("inside"))
