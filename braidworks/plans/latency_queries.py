"""Latency traces: line items as traces, with the price as the duration."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidworks.functions import scalars
from braidworks.operators import latency

from .registry import DRAWN, query, read

_TRACES = "(SELECT l_suppkey AS thread, l_orderkey * 10 + l_linenumber AS start_us, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS duration_us FROM lineitem)"


def _traces(spark, d):
    start = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    duration = (F.floor("l_extendedprice").cast("long") % 5000).alias("duration_us")
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("thread"), start.alias("absl_start_us"), start.alias("start_us"), duration)


def _ranked(where="true"):
    return f"(SELECT duration_us, row_number() OVER (ORDER BY duration_us) - 1 AS i, count(*) OVER () AS n FROM {_TRACES} WHERE {where})"


@query(f"""
SELECT count(*) / max(start_us + duration_us) AS throughput, CAST((sum(duration_us) - min(duration_us)) // count(*) AS BIGINT) AS average,
 (SELECT duration_us FROM {_ranked()} WHERE i = CAST(floor(50.0 / 100 * n) AS BIGINT)) AS p50, (SELECT duration_us FROM {_ranked()} WHERE i = CAST(floor(99.0 / 100 * n) AS BIGINT)) AS p99,
 (SELECT duration_us FROM {_ranked()} WHERE i = CAST(floor(99.9 / 100 * n) AS BIGINT)) AS p99_9 FROM {_TRACES}""")
def pf_latency_summary(spark, d):
    return latency.summary(_traces(spark, d), [50.0, 99.0, 99.9])


@query(f"SELECT duration_us FROM {_TRACES} ORDER BY 1 OFFSET 1234 LIMIT 1")
def sl_nth_smallest(spark, d):
    return latency.nth_smallest(_traces(spark, d), "duration_us", 1234)


@query(f"SELECT 50.0::DOUBLE AS percent, duration_us AS value FROM {_ranked()} WHERE i = CAST(floor(0.5 * n) AS BIGINT)")
def sl_median(spark, d):
    return latency.median(_traces(spark, d), "duration_us")


@query(f"SELECT least(duration_us // 50, 10) AS bucket, count(*) AS n FROM {_TRACES} GROUP BY 1")
def pf_histogram(spark, d):
    return latency.histogram(_traces(spark, d))


@query(f"""
WITH s AS (SELECT thread AS t, least(duration_us // 50, 10) AS bucket, count(*) AS n FROM {_TRACES} GROUP BY 1, 2)
SELECT t, bucket, n, n - lag(n, 1, 0) OVER (PARTITION BY bucket ORDER BY t) AS delta FROM s""")
def pf_histogram_deltas(spark, d):
    bucket = F.least(F.call_function("div", F.col("duration_us"), F.lit(50).cast("long")), F.lit(10).cast("long"))
    snapshots = _traces(spark, d).groupBy(F.col("thread").alias("t"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return latency.histogram_deltas(snapshots, "t")


@query(f"""
WITH t AS (SELECT thread % 4 AS thread, start_us, duration_us FROM {_TRACES}),
n AS (SELECT *, row_number() OVER w - 1 AS i, first_value(start_us) OVER w AS base FROM t WINDOW w AS (PARTITION BY thread ORDER BY start_us, duration_us)),
c AS (SELECT *, greatest((start_us - base + 4999) // 5000 - 1, 0) - i AS own FROM n),
p AS (SELECT *, i + min(own) OVER (PARTITION BY thread ORDER BY i) AS win FROM c),
r AS (SELECT *, count(*) OVER (PARTITION BY thread, win) AS k, row_number() OVER (PARTITION BY thread, win ORDER BY duration_us) - 1 AS place, max(win) OVER (PARTITION BY thread) AS last FROM p)
SELECT thread, base + win * 5000 AS absl_start_us, base + win * 5000 AS start_us, duration_us FROM r
WHERE k >= 100 AND win < last AND place = CAST(floor(0.99::DOUBLE * k) AS BIGINT)""")
def pf_timeseries_p99(spark, d):
    return latency.window_percentiles(_traces(spark, d).withColumn("thread", F.col("thread") % 4), 5000, 99.0, "thread")


@query(f"""
WITH w AS (SELECT (start_us - (SELECT min(start_us) FROM {_TRACES})) // 5000 AS "window", duration_us FROM {_TRACES}),
r AS (SELECT *, count(*) OVER (PARTITION BY "window") AS n, row_number() OVER (PARTITION BY "window" ORDER BY duration_us) - 1 AS i FROM w)
SELECT "window", n, duration_us FROM r WHERE n >= 100 AND i = CAST(floor(0.99 * n) AS BIGINT)""")
def pf_timeseries_tumbling(spark, d):
    return latency.tumbling_percentiles(_traces(spark, d), 5000, 99.0)


@query("""
WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, value AS a FROM s WHERE i = 1
 UNION ALL SELECT s.user_id, s.i, CASE WHEN a = 0 THEN value ELSE 0.25 * value + 0.75 * a END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, round(arg_max(a, i), 6) AS average FROM r GROUP BY 1""")
def pf_ewma(spark, d):
    return latency.ewma(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.25).select("user_id", F.round("average", 6).alias("average"))


@query("""
WITH r AS (SELECT user_id, event_id AS tsc, sum(1) OVER w AS inv, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w AS smp, sum(event_id % 11) OVER w AS cyc
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, tsc, inv - coalesce(lag(inv) OVER w, 0) AS di, smp - coalesce(lag(smp) OVER w, 0) AS ds, cyc - coalesce(lag(cyc) OVER w, 0) AS dc, tsc - coalesce(lag(tsc) OVER w, 0) AS dt
  FROM r WHERE tsc > 0 WINDOW w AS (PARTITION BY user_id ORDER BY tsc))
SELECT user_id, tsc, round(load, 9) AS load FROM (SELECT user_id, tsc, CASE WHEN ds <> 0 THEN di / ds ELSE 1.0 END * dc / dt AS load FROM x) WHERE load < 4""")
def pf_sampled_load(spark, d):
    from pyspark.sql import Window

    upto, e = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id")
    readings = read(spark, d, "events").select(
        "user_id", e.alias("tsc"), F.count(F.lit(1)).over(upto).alias("invocations"), F.sum(F.when(e % 3 == 0, 1).otherwise(0)).over(upto).alias("samples"), F.sum(e % 11).over(upto).alias("cycles"))
    return latency.sampled_load(readings.where("tsc > 0"), "user_id", 4).select("user_id", "tsc", F.round("load", 9).alias("load"))


@query(f"""
SELECT count(*) AS n, count(*) * 1e6 / 2000000 AS rate, 0.75::DOUBLE AS cpu, min(duration_us) AS min, CAST(sum(duration_us) AS DOUBLE) / count(*) AS mean, max(duration_us) AS max,
 {", ".join(f"(SELECT duration_us FROM {_ranked('duration_us > 0')} WHERE i = CAST(floor({q} / 100 * n) AS BIGINT)) AS p{str(q).replace('.', '_').removesuffix('_0')}" for q in (90.0, 99.0, 99.9, 99.99))}
FROM {_TRACES} WHERE duration_us > 0""")
def pf_load_summary(spark, d):
    return latency.load_summary(_traces(spark, d), 2_000_000, 3.0, 1.0)


@query(f"""
WITH t AS (SELECT thread % 3 AS g, start_us * 10 + thread % 10 AS o, duration_us FROM {_TRACES}),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, duration_us) AS i, count(*) OVER (PARTITION BY g) AS n FROM t)
SELECT g, count(*) AS n, CAST(n - 200 AS BIGINT) AS expected FROM r WHERE i > 100 AND i <= n - 100 GROUP BY g, r.n""")
def pf_trimmed(spark, d):
    t = _traces(spark, d).select((F.col("thread") % 3).alias("g"), F.struct((F.col("start_us") * 10 + F.col("thread") % 10).alias("a"), "duration_us").alias("o"), "duration_us")
    left = latency.trimmed(t, "g", "o", 100).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    whole = t.groupBy("g").agg((F.count(F.lit(1)) - 200).alias("expected"))
    return left.join(whole, "g")


_LEFT = f"""(SELECT duration_us FROM (
  SELECT duration_us, row_number() OVER (PARTITION BY thread % 3 ORDER BY start_us * 10 + thread % 10, duration_us) AS i, count(*) OVER (PARTITION BY thread % 3) AS n FROM {_TRACES})
  WHERE i > 100 AND i <= n - 100 AND duration_us > 0)"""


@query(f"""
WITH r AS (SELECT duration_us, row_number() OVER (ORDER BY duration_us) - 1 AS i, count(*) OVER () AS n FROM {_LEFT})
SELECT count(*) AS n, count(*) * 1e6 / 2000000 AS rate, 0.75::DOUBLE AS cpu, min(duration_us) AS min, CAST(sum(duration_us) AS DOUBLE) / count(*) AS mean, max(duration_us) AS max,
 {", ".join(f"(SELECT duration_us FROM r WHERE i = CAST(floor({q} / 100 * n) AS BIGINT)) AS p{str(q).replace('.', '_').removesuffix('_0')}" for q in (90.0, 99.0, 99.9, 99.99))}
FROM r""")
def pf_load_summary_trimmed(spark, d):
    """The load's summary without what each thread measured while it came up and went down."""
    t = _traces(spark, d).select((F.col("thread") % 3).alias("g"), (F.col("start_us") * 10 + F.col("thread") % 10).alias("o"), "duration_us")
    return latency.load_summary(latency.trimmed(t, "g", "o", 100), 2_000_000, 3.0, 1.0)


@query(
    "SELECT CASE WHEN r = '' OR starts_with(r, 'Success') THEN 'success' WHEN starts_with(r, '500') THEN 'server_error' ELSE 'other' END AS result, count(*) AS n"
    " FROM (SELECT CASE event_type WHEN 'error' THEN '500 failed' WHEN 'signup' THEN '' WHEN 'purchase' THEN 'Success!' ELSE event_type END AS r FROM events) GROUP BY 1"
)
def pf_result_tally(spark, d):
    kind = F.expr("CASE event_type WHEN 'error' THEN '500 failed' WHEN 'signup' THEN '' WHEN 'purchase' THEN 'Success!' ELSE event_type END")
    return latency.result_tally(read(spark, d, "events").select(kind.alias("r")), "r")


@query("SELECT event_id FROM events WHERE event_id % 13 <= 7 AND event_type <> 'error'")
def pf_served(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select("event_id", e.alias("start_us"), (e + e % 13).alias("sent_us"), (F.col("event_type") != "error").alias("ok"))
    return latency.served(rows, 7).select("event_id")


@query(
    "SELECT CASE WHEN x < 60 THEN 'user_timeline' WHEN x < 90 THEN 'home_timeline' WHEN x < 95 THEN 'compose' ELSE 'remove' END AS kind, count(*) AS n"
    " FROM (SELECT event_id % 100 AS x FROM events) GROUP BY 1"
)
def pf_request_mix(spark, d):
    return read(spark, d, "events").groupBy(latency.request_mix(F.col("event_id") % 100).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH g AS (SELECT s AS stream, i, greatest(1, CAST(round(-ln(1 - {DRAWN.format(seed=7, of="s || ':' || i")}) / 0.01::DOUBLE) AS BIGINT)) AS gap FROM range(4) a(s), range(1, 4001) b(i))
SELECT stream, start_us FROM (SELECT stream, CAST(sum(gap) OVER (PARTITION BY stream ORDER BY i) AS BIGINT) AS start_us FROM g) WHERE start_us <= 100000""")
def pf_arrivals(spark, d):
    return latency.arrivals(spark, 0.01, 100_000, seed=7, streams=4)


@query(f"""
WITH w AS (SELECT value, sum((value + 1) ** -0.9::DOUBLE) OVER (ORDER BY value) AS upto FROM range(100) r(value))
SELECT draw, CAST(least((SELECT count(*) FROM w WHERE upto <= u * (SELECT max(upto) FROM w)), 99) AS BIGINT) AS value FROM (SELECT draw, {DRAWN.format(seed=7, of="draw")} AS u FROM range(5000) d(draw))""")
def pf_zipf(spark, d):
    return latency.zipf(spark, 100, 0.9, 5000, seed=7)


@query(f"""
SELECT c_custkey, 5.0::DOUBLE AS fixed, CASE WHEN u < 0.1 THEN 9.0::DOUBLE ELSE 1.0::DOUBLE END AS bimodal, round(-ln(1 - u) * 4.0::DOUBLE, 6) AS exponential
FROM (SELECT c_custkey, {DRAWN.format(seed=3, of="c_custkey")} AS u FROM customer)""")
def pf_service_time(spark, d):
    draw = scalars.drawn(3, F.col("c_custkey"))
    time = latency.service_time
    return read(spark, d, "customer").select("c_custkey", time("fixed:5").alias("fixed"), time("bimodal:1:9:0.1", draw).alias("bimodal"), F.round(time("exponential:4", draw), 6).alias("exponential"))


@query("""
WITH l AS (SELECT s_nationkey AS threads, s_suppkey AS exp_id, unnest(['map phase', 'map work', 'map user']) AS phase, unnest([s_suppkey % 9 + 20, s_suppkey % 5, s_suppkey % 3]) AS t FROM supplier)
SELECT threads, phase, round(CAST(sum(t) AS DOUBLE) / 4, 6) AS average FROM l GROUP BY 1, 2
UNION ALL SELECT threads, 'map phase overhead', round(CAST(sum(CASE WHEN phase = 'map phase' THEN t ELSE -t END) AS DOUBLE) / 4, 6) FROM l GROUP BY 1""")
def pf_phase_breakdown(spark, d):
    s = F.col("s_suppkey")
    line = lambda name, x: F.concat(F.lit(name + ": "), x.cast("string"))
    lines = read(spark, d, "supplier").select(
        F.col("s_nationkey").alias("threads"), s.alias("exp_id"), F.lit(0).alias("iteration"), F.lit(0).alias("seq"),
        F.explode(F.array(line("map phase", s % 9 + 20), line("map work", s % 5), line("map user", s % 3))).alias("line"))
    found = latency.phase_breakdown(lines, 4, {"map phase": ["map work", "map user"]})
    return found.select("threads", "phase", F.round("average", 6).alias("average"))
