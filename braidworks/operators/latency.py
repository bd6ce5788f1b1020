"""Load generation and latency traces: exact order statistics, windows, histograms, averages."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidworks.functions.scalars import drawn
from braidworks.sources.checkpoints import snapshot

from .keyed import dealt, in_ranges
from .ordered import HOT_ROWS, PART, hot_apart, hot_ranges, previous, smoothed, with_carries, within


def values_at(rows: DataFrame, value: str, wanted: dict[float, Column], ranges: int | None = None) -> DataFrame:
    """(percent, value): for each label in `wanted`, the element of the sorted values at a place (from 0) that is an expression of their number, `total`.

    Exact, without sorting all rows: equal values are counted (combined before the shuffle), the different
    ones are dealt to ranges of like size, whose bounds Spark samples from the values themselves, so that no outlier
    gathers the others in one range. A row a range tells which ranges hold a place that is asked for; only their values are put in
    order, each range by itself. Nulls are left out; a place beyond the last has no element.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = in_ranges(counts, "v", ranges=ranges)
    sums = ranged.groupBy("__range").agg(F.sum("n").alias("here"))  # a row a range
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    places = sums.select("__range", (F.sum("here").over(upto) - F.col("here")).alias("before"), "here", F.sum("here").over(Window.partitionBy()).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(float(label)).alias("percent"), place.cast("long").alias("place")) for label, place in wanted.items()]))
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("here"))
    found = places.select("__range", "before", "here", asked.alias("asked")).select("__range", "before", "here", "asked.*").where(inside)
    found = found.groupBy("__range", "before").agg(F.collect_list(F.struct("percent", "place")).alias("asked"))  # as many as `wanted` has
    running = F.sum("n").over(Window.partitionBy("__range").orderBy("v")) + F.col("before")
    ordered = ranged.join(F.broadcast(found), "__range").select("v", "n", running.alias("upto"), "asked")
    hits = ordered.select("v", "n", "upto", F.explode("asked").alias("asked")).where((F.col("asked.place") < F.col("upto")) & (F.col("asked.place") >= F.col("upto") - F.col("n")))
    return hits.select("asked.percent", F.col("v").alias("value"))


def floor_rank_values(rows: DataFrame, value: str, percents: list[float], ranges: int | None = None) -> DataFrame:
    """PF05, SL01: (percent, value): the element at place floor(percent / 100 * count) of the sorted values, from 0. 100 percent has no element."""
    return values_at(rows, value, {p: F.floor(F.lit(float(p)) / 100 * F.col("total")) for p in percents}, ranges)


def median(rows: DataFrame, value: str) -> DataFrame:
    """SL02: the element at half the count."""
    return floor_rank_values(rows, value, [50.0])


def nth_smallest(rows: DataFrame, value: str, n: int) -> DataFrame:
    """SL01: the value with place n, from 0, for any n; no row if there are no more than n."""
    return values_at(rows, value, {0.0: F.lit(n)}).select(F.col("value").alias(value))


def throughput(traces: DataFrame) -> Column:
    """PF03: requests a unit of time until the last has ended."""
    return F.count(F.lit(1)) / F.max(F.col("start_us") + F.col("duration_us"))


def average_latency(duration: str = "duration_us") -> Column:
    """PF04: as the harness has it: the smallest isn't summed but counted, and the division is of integers."""
    return F.call_function("div", F.sum(duration) - F.min(duration), F.count(F.lit(1)))


def summary(traces: DataFrame, percents: list[float]) -> DataFrame:
    """PF03-05 in one row: rate, average and a column p<percent> for each percent."""
    values = floor_rank_values(traces, "duration_us", percents)
    columns = [F.max(F.when(F.col("percent") == p, F.col("value"))).alias(_name(p)) for p in percents]
    return traces.agg(throughput(traces).alias("throughput"), average_latency().alias("average")).crossJoin(F.broadcast(values.agg(*columns)))  # two single rows


def _name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def window_percentiles(traces: DataFrame, interval_us: int, percent: float, stream: str, least: int = 100, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """PF06: (stream, absl_start_us, start_us, duration_us) of each window, a stream by itself.

    A row that starts after the window's end closes it, and the window moves by one interval only,
    however long the gap; windows with fewer than `least` rows aren't put out, nor is the last.

    By its start alone the i-th row (from 0) of a stream belongs to window c_i, which never falls; and since a
    row moves the window by one at most, it lands in the least of c_j + (i - j) over the rows j up to it: a running minimum.
    A hot stream is dealt to ranges: number, first start and minimum are carried from a range to the stream's next. A window's equal durations
    are counted before they meet. So neither a busy stream nor a long window is one task's work.
    """
    order, interval, firsts = ["start_us", "duration_us", "absl_start_us"], F.lit(interval_us).cast("long"), ["__absl_first", "__first"]
    known = traces.select(stream, *order).where(F.col(stream).isNotNull())
    hot, rest = hot_apart(known, stream, hot_rows)
    row = F.struct(*order)
    own = F.greatest(F.call_function("div", F.col("start_us") - F.col("__first") + interval - 1, interval) - 1, F.lit(0).cast("long")) - F.col("__i")

    def in_windows(rows: DataFrame, upto, with_ranges: bool) -> DataFrame:
        """(stream, window, duration, firsts, number) of a task's rows, counted where they are. `rows` has the stream's first row in `firsts`, numbers and nothing else: no task sorts structs."""
        rows = with_carries(rows, stream, __before=(F.count(F.lit(1)), F.sum)) if with_ranges else rows.withColumn("__before", F.lit(0))
        rows = rows.withColumn("__i", F.row_number().over(upto) - 1 + F.coalesce("__before", F.lit(0))).withColumn("__own", own)
        rows = with_carries(rows, stream, __least=(F.min("__own"), F.min)) if with_ranges else rows.withColumn("__least", F.lit(None).cast("long"))
        placed = rows.withColumn("__window", F.col("__i") + F.least(F.min("__own").over(upto), F.col("__least")))
        here = [stream, PART] if with_ranges else [stream]
        return placed.groupBy(*here, "__window", "duration_us", *firsts).agg(F.count(F.lit(1)).alias("__c")).select(stream, "__window", "duration_us", *firsts, "__c")

    total = known.count()
    up = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counts = in_windows(rest.withColumns({firsts[0]: F.first("absl_start_us").over(up), firsts[1]: F.first("start_us").over(up)}), up, False)
    if hot is not None:
        first = hot.groupBy(stream).agg(F.min(row).alias("f")).select(stream, F.col("f.absl_start_us").alias(firsts[0]), F.col("f.start_us").alias(firsts[1]))
        counts = counts.unionByName(in_windows(hot_ranges(hot, stream, *order, ranges=ranges).join(F.broadcast(first), stream), within(stream, *order), True))
    counts = dealt(counts, total, stream, "__window").groupBy(stream, "__window", "duration_us", *firsts).agg(F.sum("__c").alias("__c"))
    inside = Window.partitionBy(stream, "__window")
    ranked = counts.withColumn("__n", F.sum("__c").over(inside)).withColumn("__upto", F.sum("__c").over(inside.orderBy("duration_us")))
    place = F.floor(F.lit(percent / 100.0) * F.col("__n"))
    chosen = ranked.where((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__c")))  # a row a window
    last = F.max("__window").over(Window.partitionBy(stream))
    at = [(F.col(c) + F.col("__window") * interval).alias(name) for c, name in zip(firsts, ("absl_start_us", "start_us"))]
    return chosen.withColumn("__last", last).where((F.col("__window") < F.col("__last")) & (F.col("__n") >= least)).select(stream, *at, "duration_us")


def tumbling_percentiles(traces: DataFrame, interval_us: int, percent: float, least: int = 100) -> DataFrame:
    """PF06 where no gap is longer than an interval: (window, n, duration_us) of fixed windows from the first start."""
    first = F.broadcast(traces.agg(F.min("start_us").alias("first")))
    numbered = traces.crossJoin(first).select(F.call_function("div", F.col("start_us") - F.col("first"), F.lit(interval_us).cast("long")).alias("window"), "duration_us")
    counts = numbered.groupBy("window", "duration_us").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy("window")
    ranked = counts.select("window", "duration_us", "c", F.sum("c").over(inside).alias("n"), F.sum("c").over(inside.orderBy("duration_us")).alias("upto"))
    place = F.floor(F.lit(percent / 100.0) * F.col("n"))
    return ranked.where((F.col("n") >= least) & (place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select("window", "n", "duration_us")


def histogram(traces: DataFrame, width: int = 50, last: int = 10, duration: str = "duration_us") -> DataFrame:
    """PF08: (bucket, n) of durations; the last bucket is open."""
    bucket = F.least(F.call_function("div", F.col(duration), F.lit(width).cast("long")), F.lit(last).cast("long"))
    return traces.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_deltas(snapshots: DataFrame, time: str) -> DataFrame:
    """PF08: what each bucket has gained since the reading before. `snapshots` is (time, bucket, n)."""
    before = F.lag("n", 1, 0).over(Window.partitionBy("bucket").orderBy(time))
    return snapshots.withColumn("delta", F.col("n") - before)


def ewma(rows: DataFrame, key: str, order: list[str], value: str, weight: float, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """PF09: (key, average): weight * value + (1 - weight) * average in order; an average of zero is replaced. Rows without key or value take no part."""
    return smoothed(rows, key, order, value, weight, hot_rows, ranges)


def sampled_load(readings: DataFrame, key: str, cores: int, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """PF10: (key, tsc, load) from cumulative counters: invocations a sample, times cycles a tick; readings beyond `cores` are dropped.

    Ratios are as between neighbouring readings; pass them on to ewma for the smoothed load. One reading a key and tsc.
    """
    counters = ["invocations", "samples", "cycles", "tsc"]
    rows = previous(readings.select(key, *counters), key, "tsc", counters, "__before", hot_rows, ranges)
    delta = {c: F.col(c) - F.coalesce(F.col("__before")[c], F.lit(0)) for c in counters}
    ratio = F.when(delta["samples"] != 0, delta["invocations"] / delta["samples"]).otherwise(1.0)
    loads = rows.withColumn("load", ratio * delta["cycles"] / delta["tsc"])
    return loads.where(F.col("load") < cores).select(key, "tsc", "load")


def arrivals(spark: SparkSession, per_us: float, duration_us: int, seed: int = 0, streams: int = 1) -> DataFrame:
    """PF01: (stream, start_us) of Poisson arrivals: gaps are exponential, rounded, 1 at least; each stream is drawn by itself.

    Draws are hashes of seed, stream and number, so more of them begin alike: where the gaps drawn don't fill
    the time in every stream, twice as many are drawn.
    """
    most = int(duration_us * per_us * 2 + 100)
    gap = F.greatest(F.lit(1).cast("long"), F.round(-F.log(1 - drawn(seed, F.col("stream"), F.col("i"))) / per_us).cast("long"))
    while True:
        gaps = spark.range(streams).select(F.col("id").alias("stream"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("i")).withColumn("gap", gap)
        if not streams or gaps.groupBy("stream").agg(F.sum("gap").alias("all")).agg(F.min("all")).first()[0] > duration_us:
            break
        most *= 2
    return gaps.withColumn("start_us", F.sum("gap").over(Window.partitionBy("stream").orderBy("i"))).where(F.col("start_us") <= duration_us).select("stream", "start_us")


def served(requests: DataFrame, most_late_us: int) -> DataFrame:
    """PF02: requests that weren't too late to send and didn't fail. Columns: start_us, sent_us, ok."""
    return requests.where((F.col("sent_us") - F.col("start_us") <= most_late_us) & F.col("ok"))


def zipf(spark: SparkSession, n: int, exponent: float, draws: int, seed: int = 0) -> DataFrame:
    """PF11: (draw, value) with value in [0, n), weighted (value + 1) ** -exponent. The weights' sums are an array literal of n doubles."""
    sums = np.cumsum(np.arange(1, n + 1, dtype=float) ** -exponent)

    @F.pandas_udf("long")
    def pick(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(sums, u.to_numpy() * sums[-1], side="right"), n - 1))

    return spark.range(draws).select(F.col("id").alias("draw"), pick(drawn(seed, F.col("id"))).alias("value"))


#: The request mix in percent.
MIX = [("user_timeline", 60), ("home_timeline", 30), ("compose", 5), ("remove", 5), ("follow", 0)]


def request_mix(draw: Column, mix: list[tuple[str, int]] = MIX) -> Column:
    """PF12: kind of request for a draw from [0, 100)."""
    upto, result = 100, F.lit(None).cast("string")
    for kind, share in reversed(mix):
        result, upto = F.when(draw < upto, F.lit(kind)).otherwise(result), upto - share
    return result


def service_time(spec: str, draw: Column | None = None) -> Column:
    """PF14: `fixed:v`, `exponential:mean` or `bimodal:low:high:share of high` as a column, for a draw from [0, 1)."""
    kind, *numbers = spec.split(":")
    v = [float(x) for x in numbers]
    if kind == "fixed" and len(v) == 1:
        return F.lit(v[0])
    if kind == "exponential" and len(v) == 1:
        return -F.log(1 - draw) * v[0]
    if kind == "bimodal" and len(v) == 3:
        return F.when(draw < v[2], v[1]).otherwise(v[0])
    raise ValueError(f"not a service time: {spec}")


def load_summary(samples: DataFrame, elapsed_us: float, busy: float, idle: float, duration: str = "duration_us") -> DataFrame:
    """PF15: one row: count, rate, cpu share, min, plain mean, p90, p99, p99.9, p99.99, max of complete requests (duration over 0)."""
    done = samples.where(F.col(duration) > 0)
    percents = [90.0, 99.0, 99.9, 99.99]
    values = floor_rank_values(done, duration, percents).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(_name(p)) for p in percents])
    whole = done.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 1e6 / F.lit(float(elapsed_us))).alias("rate"), F.lit(busy / (idle + busy)).alias("cpu"),
        F.min(duration).alias("min"), (F.sum(duration).cast("double") / F.count(F.lit(1))).alias("mean"), F.max(duration).alias("max"),
    )
    return whole.crossJoin(F.broadcast(values))  # two single rows


#: Threads whose bounds are broadcast at most; with more, a thread has few of the rows, and rows meet bounds by shuffle.
BROADCAST_THREADS = 200_000


def trimmed(samples: DataFrame, thread: str, order: str, ends: int = 1000) -> DataFrame:
    """PF16: without the first and last `ends` samples of each thread; a thread with no more than both fails.

    Ties go by the whole row. Only what is cut is put in order: the `ends` first and last rows of a thread (a bound that goes below the
    shuffle). The last row of the cut ones is a bound for the others, which stay where they are; equal rows on the bound are counted.
    """
    if not ends:
        return samples
    whole = F.struct(order, *[c for c in samples.columns if c != order])
    rows = samples.select(F.col(thread).alias("__thread"), whole.alias("__row"))

    def cut(side: str, first: Column, last) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("__thread").orderBy(first))
        gone = rows.withColumn("__nth", nth).where(F.col("__nth") <= ends).groupBy("__thread", "__row").agg(F.count(F.lit(1)).alias("c"))
        return gone.groupBy("__thread").agg(last("__row").alias(side), F.sum("c").alias(f"{side}_n"), F.max_by("c", "__row").alias("hi_c"), F.min_by("c", "__row").alias("lo_c"))

    low = cut("low", F.asc("__row"), F.max).withColumnRenamed("hi_c", "low_c").drop("lo_c")
    high = cut("high", F.desc("__row"), F.min).withColumnRenamed("lo_c", "high_c").drop("hi_c")
    totals = rows.groupBy("__thread").agg(F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") > 2 * ends, F.col("n")).otherwise(F.raise_error(F.lit("a thread has too few samples")).cast("long"))
    bounds = totals.join(low, "__thread").join(high, "__thread").withColumn("n", checked).where("n > 0")
    bounds = snapshot(bounds)  # a row a thread
    near = rows.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_THREADS else bounds, "__thread")
    between = near.where((F.col("__row") > F.col("low")) & (F.col("__row") < F.col("high"))).select("__row.*")
    equal = near.where((F.col("__row") == F.col("low")) | (F.col("__row") == F.col("high"))).groupBy("__thread", "__row", "low", "high", "low_c", "high_c").agg(F.count(F.lit(1)).alias("c"))
    left = F.col("c") - F.when(F.col("__row") == F.col("low"), F.col("low_c")).otherwise(0) - F.when(F.col("__row") == F.col("high"), F.col("high_c")).otherwise(0)
    copies = equal.withColumn("left", left).where("left > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("left").cast("int"))).alias("__copy")).select("__row.*")
    return between.unionByName(copies).select(*samples.columns)


def phase_breakdown(lines: DataFrame, batch: int, overheads: dict[str, list[str]]) -> DataFrame:
    """PF18: lines (threads, exp_id, iteration, line `name: value`) as (threads, phase, average): sums over iterations, averaged over the batch.

    `overheads` names phases to add: a phase's time less that of its parts. The last line of a name counts in an
    iteration, but for `merge work time`, whose lines add up.
    """
    name, value = F.trim(F.regexp_extract("line", "^([^:]*):", 1)), F.regexp_extract("line", ":\\s*([0-9.eE+-]+)", 1).cast("double")
    parsed = lines.select("threads", "exp_id", "iteration", name.alias("phase"), value.alias("t"), F.col("seq")).where("phase <> ''")
    latest = parsed.groupBy("threads", "exp_id", "iteration", "phase").agg(F.max_by("t", "seq").alias("last"), F.sum("t").alias("all"))
    once = F.when(F.col("phase") == "merge work time", F.col("all")).otherwise(F.col("last"))
    phases = latest.groupBy("threads", "phase").agg((F.sum(once) / batch).alias("average"))
    rest = [
        phases.where(F.col("phase").isin([whole, *parts])).groupBy("threads").agg(F.sum(F.when(F.col("phase") == whole, F.col("average")).otherwise(-F.col("average"))).alias("average"))
        .select("threads", F.lit(f"{whole} overhead").alias("phase"), "average")
        for whole, parts in overheads.items()
    ]
    return reduce(DataFrame.unionByName, rest, phases)


def result_tally(responses: DataFrame, text: str) -> DataFrame:
    """PF19: (result, n): empty or beginning with `Success` is success, beginning with 500 a server error."""
    kind = F.when((F.col(text) == "") | F.col(text).startswith("Success"), "success").when(F.col(text).startswith("500"), "server_error").otherwise("other")
    return responses.groupBy(kind.alias("result")).agg(F.count(F.lit(1)).alias("n"))
