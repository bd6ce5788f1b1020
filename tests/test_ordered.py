"""Work along an order in ranges: one hot key, one outlier, one stream, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from braidworks.operators import keyed, latency, ordered


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_running_totals_cross_ranges(spark):
    rows = [(k, i, (i * 7) % 5 - 2) for k, n in ((0, 900), (1, 3), (2, 200)) for i in range(n)]
    got = ordered.running_total(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], "v", "upto", hot_rows=150, ranges=6).collect()
    sums, expected = {}, []
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        expected.append((k, i, v, sums[k]))
    assert plain(got) == plain(expected)
    assert ordered.running_total(spark.createDataFrame([], "k long, i long, v long").withColumn("x", F.lit(1)), "k", ["i"], "v", "upto").count() == 0


def test_previous_rows_cross_ranges(spark):
    rows = [(k, i, i * i) for k, n in ((0, 500), (1, 1), (2, 40)) for i in range(n)]
    got = ordered.previous(spark.createDataFrame(rows, "k long, i long, v long").repartition(3), "k", "i", ["i", "v"], "p", hot_rows=30, ranges=8).collect()
    assert {(r.k, r.i): r.p and tuple(r.p) for r in got} == {(k, i): (i - 1, (i - 1) ** 2) if i else None for k, i, _ in rows}


def loop(values, weight):
    average = 0.0
    for x in values:
        average = x if average == 0 else weight * x + (1 - weight) * average
    return average


@pytest.mark.parametrize("weight", [0.25, 0.001, 0.0, 1.0])
def test_a_hot_keys_average_is_the_loops(spark, weight):
    draw = random.Random(6)
    values = {0: [draw.choice([0.0, draw.uniform(-5, 9)]) for _ in range(3000)], 1: [0.0] * 700, 2: [4.0], 3: [0.0, 0.0, 5.0, -15.0, 2.0, 7.0], 4: [draw.uniform(1, 2) for _ in range(400)]}
    rows = [(k, i, x) for k, xs in values.items() for i, x in enumerate(xs)] + [(None, 1, 1.0), (2, 9, None)]
    got = ordered.smoothed(spark.createDataFrame(rows, "k long, i long, x double").repartition(3), "k", ["i"], "x", weight, hot_rows=300, ranges=9).collect()
    assert {r.k: r.average for r in got} == {k: pytest.approx(loop(xs, weight), rel=1e-9, abs=1e-12) for k, xs in values.items()} and len(got) == 5


def test_an_average_that_comes_to_be_zero_is_replaced_after_a_carry(spark):
    # 0.5 * -4 + 0.5 * 4 is zero, wherever a range ends: composed maps alone would go on with a + b * average
    values = [4.0] * 40 + [-4.0, 6.0] + [6.0] * 3 + [-6.0, 1.0]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(values)], "k long, i long, x double")
    for ranges in (1, 2, 7, 20, 45):
        assert ordered.smoothed(rows, "k", ["i"], "x", 0.5, hot_rows=20, ranges=ranges).first().average == pytest.approx(loop(values, 0.5))
    # so many zeros that the average itself becomes zero
    values = [1.0] + [0.0] * 2800 + [3.0, 5.0]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(values)], "k long, i long, x double")
    assert ordered.smoothed(rows, "k", ["i"], "x", 0.75, hot_rows=20, ranges=5).first().average == loop(values, 0.75) == 4.5
    assert ordered.smoothed(rows.limit(0), "k", ["i"], "x", 0.5).count() == 0


def test_an_outlier_doesnt_gather_the_others(spark):
    draw = random.Random(1)
    values = [draw.randrange(10**9) for _ in range(40_000)] + [4 * 10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    sizes = [r["n"] for r in keyed.in_ranges(df.groupBy("v").count(), "v", ranges=16).groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(values) / 16
    found = latency.floor_rank_values(df, "v", [0.0, 1.0, 50.0, 50.1, 99.9, 99.999, 100.0], ranges=16)
    assert {r.percent: r.value for r in found.collect()} == {p: sorted(values)[int(p / 100 * len(values))] for p in (0.0, 1.0, 50.0, 50.1, 99.9, 99.999)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "true" not in [line.rsplit(", ", 1)[-1] for line in plan.splitlines() if "Sort [" in line]  # no global one


def test_places_beyond_the_ends(spark):
    df = spark.createDataFrame([(v,) for v in (5, 5, None, 1, 9)], "v int")
    assert [latency.nth_smallest(df, "v", n).collect() for n in (0, 1, 2, 3)] == [[(1,)], [(5,)], [(5,)], [(9,)]]
    assert latency.nth_smallest(df, "v", 4).count() == 0 and latency.floor_rank_values(df.limit(0), "v", [50.0]).count() == 0


def windows_by_loop(rows, interval, percent, least):
    out, streams = [], {}
    for s, absl, start, d in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        streams.setdefault(s, []).append((absl, start, d))
    for s, own in streams.items():
        (absl, at, _), held = own[0], []
        for _, start, d in own:
            if at + interval < start:
                if len(held) >= least:
                    out.append((s, absl, at, sorted(held)[int(percent / 100 * len(held))]))
                at, absl, held = at + interval, absl + interval, []
            held.append(d)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 12])
def test_windows_of_a_hot_stream_cross_ranges(spark, ranges):
    draw, rows = random.Random(2), []
    for s, n in ((0, 4000), (1, 30), (2, 700), (None, 50)):
        at = draw.randrange(1000)
        for _ in range(n):
            at += draw.choice([0, 1, 1, 2, 3]) if draw.random() < 0.99 else draw.randrange(4000)
            rows.append((s, at + 5, at, draw.choice([7, draw.randrange(500)])))
    df = spark.createDataFrame(rows, "s long, absl_start_us long, start_us long, duration_us long").repartition(5)
    got = latency.window_percentiles(df, 50, 90.0, "s", least=10, hot_rows=500, ranges=ranges).collect()
    expected = windows_by_loop([r for r in rows if r[0] is not None], 50, 90.0, 10)
    assert plain(got) == plain(expected) and len(expected) > 50
    if ranges == 12:
        spread = keyed.in_ranges(df.where("s = 0"), "s", "start_us", ranges=12).groupBy("__range").count().collect()
        assert len(spread) == 12  # the one stream is many tasks' work


def test_loads_of_a_hot_key_cross_ranges(spark):
    rows = [(k, 10 * i + 10, i * 3 + 3, i // 2, i * 2 + 1) for k, n in ((0, 300), (1, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, tsc long, invocations long, samples long, cycles long").repartition(4)
    by = lambda n: sorted(map(tuple, latency.sampled_load(df, "k", 4, hot_rows=n, ranges=9).collect()))
    expected, before = [], {}
    for k, *row in rows:
        tsc, inv, smp, cyc = (a - b for a, b in zip(row, before.get(k, (0, 0, 0, 0))))
        before[k] = row
        expected.append((k, row[0], (inv / smp if smp else 1.0) * cyc / tsc))
    assert by(10) == by(1000) == sorted(expected)


def test_trimming_counts_equal_rows_on_the_bounds(spark):
    draw = random.Random(3)
    rows = [(t, draw.randrange(12), draw.choice("ab")) for t in range(3) for _ in range(60)] + [(9, 5, "a")] * 25
    got = latency.trimmed(spark.createDataFrame(rows, "t long, o long, x string").repartition(4), "t", "o", 10).collect()
    by = {t: sorted((o, x) for s, o, x in rows if s == t)[10:-10] for t in (0, 1, 2, 9)}
    assert plain(got) == plain((t, o, x) for t, kept in by.items() for o, x in kept)
    assert latency.trimmed(spark.createDataFrame(rows, "t long, o long, x string"), "t", "o", 0).count() == len(rows)
    with pytest.raises(Exception, match="too few"):
        latency.trimmed(spark.createDataFrame(rows[:15], "t long, o long, x string"), "t", "o", 10).collect()
