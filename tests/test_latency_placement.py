import random

from pyspark.sql import functions as F

from braidworks.operators import latency, placement


def traces(spark, rows):
    return spark.createDataFrame(rows, "s long, absl_start_us long, start_us long, duration_us long")


def test_floor_rank(spark):
    small = spark.createDataFrame([(v,) for v in (4, 2, 1, 3)], "v long")
    assert {r.percent: r.value for r in latency.floor_rank_values(small, "v", [25.0, 50.0, 99.0]).collect()} == {25.0: 2, 50.0: 3, 99.0: 4}
    draw = random.Random(2)
    values = [draw.choice([7, draw.randrange(10**7)]) for _ in range(5000)]  # half of them are one value
    got = {r.percent: r.value for r in latency.floor_rank_values(spark.createDataFrame([(v,) for v in values], "v long"), "v", [1.0, 50.0, 99.9]).collect()}
    assert got == {p: sorted(values)[int(p / 100 * 5000)] for p in got} and len(got) == 3


def test_average_leaves_out_the_smallest(spark):
    rows = traces(spark, [(0, i, i, d) for i, d in enumerate((1, 2, 3, 4))])
    assert rows.agg(latency.average_latency().alias("a")).first().a == 2


def test_window_moves_one_interval_a_row(spark):
    rows, at = [], 0
    for i in range(1000):
        at += 1 if i % 300 else 5000
        rows.append((1, at + 7, at, i * 37 % 101))
    got = [tuple(r)[1:] for r in latency.window_percentiles(traces(spark, rows), 100, 50.0, "s", least=20).orderBy("start_us").collect()]
    cur, held, expected = rows[0][2], [], []
    for _, _, start, d in rows:
        if cur + 100 < start:
            if len(held) >= 20:
                expected.append((cur + 7, cur, sorted(held)[int(50.0 / 100 * len(held))]))
            cur, held = cur + 100, []
        held.append(d)
    assert got == expected and expected


def test_ewma_replaces_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 4.0), (1, 3, 8.0)], "k long, seq long, x double")
    assert latency.ewma(rows, "k", ["seq"], "x", 0.25).first().average == 5.0


def test_first_sample_seeds_the_load(spark):
    rows = spark.createDataFrame([(1, 10, 4, 2, 5), (1, 20, 8, 4, 10), (1, 30, 9, 4, 1000)], "n long, tsc long, invocations long, samples long, cycles long")
    assert [r.load for r in latency.sampled_load(rows, "n", 4).orderBy("tsc").collect()] == [1.0, 1.0]  # the third is beyond the cores


def test_arrivals_keep_their_rate(spark):
    n = latency.arrivals(spark, 0.05, 100_000, seed=1).count()
    assert abs(n - 5000) < 250


def test_arrivals_fill_the_time_however_few_were_drawn_first(spark):
    few = latency.arrivals(spark, 2.0, 3000, seed=4, streams=2).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("start_us").alias("last")).collect()
    assert len(few) == 2 and all(r["last"] > 2990 for r in few)
    assert latency.arrivals(spark, 0.5, 100, streams=0).count() == 0


def test_zipf_weights(spark):
    got = {r.value: r.n for r in latency.zipf(spark, 3, 1.0, 6000, seed=1).groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = 1 + 1 / 2 + 1 / 3
    assert all(abs(got[i] / 6000 - 1 / (i + 1) / total) < 0.03 for i in range(3))


def test_pick_until_memory_suffices(spark):
    rows = spark.createDataFrame([(1, i, float(10 - i), 100.9) for i in range(8)], "node long, id long, u double, mem double")
    pick = lambda m, n: sorted(r.id for r in placement.pick_tasks(rows, "node", "u", "id", F.col("mem"), m, n).collect())
    assert pick(250, 0) == [0, 1, 2] and pick(0, 0) == [0] and pick(0, 4) == [0, 1, 2, 3] and pick(10_000, 0) == list(range(8))


def test_destination_rounds(spark):
    nodes = spark.createDataFrame([(1, False, False, 1.0, 5000.0, 0), (2, False, False, 9.0, 5000.0, 1), (3, True, False, 9.0, 9000.0, 2)], "ip long, isol boolean, acquired boolean, cores double, mem_mbs double, pos int")
    asked = spark.createDataFrame(
        [(1, 9, False, 4.0, 100.0, 0), (2, 9, False, 20.0, 100.0, 0), (3, 9, True, 20.0, 100.0, 1), (4, 2, True, 4.0, 100.0, 0), (5, 9, True, 0.0, 9000.0, 0)],
        "req_id long, requestor long, mem_pressure boolean, cores double, mem_mbs double, turn int",
    )
    assert {r.req_id: r.ip for r in placement.migration_destinations(asked, nodes).collect()} == {1: 2, 2: None, 3: 2, 4: 1, 5: None}


NODE = "lpid long, ip long, isol boolean, acquired boolean, cores double, mem_mbs double"
ENTRY = "lpid long, seq long, kind string, ip long, mem_pressure boolean, cores double, mem_mbs double"


def test_destinations_depend_on_earlier_ones(spark):
    nodes = spark.createDataFrame([(1, ip, ip == 4, False, 8.0, 9000.0) for ip in (1, 2, 3, 4)] + [(2, 7, False, False, 1.0, 9000.0), (2, 7, False, False, 1.0, 9000.0)], NODE)
    ask = lambda seq, ip=1, pressure=False, cores=4.0, lpid=1: (lpid, seq, "destination", ip, pressure, cores, 100.0)
    log = [
        ask(1), ask(2), ask(3), (1, 4, "release", 2, None, None, None), ask(5), (1, 6, "release", 2, None, None, None), (1, 7, "release", 2, None, None, None),
        (1, 8, "acquire", 2, None, None, None), (1, 9, "acquire", 2, None, None, None), (1, 10, "acquire", 99, None, None, None),
        (1, 11, "place", None, None, None, None), (1, 12, "place", None, None, None, None), (1, 13, "place", None, None, None, None), (1, 14, "place", None, None, None, None),
        (1, 15, "release", 3, None, None, None), (1, 16, "report", 3, None, 2.0, 9000.0), ask(17), ask(18, pressure=True), ask(1, lpid=2, cores=2.0), ask(2, lpid=2, cores=2.0, pressure=True), ask(1, lpid=3),
        (None, 1, "place", None, None, None, None), (1, None, "place", None, None, None, None),
    ]
    got = {(r.lpid, r.seq): r.ip for r in placement.placements(spark.createDataFrame(log, ENTRY).repartition(3), nodes).collect()}
    first = [2, 3, None, 2, 2, 2, None, 2, None, None, 3, 1, 2, 3, 3, 3, None, 3]
    assert got == {(1, seq): ip for seq, ip in enumerate(first, 1)} | {(2, 1): None, (2, 2): 7, (3, 1): None}


def test_placements_match_a_loop(spark):
    draw = random.Random(8)
    nodes = [(p, ip, draw.random() < 0.2, draw.random() < 0.2, float(draw.randrange(9)), float(draw.randrange(9) * 1000)) for p in range(3) for ip in range(30)]
    log = [
        (draw.choice([0, 0, 0, 1, 2]), seq, draw.choice(["destination"] * 4 + ["place", "acquire", "release", "release", "release", "report"]), draw.randrange(33), draw.random() < 0.5, float(draw.randrange(9)), float(draw.randrange(8) * 1000))
        for seq in range(3000)
    ]
    state = {p: {n[1]: list(n[2:]) for n in nodes if n[0] == p} for p in range(3)}
    turns, expected = {p: 0 for p in range(3)}, {}
    for p, seq, kind, ip, pressure, cores, memory in log:
        circle = [k for k in state[p] if k >= turns[p]] + [k for k in state[p] if k < turns[p]]
        found = None
        if kind == "destination":
            roomy = [k for k in circle if k != ip and not state[p][k][0] and not state[p][k][1] and state[p][k][3] >= memory + 1024]
            found = next((k for k in roomy if state[p][k][2] >= cores), next(iter(roomy), None) if pressure else None)
            if found is not None:
                state[p][found][1], turns[p] = True, found + 1
        elif kind == "place":
            found = next(k for k in circle if not state[p][k][0])
            turns[p] = found + 1
        elif kind == "report":
            if ip in state[p]:
                found, state[p][ip][2:] = ip, [cores, memory]
        elif ip in state[p] and state[p][ip][1] == (kind == "release"):
            found, state[p][ip][1] = ip, kind == "acquire"
        expected[seq] = found
    got = placement.placements(spark.createDataFrame(log, ENTRY).repartition(5), spark.createDataFrame(nodes, NODE)).collect()
    assert {r.seq: r.ip for r in got} == expected and len(got) == 3000
    assert placement.placements(spark.createDataFrame([], ENTRY), spark.createDataFrame(nodes, NODE)).count() == 0


def test_a_busy_threads_samples_stay_where_they_are(spark):
    samples = spark.range(3000, numPartitions=4).select((F.col("id") % 2).alias("thread"), F.col("id").alias("at"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = latency.trimmed(samples, "thread", "at", 100)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r["at"] for r in left.collect()) == list(range(200, 2800))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_ranges_follow_the_number_of_a_hot_key_s_rows(spark, monkeypatch):
    from braidworks.operators import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    rows = spark.range(2000).select(F.lit(1).alias("key"), "id")
    ranged = ordered.hot_ranges(rows, "key", "id")
    sizes = [n for n in ranged.groupBy(F.spark_partition_id().alias("p")).count().select("count").toPandas()["count"]]
    assert sum(sizes) == 2000 and ranged.select(ordered.PART).distinct().count() == 20 and max(sizes) < 600
    total = ordered.running_total(rows, "key", ["id"], "id", "total", hot_rows=50)
    assert total.where(F.col("total") != F.col("id") * (F.col("id") + 1) / 2).isEmpty()
