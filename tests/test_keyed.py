from bisect import bisect_left

from pyspark.sql import functions as F

from braidworks.operators import keyed
from braidworks.plans import keyed_queries


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows=((1, "a"), (2, "b"), (3, "c"))):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_random_operations_match_a_dict(spark):
    import random

    draw, model = random.Random(5), {}
    log = []
    for seq in range(500):
        k, gone = draw.randrange(40), draw.random() < 0.1
        log.append((k, f"v{seq}", seq, gone))
        model.pop(k, None) if gone else model.update({k: f"v{seq}"})
    net = keyed.net_state(spark.createDataFrame(log, "k long, v string, seq long, gone boolean"), "k", ["seq"], F.col("gone"), ["v"])
    assert {r.k: r.v for r in net.collect()} == model


def test_upsert_prefers_updates_and_the_last_of_them(spark):
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (9, "z", 1)], "k long, v string, seq long")
    assert pairs(keyed.upsert(table(spark), updates, "k", ["seq"])) == [(1, "a"), (2, "y"), (3, "c"), (9, "z")]
    null = spark.createDataFrame([(1, None, 1)], "k long, v string, seq long")
    assert (1, None) in pairs(keyed.upsert(table(spark), null, "k", ["seq"]))  # a null is a value


def test_insert_remove_take(spark):
    new, flags = keyed.insert_if_absent(table(spark), spark.createDataFrame([(1, "n", 1), (7, "n", 2), (7, "m", 1)], "k long, v string, seq long"), "k", ["seq"])
    assert pairs(new) == [(1, "a"), (2, "b"), (3, "c"), (7, "m")] and pairs(flags) == [(1, False), (7, True)]
    left, existed = keyed.remove(table(spark), spark.createDataFrame([(1,), (8,), (1,)], "k long"), "k")
    assert pairs(left) == [(2, "b"), (3, "c")] and pairs(existed) == [(1, True), (8, False)]
    taken, rest = keyed.take(table(spark), spark.createDataFrame([(3,)], "k long"), "k")
    assert pairs(taken) == [(3, "c")] and pairs(rest) == [(1, "a"), (2, "b")]


def test_apply_starts_missing_keys_at_the_default(spark):
    numbers = spark.createDataFrame([(1, 10)], "k long, v long")
    got = keyed.apply(numbers, spark.createDataFrame([(1, 5), (2, 5)], "k long, update long"), "k", "v", 100, lambda old, u: old + u)
    assert pairs(got) == [(1, 15), (2, 105)]


def test_multi_get_keeps_order_and_drops_misses(spark):
    asked = spark.createDataFrame([("r", [3, 8, 1, 3])], "req string, ids array<long>")
    got = keyed.multi_get(table(spark), asked, "ids", "k").orderBy("pos").select("pos", "v")
    assert [tuple(r) for r in got.collect()] == [(0, "c"), (2, "a"), (3, "c")]


def test_shards_of_extreme_hashes(spark):
    top = (1 << 64) - 1
    rows = spark.createDataFrame([(str(x),) for x in (0, top, top >> 1, (top >> 1) + 1)], "h string").select(F.col("h").cast("decimal(20,0)").alias("h"))
    for power in (0, 1, 5, 13):
        got = {int(r.h): r.s for r in rows.select("h", keyed.shard_index(F.col("h"), power).alias("s")).collect()}
        assert got == {int(h): min(int(h) // (top >> power), (1 << power) - 1) for h in got}
    signed = spark.range(1).select(keyed.unsigned(F.lit(-1)).alias("h")).first().h
    assert int(signed) == top


def test_successors_of_many_probes(spark):
    import random

    draw = random.Random(3)
    keys, probes = [draw.randrange(1000) for _ in range(200)], list(range(-5, 1010, 3))
    got = keyed.successors(spark.createDataFrame([(p,) for p in probes], "p long"), spark.createDataFrame([(k,) for k in keys], "k long"), "p", "k")
    assert {r.p: r.successor for r in got.collect()} == {p: min((k for k in keys if k >= p), default=None) for p in probes}


def test_every_order_gets_its_successor(spark):
    data = "/root/testdata/sf0.001"
    keys = sorted({r.k for r in spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_extendedprice AS k").collect()})
    probes = {r.p for r in spark.read.parquet(f"{data}/orders.parquet").selectExpr("o_totalprice / 3 AS p").collect()}
    got = keyed_queries.pf_successor_lookup(spark, data).collect()
    assert sorted((r.probe, r.successor) for r in got) == sorted((p, keys[i] if (i := bisect_left(keys, p)) < len(keys) else None) for p in probes)


def test_ordered_container(spark):
    t = table(spark)
    assert pairs(keyed.nth(t, "k", 1)) == [(2, "b")]
    popped, rest = keyed.pop(t, "k", 2)
    assert pairs(popped) == [(1, "a"), (2, "b")] and pairs(rest) == [(3, "c")]
    front = keyed.push(t, spark.createDataFrame([(10, "x"), (11, "y")], "k long, v string"), "k", front=True)
    assert pairs(front) == [(-1, "x"), (0, "y"), (1, "a"), (2, "b"), (3, "c")]
    assert [r.k for r in keyed.ordered(t, "k", descending=True).collect()] == [3, 2, 1]
    assert keyed.append_batch_if(t, t, 2).count() == 3 and keyed.append_batch_if(t, t, 3).count() == 6


def test_snapshot_survives_its_source(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.save(table(spark), path, "k")
    kept = keyed.copy(keyed.load(spark, path))
    keyed.save(table(spark, [(9, "z")]), path)
    assert pairs(kept) == [(1, "a"), (2, "b"), (3, "c")]


def test_empty_tables(spark):
    none = table(spark).limit(0)
    assert keyed.size(none).first().empty and keyed.drain(none, F.count(F.lit(1)).alias("n"))[0].first().n == 0
    assert keyed.upsert(none, spark.createDataFrame([], "k long, v string, seq long"), "k", ["seq"]).count() == 0


def test_rows_are_numbered_across_ranges(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)] + [(5, 5000), (5, 5001)]
    df = spark.createDataFrame(rows, "k long, x long")
    got = keyed.numbered(df, ["k", "x"], "n").collect()
    assert [(r.k, r.x) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(1002))
    assert keyed.numbered(df.limit(0), ["k"]).count() == 0


def test_successors_match_a_scan(spark):
    keys, probes = [1.0, 5.0, 5.0, 9.5, None], [0.0, 1.0, 4.9, 5.0, 9.5, 9.6, None]
    got = keyed.successors(spark.createDataFrame([(p,) for p in probes], "p double"), spark.createDataFrame([(k,) for k in keys], "k double"), "p", "k")
    expected = {p: min((k for k in keys if k is not None and k >= p), default=None) if p is not None else None for p in probes}
    assert {r.p: r.successor for r in got.collect()} == expected
    none = keyed.successors(spark.createDataFrame([(1.0,)], "p double"), spark.createDataFrame([], "k double"), "p", "k")
    assert [tuple(r) for r in none.collect()] == [(1.0, None)]


def test_a_scan_that_is_stopped_opens_few_partitions(spark, tmp_path):
    opened = tmp_path / "opened"
    opened.mkdir()

    def visit(row, stop):
        (opened / str(row["k"] // 10)).touch()
        return row["k"] != stop

    table = spark.range(0, 400, 1, 40).withColumnRenamed("id", "k")
    assert keyed.for_each_until(table, lambda row: visit(row, 5)) is False
    assert len(list(opened.iterdir())) == 1
    assert keyed.for_each_until(table, lambda row: visit(row, 21)) is False
    assert 2 < len(list(opened.iterdir())) < 10
    assert keyed.for_each_until(table, lambda row: visit(row, -1)) is True and len(list(opened.iterdir())) == 40
    assert keyed.for_each_until(table.limit(0), lambda row: False) is True


def test_no_test_name_repeats():
    import ast
    import pathlib

    for path in pathlib.Path(__file__).parent.rglob("test_*.py"):
        names = [node.name for node in ast.parse(path.read_text()).body if isinstance(node, ast.FunctionDef)]
        assert len(names) == len(set(names)), path
