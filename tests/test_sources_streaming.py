import json

import pandas as pd
from pyspark.sql import functions as F

from braidworks.sources import graphs
from braidworks.streaming import fanout, state


def test_matrix_market(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("% made by hand\n3 3 2\n1 2\n2 3\n")
    edges = graphs.symmetric(graphs.matrix_market(spark, str(tmp_path / "g.mtx")))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert graphs.graph_users(spark, 3).orderBy("user_id").first().username == "username_1"


def test_config_traces_digests(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"secret": "s",
                                                 "port": 9}))
    assert graphs.config(spark, str(tmp_path / "c.json")).first().port == 9
    rows = spark.createDataFrame([(1, 5), (2, 6)], "start_us long, duration_us long")
    graphs.write_traces(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, graphs.read_traces(spark, str(tmp_path / "t")).collect())) == [(1, 5), (2, 6)]
    graphs.write_trace_dump(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert graphs.file_digests(spark, str(tmp_path / "c.json")).first().md5
    pair = graphs.synthetic_pairs(spark, 5).first()
    assert len(pair.key) == 20 and len(pair.value) == 2


def test_fanout_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    messages = [{"user_id": 1, "req_id": i, "post_id": i, "timestamp": i, "user_mentions_id": [9]} for i in range(5)]
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, messages), "not a message"]))
    edges = spark.createDataFrame([(4, 1), (5, 1)], "follower long, followee long")
    stream = spark.readStream.text(str(tmp_path / "in"))
    fanout.run_fanout(stream, edges, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.user_id, r.post_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = fanout.entries_of_messages(spark.read.text(str(tmp_path / "in")), edges)
    assert got == {(r.user_id, r.post_id) for r in batch.collect()} == {(u, i) for u in (4, 5, 9) for i in range(5)}


def test_running_values_keep_state_over_batches(spark, tmp_path):
    for i, rows in enumerate(([(1, 2), (2, 3)], [(1, 5)])):
        pd.DataFrame(rows, columns=["k", "update"]).to_parquet(tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("k long, update long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    values = state.running_values(stream, "k", lambda value, updates: value + updates.sum())
    q = values.writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.value for r in spark.table("running").groupBy("k").agg(F.max("value").alias("value")).collect()} == {1: 7, 2: 3}


def test_windows_and_sessions_run(spark, tmp_path):
    rows = pd.DataFrame({"k": [1, 1, 1], "t": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 05:00"]).tz_localize("UTC")})
    (tmp_path / "in").mkdir()
    rows.to_parquet(tmp_path / "in" / "a.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("k long, t timestamp").parquet(str(tmp_path / "in"))
    for name, df, end in (("win", state.windowed_counts(stream, "t", "k"), "01:00"), ("ses", state.sessions(stream, "t", "k"), "00:40")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.table(name).selectExpr("k", "n", "date_format(`" + df.columns[0] + "`.start, 'HH:mm') AS a", "date_format(`" + df.columns[0] + "`.end, 'HH:mm') AS b").collect()
        assert [tuple(r) for r in rows] == [(1, 2, "00:00", end)]  # the last window is still open


def test_symmetric_edges_are_compared_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (None, None)], "x long, y long")
    found = graphs.symmetric(edges)
    key = lambda e: tuple((v is None, v or 0) for v in e)
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(1, 2), (2, 1), (3, 3), (None, 4), (4, None), (5, None), (None, 5), (None, None)], key=key)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
