"""Bucketed tables, timelines with tombstones, keyed state over several batches and restarts."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidworks.operators import keyed, social
from braidworks.sources import shards, timelines
from braidworks.streaming import fanout, state


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def shuffled_above(df, table="Bucketed: true"):
    """Exchanges above the scan of a bucketed table."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    scans = [i for i, line in enumerate(lines) if table in line]
    assert scans, lines
    found = []
    for i in scans:
        at = depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < at:
                at = depth(line)
                found += [line] if "Exchange" in line else []
    return found


def test_saved_shards_are_not_shuffled_again(spark, tmp_path):
    path = str(tmp_path / "it's")
    shards.save_shards(spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k long, v string"), path, "k", 3)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = shards.load_shards(spark, path)
        assert shards.shards_of(spark, path) == 8 and table.count() == 500
        asked = spark.createDataFrame([(3,), (3,), (999,)], "k long")
        got = keyed.get(table, asked, "k")
        assert shuffled_above(got) == [] and plain(got.collect()) == [(3, "v3"), (3, "v3"), (999, None)]
        lists = keyed.multi_get(table, spark.createDataFrame([(1, [5, 777, 6])], "req long, ids array<long>"), "ids", "k")
        assert shuffled_above(lists) == [] and plain(lists.select("req", "pos", "k", "v").collect()) == [(1, 0, 5, "v5"), (1, 2, 6, "v6")]
        updates = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1000, "more", 1)], "k long, v string, seq long")
        changed = shards.upsert_shards(spark, path, updates, ["seq"])
        assert shuffled_above(changed) == []
        assert {r.k: r.v for r in changed.collect()} == {i: f"v{i}" for i in range(500)} | {1: "new", 1000: "more"}
        sums = table.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert shuffled_above(sums) == [] and sums.where("n = 1").count() == 500
        assert shuffled_above(table.groupBy("v").count(), "FileScan") != []  # the check sees one where it is
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    shards.save_shards(spark.createDataFrame([(1, "z")], "k long, v string"), path, "k", 1)
    assert plain(shards.load_shards(spark, path).collect()) == [(1, "z")] and shards.shards_of(spark, path) == 2


ENTRY = "user_id long, timestamp long, post_id long"


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_entries_of_posts_without_tombstones_are_not_shuffled(spark, tmp_path, monkeypatch):
    store = timelines.TimelineStore(spark, str(tmp_path), buckets=8, entry=ENTRY)
    frame = lambda r: spark.createDataFrame(r, ENTRY)
    store.add(frame([(u, p, p) for u in range(40) for p in range(5)] + [(1, 9, None)]).repartition(4), 1)
    store.remove(frame([(u, 3, 3) for u in range(0, 40, 2)]), 2)
    left = sorted([(u, p, p) for u in range(40) for p in range(5) if p != 3 or u % 2] + [(1, 9, None)], key=repr)
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    at = next(i for i, line in enumerate(lines) if line.startswith("Join LeftOuter"))
    assert next(line for line in lines[at + 1 :] if not line.startswith("Project")).startswith("Join LeftSemi")
    for most in (timelines.BROADCAST_POSTS, 0):  # with none, all entries meet the tombstones by shuffle
        monkeypatch.setattr(timelines, "BROADCAST_POSTS", most)
        assert plain(store.read().select("user_id", "timestamp", "post_id").collect()) == left
    monkeypatch.setattr(timelines, "BUCKETS_AT_ONCE", 3)
    assert len(store.compact(3)) > 3 and store.touched() == []
    assert plain(store.read().select("user_id", "timestamp", "post_id").collect()) == left
    assert {p.parent.parent.name for p in tmp_path.rglob("*.parquet")} >= {"version=3"}


def test_tombstones_hide_and_compaction_rewrites_what_they_touch(spark, tmp_path):
    store = timelines.TimelineStore(spark, str(tmp_path), buckets=8, entry=ENTRY)
    assert store.read().count() == 0 and store.compact(1) == []
    rows = [(u, t, 100 * u + t) for u in range(40) for t in range(5)]
    frame = lambda r: spark.createDataFrame(r, ENTRY)
    store.add(frame(rows), 1)
    gone = [(3, t, 300 + t) for t in range(5)] + [(7, 2, 702), (7, 9, 709)]
    store.remove(frame(gone), 2)
    store.add(frame([(3, 1, 301), (50, 1, 1)]), 3)  # one comes back
    expected = plain([r for r in rows if r not in gone] + [(3, 1, 301), (50, 1, 1)])
    entries = lambda: plain(store.read().select("user_id", "timestamp", "post_id").collect())
    assert entries() == expected
    before, touched = files_of(tmp_path / "entries"), store.touched()
    assert store.compact(4) == touched and 1 <= len(touched) <= 2
    after = files_of(tmp_path / "entries")
    for name, time in before.items():
        if not any(f"bucket={b}/" in name for b in touched):
            assert after[name] == time  # neither read nor written
        else:
            assert name not in after
    assert entries() == expected and store.touched() == [] and store.compact(5) == []
    store.remove(frame([r for r in rows if r[0] == 3] + [(3, 1, 301)]), 6)
    store.compact(7)
    assert entries() == [r for r in expected if r[0] != 3]
    store.remove(frame(rows + [(50, 1, 1)]), 8)  # nothing is left
    store.compact(9)
    assert entries() == []


def test_a_compaction_that_broke_off_brings_nothing_back(spark, tmp_path, monkeypatch):
    store = timelines.TimelineStore(spark, str(tmp_path), buckets=2, entry=ENTRY)
    frame = lambda r: spark.createDataFrame(r, ENTRY)
    store.add(frame([(1, 1, 1), (1, 2, 2), (2, 1, 3)]), 1)
    store.remove(frame([(1, 1, 1)]), 2)
    with monkeypatch.context() as m:
        m.setattr(store, "_drop", lambda folder: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.compact(3)
    entries = lambda: plain(store.read().select("user_id", "timestamp", "post_id").distinct().collect())
    assert entries() == [(1, 2, 2), (2, 1, 3)]
    store.compact(4)
    assert entries() == [(1, 2, 2), (2, 1, 3)] and store.touched() == []


def test_few_and_many_removals_give_the_same(spark, monkeypatch):
    home = spark.createDataFrame([(u, t, p) for u in range(6) for t, p in ((1, 1), (2, 2), (3, 1))], ENTRY)
    going = spark.createDataFrame([(0, 1, 1), (5, 1, 1), (2, 2, 2), (9, 9, 9)], ENTRY)
    left = plain(social.without_entries(home, going).collect())
    assert left == plain(home.join(going, ["user_id", "timestamp", "post_id"], "left_anti").collect()) and len(left) == 15


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def test_running_values_survive_a_restart(spark, tmp_path):
    batches = [[(1, 2), (2, 3)], [(1, 5)], [(2, 1), (3, 9), (1, 1)]]
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema("k long, update long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        values = state.running_values(stream, "k", lambda value, updates: value + int(updates.sum()), default=100)
        seen = []
        drain(values.writeStream.foreachBatch(lambda b, i: seen.extend(map(tuple, b.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        return seen

    out = []
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["k", "update"]).to_parquet(tmp_path / "in" / f"{i}.parquet")
        if i:  # two batches in the first run, the third after a restart
            out += run()
    assert out.count((1, 102)) == 1 and {k: v for k, v in out} == {1: 108, 2: 104, 3: 109} and len(out) == 6


def test_sessions_end_by_timers_as_they_do_at_rest(spark, tmp_path):
    uses = [
        [(1, "a", 0), (1, "a", 40), (1, "b", 10), (2, "a", 5)],
        [(1, "a", 90), (3, "c", 130)],  # 1a is late by less than the ttl; 1b and 2a end while no one is looking
        [(2, "a", 150), (1, "a", 300)],  # 2a opens anew
        [(9, "z", 1000)],
    ]
    (tmp_path / "in").mkdir()
    out = []

    def run():
        stream = spark.readStream.schema("k long, session string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = state.sessions_with_ttl(stream, "k", "t", 60)
        drain(found.writeStream.foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())

    for i, rows in enumerate(uses):
        frame = pd.DataFrame([(k, s, pd.Timestamp(5000 + t, unit="s", tz="UTC")) for k, s, t in rows], columns=["k", "session", "t"])
        frame.to_parquet(tmp_path / "in" / f"{i}.parquet", coerce_timestamps="us")
        if i % 2:  # two files a run: a restart between the second and the third
            run()
    table = spark.read.parquet(str(tmp_path / "in"))
    expected = [tuple(r) for r in state.session_events(table, "k", "t", 60).collect()]
    open_ones = [r for r in expected if r[2] == "expired" and r[3] >= 6000 * 10**6]
    assert plain(out) == plain([r for r in expected if r not in open_ones]) and len(open_ones) == 1
    assert {(1, "b", "expired", 5070 * 10**6), (2, "a", "expired", 5065 * 10**6), (1, "a", "expired", 5150 * 10**6)} <= set(out)


def test_a_message_delivered_again_shifts_no_page(spark, tmp_path):
    messages = [json.dumps({"user_id": 1, "req_id": i, "post_id": i, "timestamp": i, "user_mentions_id": [9]}) for i in range(6)]
    edges = spark.createDataFrame([(4, 1), (5, 1)], "follower long, followee long")
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((messages[:3], [messages[2], messages[0], *messages[3:5]], [messages[4], messages[5], messages[5]])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        if i != 1:
            stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
            drain(fanout.run_fanout(stream, edges, str(tmp_path / "out"), str(tmp_path / "ck")))
    entries = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert entries.count() == 18
    assert [r.post_id for r in social.page(entries, 1, 4).where("user_id = 4").orderBy("rank").collect()] == [4, 3, 2]
    assert plain(entries.select("user_id", "timestamp", "post_id").collect()) == plain(fanout.entries_of_messages(spark.read.text(str(tmp_path / "in")), edges).collect())


def test_a_store_keeps_a_posts_readers_as_lists(spark, tmp_path):
    store = timelines.TimelineStore(spark, str(tmp_path), buckets=2, entry=ENTRY)
    edges = spark.createDataFrame([(f, 7) for f in range(40)] + [(None, 7), (3, 8)], "follower long, followee long")
    posts = spark.createDataFrame([(7, 1, 10, [99, 3]), (8, 2, 11, [5]), (9, 3, 12, None)], "user_id long, timestamp long, post_id long, mentioned array<long>")
    lists = social.reader_lists(edges, bucket=store.bucket)
    store.add(social.home_lists(posts, lists, edges, store.bucket, "mentioned"), 1)
    assert spark.read.parquet(f"{tmp_path}/entries").count() <= 6  # 44 entries
    entries = lambda: plain(store.read().select("user_id", "timestamp", "post_id").collect())
    whole = plain(social.home_entries(posts, edges, "mentioned").collect())
    assert entries() == whole
    store.add(spark.createDataFrame([([4, 4, 6], 1, 10)], "readers array<long>, timestamp long, post_id long").select("*", F.explode(F.array(store.bucket(F.lit(4).cast("long")))).alias("bucket")), 2)
    gone = edges.where("follower is null or follower between 6 and 9")
    store.remove(social.home_lists(posts.where("user_id = 7"), social.reader_lists(gone, bucket=store.bucket)), 3)
    same = store.bucket(F.lit(4).cast("long")), store.bucket(F.lit(6).cast("long"))
    more = [(4, 1, 10), (4, 1, 10)] + ([] if spark.range(1).select(same[0] == same[1]).first()[0] else [(6, 1, 10)])
    left = plain([r for r in whole if r[2] != 10 or r[0] not in (6, 7, 8, 9)] + more)  # an entry without a reader stays, one that is there twice stays twice
    assert entries() == left
    store.compact(4)
    assert entries() == left
