import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from braidworks.functions import scalars, text
from braidworks.operators import social


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_links_and_mentions(spark):
    assert one(spark, text.links(F.lit("x http://a.b/c?d https://q.z end"))) == ["http://a.b", "https://q.z"]
    assert one(spark, text.mentions(F.lit("hi @bob-x @a_b"))) == ["bob-x", "a_b"]
    assert one(spark, text.with_short_links(F.lit("x http://a.b/c?d https://q.z end"), F.array(F.lit("S0"), F.lit("S1")))) == "x S0/c?d S1 end"


def timeline(spark):
    return spark.createDataFrame([(7, 5, 1), (7, 5, 2), (7, 4, 3)], "user_id long, timestamp long, post_id long")


@pytest.mark.parametrize(("start", "stop", "posts"), [(0, 2, [2, 1]), (2, 9, [3]), (3, 9, []), (1, 1, []), (-1, 2, [])])
def test_pages(spark, start, stop, posts):
    assert [r.post_id for r in social.page(timeline(spark), start, stop).orderBy("rank").collect()] == posts
    asked = spark.createDataFrame([(1, 7, start, stop)], "req_id long, user_id long, start int, stop int")
    assert [r.post_id for r in social.pages(timeline(spark), asked).orderBy("rank").collect()] == posts


def test_a_page_is_shorter_where_a_post_is_gone(spark):
    left = timeline(spark).where("post_id <> 2")
    assert [r.post_id for r in social.read_posts(social.page(timeline(spark), 0, 2), left).collect()] == [1]


def test_follow_script(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], "follower long, followee long")
    edges = social.unfollow(social.follow(edges, edges), spark.createDataFrame([(5, 6)], "follower long, followee long"))
    assert {r.user_id: r.ids for r in social.followers(edges).collect()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert {r.user_id: r.ids for r in social.followees(edges).collect()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


@pytest.mark.parametrize("most_ids", [social.BROADCAST_IDS, 0])
def test_removal_leaves_former_followers_entries(spark, monkeypatch, most_ids):
    monkeypatch.setattr(social, "BROADCAST_IDS", most_ids)  # with none, entries meet by shuffle
    posts = timeline(spark).withColumn("mentioned", F.array(F.lit(50).cast("long")))
    before = spark.createDataFrame([(8, 7), (9, 7)], "follower long, followee long")
    home = social.home_entries(posts, before, "mentioned")
    now = before.where("follower <> 9")
    asked = spark.createDataFrame([(1, 7, 0, 1)], "req_id long, user_id long, start int, stop int")
    left = social.remove_posts(posts, timeline(spark), home, now, asked, "mentioned")
    assert sorted(r.post_id for r in left.posts.collect()) == [1, 3]
    assert sorted((r.user_id, r.post_id) for r in left.home_timeline.collect() if r.post_id == 2) == [(9, 2)]


def test_only_entries_of_removed_posts_meet_those_that_go(spark, monkeypatch):
    monkeypatch.setattr(social, "BROADCAST_IDS", 0)
    home = spark.range(50).select((F.col("id") % 9).alias("user_id"), (F.col("id") % 3 + 3).alias("timestamp"), (F.col("id") % 3 + 1).alias("post_id"))
    edges, asked = spark.createDataFrame([(8, 7)], "follower long, followee long"), spark.createDataFrame([(1, 7, 0, 1)], "req_id long, user_id long, start int, stop int")
    left = social.remove_posts(timeline(spark), timeline(spark), home, edges, asked)
    lines = [line.lstrip(" :+-") for line in left.home_timeline._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = next(i for i, line in enumerate(lines) if line.startswith("Join LeftAnti") and "user_id" in line)
    below = next(line for line in lines[at + 1 :] if not line.startswith("Project"))
    assert below.startswith("Join LeftSemi") and "post_id" in below


def test_short_links_that_meet_by_chance_stay_apart(spark):
    links = spark.createDataFrame([(1, "s", "http://a"), (2, "s", "http://b"), (2, "t", "http://c")], "post_id long, shortened_url string, expanded_url string")
    asked = links.where("post_id = 2").select("post_id", "shortened_url")
    assert sorted(r.expanded_url for r in social.extended_urls(links, asked).collect()) == ["http://b", "http://c"]
    assert [tuple(r) for r in social.remove_urls(links, asked).collect()] == [(1, "s", "http://a")]
    assert social.remove_urls(links, asked.select("shortened_url")).count() == 0  # tables without posts: by the link alone


def test_pages_from_posts_are_those_of_written_timelines(spark):
    draw = random.Random(3)
    posts = [(draw.randrange(6), draw.randrange(40), i, [draw.randrange(9)] * draw.randrange(3)) for i in range(200)]
    posts = spark.createDataFrame(posts, "user_id long, timestamp long, post_id long, mentioned array<long>")
    edges = spark.createDataFrame(sorted({(draw.randrange(9), draw.randrange(6)) for _ in range(25)}), "follower long, followee long")
    for start, stop in ((0, 5), (3, 12), (0, 300), (4, 4)):
        whole = social.page(social.home_entries(posts, edges, "mentioned").distinct(), start, stop).collect()
        assert sorted(whole) == sorted(social.home_page(posts, edges, start, stop, "mentioned").collect())
    entries = social.home_entries(posts, edges, "mentioned")
    assert entries.count() == entries.distinct().count()


def test_tokens_are_verified(spark):
    users = social.registered(spark.createDataFrame([("bob", 2, "pw"), ("zoë", 34567, "pw")], "username string, user_id long, password string"), F.lit("salt"))
    tokens = social.login(spark.createDataFrame([("bob", "pw"), ("zoë", "pw")], "username string, password string"), users, "secret", F.lit(100)).select("token")
    assert sorted(tuple(r)[1:] for r in social.verified(tokens, "secret", F.lit(3700)).collect()) == [(2, "bob"), (34567, "zoë")]
    assert social.verified(tokens, "secret", F.lit(3701)).count() == 0 and social.verified(tokens, "other", F.lit(100)).count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("a.b",), ("a.b.c.d",)], "token string")
    assert social.verified(odd, "secret", F.lit(0)).count() == 0


def test_media_arrays_default_to_empty(spark):
    media = lambda i, t: one(spark, social.decoded_media(F.lit(i), F.lit(t)))
    assert media("[5, 6]", '["png","jpg"]') == [(5, "png"), (6, "jpg")] and media(None, "") == [] and media(" [ ] ", None) == []
    for ids, types in (("[5]", "[]"), ("[5", '["png"]'), ("x", "[]")):
        with pytest.raises(Exception, match="differ in number|JSON array"):
            media(ids, types)


def test_post_store(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, text string")
    assert sorted(map(tuple, social.store_posts(posts, spark.createDataFrame([(2, "x"), (3, "c")], "post_id long, text string")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    ids = spark.createDataFrame([(2,), (2,), (9,)], "post_id long")
    assert [r.text for r in social.posts_of(posts, ids).collect()] == ["b"]
    left, gone = social.delete_posts(posts, ids)
    assert [r.post_id for r in left.collect()] == [1] and sorted(map(tuple, gone.collect())) == [(2, True), (9, False)]


def test_compose_writes_all_tables(spark):
    users = social.registered(spark.createDataFrame([("bob", 2, "B", "B", "pw"), ("eve", 3, "E", "E", "pw")], "username string, user_id long, first_name string, last_name string, password string"), F.lit("s"))
    asked = spark.createDataFrame(
        [(100, 1, "bob", 2, "hi @eve @nobody http://a.b/c", [5], ["png"], 0, 9)],
        "post_id long, req_id long, username string, user_id long, text string, media_ids array<long>, media_types array<string>, post_type int, timestamp long",
    )
    made = social.compose_posts(asked, users, spark.createDataFrame([(4, 2)], "follower long, followee long"))
    post = made.posts.first()
    assert post.user_mentions == [(3, "eve")] and post.media == [(5, "png")] and post.urls[0].expanded_url == "http://a.b" and post.text.endswith("/c")
    assert sorted(r.user_id for r in made.home_timeline.collect()) == [3, 4]
    assert made.short_links.count() == 1


def test_strict_forms_fail(spark):
    users = spark.createDataFrame([("bob", 2)], "username string, user_id long")
    posts = spark.createDataFrame([(1, "@eve")], "post_id long, text string")
    assert social.resolved_mentions(posts, users).count() == 0
    with pytest.raises(Exception, match="unknown user eve"):
        social.resolved_mentions(posts, users, strict=True).collect()
    with pytest.raises(Exception, match="differ in number"):
        spark.range(1).select(social.composed_media(F.array(F.lit(1)), F.array().cast("array<string>"))).collect()


def test_login_token_is_a_signed_one(spark):
    users = social.registered(spark.createDataFrame([("bob", 2, "pw")], "username string, user_id long, password string"), F.lit("salt"))
    tries = spark.createDataFrame([("bob", "pw"), ("bob", "no"), ("eve", "pw")], "username string, password string")
    got = {(r.username, r.password): r for r in social.login(tries, users, "secret", F.lit(17)).collect()}
    assert [got[k].status for k in (("bob", "pw"), ("bob", "no"), ("eve", "pw"))] == ["OK", "WRONG_PASSWORD", "NOT_REGISTERED"]
    head, claims, signature = got["bob", "pw"].token.split(".")
    right = hmac.new(b"secret", f"{head}.{claims}".encode(), hashlib.sha256).digest()
    assert base64.urlsafe_b64decode(signature + "=") == right
    assert json.loads(base64.urlsafe_b64decode(claims + "==")) == {"timestamp": "17", "ttl": "3600", "user_id": "2", "username": "bob"}
    assert got["bob", "no"].token is None


def test_unique_id(spark):
    got = one(spark, scalars.unique_id(F.lit(0xABC), F.lit(1514764800001), F.lit(2)))
    assert got == 0x2BC0000000001002


def test_splitmix(spark):
    mask, x, expected = (1 << 64) - 1, 42, []
    for _ in range(20):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        expected.append(z ^ z >> 31)
    got = spark.range(1, 21).select(scalars.splitmix64(42, F.col("id")).alias("z")).collect()
    assert [int(r.z) for r in got] == expected


def test_followers_of_a_hot_user_come_in_bounded_chunks(spark):
    rows = [(f, 1) for f in range(1000)] * 2 + [(f, 2) for f in range(7)] + [(5, 3)]
    edges = spark.createDataFrame(rows, "follower long, followee long").repartition(5)
    for hot_rows in (100, 10_000):
        chunks = social.follower_chunks(edges, 64, hot_rows)
        got = {(r.user_id, r.chunk): r.ids for r in chunks.collect()}
        assert got == {(1, c): list(range(64 * c, min(1000, 64 * c + 64))) for c in range(16)} | {(2, 0): list(range(7)), (3, 0): [5]}
        asked = spark.createDataFrame([(1, 999), (1, 1000), (1, 64), (2, 7), (3, 5), (4, 4), (3, 5)], "user_id long, follower long")
        assert sorted(map(tuple, social.is_follower(chunks, asked).collect())) == [(1, 64, True), (1, 999, True), (1, 1000, False), (2, 7, False), (3, 5, True), (3, 5, True), (4, 4, False)]


def test_readers_come_in_bounded_lists(spark):
    edges = [(f, 7) for f in range(200)] + [(1, 8), (None, 8), (None, 7), (2, None)]
    lists = [(r.user_id, r.readers) for r in social.reader_lists(spark.createDataFrame(edges, "follower long, followee long"), 40).collect()]
    assert all(len(ids) <= 40 for _, ids in lists) and len([u for u, _ in lists if u == 7]) > 1 and len([u for u, _ in lists if u == 8]) == 1
    key = lambda e: (e[1], e[0] is None, e[0] or 0)
    assert sorted(((f, u) for u, ids in lists for f in ids), key=key) == sorted((e for e in edges if e[1] is not None), key=key)


def test_fan_out_makes_entries_after_the_join(spark):
    posts = spark.createDataFrame([(7, 1, 10), (7, 2, 11), (8, 3, 12), (9, 4, 13)], "user_id long, timestamp long, post_id long")
    entries = social.home_entries(posts, spark.createDataFrame([(1, 7), (None, 7), (2, 8)], "follower long, followee long"))
    assert sorted((str(r.user_id), r.timestamp, r.post_id) for r in entries.collect()) == [("1", 1, 10), ("1", 2, 11), ("2", 3, 12), ("None", 1, 10), ("None", 2, 11)]
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(readers" in plan.split("Join Inner")[0]


def test_mentions_are_looked_up_in_the_readers_lists(spark, monkeypatch):
    monkeypatch.setattr(social, "CHUNK_IDS", 4)  # 7's followers come in three lists, 9 has one, 5 has none
    edges = [(f, 7) for f in range(6)] + [(None, 7), (1, 9), (None, 9), (3, None)]
    named = [*range(12), 3, 11, None, None]
    posts = [(u, 10 + i, 100 + i, m) for i, (u, m) in enumerate([(7, named), (9, named), (5, named), (None, [1, 3]), (7, None), (9, [1]), (5, None)])]
    entries = social.home_entries(
        spark.createDataFrame(posts, "user_id long, timestamp long, post_id long, mentioned array<long>"), spark.createDataFrame(edges, "follower long, followee long"), "mentioned"
    )
    expected = []
    for u, t, p, m in posts:
        own = [f for f, e in edges if u is not None and e == u]
        expected += [(f, t, p) for f in own + [x for x in dict.fromkeys(m or []) if x is None or x not in own]]
    assert sorted(map(str, map(tuple, entries.collect()))) == sorted(map(str, expected))


def test_messages_are_parsed_once(spark):
    from braidworks.streaming.fanout import entries_of_messages

    entries = entries_of_messages(spark.createDataFrame([('{"post_id": 1}',)], "value string"), spark.createDataFrame([(1, 7)], "follower long, followee long"))
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [value") == 1


def test_composing_looks_mentions_up_only_where_they_matter(spark):
    users = spark.createDataFrame([("eve", 3)], "username string, user_id long")
    asked = spark.createDataFrame(
        [(100, 1, "bob", 2, "hi @eve http://a.b/c http://a.b/d", [5], ["png"], 0, 9), (101, 1, "bob", 2, "none", [5], ["png"], 0, 9)],
        "post_id long, req_id long, username string, user_id long, text string, media_ids array<long>, media_types array<string>, post_type int, timestamp long",
    )
    made = social.compose_posts(asked, users, spark.createDataFrame([(4, 2)], "follower long, followee long"))
    assert "Join" not in "".join(t._jdf.queryExecution().optimizedPlan().toString() for t in (made.user_timeline, made.short_links))
    assert sorted((r.user_id, r.post_id) for r in made.home_timeline.collect()) == [(3, 100), (4, 100), (4, 101)]
    assert [(r.post_id, r.expanded_url) for r in made.short_links.collect()] == [(100, "http://a.b"), (100, "http://a.b")]


def test_tasks_that_compare_pairs_follow_their_number(spark, monkeypatch):
    from braidworks.plans import social_queries

    data = "/root/testdata/sf0.001"
    rows = social_queries.read(spark, data, "lineitem").count()
    monkeypatch.setattr(social_queries, "TASK_PAIRS", 500)
    edges = social_queries._edges(spark, data)
    assert f", {rows // 500}" in next(line for line in edges._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line)
    assert edges.count() == social_queries._pairs(spark, data).distinct().count()


def test_a_home_table_stays_where_it_is_with_over_a_million_removed_posts(spark, monkeypatch):
    monkeypatch.setattr(social, "BROADCAST_IDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mine = spark.range(1_050_000).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("timestamp"), F.col("id").alias("post_id"))
        home = spark.range(9).select((F.col("id") + 1).alias("user_id"), F.lit(1).cast("long").alias("timestamp"), F.col("id").alias("post_id"))
        edges = spark.createDataFrame([(1, 0), (3, 3)], "follower long, followee long")
        asked = spark.range(1_049_999).select("id", F.col("id").alias("user_id"), F.col("id").alias("req_id"), F.lit(0).alias("start"), F.lit(1).alias("stop")).drop("id")
        left = social.remove_posts(mine, mine, home, edges, asked)
        plan = left.home_timeline._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [post_id" in line]
        assert len(joins) > 1 and all("BroadcastHashJoin" in line for line in joins)
        assert sorted(r.post_id for r in left.home_timeline.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]  # only post 0 has a reader among its author's followers here
        assert [tuple(r) for r in left.user_timeline.collect()] == [(1_049_999, 1, 1_049_999)] and left.posts.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
