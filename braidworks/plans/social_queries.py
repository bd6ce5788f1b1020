"""Timelines, followers, posts and users: events are posts, orders and line items make the followers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidworks.functions import scalars, text
from braidworks.operators import social
from braidworks.sources import graphs, timelines
from braidworks.sources.checkpoints import shared_folder, snapshot

from .registry import query, read


def _timeline(spark, d):
    return read(spark, d, "events").select("user_id", F.col("ts").alias("timestamp"), F.col("event_id").alias("post_id"))


def _posts(spark, d):
    """Posts that are still there: without those of type `error`. Timelines keep these."""
    return read(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("post_id"), "user_id", F.col("ts").alias("timestamp"), "event_type", "value")


def _pairs(spark, d):
    """Who bought of whom, as often as it happened."""
    orders, items = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("follower"), F.col("l_suppkey").alias("followee"))


#: Pairs that a task compares, about: their number decides how many tasks there are, so what one holds stays the same.
TASK_PAIRS = 1 << 18


def _edges(spark, d):
    """Who bought of whom, once. Dealt as the look-up of a mentioned user among the author's followers needs it."""
    tasks = max(spark.sparkContext.defaultParallelism, read(spark, d, "lineitem").count() // TASK_PAIRS)
    return _pairs(spark, d).repartition(tasks, "followee", "follower").distinct()


def _texts(spark, d):
    e = read(spark, d, "events")
    user, event, seventh = ((F.col(c) % n).cast("string") for c, n in (("user_id", 50), ("event_id", 1 << 62), ("event_id", 7)))
    words = F.concat("event_type", F.lit(" @username_"), user, F.lit(" http://h"), event, F.lit(".x/p and @nobody-here https://y"), seventh, F.lit("?q end"))
    return e.select(F.col("event_id").alias("post_id"), "user_id", words.alias("text"))


def _users(spark, d):
    e = read(spark, d, "events").select("user_id").distinct()
    name = lambda s: F.concat(F.lit(s), F.col("user_id").cast("string"))
    accounts = e.select(name("username_").alias("username"), "user_id", name("first_").alias("first_name"), name("last_").alias("last_name"), name("password_").alias("password"))
    return social.registered(accounts, name("salt_"))


_RANKED = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM events"
_LIVE = "(SELECT event_id, event_type FROM events WHERE event_type <> 'error')"
_EDGES = "(SELECT DISTINCT o_custkey AS follower, l_suppkey AS followee FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"SELECT user_id, r.event_id AS post_id, CAST(rank AS INTEGER) AS rank, event_type FROM ({_RANKED}) r JOIN {_LIVE} l ON l.event_id = r.event_id WHERE rank < 10")
def sn_read_user_timeline(spark, d):
    entries = social.page(_timeline(spark, d), 0, 10)
    return social.read_posts(entries, _posts(spark, d)).select("user_id", "post_id", "rank", "event_type")


@query(f"""
WITH q AS (SELECT c_custkey AS req_id, c_custkey % 150 AS user_id, CAST(c_custkey % 7 AS INTEGER) - 1 AS start, CAST(c_custkey % 11 AS INTEGER) AS stop FROM customer)
SELECT req_id, r.event_id AS post_id, event_type FROM q JOIN ({_RANKED}) r ON r.user_id = q.user_id AND rank >= start AND rank < stop AND start >= 0 JOIN {_LIVE} l ON l.event_id = r.event_id""")
def sn_timeline_requests(spark, d):
    c = F.col("c_custkey")
    asked = read(spark, d, "customer").select(c.alias("req_id"), (c % 150).alias("user_id"), (c % 7 - 1).cast("int").alias("start"), (c % 11).cast("int").alias("stop"))
    return social.read_posts(social.pages(_timeline(spark, d), asked), _posts(spark, d)).select("req_id", "post_id", "event_type")


@query(f"""
WITH day AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) - 1 AS rank FROM events)
SELECT user_id, event_id AS post_id, CAST(rank AS INTEGER) AS rank FROM day WHERE rank >= 2 AND rank < 9""")
def sn_timeline_ties(spark, d):
    days = _timeline(spark, d).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return social.page(days, 2, 9).select("user_id", "post_id", "rank")


_HOME = f"""(SELECT DISTINCT user_id, ts, event_id FROM (
  SELECT follower AS user_id, ts, event_id FROM events JOIN {_EDGES} ON followee = user_id
  UNION ALL SELECT (user_id + 1) % 150, ts, event_id FROM events WHERE event_id % 3 = 0))"""


def _mentioning(spark, d):
    """Posts with whom they mention: every third one the author's neighbour."""
    mentioned = F.when(F.col("post_id") % 3 == 0, F.array((F.col("user_id") + 1) % 150)).otherwise(F.array().cast("array<bigint>"))
    return _timeline(spark, d).withColumn("mentioned", mentioned)


def _home(spark, d, edges=None):
    return social.home_entries(_mentioning(spark, d), _edges(spark, d) if edges is None else edges, "mentioned")


@query(f"SELECT user_id, event_id AS post_id FROM {_HOME}")
def sn_write_home_timeline(spark, d):
    return _home(spark, d).select("user_id", "post_id")


@query(f"""
SELECT user_id, r.event_id AS post_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM {_HOME}) r
JOIN {_LIVE} l ON l.event_id = r.event_id WHERE rank < 10""")
def sn_read_home_timeline_dangling(spark, d):
    entries = social.home_page(_mentioning(spark, d), _edges(spark, d), 0, 10, "mentioned")
    return social.read_posts(entries, _posts(spark, d)).select("user_id", "post_id", "event_type")


@query("SELECT DISTINCT user_id, event_id AS post_id FROM events")
def sn_write_user_timeline(spark, d):
    timeline = _timeline(spark, d)
    return social.write_user_timeline(timeline.where("post_id % 2 = 0"), timeline).select("user_id", "post_id")


_CUT = f"(SELECT user_id, event_id FROM ({_RANKED}) WHERE rank < 3 + user_id % 2)"
_GONE = f"(SELECT c.user_id, c.event_id FROM {_CUT} c JOIN {_LIVE} l ON l.event_id = c.event_id)"


@query(f"""
SELECT 'posts' AS "table", count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {_LIVE} WHERE event_id NOT IN (SELECT event_id FROM {_GONE})
UNION ALL SELECT 'user_timeline', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id NOT IN (SELECT event_id FROM {_CUT})
UNION ALL SELECT 'home_timeline', count(*), CAST(sum(event_id) AS BIGINT) FROM {_HOME} h WHERE NOT EXISTS (
  SELECT 1 FROM {_GONE} g JOIN {_EDGES} e ON e.followee = g.user_id WHERE e.follower = h.user_id AND g.event_id = h.event_id)
  AND NOT (event_id % 3 = 0 AND EXISTS (SELECT 1 FROM {_GONE} g WHERE g.event_id = h.event_id AND (g.user_id + 1) % 150 = h.user_id))
UNION ALL SELECT 'short_links', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id NOT IN (SELECT event_id FROM {_GONE})""")
def sn_remove_posts(spark, d):
    """Of every user's newest three or four posts: posts, both kinds of entries, mentioned users' entries and short links go."""
    timeline, edges, links = _timeline(spark, d), snapshot(_edges(spark, d)), F.concat(F.lit("s"), F.col("post_id").cast("string"))
    asked = timeline.select("user_id").distinct().select("user_id", F.col("user_id").alias("req_id"), F.lit(0).alias("start"), (F.col("user_id") % 2 + 3).cast("int").alias("stop"))
    posts = _posts(spark, d).join(_mentioning(spark, d).select("post_id", "mentioned"), "post_id").withColumn("urls", F.array(F.struct(links.alias("shortened_url"))))
    short = timeline.select(links.alias("shortened_url"), "post_id")
    left = social.remove_posts(posts, timeline, _home(spark, d, edges), edges, asked, "mentioned", "urls", short)
    count = lambda t, name: t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.sum("post_id").alias("ids"))
    return reduce(DataFrame.unionByName, [count(getattr(left, name), name) for name in ("posts", "user_timeline", "home_timeline", "short_links")])


@query(f"""
SELECT step, user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {_HOME} h, (SELECT unnest(['merged', 'compacted']) AS step) WHERE NOT EXISTS (
  SELECT 1 FROM {_GONE} g JOIN {_EDGES} e ON e.followee = g.user_id WHERE e.follower = h.user_id AND g.event_id = h.event_id) GROUP BY 1, 2""")
def sn_remove_by_tombstones(spark, d):
    """Removed posts' entries go from a stored home timeline: hidden by tombstones first, then compacted away."""
    store = timelines.TimelineStore(spark, f"{shared_folder(spark)}/timelines-{uuid.uuid4()}")
    edges = snapshot(_edges(spark, d))
    lists = snapshot(social.reader_lists(edges, bucket=store.bucket))
    store.add(social.home_lists(_mentioning(spark, d), lists, edges, store.bucket, "mentioned"), 1)
    asked = _timeline(spark, d).select("user_id").distinct().select("user_id", F.col("user_id").alias("req_id"), F.lit(0).alias("start"), (F.col("user_id") % 2 + 3).cast("int").alias("stop"))
    gone = social.pages(_timeline(spark, d), asked).join(_posts(spark, d).select("post_id"), "post_id").select("user_id", "timestamp", "post_id")
    store.remove(social.home_lists(gone, lists), 2)
    sums = lambda step: snapshot(store.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("post_id").alias("ids")).withColumn("step", F.lit(step)))
    merged = sums("merged")
    store.compact(3)
    compacted = sums("compacted")
    store.delete()
    return merged.unionByName(compacted).select("step", "user_id", "n", "ids")


@query(f"""
SELECT 'stored' AS step, event_id AS post_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'new' END AS state FROM events WHERE event_type <> 'error' OR event_id % 2 = 1
UNION ALL SELECT 'read', event_id, event_type FROM {_LIVE} WHERE event_id IN (SELECT c_custkey * 5 FROM customer)
UNION ALL SELECT 'left', event_id, event_type FROM {_LIVE} WHERE event_id NOT IN (SELECT c_custkey * 5 FROM customer)
UNION ALL SELECT 'deleted', c_custkey * 5, CASE WHEN c_custkey * 5 IN (SELECT event_id FROM {_LIVE}) THEN 'existed' ELSE 'unknown' END FROM customer""")
def sn_post_store(spark, d):
    """Storing keeps the post of an id that is there; reading and deleting take lists of ids."""
    posts = _posts(spark, d).select("post_id", F.col("event_type").alias("state"))
    new = read(spark, d, "events").where("event_id % 2 = 1").select(F.col("event_id").alias("post_id"), F.lit("new").alias("state"))
    ids = read(spark, d, "customer").select((F.col("c_custkey") * 5).alias("post_id"))
    left, gone = social.delete_posts(posts, ids)
    parts = {
        "stored": social.store_posts(posts.where("post_id % 2 = 0"), new), "read": social.posts_of(posts, ids), "left": left,
        "deleted": gone.select("post_id", F.when(F.col("existed"), "existed").otherwise("unknown").alias("state")),
    }
    return reduce(DataFrame.unionByName, [t.select(F.lit(step).alias("step"), "post_id", "state") for step, t in parts.items()])


@query(f"SELECT followee AS user_id, string_agg(follower, ',' ORDER BY follower) AS ids FROM {_EDGES} GROUP BY 1")
def sn_followers(spark, d):
    return social.followers(_edges(spark, d)).select("user_id", F.array_join("ids", ",").alias("ids"))


@query(f"""
SELECT user_id, chunk, string_agg(follower, ',' ORDER BY follower) AS ids FROM (
  SELECT followee AS user_id, follower, CAST((row_number() OVER (PARTITION BY followee ORDER BY follower) - 1) // 100 AS BIGINT) AS chunk FROM {_EDGES}) GROUP BY 1, 2""")
def sn_follower_chunks(spark, d):
    return social.follower_chunks(_edges(spark, d), 100).select("user_id", "chunk", F.array_join("ids", ",").alias("ids"))


@query(f"""
SELECT followee AS user_id, follower, e IS NOT NULL AS follows FROM (SELECT c_custkey % 101 AS followee, c_custkey AS follower FROM customer)
LEFT JOIN (SELECT *, 1 AS e FROM {_EDGES}) USING (followee, follower)""")
def sn_is_follower(spark, d):
    asked = read(spark, d, "customer").select((F.col("c_custkey") % 101).alias("user_id"), F.col("c_custkey").alias("follower"))
    return social.is_follower(social.follower_chunks(_edges(spark, d), 100), asked)


@query(f"SELECT follower AS user_id, string_agg(followee, ',' ORDER BY followee) AS ids FROM {_EDGES} GROUP BY 1")
def sn_followees(spark, d):
    return social.followees(_edges(spark, d)).select("user_id", F.array_join("ids", ",").alias("ids"))


@query(f"SELECT follower, followee FROM {_EDGES} WHERE follower % 3 <> 0 UNION SELECT c_custkey, 0 FROM customer WHERE c_custkey % 3 <> 0")
def sn_follow_unfollow(spark, d):
    edges = social.follow(_edges(spark, d), read(spark, d, "customer").select(F.col("c_custkey").alias("follower"), F.lit(0).cast("long").alias("followee")))
    return social.unfollow(edges, edges.where("follower % 3 = 0"))


_USERS = "(SELECT DISTINCT 'username_' || user_id AS username, user_id FROM events)"


@query(f"""
SELECT a.user_id AS follower, b.user_id AS followee FROM customer JOIN {_USERS} a ON a.username = 'username_' || c_custkey
JOIN {_USERS} b ON b.username = 'username_' || c_custkey * 7 WHERE a.user_id <> 0 AND b.user_id <> 0""")
def sn_follow_by_name(spark, d):
    name = lambda k: F.concat(F.lit("username_"), (F.col("c_custkey") * k).cast("string"))
    return social.edges_by_name(read(spark, d, "customer").select(name(1).alias("follower_name"), name(7).alias("followee_name")), _users(spark, d))


_TEXTS = "(SELECT event_id AS post_id, event_type || ' @username_' || user_id % 50 || ' http://h' || event_id || '.x/p and @nobody-here https://y' || event_id % 7 || '?q end' AS text FROM events)"
_FOUND = f"(SELECT post_id, text, regexp_extract_all(text, '(http://|https://)([a-zA-Z0-9_!~*''().&=+$%-]+)', 0) AS links FROM {_TEXTS})"
_SHORT = "'http://short-url/' || substr(sha256({link} || '|' || post_id || ':' || {i}), 1, 10)"


@query(f"""
SELECT post_id, CAST(pos - 1 AS INTEGER) AS pos, m.username, user_id FROM
 (SELECT post_id, unnest(names) AS username, unnest(range(1, len(names) + 1)) AS pos FROM (SELECT post_id, regexp_extract_all(text, '@([a-zA-Z0-9_-]+)', 1) AS names FROM {_TEXTS})) m
JOIN {_USERS} u ON u.username = m.username""")
def sn_mentions_resolved(spark, d):
    return social.resolved_mentions(_texts(spark, d), _users(spark, d))


@query(f"""
SELECT post_id, array_to_string(links, ' ') AS links,
  replace(replace(text, links[1], {_SHORT.format(link='links[1]', i=0)}), links[2], {_SHORT.format(link='links[2]', i=1)}) AS text FROM {_FOUND}""")
def sn_urls_shortened_text(spark, d):
    done = social.composed_text(_texts(spark, d))
    return done.select("post_id", F.array_join(F.transform("urls", lambda u: u["expanded_url"]), " ").alias("links"), "text")


@query(
    f"SELECT DISTINCT {_SHORT.format(link='link', i='i')} AS shortened_url, link AS expanded_url FROM (SELECT post_id, unnest(links) AS link, unnest(range(len(links))) AS i"
    f" FROM {_FOUND}) WHERE post_id % 2 = 0"
)
def sn_extended_urls(spark, d):
    made = social.composed_text(_texts(spark, d)).select("post_id", F.explode("urls").alias("u")).select("post_id", "u.*")
    asked = made.where("post_id % 2 = 0").select("post_id", "shortened_url").distinct()
    return social.extended_urls(made, asked).select("shortened_url", "expanded_url").distinct()


@query(
    f"SELECT {_SHORT.format(link='link', i='i')} AS shortened_url, link AS expanded_url FROM (SELECT post_id, unnest(links) AS link, unnest(range(len(links))) AS i"
    f" FROM {_FOUND}) WHERE post_id % 2 = 1"
)
def sn_remove_urls(spark, d):
    made = social.composed_text(_texts(spark, d)).select("post_id", F.explode("urls").alias("u")).select("post_id", "u.*")
    return social.remove_urls(made, made.where("post_id % 2 = 0")).drop("post_id")


@query(f"""
SELECT 'username_' || c_custkey AS username, CASE WHEN user_id IS NULL THEN 'NOT_REGISTERED'
  WHEN sha256('password_' || c_custkey % 100 || 'salt_' || user_id) = sha256('password_' || user_id || 'salt_' || user_id) THEN 'OK' ELSE 'WRONG_PASSWORD' END AS status
FROM customer LEFT JOIN {_USERS} u ON u.username = 'username_' || c_custkey""")
def sn_login_status(spark, d):
    c = F.col("c_custkey").cast("string")
    attempts = read(spark, d, "customer").select(F.concat(F.lit("username_"), c).alias("username"), F.concat(F.lit("password_"), (F.col("c_custkey") % 100).cast("string")).alias("password"))
    return social.login(attempts, _users(spark, d), "secret", F.lit(1700000000)).select("username", "status")


def _keyed_pad(byte: int) -> str:
    """The padded key `secret` of a keyed hash as a SQL blob."""
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in b"secret".ljust(64, b"\0")) + "'::BLOB"


_URL64 = "rtrim(translate(to_base64({0}), '+/', '-_'), '=')"
_HEAD, _CLAIMS = """'{"alg":"HS256","typ":"JWT"}'""", """'{"timestamp":"1700000000","ttl":"3600","user_id":"' || user_id || '","username":"username_' || user_id || '"}'"""
_MESSAGE = f"{_URL64.format(f'encode({_HEAD})')} || '.' || {_URL64.format(f'encode({_CLAIMS})')}"
_TOKENS = f"""(SELECT user_id, message || '.' || {_URL64.format(f"unhex(sha256({_keyed_pad(0x5C)} || unhex(sha256({_keyed_pad(0x36)} || encode(message)))))")} AS token
  FROM (SELECT user_id, {_MESSAGE} AS message FROM (SELECT DISTINCT user_id FROM events)))"""


def _logged_in(spark, d):
    name = F.concat(F.lit("password_"), F.col("user_id").cast("string"))
    users = _users(spark, d)
    return social.login(users.select("username", name.alias("password")), users, "secret", F.lit(1700000000))


@query(f"SELECT 'username_' || user_id AS username, 'password_' || user_id AS password, 'OK' AS status, token FROM {_TOKENS}")
def sn_login_tokens(spark, d):
    return _logged_in(spark, d)


@query("SELECT user_id, 'username_' || user_id AS username FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0")
def sn_verified_tokens(spark, d):
    """Of three users one sends the token as given, one with another's claims, one with a broken signature."""
    n = F.regexp_extract("username", "[0-9]+", 0).cast("long") % 3
    other = F.when(n == 1, F.regexp_replace("token", "\\.[^.]+\\.", ".e30.")).otherwise(F.concat("token", F.lit("A")))
    sent = _logged_in(spark, d).select("username", F.when(n == 0, F.col("token")).otherwise(other).alias("token"))
    return social.verified(sent.select("token"), "secret", F.lit(1700000100)).select("user_id", "username")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || ':png,' || (p_size + 1) || ':jpg' ELSE '' END AS media FROM part")
def sn_media_decoded(spark, d):
    p, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    ids = F.when(n == 0, F.concat(F.lit("["), p, F.lit(","), (F.col("p_size") + 1).cast("string"), F.lit("]"))).when(n == 1, F.lit("[]"))
    types = F.when(n == 0, F.lit('["png", "jpg"]')).when(n == 1, F.lit(""))
    media = social.decoded_media(ids, types)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(media, lambda m: F.concat_ws(":", m["media_id"].cast("string"), m["media_type"])), ",").alias("media"))


@query("SELECT event_id, (event_id * 1000) << 8 | (user_id % 46) AS id FROM events")
def sn_port_unique_id(spark, d):
    return read(spark, d, "events").select("event_id", scalars.port_unique_id(F.col("event_id") * 1000, F.col("user_id") % 46).alias("id"))


@query(
    "SELECT username, user_id, sha256('password_' || user_id || 'salt_' || user_id) AS password_hashed, user_id << 16 AS shifted_id"
    " FROM (SELECT DISTINCT 'username_' || user_id AS username, user_id FROM events)"
)
def sn_register_users(spark, d):
    return _users(spark, d).select("username", "user_id", "password_hashed", social.user_id_of(F.col("user_id")).alias("shifted_id"))


@query("SELECT 'username_' || c_custkey AS username, user_id FROM customer JOIN (SELECT DISTINCT user_id FROM events) ON user_id = c_custkey")
def sn_creators(spark, d):
    names = read(spark, d, "customer").select(F.concat(F.lit("username_"), F.col("c_custkey").cast("string")).alias("username"))
    return social.creators(names, _users(spark, d)).select("username", F.col("creator.user_id").alias("user_id"))


@query("""
SELECT event_id, ((CAST(user_id AS BIGINT) & 2047) << 52) | (((1514764800000 + event_id * 1000 - 1514764800000) & 1099511627775) << 12) | ((event_id % 5000) & 4095) AS id FROM events""")
def sn_unique_id(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", scalars.unique_id(F.col("user_id").bitwiseAND(2047), e * 1000 + 1514764800000, e % 5000).alias("id"))


@query("SELECT p_partkey, p_partkey || ':' || 'png,' || (p_size + 1) || ':jpg' AS media FROM part")
def sn_media_zip(spark, d):
    ids = F.array("p_partkey", (F.col("p_size") + 1).cast("long"))
    media = social.composed_media(ids, F.array(F.lit("png"), F.lit("jpg")))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(media, lambda m: F.concat_ws(":", m["media_id"].cast("string"), m["media_type"])), ",").alias("media"))


@query("SELECT p_partkey, split_part('a.' || replace(p_name, ' ', '.'), '.', 3) AS media_type, CAST(CAST('0x' || substr(md5(p_name), 1, 15) AS UBIGINT) AS BIGINT) AS media_id FROM part")
def sn_media_name_parse(spark, d):
    name = F.concat(F.lit("a."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    return read(spark, d, "part").select("p_partkey", text.media_type(name).alias("media_type"), text.media_id(F.md5("p_name")).alias("media_id"))


@query("SELECT c_custkey AS filename, coalesce(p_name, '') AS data FROM customer LEFT JOIN part ON p_partkey = c_custkey * 3")
def sn_get_media(spark, d):
    files = read(spark, d, "part").select(F.col("p_partkey").alias("filename"), F.col("p_name").cast("binary").alias("data"))
    asked = read(spark, d, "customer").select((F.col("c_custkey") * 3).alias("filename"), "c_custkey")
    return social.get_media(files, asked).select(F.col("c_custkey").alias("filename"), F.col("data").cast("string").alias("data"))


@query(f"""
SELECT t.post_id, len(regexp_extract_all(text, 'https?://')) AS n_urls, CAST(count(u.user_id) AS INTEGER) AS n_mentions FROM {_TEXTS} t
LEFT JOIN {_USERS} u ON text LIKE '%@' || u.username || ' %' GROUP BY 1, 2""")
def sn_compose_posts(spark, d):
    e = _texts(spark, d)
    asked = e.select(
        "post_id", F.col("post_id").alias("req_id"), F.concat(F.lit("username_"), F.col("user_id").cast("string")).alias("username"), "user_id", "text",
        F.array("post_id").alias("media_ids"), F.array(F.lit("png")).alias("media_types"), F.lit(0).alias("post_type"), F.col("post_id").alias("timestamp"),
    )
    posts = social.compose_posts(asked, _users(spark, d), _edges(spark, d)).posts
    return posts.select("post_id", F.size("urls").cast("long").alias("n_urls"), F.size("user_mentions").alias("n_mentions"))


@query(f"""
WITH t AS (SELECT e.post_id, user_id, text FROM {_TEXTS} e JOIN (SELECT event_id AS post_id, user_id FROM events) USING (post_id)),
named AS (SELECT post_id, u.user_id AS reader FROM {_TEXTS} x JOIN {_USERS} u ON text LIKE '%@' || u.username || ' %')
SELECT 'user_timeline' AS "table", user_id, post_id, '' AS link FROM t
UNION ALL SELECT 'home_timeline', user_id, post_id, '' FROM (SELECT follower AS user_id, post_id FROM t JOIN {_EDGES} ON followee = t.user_id UNION SELECT reader, post_id FROM named)
UNION ALL SELECT 'short_links', CAST(-1 AS BIGINT), post_id, {_SHORT.format(link='link', i='i')} || ' ' || link
FROM (SELECT post_id, unnest(links) AS link, unnest(range(len(links))) AS i FROM {_FOUND})""")
def sn_compose_outputs(spark, d):
    """What composing puts into the other tables: the author's timeline, the readers' home timelines, short links."""
    e = _texts(spark, d)
    asked = e.select(
        "post_id", F.col("post_id").alias("req_id"), F.concat(F.lit("username_"), F.col("user_id").cast("string")).alias("username"), "user_id", "text",
        F.array("post_id").alias("media_ids"), F.array(F.lit("png")).alias("media_types"), F.lit(0).alias("post_type"), F.col("post_id").alias("timestamp"),
    )
    made = social.compose_posts(asked, _users(spark, d), _edges(spark, d))
    parts = {name: getattr(made, name).select("user_id", "post_id", F.lit("").alias("link")) for name in ("user_timeline", "home_timeline")}
    parts["short_links"] = made.short_links.select(F.lit(-1).cast("long").alias("user_id"), "post_id", F.concat_ws(" ", "shortened_url", "expanded_url").alias("link"))
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("table"), "user_id", "post_id", "link") for name, t in parts.items()])


@query("SELECT event_id AS post_id, '{\"post_id\":\"' || event_id || '\",\"creator\":{\"user_id\":\"' || user_id || '\"},\"timestamp\":\"' || event_id * 2 || '\"}' AS json FROM events")
def sn_post_json(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("post_id"), "user_id", (F.col("event_id") * 2).alias("timestamp"))
    return rows.select("post_id", social.timeline_json(rows).alias("json"))


@query("SELECT event_id AS post_id, user_id, event_type AS text FROM events")
def sn_post_json_roundtrip(spark, d):
    from braidworks.schemas import POST

    empty = F.array()
    rows = read(spark, d, "events").select(F.struct(
        F.col("event_id").alias("post_id"), F.struct("user_id", F.col("event_type").alias("username")).alias("creator"), F.lit(1).cast("long").alias("req_id"), F.col("event_type").alias("text"),
        empty.cast(POST["user_mentions"].dataType).alias("user_mentions"), empty.cast(POST["media"].dataType).alias("media"), empty.cast(POST["urls"].dataType).alias("urls"),
        F.col("event_id").alias("timestamp"), F.lit(0).alias("post_type")).alias("p"))
    back = rows.select(F.from_json(F.to_json("p"), POST).alias("p"))
    return back.select("p.post_id", F.col("p.creator.user_id").alias("user_id"), "p.text")


@query(f"SELECT user_id, event_id AS post_id FROM ({_RANKED}) WHERE rank < 10")
def sn_two_tier_page(spark, d):
    timeline = _timeline(spark, d)
    return social.two_tier_page(timeline.where("post_id % 3 = 0"), timeline, 0, 10).select("user_id", "post_id")


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND NOT (event_id + 3600 < 5000)")
def sn_live_sessions(spark, d):
    e = F.col("event_id")
    user = F.when(e % 5 != 0, F.col("user_id")).alias("user_id")
    rows = read(spark, d, "events").select("event_id", user, F.lit(0).alias("start"), F.lit(10).alias("stop"), e.alias("timestamp"), F.lit(3600).alias("ttl"))
    return social.live_sessions(rows, F.lit(5000)).select("event_id")


@query(f"SELECT follower AS x, followee AS y FROM {_EDGES} UNION SELECT followee, follower FROM {_EDGES}")
def io_graph_symmetrize(spark, d):
    return graphs.symmetric(_pairs(spark, d).select(F.col("follower").alias("x"), F.col("followee").alias("y")))


@query(
    "SELECT user_id, event_id AS post_id FROM (SELECT follower AS user_id, event_id FROM events JOIN (SELECT DISTINCT o_custkey AS follower, l_suppkey AS followee"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey) ON followee = user_id UNION SELECT (user_id + 1) % 150, event_id FROM events)"
)
def io_fanout_messages(spark, d):
    from braidworks.streaming.fanout import entries_of_messages

    e = F.col("event_id")
    mentioned = F.array((F.col("user_id") + 1) % 150).alias("user_mentions_id")
    messages = read(spark, d, "events").select(F.to_json(F.struct("user_id", e.alias("req_id"), e.alias("post_id"), e.alias("timestamp"), mentioned)).alias("value"))
    return entries_of_messages(messages, _edges(spark, d)).select("user_id", "post_id")


@query("SELECT 0 AS id WHERE false")
def sn_no_op(spark, d):
    return social.no_op(spark).select(F.col("id").cast("int").alias("id"))
