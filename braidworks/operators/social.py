"""Posts, timelines, followers and users over plain tables.

A timeline is rows (user_id, timestamp, post_id); followers are rows (follower, followee). Each
operation returns new tables. Pages are cut from a timeline's ranks before posts are joined, so a page
is shorter where posts are gone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidworks.functions import text as texts
from braidworks.functions.scalars import signed_token, token_claims
from braidworks.sources.checkpoints import snapshot

from .ordered import HOT_ROWS, running_total


@dataclass(frozen=True)
class Composed:
    """SN01's results."""

    posts: DataFrame
    user_timeline: DataFrame
    home_timeline: DataFrame
    short_links: DataFrame


def followers(edges: DataFrame) -> DataFrame:
    """SN20: (user_id, ids): who follows a user, ascending."""
    return edges.groupBy(F.col("followee").alias("user_id")).agg(F.array_sort(F.collect_set("follower")).alias("ids"))


#: Ids of a list at most.
CHUNK_IDS = 1 << 16


def follower_chunks(edges: DataFrame, most: int = CHUNK_IDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """SN20: (user_id, chunk, ids): who follows a user, ascending, in chunks (from 0) of `most` ids and a shorter last one: no list grows with a user's fame."""
    known = edges.select(F.col("followee").alias("user_id"), "follower").distinct().withColumn("__one", F.lit(1))
    placed = running_total(known, "user_id", ["follower"], "__one", "__place", hot_rows)
    chunk = F.floor((F.col("__place") - 1) / most).alias("chunk")
    return placed.groupBy("user_id", chunk).agg(F.array_sort(F.collect_list("follower")).alias("ids"))


def is_follower(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """SN20 from chunks: each (user_id, follower) asked for with whether it `follows`; a chunk is opened only if its ends enclose the id."""
    ends = chunks.select("user_id", F.col("ids")[0].alias("__low"), F.element_at("ids", -1).alias("__high"), "ids")
    met = asked.distinct().join(ends, "user_id").where((F.col("follower") >= F.col("__low")) & (F.col("follower") <= F.col("__high")))
    hits = met.where(F.array_contains("ids", F.col("follower"))).select("user_id", "follower", F.lit(True).alias("follows"))
    return asked.join(hits, ["user_id", "follower"], "left").withColumn("follows", F.coalesce("follows", F.lit(False)))


def followees(edges: DataFrame) -> DataFrame:
    """SN20: (user_id, ids): whom a user follows, ascending."""
    return edges.groupBy(F.col("follower").alias("user_id")).agg(F.array_sort(F.collect_set("followee")).alias("ids"))


def follow(edges: DataFrame, new: DataFrame) -> DataFrame:
    """SN19: with the new edges; an edge that's there stays one."""
    return edges.select("follower", "followee").union(new.select("follower", "followee")).distinct()


def unfollow(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("follower", "followee").distinct(), ["follower", "followee"], "left_anti")


def edges_by_name(named: DataFrame, users: DataFrame, strict: bool = False) -> DataFrame:
    """SN21: (follower_name, followee_name) as ids; unknown names fail if strict, else drop; an id 0 is no user."""
    ids = users.select("username", "user_id")
    a = ids.select(F.col("username").alias("follower_name"), F.col("user_id").alias("follower"))
    b = ids.select(F.col("username").alias("followee_name"), F.col("user_id").alias("followee"))
    found = named.join(a, "follower_name", "left").join(b, "followee_name", "left")
    if strict:
        found = found.select(*[_known(c, "long", F.lit("an unknown user name")).alias(c) for c in ("follower", "followee")])
    return found.where((F.col("follower") != 0) & (F.col("followee") != 0)).select("follower", "followee")


def write_user_timeline(timeline: DataFrame, posts: DataFrame) -> DataFrame:
    """SN12: with each post under its author."""
    return timeline.union(posts.select("user_id", "timestamp", "post_id")).distinct()


def home_entries(posts: DataFrame, edges: DataFrame, mentioned: str | None = None) -> DataFrame:
    """SN14: an entry for each follower of a post's author and each mentioned user; the author only if among these.

    Whoever takes the tables in sees to it that posts have different ids and edges are distinct (store_posts, follow, keyed.violations); so only a mentioned user can have an entry twice: mentions
    of the author's followers are left out, and the fan-out itself, which is the bulk, isn't compared. A post meets its author's followers as lists and is fanned out
    from these, so neither the shuffle nor the join makes a row an entry. Its mentions go with it and are looked up in the list, so posts are read once.
    """
    lists = reader_lists(edges, every_part=mentioned is not None)
    if mentioned is None:
        met = posts.select("user_id", "timestamp", "post_id").join(lists.select("user_id", "readers"), "user_id")
    else:
        met = posts.select("user_id", "timestamp", "post_id", F.array_distinct(mentioned).alias("__named")).join(lists, "user_id", "left")
        other = lambda u: F.coalesce(F.pmod(F.xxhash64(u), "slices") != F.col("part"), F.lit(False)) | (u.isNotNull() & F.coalesce(F.array_contains("readers", u), F.lit(False)))  # noqa: E731  of another list, or in this one
        met = met.select(F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in (F.col("readers"), F.filter("__named", lambda u: ~other(u)))]).alias("readers"), "timestamp", "post_id")
    return met.select(F.explode("readers").alias("user_id"), "timestamp", "post_id")


def home_lists(posts: DataFrame, lists: DataFrame, edges: DataFrame | None = None, bucket: Callable[[Column], Column] | None = None, mentioned: str | None = None) -> DataFrame:
    """SN14 as lists (readers, timestamp, post_id, bucket): home_entries before they are fanned out, a post's readers bucket by bucket. `lists` are reader_lists by bucket; mentioned users are looked up in `edges`."""
    met = posts.select("user_id", "timestamp", "post_id").join(lists.select("user_id", "readers", "bucket"), "user_id").select("readers", "timestamp", "post_id", "bucket")
    if mentioned is None:
        return met
    named = _mention_entries(posts, edges, mentioned)
    return met.unionByName(named.select(F.array("user_id").alias("readers"), "timestamp", "post_id", bucket(F.col("user_id")).alias("bucket")))


def reader_lists(edges: DataFrame, most: int | None = None, every_part: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """(user_id, readers, part, slices): who follows a user, in any order; one list of up to `most` (else CHUNK_IDS) ids, of those with more followers several lists of half as many on average.

    Of these the list `part` has the followers whose hash modulo `slices` it is; other users' `slices` is null. With `every_part` a part that nobody falls to is an empty list.
    With `bucket` each list has followers of one `bucket` only, which is one more column; then there are no empty lists.
    """
    most = CHUNK_IDS if most is None else most
    known = edges.where("followee is not null")
    famous = known.groupBy(F.col("followee").alias("__famous")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)  # at most one in `most` edges
    famous = famous.select("__famous", F.ceil(2 * F.col("__n") / most).alias("__slices"))
    part = F.when(F.col("__slices").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("follower"), "__slices"))
    dealt = known.join(F.broadcast(famous), F.col("followee") == F.col("__famous"), "left").select("followee", "follower", "__slices", part.alias("__part"), F.lit(True).alias("__edge"), *([] if bucket is None else [bucket(F.col("follower")).alias("bucket")]))
    if every_part and bucket is None:
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1)).alias("__part")
        dealt = dealt.unionByName(famous.select(F.col("__famous").alias("followee"), F.lit(None).cast(edges.schema["follower"].dataType).alias("follower"), "__slices", parts, F.lit(False).alias("__edge")))
    grouped = dealt.groupBy(F.col("followee").alias("user_id"), F.col("__part").alias("part"), F.col("__slices").alias("slices"), *([] if bucket is None else ["bucket"]))
    lists = grouped.agg(F.collect_list("follower").alias("__ids"), F.count_if(F.col("follower").isNull() & F.col("__edge")).alias("__nulls"))  # a list leaves nulls out
    readers = F.when(F.col("__nulls") == 0, F.col("__ids")).otherwise(F.concat("__ids", F.array_repeat(F.lit(None).cast("long"), F.col("__nulls").cast("int"))))
    return lists.select("user_id", readers.alias("readers"), "part", "slices", *([] if bucket is None else ["bucket"]))


def _mention_entries(posts: DataFrame, edges: DataFrame, mentioned: str) -> DataFrame:
    """Entries of mentioned users that don't follow the author."""
    by_name = posts.select(F.col("user_id").alias("followee"), F.explode(mentioned).alias("follower"), "timestamp", "post_id").distinct()
    return by_name.join(edges, ["followee", "follower"], "left_anti").select(F.col("follower").alias("user_id"), "timestamp", "post_id")


def home_page(posts: DataFrame, edges: DataFrame, start: int, stop: int, mentioned: str | None = None) -> DataFrame:
    """SN15 from posts: every reader's entries of ranks [start, stop), without writing home timelines first.

    Of an author's posts only the `stop` newest can be on any page, so the others are cut before the
    fan-out: its size follows authors and readers, not their history.
    """
    newest = page(posts, 0, stop).drop("rank")
    entries = home_entries(newest, edges)
    if mentioned is not None:
        entries = entries.unionByName(page(_mention_entries(posts, edges, mentioned), 0, stop).drop("rank"))
    return page(entries, start, stop)


def timeline_ranks(timeline: DataFrame) -> DataFrame:
    """Entries with their rank from 0: newest first, larger post_id first where that ties."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("post_id"))
    return timeline.withColumn("rank", F.row_number().over(newest) - 1)


def page(timeline: DataFrame, start: int, stop: int) -> DataFrame:
    """Every user's entries of ranks [start, stop); none if the bounds make no page.

    The bound on the rank goes below the shuffle (window group limit), so of a hot user's
    entries only `stop` a partition move.
    """
    ranks = timeline_ranks(timeline)
    return ranks.where(F.lit(0 <= start < stop) & (F.col("rank") < stop) & (F.col("rank") >= start))


def pages(timeline: DataFrame, requests: DataFrame) -> DataFrame:
    """SN13, SN15: entries of each request (req_id, user_id, start, stop). Users that aren't asked for don't move."""
    sound = requests.where("start >= 0 and stop > start")
    most = sound.agg(F.max("stop")).first()[0] or 0
    asked = timeline.join(sound.select("user_id").distinct(), "user_id", "left_semi")
    ranks = timeline_ranks(asked).where(F.col("rank") < most)
    return ranks.join(sound, "user_id").where("rank >= start and rank < stop")


def read_posts(entries: DataFrame, posts: DataFrame) -> DataFrame:
    """SN16: entries with their post's columns; entries whose post is gone are dropped."""
    return entries.join(posts.drop("user_id", "timestamp"), "post_id")


def two_tier_page(cache: DataFrame, store: DataFrame, start: int, stop: int) -> DataFrame:
    """SN13 with a cache before the store: what the cache lacks comes from the store."""
    missing = store.join(cache, ["user_id", "timestamp", "post_id"], "left_anti")
    return page(cache.unionByName(missing), start, stop)


@dataclass(frozen=True)
class Removal:
    """SN18's tables after it."""

    posts: DataFrame
    user_timeline: DataFrame
    home_timeline: DataFrame
    short_links: DataFrame | None


#: Rows of a small side that are broadcast at most: some 130 MB of posts' ids; with more, rows meet by shuffle.
BROADCAST_ROWS = 4_000_000
#: Ids in lists that are broadcast at most: 32 MB of them.
BROADCAST_IDS = 4_000_000


def remove_posts(
    posts: DataFrame, user_timeline: DataFrame, home_timeline: DataFrame, edges: DataFrame, requests: DataFrame,
    mentioned: str | None = None, urls: str | None = None, short_links: DataFrame | None = None,
) -> Removal:
    """SN18: a page of a user's posts goes from all tables.

    Home entries go from the present followers and the mentioned users only: whoever
    unfollowed since keeps an entry without a post. The home table is read once: an entry looks up its post among the removed ones, and
    only if it's there, its reader among those whose entries go. These are broadcast, up to BROADCAST_ROWS posts and BROADCAST_IDS
    readers; with more, only entries of removed posts are shuffled and compared, which reads the table twice.
    """
    cut = snapshot(pages(user_timeline, requests).select("user_id", "timestamp", "post_id").distinct())
    gone = snapshot(cut.join(posts.drop("user_id", "timestamp"), "post_id"))
    authors = gone.select(F.col("user_id").alias("followee")).distinct()
    going = home_entries(gone, edges.join(authors, "followee", "left_semi").distinct(), mentioned)
    keys, small = ["user_id", "timestamp", "post_id"], cut.count() <= BROADCAST_ROWS
    few = F.broadcast if small else lambda df: df
    removed = few(gone.select("post_id").distinct())
    if small and going.count() <= BROADCAST_IDS:
        home = without_entries(home_timeline, going)
    else:
        touched = home_timeline.join(removed, "post_id", "left_semi").join(going, keys, "left_anti")  # Spark would put the second join below an inner one, on all entries
        home = home_timeline.join(removed, "post_id", "left_anti").unionByName(touched.select(*home_timeline.columns))
    links = short_links
    if urls is not None and short_links is not None:
        links = remove_urls(short_links, gone.select("post_id", F.explode(urls).alias("u")).select("post_id", "u.shortened_url"))
    return Removal(posts.join(removed, "post_id", "left_anti"), without_page(user_timeline, few(cut)), home, links)


def without_page(timeline: DataFrame, cut: DataFrame) -> DataFrame:
    """The timeline without the given entries. These meet by their post alone, so that a broadcast is keyed by one number."""
    other = cut.select(*[F.col(c).alias(f"__{c}") for c in ("user_id", "timestamp", "post_id")])
    same = [(F.col(c) <= F.col(f"__{c}")) & (F.col(c) >= F.col(f"__{c}")) for c in ("user_id", "timestamp")]
    return timeline.join(other, (F.col("post_id") == F.col("__post_id")) & same[0] & same[1], "left_anti")


def without_entries(timeline: DataFrame, going: DataFrame) -> DataFrame:
    """The timeline without the given entries (user_id, timestamp, post_id), which are few enough to broadcast: a post's readers as one list."""
    lists = going.groupBy(F.col("post_id").alias("__post"), F.col("timestamp").alias("__at")).agg(F.collect_list("user_id").alias("__readers"))
    same_time = (F.col("timestamp") <= F.col("__at")) & (F.col("timestamp") >= F.col("__at"))  # not a second key: one number is the faster one
    hit = (F.col("post_id") == F.col("__post")) & same_time & F.array_contains("__readers", F.col("user_id"))
    return timeline.join(F.broadcast(lists), hit, "left_anti")


def store_posts(posts: DataFrame, new: DataFrame) -> DataFrame:
    """SN17: with the new posts; an id that is there keeps its post."""
    return posts.unionByName(new.join(posts.select("post_id"), "post_id", "left_anti").select(*posts.columns))


def posts_of(posts: DataFrame, asked: DataFrame) -> DataFrame:
    """SN17: posts of the asked ids; ids without one give nothing."""
    return posts.join(asked.select("post_id").distinct(), "post_id", "left_semi")


def delete_posts(posts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SN17: the posts without those of the ids, and for each id whether it `existed`."""
    ids = gone.select("post_id").distinct()
    there = posts.select("post_id", F.lit(True).alias("existed"))
    return posts.join(ids, "post_id", "left_anti"), ids.join(there, "post_id", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def _known(column: str, kind: str, message: Column) -> Column:
    """The column; where it is null, the query fails."""
    return F.coalesce(F.col(column), F.raise_error(message).cast(kind))


def resolved_mentions(posts: DataFrame, users: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """SN06: (post_id, pos, username, user_id) of each mention; unknown names drop, or fail if strict."""
    named = posts.select("post_id", F.posexplode(texts.mentions(F.col(text))).alias("pos", "username"))
    found = named.join(users.select("username", "user_id"), "username", "left")
    if strict:
        return found.select("post_id", "pos", "username", _known("user_id", "long", F.concat(F.lit("unknown user "), F.col("username"))).alias("user_id"))
    return found.where("user_id is not null").select("post_id", "pos", "username", "user_id")


def composed_text(posts: DataFrame, text: str = "text") -> DataFrame:
    """SN02-05, SN07: adds `urls` (shortened_url, expanded_url), `mention_names`, and the text with short links."""
    found = posts.withColumn("__links", texts.links(F.col(text)))
    urls = F.transform("__links", lambda link, i: F.struct(texts.short_link(link, F.concat_ws(":", F.col("post_id"), i)).alias("shortened_url"), link.alias("expanded_url")))
    return (
        found.withColumn("urls", urls).withColumn("mention_names", texts.mentions(F.col(text)))
        .withColumn(text, texts.with_short_links(F.col(text), F.transform("urls", lambda u: u["shortened_url"]))).drop("__links")
    )


def composed_media(ids: Column, types: Column) -> Column:
    """SN10: ids and types side by side; different lengths fail."""
    both = F.transform(F.arrays_zip(ids.alias("media_id"), types.alias("media_type")), lambda m: F.struct(m["media_id"].alias("media_id"), m["media_type"].alias("media_type")))
    return F.when(F.size(ids) == F.size(types), both).otherwise(F.raise_error(F.lit("media ids and types differ in number")))


def compose_posts(requests: DataFrame, users: DataFrame, edges: DataFrame) -> Composed:
    """SN01: posts of compose requests (schemas.COMPOSE with a post_id), and what they add to the other tables."""
    posts = composed_text(requests)
    resolved = resolved_mentions(posts.select("post_id", F.array_join(F.transform("mention_names", lambda n: F.concat(F.lit("@"), n)), " ").alias("text")), users)
    who = resolved.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("pos", "user_id", "username"))).alias("m"))
    posts = posts.join(who, "post_id", "left").select(
        "post_id", F.struct("user_id", "username").alias("creator"), "req_id", "text",
        F.transform(
            F.coalesce("m", F.array().cast("array<struct<pos: int, user_id: bigint, username: string>>")),
            lambda m: F.struct(m["user_id"].alias("user_id"), m["username"].alias("username")),
        ).alias("user_mentions"),
        composed_media(F.col("media_ids"), F.col("media_types")).alias("media"), "urls", "timestamp", "post_type", "user_id",
    )
    # An author's and its followers' entries, and links, need no mentions looked up.
    authored, named = requests.select("user_id", "timestamp", "post_id"), posts.select("user_id", "timestamp", "post_id", F.transform("user_mentions", lambda m: m["user_id"]).alias("mentioned"))
    links = composed_text(requests).select("post_id", F.explode("urls").alias("u")).select("u.*", "post_id")
    return Composed(posts.drop("user_id"), authored, home_entries(authored, edges).unionByName(_mention_entries(named, edges, "mentioned")), links)


def _link_key(a: DataFrame, b: DataFrame) -> list[str]:
    """What tells short links apart: their post too, where both tables have it. Forty bits of a hash alone meet by chance among some million links."""
    return [c for c in ("shortened_url", "post_id") if c == "shortened_url" or (c in a.columns and c in b.columns)]


def extended_urls(short_links: DataFrame, asked: DataFrame, strict: bool = True) -> DataFrame:
    """SN08: expanded links of short ones, those of the same post if both tables have `post_id`; unknown ones fail if strict, else drop."""
    found = asked.join(short_links, _link_key(asked, short_links), "left")
    if strict:
        return found.withColumn("expanded_url", _known("expanded_url", "string", F.lit("an unknown short link")))
    return found.where("expanded_url is not null")


def remove_urls(short_links: DataFrame, gone: DataFrame) -> DataFrame:
    """SN09: without the links that are gone, those of the same post if both tables have `post_id`."""
    key = _link_key(short_links, gone)
    return short_links.join(gone.select(*key).distinct(), key, "left_anti").select(*short_links.columns)


def get_media(files: DataFrame, asked: DataFrame) -> DataFrame:
    """SN11: data of each asked file name; empty if there's none. Uploads are keyed.upsert."""
    return asked.join(files, "filename", "left").withColumn("data", F.coalesce("data", F.lit(bytearray())))


def registered(accounts: DataFrame, salt: Column) -> DataFrame:
    """SN22, SN23: users of accounts (user_id, names, password): SHA-256 of password and salt in place of the password."""
    return accounts.withColumn("salt", salt).withColumn("password_hashed", F.sha2(F.concat("password", "salt"), 256)).drop("password")


def user_id_of(unique_id: Column) -> Column:
    """SN23: a registered user's id has 16 low bits free."""
    return F.shiftleft(unique_id, 16)


def login(attempts: DataFrame, users: DataFrame, secret: str, timestamp: Column) -> DataFrame:
    """SN24: attempts (username, password) with `status` and, if it's `OK`, the token."""
    found = attempts.join(users.select("username", "user_id", "salt", "password_hashed"), "username", "left")
    right = F.sha2(F.concat("password", "salt"), 256) == F.col("password_hashed")
    status = F.when(F.col("user_id").isNull(), "NOT_REGISTERED").when(right, "OK").otherwise("WRONG_PASSWORD")
    token = F.when(F.col("status") == "OK", signed_token(F.col("user_id"), F.col("username"), timestamp, secret))
    return found.withColumn("status", status).withColumn("token", token).select("username", "password", "status", "token")


def creators(names: DataFrame, users: DataFrame) -> DataFrame:
    """SN25: usernames with a creator struct (user_id, username)."""
    return names.join(users.select("username", "user_id"), "username").select("username", F.struct("user_id", "username").alias("creator"))


def no_op(spark) -> DataFrame:
    """SN29."""
    return spark.range(0)


def timeline_json(entries: DataFrame) -> Column:
    """FE01: a post as JSON, its ids as text."""
    as_text = lambda c: F.col(c).cast("string").alias(c)
    return F.to_json(F.struct(as_text("post_id"), F.struct(as_text("user_id")).alias("creator"), as_text("timestamp")))


def live_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """FE02: requests with all arguments whose session hasn't run out."""
    return requests.where(F.col("user_id").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull() & ~(F.col("timestamp") + F.col("ttl") < now))


def verified(requests: DataFrame, secret: str, now: Column, token: str = "token") -> DataFrame:
    """FE02: requests whose token is signed with the secret and hasn't run out, with its `user_id` and `username`."""
    claims = F.from_json(token_claims(F.col(token), secret), "timestamp string, ttl string, user_id string, username string")
    found = requests.withColumn("__claims", claims)
    live = F.col("__claims.timestamp").cast("long") + F.col("__claims.ttl").cast("long") >= now
    return found.where(live).select(*requests.columns, F.col("__claims.user_id").cast("long").alias("user_id"), F.col("__claims.username").alias("username"))


def decoded_media(ids: Column, types: Column) -> Column:
    """FE03: a request's media from its JSON arrays; missing ones are empty, broken ones or such of different lengths fail."""
    def listed(text: Column, schema: str) -> Column:
        asked = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("[]"))
        parsed = F.from_json(asked, schema)
        return F.when(F.get(parsed, F.lit(0)).isNull() & (F.regexp_replace(asked, "\\s", "") != "[]"), F.raise_error(F.lit("not a JSON array")).cast(schema)).otherwise(parsed)

    return composed_media(listed(ids, "array<bigint>"), listed(types, "array<string>"))
