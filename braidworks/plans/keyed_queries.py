"""Keyed tables, ordered containers and sets over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidworks.operators import keyed
from braidworks.sources import shards
from braidworks.sources.checkpoints import shared_folder, snapshot_and_drop

from .registry import query, read


def _parts(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_name")


def _ids(spark, d, times=1):
    return read(spark, d, "customer").select((F.col("c_custkey") * times).alias("p_partkey"))


@query("SELECT c_custkey * 3 AS p_partkey, p_name FROM customer LEFT JOIN part ON p_partkey = c_custkey * 3")
def kv_get_present_missing(spark, d):
    return keyed.get(_parts(spark, d), _ids(spark, d, 3), "p_partkey")


_SHARD = "CAST(least(CAST(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) AS HUGEINT) // 576460752303423487, 31) AS BIGINT)"


def _shard():
    """One of 32 shards, by a hash that SQL has too."""
    h = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return h, keyed.shard_index(h, 5)


@query(f"SELECT c_custkey * 3 AS p_partkey, p_name, coalesce(shard, -1) AS partition FROM customer LEFT JOIN (SELECT p_partkey AS k, p_name, {_SHARD} AS shard FROM part) ON k = c_custkey * 3")
def kv_get_with_location(spark, d):
    found = keyed.get_with_location(keyed.build(_parts(spark, d), "p_partkey"), _ids(spark, d, 3), "p_partkey", _shard()[1])
    return found.withColumn("partition", F.coalesce("partition", F.lit(-1).cast("long")))


@query("""
SELECT key, coalesce(v, c_mktsegment) AS value FROM
 (SELECT coalesce(c_custkey, user_id) AS key, c_mktsegment, v FROM customer FULL JOIN
  (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1) ON user_id = c_custkey)""")
def kv_upsert_last_wins(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    updates = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", "event_id")
    return keyed.upsert(table, updates, "key", ["ts", "event_id"])


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE first_type END AS p_name, p_partkey % 2 <> 0 AS inserted
FROM part JOIN (SELECT p_partkey AS k, p_type AS first_type FROM part) ON k = p_partkey""")
def kv_try_emplace(spark, d):
    part = read(spark, d, "part")
    table = part.where("p_partkey % 2 = 0").select("p_partkey", "p_name")
    both = part.select("p_partkey", F.col("p_type").alias("p_name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    later = both.withColumn("p_name", F.when(F.col("seq") == 1, F.col("p_name")).otherwise("late"))
    new, flags = keyed.insert_if_absent(table, later, "p_partkey", ["seq"])
    return new.join(flags, "p_partkey")


@query("SELECT DISTINCT c_custkey * 2 AS p_partkey, c_custkey * 2 IN (SELECT p_partkey FROM part) AS existed FROM customer")
def kv_remove_existed(spark, d):
    return keyed.remove(_parts(spark, d), _ids(spark, d, 2), "p_partkey")[1]


@query("""
SELECT 'taken' AS side, count(*) AS n, CAST(coalesce(sum(p_partkey), 0) AS BIGINT) AS keys FROM part WHERE p_partkey IN (SELECT c_custkey * 2 FROM customer)
UNION ALL SELECT 'rest', count(*), CAST(coalesce(sum(p_partkey), 0) AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT c_custkey * 2 FROM customer)""")
def kv_take(spark, d):
    taken, rest = keyed.take(_parts(spark, d), _ids(spark, d, 2), "p_partkey")
    count = lambda t, side: t.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("p_partkey"), F.lit(0).cast("long")).alias("keys"))
    return count(taken, "taken").unionByName(count(rest, "rest"))


@query("SELECT p_partkey, p_name, p_partkey IN (SELECT c_custkey * 2 FROM customer) AS taken FROM part")
def kv_take_rows(spark, d):
    taken, rest = keyed.take(_parts(spark, d), _ids(spark, d, 2), "p_partkey")
    return taken.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False)))


@query("""
SELECT coalesce(c_custkey, user_id) AS key, CASE WHEN n IS NULL THEN size ELSE coalesce(size, 0) * 2 + n END AS value
FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer)
FULL JOIN (SELECT user_id * 3 AS user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def kv_apply_default_insert(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.floor("c_acctbal").cast("long").alias("value"))
    updates = read(spark, d, "events").groupBy((F.col("user_id") * 3).alias("key")).agg(F.count(F.lit(1)).alias("update"))
    return keyed.apply(table, updates, "key", "value", 0, lambda old, n: old * 2 + n)


@query("""
SELECT req_id, CAST(pos - 1 AS INTEGER) AS pos, p_partkey, p_name FROM
 (SELECT c_custkey AS req_id, unnest([c_custkey * 7, 5, c_custkey, 5]) AS id, unnest([1, 2, 3, 4]) AS pos FROM customer) JOIN part ON p_partkey = id""")
def kv_multi_get_ordered(spark, d):
    c = F.col("c_custkey")
    asked = read(spark, d, "customer").select(c.alias("req_id"), F.array(c * 7, F.lit(5).cast("long"), c, F.lit(5).cast("long")).alias("ids"))
    return keyed.multi_get(_parts(spark, d), asked, "ids", "p_partkey")


@query("SELECT p_partkey, p_name FROM part")
def kv_all_pairs(spark, d):
    return keyed.pairs(_parts(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS distinct_hashes FROM part")
def kv_hashes_and_keys(spark, d):
    return keyed.hashes_and_keys(_parts(spark, d), "p_partkey").agg(F.count("hash").alias("n"), F.countDistinct("hash").alias("distinct_hashes"))


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_extendedprice) AS highest, count(*) AS n FROM lineitem")
def kv_reduce_sum_max(spark, d):
    return keyed.reduce(read(spark, d, "lineitem"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_extendedprice").alias("highest"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_partkey, CAST(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) AS VARCHAR) AS hash, {_SHARD} AS shard FROM part")
def kv_hash_key_shard(spark, d):
    """Each key with its hash and the shard that this leads to."""
    h, shard = _shard()
    rows = keyed.hashes_and_keys(_parts(spark, d), "p_partkey", h)
    return rows.select("p_partkey", F.col("hash").cast("string").alias("hash"), shard.alias("shard"))


@query(f"SELECT {_SHARD} AS shard, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1")
def kv_reduce_shards(spark, d):
    return keyed.reduce_shards(read(spark, d, "part"), "p_partkey", 5, F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"), hashed=_shard()[0])


@query("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, true AS spread FROM part")
def kv_reduce_hashed_shards(spark, d):
    shards = keyed.reduce_shards(read(spark, d, "part"), "p_partkey", 5, F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))
    even = (F.count(F.lit(1)) == 32) & (F.max("n") < 2 * F.min("n") + 60)
    return shards.agg(F.sum("n").alias("n"), F.sum("sizes").alias("sizes"), even.alias("spread"))


@query("SELECT count(*) AS drained, CAST(0 AS BIGINT) AS left_over FROM part")
def kv_drain(spark, d):
    result, empty = keyed.drain(_parts(spark, d), F.count(F.lit(1)).alias("drained"))
    return result.crossJoin(empty.agg(F.count(F.lit(1)).alias("left_over")))


@query("SELECT p_partkey, p_name FROM part")
def kv_copy_snapshot(spark, d):
    return keyed.copy(_parts(spark, d))


@query("""
SELECT p_partkey, CASE WHEN hit THEN 'swapped' ELSE p_brand END AS p_brand, hit AS swapped FROM
 (SELECT p_partkey, p_brand, p_partkey % 3 = 0 AND p_brand = 'Brand#13' AS hit FROM part)""")
def kv_compare_and_set(spark, d):
    part = read(spark, d, "part")
    swaps = part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("Brand#13").alias("old_value"), F.lit("swapped").alias("new_value"))
    return keyed.compare_and_set(part.select("p_partkey", "p_brand"), swaps, "p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT (p_partkey % 3 = 0 AND p_brand = 'Brand#13')")
def kv_remove_if_equals(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    expected = part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("Brand#13").alias("p_brand"))
    return keyed.remove_if_equals(part, expected, "p_partkey", "p_brand")


_CHANGE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


@query(f"SELECT user_id, CAST(sum({_CHANGE}) AS BIGINT) AS \"references\" FROM events GROUP BY 1 HAVING sum({_CHANGE}) > 0")
def kv_refcount(spark, d):
    return keyed.live_references(read(spark, d, "events").withColumn("amount", F.expr(_CHANGE)), "user_id", "amount")


@query("""
SELECT user_id, event_type, value FROM
 (SELECT user_id, arg_max({'t': event_type, 'v': value}, (ts, event_id)) AS l FROM events GROUP BY 1), (SELECT l.t AS event_type, l.v AS value)
WHERE event_type <> 'error'""")
def kv_op_log_net_state(spark, d):
    return keyed.net_state(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", ["event_type", "value"])


@query("""
SELECT probe, l_extendedprice AS successor FROM (SELECT DISTINCT o_totalprice / 3 AS probe FROM orders)
ASOF LEFT JOIN (SELECT DISTINCT l_extendedprice FROM lineitem) ON probe <= l_extendedprice""")
def pf_successor_lookup(spark, d):
    probes = read(spark, d, "orders").select((F.col("o_totalprice") / 3).alias("probe")).distinct()
    return keyed.successors(probes, read(spark, d, "lineitem").select("l_extendedprice"), "probe", "l_extendedprice")


@query("SELECT count(*) AS size, count(*) = 0 AS empty FROM part")
def gc_size(spark, d):
    return keyed.size(_parts(spark, d))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey OFFSET 17 LIMIT 1")
def gc_find_by_order(spark, d):
    return keyed.nth(_parts(spark, d), "p_partkey", 17)


@query("SELECT arg_min(p_name, p_partkey) AS front, arg_max(p_name, p_partkey) AS back FROM part")
def gc_front_back(spark, d):
    return keyed.ends(_parts(spark, d), "p_partkey").select(F.col("front.p_name").alias("front"), F.col("back.p_name").alias("back"))


@query("""
SELECT 'popped' AS side, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 25)
UNION ALL SELECT 'rest', count(*), CAST(sum(p_partkey) AS BIGINT) FROM (SELECT * FROM part ORDER BY p_partkey DESC OFFSET 25)""")
def gc_pop_back(spark, d):
    popped, rest = keyed.pop(_parts(spark, d), "p_partkey", 25, front=False)
    count = lambda t, side: t.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))
    return count(popped, "popped").unionByName(count(rest, "rest"))


@query("SELECT p_partkey >= 100 AS latter, count(*) AS n FROM part GROUP BY 1")
def gc_split(spark, d):
    low, high = keyed.split(_parts(spark, d), "p_partkey", 100)
    return keyed.insert(low.withColumn("latter", F.lit(False)), high.withColumn("latter", F.lit(True))).groupBy("latter").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_partkey >= 100 AS latter FROM part")
def gc_split_rows(spark, d):
    low, high = keyed.split(_parts(spark, d), "p_partkey", 100)
    return keyed.insert(low.withColumn("latter", F.lit(False)), high.withColumn("latter", F.lit(True)))


@query("SELECT s_suppkey + (SELECT max(p_partkey) + 1 - (SELECT min(s_suppkey) FROM supplier) FROM part) AS seq, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part")
def gc_push_back(spark, d):
    table = _parts(spark, d).select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"))
    return keyed.push(table, read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name")), "seq")


@query("SELECT p_partkey - 10 AS p_partkey, upper(p_name) AS p_name FROM part")
def gc_rebase_for_all(spark, d):
    return keyed.for_all(keyed.rebase(_parts(spark, d), "p_partkey", 10), p_name=F.upper("p_name"))


@query("SELECT p_partkey, p_name FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE (SELECT count(*) FROM part) <= 1000000")
def gc_append_batch_if(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name"))
    some = keyed.append_batch_if(_parts(spark, d), rows, 1_000_000)
    return keyed.append_batch_if(some, rows, 10)


@query("SELECT c_custkey * 2 AS p_partkey, c_custkey * 2 IN (SELECT p_partkey FROM part) AS there FROM customer")
def set_contains(spark, d):
    return keyed.set_contains(_parts(spark, d).select("p_partkey"), _ids(spark, d, 2), "p_partkey")


@query("SELECT user_id FROM events UNION SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def set_put_remove(spark, d):
    users, customers = read(spark, d, "events").select("user_id"), read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return keyed.set_remove(keyed.set_put(users, customers), read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id")


@query("SELECT user_id, count(*) AS \"rows\" FROM events GROUP BY 1 HAVING count(*) > 1")
def kv_unique_violations(spark, d):
    return keyed.violations(read(spark, d, "events"), "user_id")


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def kv_build(spark, d):
    """Built by inserting in order: of equal keys the last one stays."""
    events = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", "event_id")
    built = keyed.upsert(events.limit(0).select("key", "value"), events, "key", ["ts", "event_id"])
    return keyed.build(built, "key").select("key", "value")


@query("SELECT p_partkey, p_name FROM part")
def kv_save_load(spark, d):
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4()}"
    shards.save_shards(_parts(spark, d), path, "p_partkey", 3)
    return snapshot_and_drop(shards.load_shards(spark, path), path)


@query("""
WITH saved AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0),
u AS (SELECT l_partkey, arg_max(l_orderkey * 10 + l_linenumber, (l_orderkey, l_linenumber)) AS name FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1)
SELECT coalesce(p_partkey, l_partkey) AS p_partkey, coalesce(CAST(name AS VARCHAR), p_name) AS p_name FROM saved FULL JOIN u ON l_partkey = p_partkey""")
def kv_saved_upsert(spark, d):
    """Line items rename every fifth part of a saved table, or put it there: only they are shuffled."""
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4()}"
    shards.save_shards(_parts(spark, d).where("p_partkey % 3 <> 0"), path, "p_partkey", 3)
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    updates = read(spark, d, "lineitem").where("l_partkey % 5 = 0").select(F.col("l_partkey").alias("p_partkey"), item.cast("string").alias("p_name"), "l_orderkey", "l_linenumber")
    return snapshot_and_drop(shards.upsert_shards(spark, path, updates, ["l_orderkey", "l_linenumber"]), path)


@query("SELECT k AS p_partkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = k) AS stopped FROM (SELECT unnest([0, 7, 1000000000]) AS k)")
def kv_scan_until(spark, d):
    """Scans that stop where they come upon a key, or have seen all."""
    stopped = [(key, not keyed.for_each_until(_parts(spark, d), lambda row, key=key: row["p_partkey"] != key)) for key in (0, 7, 1_000_000_000)]
    return spark.createDataFrame(stopped, "p_partkey int, stopped boolean")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey DESC) - 1 AS BIGINT) AS number FROM part")
def gc_ordered(spark, d):
    """Iteration in descending order: rows with their numbers."""
    down = _parts(spark, d).select((-F.col("p_partkey")).alias("down"), "p_partkey")
    return keyed.numbered(keyed.ordered(down, "down"), ["down"]).select("p_partkey", "number")


@query("SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 2 = 0")
def gc_compute(spark, d):
    def closure(batches):
        for batch in batches:
            even = batch[batch["p_partkey"] % 2 == 0]
            yield even.assign(p_name=even["p_name"].str.upper())

    return keyed.compute(_parts(spark, d), closure, "p_partkey long, p_name string")


@query("SELECT s_suppkey - (SELECT max(s_suppkey) + 1 - (SELECT min(p_partkey) FROM part) FROM supplier) AS seq, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part")
def gc_push_front(spark, d):
    table = _parts(spark, d).select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"))
    return keyed.push(table, read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name")), "seq", front=True)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def gc_pop_front(spark, d):
    return keyed.pop(_parts(spark, d), "p_partkey", 25)[0]


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) <= 25 AS popped FROM part")
def gc_pop_rows(spark, d):
    popped, rest = keyed.pop(_parts(spark, d), "p_partkey", 25)
    return popped.withColumn("popped", F.lit(True)).unionByName(rest.withColumn("popped", F.lit(False)))


_CHURN = "(SELECT user_id % 16 AS thread, event_id AS seq, event_id % 10 = 3 AS is_delete, event_id * 7919 % 100003 AS key FROM events)"
_REPLAYED = f"""
WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY seq) AS i FROM {_CHURN}),
r AS (
  SELECT thread, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, false AS is_delete, CAST(0 AS BIGINT) AS key, CAST(NULL AS BIGINT) AS victim, 0 AS change, CAST([] AS BIGINT[]) AS live
  FROM (SELECT DISTINCT thread FROM log)
  UNION ALL
  SELECT thread, i, seq, is_delete, key, victim, CASE WHEN is_delete THEN CASE WHEN victim IS NULL THEN 0 ELSE -1 END WHEN there THEN 0 ELSE 1 END,
    CASE WHEN is_delete AND victim IS NOT NULL THEN list_filter(live, lambda x: x <> victim) WHEN is_delete OR there THEN live ELSE list_append(live, key) END
  FROM (
    SELECT log.*, r.live, list_contains(r.live, log.key) AS there, CASE WHEN log.is_delete THEN list_min(list_filter(r.live, lambda x: x >= log.key)) END AS victim
    FROM r JOIN log ON log.thread = r.thread AND log.i = r.i + 1)),
"""


def _churn(spark, d):
    from braidworks.operators import churn

    e = F.col("event_id")
    log = read(spark, d, "events").select((F.col("user_id") % 16).alias("thread"), e.alias("seq"), (e % 10 == 3).alias("is_delete"), (e * 7919 % 100003).alias("key"))
    return churn.replay(log)


@query(_REPLAYED + "x AS (SELECT 1) SELECT thread, seq, is_delete, key, coalesce(victim, -1) AS victim, CAST(change AS INTEGER) AS change FROM r WHERE i > 0")
def pf_churn_log(spark, d):
    return _churn(spark, d).withColumn("victim", F.coalesce("victim", F.lit(-1).cast("long")))


@query(_REPLAYED + """
s AS (SELECT *, sum(change) OVER (PARTITION BY thread ORDER BY i) AS held FROM r WHERE i > 0),
l AS (SELECT thread, min(i) FILTER (held >= 300) AS last FROM s GROUP BY 1)
SELECT thread, seq, is_delete, coalesce(victim, key) AS key FROM s JOIN l USING (thread) WHERE (last IS NULL OR i <= last) AND (NOT is_delete OR victim IS NOT NULL)""")
def pf_churn_commands(spark, d):
    from braidworks.operators import churn

    return churn.commands(churn.until_size(_churn(spark, d), 300))
