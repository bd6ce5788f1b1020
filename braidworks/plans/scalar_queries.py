"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidworks.functions import scalars

from .registry import DRAWN, query, read


@query("SELECT p_partkey, sha256(p_name) AS sha256, md5(p_name) AS md5 FROM part")
def sc_digests(spark, d):
    return read(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha256"), F.md5("p_name").alias("md5"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey > 0 THEN CAST(floor(log2(p_partkey)) AS INTEGER) ELSE -1 END AS high,
 CAST(CASE WHEN p_partkey <= 1 THEN 1 ELSE 2 ** ceil(log2(p_partkey)) END AS BIGINT) AS power, (p_partkey + 6) // 7 AS sevenths FROM part""")
def sc_bits(spark, d):
    p = F.col("p_partkey")
    high, power = F.coalesce(scalars.highest_bit(p), F.lit(-1)), scalars.round_up_to_power2(p)
    return read(spark, d, "part").select("p_partkey", high.alias("high"), power.alias("power"), scalars.div_round_up(p, F.lit(7).cast("long")).alias("sevenths"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 16777216 + (p_partkey % 256) * 65536 + 7 * 256 + 9 AS ip FROM part")
def sc_ip_number(spark, d):
    ip = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 256).cast("string"), F.lit("7"), F.lit("9"))
    return read(spark, d, "part").select("p_partkey", scalars.ip_number(ip).alias("ip"))


@query("SELECT l_orderkey + l_partkey AS a, l_suppkey + l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sc_vector_add(spark, d):
    left, right = F.array("l_orderkey", "l_suppkey"), F.array("l_partkey", F.col("l_linenumber").cast("long"))
    rows = read(spark, d, "lineitem").select(scalars.vector_add(left, right).alias("s"))
    return rows.groupBy(F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_size * 3 AS scaled, p_size + p_partkey * 3 AS triad FROM part")
def sc_stream_kernels(spark, d):
    a, b = F.array(F.col("p_size").cast("long")), F.array("p_partkey")
    three = F.lit(3).cast("long")
    return read(spark, d, "part").select("p_partkey", scalars.stream_scale(F.array("p_size"), F.lit(3))[0].alias("scaled"), scalars.stream_triad(a, b, three)[0].alias("triad"))


_STEP = "(CAST(CAST({z} AS UHUGEINT) * {k}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT))"  # 64 bits of a product


@query(f"""
WITH s AS (SELECT p_partkey, CAST((42 + CAST(p_partkey + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM part),
a AS (SELECT p_partkey, {_STEP.format(z="xor(z, z >> 30)", k=0xBF58476D1CE4E5B9)} AS z FROM s),
b AS (SELECT p_partkey, {_STEP.format(z="xor(z, z >> 27)", k=0x94D049BB133111EB)} AS z FROM a)
SELECT p_partkey, CAST(xor(z, z >> 31) AS VARCHAR) AS draw FROM b""")
def sc_splitmix64(spark, d):
    return read(spark, d, "part").select("p_partkey", scalars.splitmix64(42, F.col("p_partkey") + 1).cast("string").alias("draw"))


@query(f"""
SELECT p_partkey, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', CAST(floor({DRAWN.format(seed=0, of="p_partkey || ':' || i")} * 62) AS INTEGER) + 1, 1), '' ORDER BY i) AS text
FROM part, range(1, 13) r(i) GROUP BY 1""")
def sc_random_text(spark, d):
    return read(spark, d, "part").select("p_partkey", scalars.random_text(F.col("p_partkey"), 12).alias("text"))


@query("SELECT event_id, event_id + 1000 AS physical FROM events")
def sc_time_offset(spark, d):
    return read(spark, d, "events").select("event_id", scalars.shifted(F.col("event_id"), F.lit(1000)).alias("physical"))
