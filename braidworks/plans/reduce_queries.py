"""Map/reduce jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidworks.operators import mapreduce as mr

from .registry import query, read


def _pairs(key, value):
    return lambda rows: rows.select(F.col(key).alias("key"), F.expr(value).alias("value"))


@query("SELECT word AS key, count(*) AS val FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1 ORDER BY 1")
def mr_wordcount_sorted(spark, d):
    return mr.Job(read(spark, d, "documents"), lambda rows: mr.words(rows, "text"), mr.SUM).run_sorted()


@query("SELECT word AS key, count(*) AS val FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1 ORDER BY val DESC, key")
def mr_wordcount_by_count(spark, d):
    return mr.Job(read(spark, d, "conversations"), lambda rows: mr.words(rows, "text"), mr.SUM).run_sorted(F.desc("val"))


@query("SELECT user_id AS key, string_agg(event_id, ',' ORDER BY event_id) AS val FROM events GROUP BY 1")
def mr_collect_list(spark, d):
    job = mr.Job(read(spark, d, "events"), _pairs("user_id", "event_id"), mr.BUFFER)
    return job.run().select("key", F.array_join("val", ",").alias("val"))


@query("SELECT user_id AS key, event_id AS val FROM events")
def mr_emit_every(spark, d):
    return mr.Job(read(spark, d, "events"), _pairs("user_id", "event_id")).run_every()


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS val FROM events GROUP BY 1")
def mr_last_value(spark, d):
    emit = lambda rows: rows.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return mr.Job(read(spark, d, "events"), emit, mr.last_by("seq")).run()


@query("SELECT k AS key, CAST(coalesce(n, 0) AS BIGINT) AS val FROM range(200) t(k) LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = k")
def mr_histogram_dense(spark, d):
    return mr.Job(read(spark, d, "events"), _pairs("user_id", "1L"), mr.SUM).run_dense(200, F.lit(0).cast("long"))


@query("SELECT l_shipmode AS key, CAST(sum(q) AS BIGINT) AS val FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1")
def mr_sum(spark, d):
    emit = lambda rows: rows.select(F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_quantity").cast("long").alias("value"))
    return mr.Job(read(spark, d, "lineitem"), emit, mr.SUM).run()


@query("""
SELECT l_returnflag AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(*) AS n FROM lineitem GROUP BY 1""")
def mr_vector_sum(spark, d):
    emit = lambda rows: rows.select(F.col("l_returnflag").alias("key"), F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")).alias("value"))
    sums = mr.Job(read(spark, d, "lineitem"), emit, mr.vector_sum(2)).run()
    return sums.select("key", F.col("val.sums")[0].alias("quantity"), F.col("val.sums")[1].alias("numbers"), F.col("val.n").alias("n"))


@query("SELECT l_returnflag AS flag, CAST(bit_xor(l_orderkey) AS BIGINT) AS l_orderkey FROM lineitem GROUP BY 1")
def mr_fold_xor(spark, d):
    rows = read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return mr.fold(rows, "flag", "l_orderkey", lambda: F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


@query("SELECT p_partkey AS key, p_size AS val FROM part")
def mr_by_index(spark, d):
    return mr.by_index(read(spark, d, "part"), "p_partkey", "p_size")
