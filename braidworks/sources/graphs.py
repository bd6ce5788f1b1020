"""Edge lists, configuration, traces and files from and to storage, all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """IO01: (x, y) of a text file of `n n m` and then `x y` lines; lines that begin with % are comments.

    The size line is the first one with three numbers; edges have two.
    """
    parts = F.split(F.trim("value"), "\\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("%")).select(parts.alias("p"))
    return lines.where(F.size("p") == 2).select(F.col("p")[0].cast("long").alias("x"), F.col("p")[1].cast("long").alias("y"))


def symmetric(edges: DataFrame) -> DataFrame:
    """IO01: both directions of each edge, once. Edges may repeat: each is compared once, its lesser end first, and turned round after that."""
    turned = F.coalesce(F.col("x") > F.col("y"), F.col("y").isNull())
    once = edges.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y")).distinct()
    back = F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
    both = F.when(F.col("x").eqNullSafe(F.col("y")), F.array(back)).otherwise(F.array(back, F.struct("x", "y")))
    return once.select(F.explode(both).alias("e")).select("e.x", "e.y")


def graph_users(spark: SparkSession, n: int) -> DataFrame:
    """IO01: accounts 1 to n with the names and passwords that the loader gives."""
    name = lambda field: F.concat(F.lit(field + "_"), F.col("user_id").cast("string")).alias(field)
    return spark.range(1, n + 1).select(F.col("id").alias("user_id")).select("user_id", name("first_name"), name("last_name"), name("username"), name("password"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """IO02: a service's JSON configuration as one row."""
    return spark.read.json(path, multiLine=True)


def write_traces(traces: DataFrame, path: str) -> None:
    """IO07: `start duration` a line."""
    traces.select(F.concat_ws(" ", "start_us", "duration_us").alias("value")).write.mode("overwrite").text(path)


def write_trace_dump(traces: DataFrame, path: str) -> None:
    """PF17: all columns as CSV, by start."""
    traces.orderBy("start_us").write.mode("overwrite").csv(path, header=True)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("long").alias("start_us"), parts[1].cast("long").alias("duration_us"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SC02: (path, md5) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def synthetic_pairs(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """IO09: n random pairs of a 20-character key and a 2-character value."""
    text = lambda size, salt: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.char(F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed + salt)), F.lit(58)) + 65)), "")
    return spark.range(n).select(text(20, 0).alias("key"), text(2, 1).alias("value"))
