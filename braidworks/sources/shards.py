"""Keyed tables that last: Parquet bucketed by key, so that later steps on the key take the table as it lies."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidworks.operators import keyed


def _name(path: str) -> str:
    return "shards_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def save_shards(table: DataFrame, path: str, key: str, power: int) -> None:
    """KV01, KV23: the rows in 2**power shards by a hash of the key, one file each, sorted by key; and how they lie, for whoever loads them.

    A table that was saved there before is replaced; it must not be the one that is being saved.
    """
    spark, name = table.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = table.repartition(1 << power, key)
    dealt.write.mode("overwrite").bucketBy(1 << power, key).sortBy(key).format("parquet").option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: load_shards() names them again, in this session or another
    layout = json.dumps({"key": key, "power": power, "columns": table.schema.toDDL()})
    spark.createDataFrame([(layout,)], "layout string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def load_shards(spark: SparkSession, path: str) -> DataFrame:
    """KV23: a saved table with its shards: get, multi_get, upsert and reductions by its key don't shuffle it."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    key, name = layout["key"], _name(path)
    rows = f"{path}/rows".replace("'", "\\'")
    clustered = f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {1 << layout['power']} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['columns']}) USING parquet {clustered} LOCATION '{rows}'")
    return spark.table(name)


def shards_of(spark: SparkSession, path: str) -> int:
    """KV17: number of shards of a saved table."""
    return 1 << json.loads(spark.read.text(f"{path}/layout").first()[0])["power"]


def upsert_shards(spark: SparkSession, path: str, updates: DataFrame, order: list[str]) -> DataFrame:
    """KV07 on a saved table: only the updates are dealt anew, to its shards; the last one of a key takes the row's place. Keys aren't null."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    key, table = layout["key"], load_shards(spark, path)
    values = [c for c in table.columns if c != key]
    dealt = keyed.build(updates, key, layout["power"])
    last = dealt.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"))
    now = [F.when(F.col("__last").isNotNull(), F.col("__last")[v]).otherwise(F.col(v)).alias(v) for v in values]
    return table.join(last, key, "full").select(key, *now)
