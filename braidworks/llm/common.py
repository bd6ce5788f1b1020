"""Helpers shared by the text operators: tables, folds, cut lineage, size checks."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this share of all is joined by broadcast: at most its inverse of them are.
HOT_SHARE = 1e-4
#: Strata of a sample at most; more of them fail.
MOST_STRATA = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is set: a new local one if all of Spark is in this process, else it fails."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="braidworks-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder: later jobs survive lost executors and don't recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of what was cut and is no more referred to: Spark removes them once both collectors on the driver have seen that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes not to be a column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text is a multiple of 5. A null id is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(df: DataFrame, per_stratum: int, stratum: str | None = None) -> DataFrame:
    """At most `per_stratum` ids of each stratum, each once: a bounded training sample. Columns doc_id, the stratum's and, if `df` has it, text.

    Those with the least hashes are taken, so the choice is the same whenever it's made again. Each
    stratum's different ids are counted by a sketch, a threshold leaves little more hashes than the sample has, and these
    go to the driver for the exact bound: counts and hashes alone, no texts. Repeats of
    an id become one row, with its least text. More than MOST_STRATA strata fail.
    """
    strata = [stratum] if stratum else []
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / float(1 << 53)
    ids = df.select("doc_id", *strata, *(["text"] if "text" in df.columns else []))

    def below(bounds: dict) -> DataFrame:
        bound = F.lit(0.0)
        for value, own in bounds.items():
            bound = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(own)).otherwise(bound) if stratum else F.lit(own)
        return ids.where(unit < bound)

    sizes = ids.groupBy(*strata).agg(F.approx_count_distinct("doc_id").alias("n")).limit(MOST_STRATA + 1).collect()
    if len(sizes) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    wanted = 1.2 * (per_stratum + 6 * per_stratum**0.5)  # the sketch errs by a twentieth
    bounds = {row[stratum] if stratum else None: min(1.0, wanted / max(1, row["n"])) for row in sizes}
    hashes: dict = {value: [] for value in bounds}
    for row in below(bounds).select(*strata, unit.alias("unit")).distinct().collect():
        hashes[row[stratum] if stratum else None].append(row["unit"])
    bounds = {value: sorted(own)[per_stratum] if len(own) > per_stratum else bounds[value] for value, own in hashes.items()}
    texts = [F.min("text").alias("text")] if "text" in df.columns else []
    return below(bounds).groupBy("doc_id", *strata).agg(*texts) if texts else below(bounds).distinct()


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], size: str) -> DataFrame:
    """`rows` with the columns of `found`, which has one row a key and in `size` how many of `rows` have it.

    Keys with more than HOT_SHARE of all rows are at most its inverse in number; these are
    broadcast, and their rows stay where they are. The others meet by shuffle.
    """
    least = (found.agg(F.sum(size)).first()[0] or 0) * HOT_SHARE
    left, right = [F.col(c) for c in rows.columns], [F.col(c) for c in found.columns if c not in (*keys, size)]
    hot = found.where(F.col(size) > least)
    first = rows.join(F.broadcast(hot), keys).select(*left, *right)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(found.where(F.col(size) <= least), keys)
    return first.unionByName(rest.select(*left, *right))
