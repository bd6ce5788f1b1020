"""A timeline table on disk that takes removals as tombstones: merged on read, and compacted where they fell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .checkpoints import drop_folder

ENTRY = "user_id long, timestamp timestamp_ntz, post_id long"
#: Posts with tombstones that are broadcast at most: some 130 MB of ids.
BROADCAST_POSTS = 4_000_000
#: Buckets that are compacted at once: so many are there twice until the old ones go.
BUCKETS_AT_ONCE = 8
#: Bytes of a row group: a writer holds one for each bucket.
ROW_GROUP = 4 << 20


class TimelineStore:
    """Entries (user_id, timestamp, post_id) in buckets of users, and tombstones beside them. Both lie there as lists: a post with those of its readers who are of one bucket.

    Each write has a version that is larger than those before it. A tombstone hides the entries of its version and
    older ones, so what is written again later is seen. A write that is repeated after a failure replaces its own folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, entry: str = ENTRY):
        self.spark, self.path, self.buckets = spark, path, buckets
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(entry)}
        self.stored = f"readers array<{kinds['user_id']}>, timestamp {kinds['timestamp']}, post_id {kinds['post_id']}"

    def bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _put(self, lists: DataFrame, kind: str, version: int, keep: bool = False) -> None:
        """Each task writes its rows into their buckets' files, all open at once: neither shuffled nor sorted. With `keep`, buckets that get no rows stay as they are.

        Values are plain and compressed, so rows that come author by author take a few bytes: the same readers follow each other for one post after another.
        """
        dealt, writers = lists.select("readers", "timestamp", "post_id", "bucket"), "spark.sql.maxConcurrentOutputFileWriters"
        put = dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false")
        before = self.spark.conf.get(writers)
        self.spark.conf.set(writers, str(self.buckets + 1))  # Spark sorts once so many are open
        try:
            put.option("partitionOverwriteMode", "dynamic" if keep else "static").parquet(f"{self.path}/{kind}/version={version}")
        finally:
            self.spark.conf.set(writers, before)

    def _lists(self, rows: DataFrame) -> DataFrame:
        """Lists (readers, timestamp, post_id, bucket), each of users of its bucket, as they are; an entry is a list of one."""
        return rows if "readers" in rows.columns else rows.select(F.array("user_id").alias("readers"), "timestamp", "post_id", self.bucket(F.col("user_id")).alias("bucket"))

    def add(self, entries: DataFrame, version: int) -> None:
        """SN12, SN14: entries, or lists of them (social.home_lists)."""
        self._put(self._lists(entries), "entries", version)

    def remove(self, going: DataFrame, version: int) -> None:
        """SN18: tombstones, of entries or lists; nothing that is there is read or written."""
        self._put(self._lists(going), "removed", version)

    def _there(self, kind: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(folder) and len(files.listStatus(folder)) > 0

    def _rows(self, kind: str) -> DataFrame:
        schema = f"{self.stored}, version int, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}") if self._there(kind) else self.spark.createDataFrame([], schema)

    def _merged(self, entries: DataFrame, removed: DataFrame) -> DataFrame:
        """Lists without the readers whom tombstones hide. Only lists of posts that have tombstones meet these by shuffle, if the posts are few enough to broadcast."""
        keys = ["bucket", "timestamp", "post_id"]
        last = removed.groupBy(*keys).agg(F.collect_list(F.struct("version", "readers")).alias("gone"))
        hidden = F.array_compact(F.flatten(F.transform(F.filter("gone", lambda g: g["version"] >= F.col("version")), lambda g: g["readers"])))
        once = F.size(F.array_distinct("readers")) == F.size("readers")  # else array_except would leave one of several
        left = F.when(once, F.array_except("readers", "hidden")).otherwise(F.filter("readers", lambda u: ~F.coalesce(F.array_contains("hidden", u), F.lit(False))))
        left = F.when(F.col("hidden").isNull(), F.col("readers")).otherwise(left)
        columns = [c for c in entries.columns if c != "readers"]
        shown = lambda rows: rows.join(last, keys, "left").withColumn("hidden", hidden).select(left.alias("readers"), *columns).where("size(readers) > 0").select(*entries.columns)
        posts = removed.select("post_id").distinct()
        if posts.count() > BROADCAST_POSTS:
            return shown(entries)
        return entries.join(F.broadcast(posts), "post_id", "left_anti").select(*entries.columns).unionByName(shown(entries.join(F.broadcast(posts), "post_id", "left_semi")))

    def read(self) -> DataFrame:
        """SN13, SN15: the entries that are there; only the buckets of the users asked for are opened where `where` names a bucket.

        Entries of buckets without tombstones pass without meeting any.
        """
        lists, touched = self._rows("entries"), self.touched()
        if touched:
            clean, mixed = lists.where(~F.col("bucket").isin(touched)), lists.where(F.col("bucket").isin(touched))
            lists = clean.unionByName(self._merged(mixed, self._rows("removed")))
        return lists.select(F.explode("readers").alias("user_id"), "timestamp", "post_id", "bucket")

    def touched(self) -> list[int]:
        """Buckets with tombstones: a list of at most `buckets` numbers, from folder names."""
        return sorted(r["bucket"] for r in self._rows("removed").select("bucket").distinct().collect()) if self._there("removed") else []

    def compact(self, upto: int) -> list[int]:
        """Writes the buckets that have tombstones up to a version without what these hide, drops the tombstones, and tells the buckets.

        Other buckets aren't read or written. All versions of a touched bucket become one, of the version `upto`, whose folder must have no
        entries of its own yet. Some buckets follow others. The merged files are put beside the old ones before those go, and tombstones go last: whoever breaks off on the way
        leaves entries twice, which a timeline's readers take as one, but brings back none.
        """
        removed = self._rows("removed").where(F.col("version") <= upto)
        touched = sorted(r["bucket"] for r in removed.select("bucket").distinct().collect())
        if not touched:
            return []
        for at in range(0, len(touched), BUCKETS_AT_ONCE):
            some = F.col("bucket").isin(touched[at : at + BUCKETS_AT_ONCE])
            old = self._rows("entries").where(some & (F.col("version") < upto))
            there = old.select("version", "bucket").distinct().collect()
            self._put(self._merged(old, removed.where(some)), "entries", upto, keep=True)
            for r in there:
                self._drop(f"entries/version={r['version']}/bucket={r['bucket']}")
        for version in {r["version"] for r in removed.select("version").distinct().collect()}:
            self._drop(f"removed/version={version}")
        return touched

    def _drop(self, folder: str) -> None:
        drop_folder(self.spark, f"{self.path}/{folder}")

    def delete(self) -> None:
        """The whole store."""
        drop_folder(self.spark, self.path)
