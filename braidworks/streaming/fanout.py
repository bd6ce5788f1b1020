"""The queue consumer: new posts' messages go to their readers' home timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidworks.operators.social import home_entries
from braidworks.schemas import FANOUT_MESSAGE


def parsed_messages(messages: DataFrame) -> DataFrame:
    """IO06: JSON messages in `value` as (user_id, timestamp, post_id, mentioned); what isn't a message is dropped."""
    found = messages.select(F.from_json("value", FANOUT_MESSAGE).alias("m")).where("m.post_id is not null").select("m.*")
    return found.select("user_id", "timestamp", "post_id", F.coalesce("user_mentions_id", F.array().cast("array<bigint>")).alias("mentioned"))


def entries_of_messages(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """IO06: (user_id, timestamp, post_id) of a table of messages, in which a message may stand twice."""
    return home_entries(parsed_messages(messages).dropDuplicates(["post_id"]), edges, "mentioned")


def run_fanout(messages: DataFrame, edges: DataFrame, table_path: str, checkpoint: str, redelivery: str = "1 day") -> StreamingQuery:
    """Starts the stream into a Parquet table of entries, partitioned by batch; each post's entries are written once.

    A message that the queue delivers again within `redelivery` of the time it first came is dropped: post ids are state for as long.
    The time is that of arrival (the batch's own, which a repeated batch keeps), so no message is ever too late. A batch's folder is
    overwritten if the batch is run again, so an entry isn't written twice after a failure either. Pages can be cut from the table as it is.
    """
    arrived = parsed_messages(messages).withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", redelivery)
    once = arrived.dropDuplicatesWithinWatermark(["post_id"]).drop("__arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        home_entries(batch, edges, "mentioned").write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
