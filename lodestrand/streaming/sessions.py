"""Sessions of events, in batch or as a stream, and an append-only sink that can be resumed (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, events, value): a session ends ``gap`` after its last event.

    On a stream ``late`` is the watermark: how late an event may come and still count.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events", "value")


def append_once(keys: list[str], path: str):
    """For foreachBatch: appends the rows of a batch whose keys the table at ``path`` hasn't; a batch that is run again adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        try:
            done = spark.read.schema(batch.schema).parquet(path).select(*keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            rows = rows.join(done, keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return run
