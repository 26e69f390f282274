"""Streams: counts by window, keep-first by key, upserts into the word store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import keep_last


def counts_by_window(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n; rows later than the watermark are dropped by it."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def first_seen(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_stream(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a table of each key's newest row. A batch that runs again writes the same version, so restarts do no harm."""
    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        Path = spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        last = Path(f"{path}/v{epoch - 1}")
        old = spark.read.parquet(f"{path}/v{epoch - 1}") if epoch and fs.exists(last) else None
        both = batch if old is None else old.unionByName(batch)
        keep_last(both, [key], order).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        if epoch > 1:
            fs.delete(Path(f"{path}/v{epoch - 2}"), True)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
