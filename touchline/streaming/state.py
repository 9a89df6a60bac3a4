"""Structured Streaming forms: windows in event time, the latest row of each key, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.sources.tables import write_upsert


def tumbling(stream: DataFrame, at: str, width: str, late: str, value: str, start: str = "0 seconds") -> DataFrame:
    """Counts and means of value per window of event time; rows later than the watermark are dropped."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width, width, start))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def latest_state(stream: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The newest values of each key so far, for update or complete mode; one struct of state per key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("s")).select(key, "s.*")


def upserting(stream: DataFrame, path: str, key: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the versioned table at path, and stops when all there is has been read."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write_upsert(batch.sparkSession, batch, path, key)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
