"""Flows over streaming DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir


def read_jsonl(spark: SparkSession, path: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """New JSON-lines files as they arrive, ``per_trigger`` files a batch; progress is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_seen(stream: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time, keys are forgotten once they are ``late``."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_counts(stream: DataFrame, by: list[str]) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; rows later than ``late`` after the watermark are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), *by, "n", "total"
    )


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all that is available now and give the result back as a table."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")
    kept: dict[str, str] = {}

    def keep(batch: DataFrame, epoch: int) -> None:
        path = f"{place}/out-{epoch}"
        batch.write.mode("overwrite").parquet(path)
        kept["last"] = path

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/state").outputMode("complete")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(kept["last"])
