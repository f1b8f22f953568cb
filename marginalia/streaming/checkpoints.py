"""An append log as a stream: records once each, counted in windows, laid over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.store import last_of


def read_files(spark: SparkSession, folder: str, schema, glob: str = "*", at: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; at names a time column, which watermarks need with a time zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn(at, F.col(at).cast("timestamp")) if at else stream


def once(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once while it can still come late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, at: str, by: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows by window and value; windows tumble, or slide."""
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    return stream.withWatermark(at, late).groupBy(frame, by).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "rows")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user: rows with no longer a gap between them."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("rows")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "rows")


def upsert_into(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Lays each batch over the table at path: the last row of each key. Versions stand side by side; the newest counts.

    A batch that comes again after a failure writes the same version again.
    """

    def lay(batch: DataFrame, number: int) -> None:
        new = last_of(batch, key, order)
        if number:
            old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}")
            # what came earlier may be newer
            new = last_of(old.unionByName(new), key, order)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(lay).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, batches: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{batches - 1}")


