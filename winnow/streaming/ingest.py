"""Lists as a stream: files that arrive in a folder are cleaned and classified as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(file_name, raw) of the *.txt files that appear in a folder. Lines of one file have no order here."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.txt").text(folder).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))


def clean_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the cleaned lines of arriving files to a Parquet table until all that is there is read."""
    cleaned = clean(read_stream(spark, folder))
    return cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
