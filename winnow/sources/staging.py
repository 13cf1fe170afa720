"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _private() -> str:
    return "file://" + tempfile.mkdtemp(prefix="winnow-lists-")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir, read again: a short plan, true sizes, and no recomputation if an executor is lost.

    Results are read later than this, so the table stays until the application ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _private()
    path = f"{base.rstrip('/')}/lists-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, text: str) -> DataFrame:
    """(text, ord, n): every different text of df (ord, text, and n if a row stands for several), the least ord and the number of its rows.

    They are few beside the rows, but what follows may take long on each; so they are spread over as many tasks as a
    shuffle has, which would be put together by their size otherwise.
    """
    n = F.sum("n") if "n" in df.columns else F.count("*")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.groupBy(text).agg(F.min("ord").alias("ord"), n.alias("n")).repartition(parts, "ord")
