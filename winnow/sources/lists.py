"""Rule lists as an ordered table of lines, and the ordered sinks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _text(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(value, file_name, block, size, at) of the *.txt files of a folder as the text reader splits them; at rises within a block."""
    rows = spark.read.options(**options).text(folder, pathGlobFilter="*.txt")
    return rows.select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))


def read_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(file_idx, file_name, line_no, raw, had_newline) of the *.txt files of a folder, files by name, lines from 1.

    Lines end at \\n, \\r or \\r\\n; a byte order mark at the start of a file is dropped; undecodable bytes become U+FFFD.
    Large files are read in blocks by several tasks. The rows of each block are counted first, so a line's number is that of
    the lines in the blocks before its own, and its place in that one; what is joined has a row for each block.
    """
    text = _text(spark, folder)
    blocks = text.groupBy("file_name", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("file_name").orderBy("block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("lines", F.sum("n").over(Window.partitionBy("file_name")))
    # Split at \n alone, lines and their ends make up the file's size, or one more if the last has no end, or three less with a byte order mark.
    plain = _text(spark, folder, lineSep="\n").groupBy("file_name").agg((F.sum(F.octet_length("value") + 1) - F.first("size")).alias("over"), F.max_by(F.substring("value", -1, 1), F.struct("block", "at")).alias("last"))
    files = plain.select("file_name", (F.col("over").isin(1, -2) & (F.col("last") != "\r")).alias("open"))
    names = blocks.select("file_name").distinct().withColumn("file_idx", F.row_number().over(Window.orderBy("file_name")) - 1)
    known = blocks.join(names, "file_name").join(files, "file_name").select("file_name", "block", "file_idx", "first", "before", "lines", "open")
    rows = text.join(F.broadcast(known), ["file_name", "block"]).withColumn("line_no", F.col("before") + F.col("at") - F.col("first") + 1)
    raw = F.when(F.col("line_no") == 1, F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "")).otherwise(F.make_valid_utf8("value"))
    return rows.select("file_idx", "file_name", "line_no", raw.alias("raw"), ((F.col("line_no") < F.col("lines")) | ~F.col("open")).alias("had_newline"))


def count_files(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number and bytes of the *.txt files of a folder, empty ones too; only their names and sizes are read. A folder that isn't there is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no folder {folder}")
    sizes = [f.getLen() for f in system.listStatus(path) if f.isFile() and f.getPath().getName().endswith(".txt")]
    return len(sizes), sum(sizes)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one file, lines from 1."""
    text = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(text, "\r\n|\r|\n")).alias("at", "line")).select((F.col("at") + 1).cast("long").alias("line_no"), "line")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url) of a source catalog: text after # dropped, blanks skipped."""
    from ..functions.text import strip

    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "raw"))
    return rows.select((F.col("at") + 1).alias("line_no"), strip(F.substring_index("raw", "#", 1)).alias("url")).where("url <> ''")


def url_filename(url: str | Column) -> Column:
    """The file a source is kept in: its host with dots as underscores, 30 characters at most, and 16 digits of its SHA-256."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.concat(F.substring(F.translate(host, ".", "_"), 1, 30), F.lit("_"), F.substring(F.sha2(url, 256), 1, 16), F.lit(".txt"))


def write_lines(df: DataFrame, path: str, column: str = "line") -> int:
    """An ordered frame as one file on the driver's machine: rows are streamed partition by partition, and the file replaced at once."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            for row in df.select(column).toLocalIterator():
                f.write(row[0] + "\n")
                n += 1
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
    return n


def content_identity(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, byte_size, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select(F.col("_metadata.file_name").alias("filename"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
