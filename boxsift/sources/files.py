"""Request files: what is accepted and what is turned away, and which files of a folder have expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxsift.sources.boxes import read_requests

HOURS = 24


def reason() -> Column:
    """Why a request of read_requests is turned away, null if it is not: malformed JSON, neither text nor boxes, a box
    without text, or one whose points are not pairs."""
    odd = lambda b: b["points"].isNull() | (F.size(b["points"]) == 0) | F.exists(b["points"], lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda v: v.isNull()))
    boxes = F.coalesce("ocr_blocks", F.array().cast("array<struct<text:string,points:array<array<int>>,confidence:double>>"))
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed")
        .when((F.coalesce("ocr_text", F.lit("")) == "") & (F.size(boxes) == 0), "no_content")
        .when(F.exists(boxes, lambda b: b.isNull() | b["text"].isNull()), "no_box_text")
        .when(F.exists(boxes, odd), "bad_points")
    )


def sorted_out(spark: SparkSession, path: str) -> DataFrame:
    """Requests of the JSON lines at path with rejected, their reason or null, and the file they came from: a row for each line
    that is not blank, read once."""
    return read_requests(spark, path).select("*", reason().alias("rejected"), F.col("_metadata.file_name").alias("file"))


def aged(spark: SparkSession, folder: str, now: Column | None = None, hours: int = HOURS) -> DataFrame:
    """Files right in folder: path, file, bytes, modified, expired (older than so many hours). Contents are not read; who
    removes them does so from this list."""
    listed = spark.read.format("binaryFile").load(folder).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    cut = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {hours} HOURS")
    old = F.col("file_modification_time") < cut
    return listed.select(F.col("file_path").alias("path"), F.col("file_name").alias("file"), F.col("file_size").alias("bytes"), F.col("file_modification_time").alias("modified"), old.alias("expired"))
