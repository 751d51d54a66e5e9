"""Batches: activity, readiness, sessions, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions.text import is_pdf

ID_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
ID_TIME = "yyyyMMdd_HHmmss"


def batch_activity(files: DataFrame, marker: str = fv.DONE_MARKER,
                   case_sensitive_ext: bool = True) -> DataFrame:
    """Per batch: files, PDFs among them, latest change, and whether the marker lies in its root.

    All four are combined before the exchange, so only one row per batch and task moves.
    """
    return files.groupBy("batch_id").agg(
        F.count("*").alias("files"),
        F.count_if(is_pdf(F.col("rel_path"), case_sensitive_ext)).alias("total_files"),
        F.max("modificationTime").alias("last_change"),
        F.coalesce(F.bool_or(F.col("rel_path") == marker), F.lit(False)).alias("has_marker"),
    )


def is_quiet(last_change: Column, as_of: Column, quiet_seconds: int) -> Column:
    return as_of - last_change >= F.make_dt_interval(secs=F.lit(quiet_seconds))


def batch_ready(activity: DataFrame, as_of: Column, quiet_seconds: int) -> DataFrame:
    """Ready: the marker is there, or the last change is at least ``quiet_seconds`` ago.
    A batch without files is not ready."""
    return activity.withColumn(
        "ready",
        F.when(F.col("has_marker"), F.lit(True))
        .when(F.col("last_change").isNull(), F.lit(False))
        .otherwise(is_quiet(F.col("last_change"), as_of, quiet_seconds)),
    )


def batch_sessions(files: DataFrame, quiet_seconds: int, key: str = "batch_id",
                   time: str = "modificationTime") -> DataFrame:
    """Spans of activity per batch: a pause of ``quiet_seconds`` or more starts the next one.

    Changes within one interval of that length are never apart by that much, so they are first
    merged by interval.  That happens before the exchange, and what is left of a batch to be
    sorted in one task is one row per interval in which it was active, not one per file.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    quiet = quiet_seconds * 1_000_000
    spans = files.groupBy(key, F.floor(micros / quiet).alias("_slot")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"), F.count("*").alias("_files")
    )
    by_time = Window.partitionBy(key).orderBy("_slot")
    pause = F.col("_first") - F.lag("_last").over(by_time)
    starts = F.coalesce(pause >= F.make_dt_interval(secs=F.lit(quiet_seconds)), F.lit(True))
    return (
        spans.withColumn("_starts", starts.cast("int"))
        .withColumn("session_no", F.sum("_starts").over(by_time))
        .groupBy(key, "session_no")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("session_end"),
            F.sum("_files").alias("files"),
        )
    )


def new_batch_id(at: Column, key: Column) -> Column:
    """``YYYYMMDD_HHMMSS_`` and four letters or digits, always the same for the same key.
    ``at`` is UTC: a timestamp without zone, or a session that runs in UTC."""
    letters = [
        F.substring(F.lit(ID_ALPHABET), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(len(ID_ALPHABET))).cast("int") + 1, F.lit(1))
        for i in range(4)
    ]
    return F.concat(F.date_format(at, ID_TIME), F.lit("_"), *letters)


def batch_id_time(batch_id: Column) -> Column:
    """When the batch was created, or NULL if the id does not say."""
    return F.try_to_timestamp(F.substring(batch_id, 1, 15), F.lit(ID_TIME)).cast("timestamp_ntz")


def iso_time(at: Column, utc_suffix: str = "Z") -> Column:
    """ISO text of a UTC time; one writer of status documents ends it with ``Z``, the other
    with ``+00:00``."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(utc_suffix))
