"""Waiting for the end of a batch: each waiter gets the first end, or a row that says that none came in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDED, TIMED_OUT = "ended", "timeout"


def waited(waiters: DataFrame, ends: DataFrame, timeout_seconds: int, lateness: str) -> DataFrame:
    """``waiters`` (``waiter, batch_id, asked_at``) and ``ends`` (``batch_id, state, ended_at``), two streams or two
    tables, into ``waiter, batch_id, asked_at, answer, state, ended_at``: the first end of the batch from
    ``asked_at`` on, if it comes within the time, else a row without one.

    On streams both sides are kept for as long as the watermarks (``lateness``) and the time allow, and
    an answer is given when these have passed: nothing is kept for batches that nobody waits for beyond
    that, and a waiter whose batch never ends does not stay."""
    asked = waiters.withWatermark("asked_at", lateness)
    came = ends.select(F.col("batch_id").alias("_batch"), "state", "ended_at").withWatermark("ended_at", lateness)
    in_time = (
        (F.col("batch_id") == F.col("_batch")) & (F.col("ended_at") >= F.col("asked_at"))
        & (F.col("ended_at") <= F.col("asked_at") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS"))
    )
    first = F.min_by(F.struct("state", "ended_at"), F.struct("ended_at", "state"))
    return (
        asked.join(came, in_time, "left_outer")
        .groupBy("waiter", "batch_id", "asked_at").agg(first.alias("_first"))
        .select("waiter", "batch_id", "asked_at",
                F.when(F.col("_first.ended_at").isNotNull(), ENDED).otherwise(TIMED_OUT).alias("answer"), "_first.*")
    )
