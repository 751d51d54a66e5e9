"""The status stream judged: changes that no writer makes, and batches that stay in a stage too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from invoicefields import fixed_values as fv

CHANGE = "batch_id STRING, state STRING, stage STRING, at LONG, seq LONG"
FINDING = (
    "batch_id STRING, finding STRING, from_state STRING, from_stage STRING, to_state STRING, to_stage STRING, "
    "since LONG, at LONG, seq LONG"
)
LAST = "state STRING, stage STRING, at LONG, seq LONG, told BOOLEAN"
UNKNOWN, STUCK, LATE = "unknown transition", "stuck", "late"

_START = (fv.STATE_PROCESSING, fv.STAGE_EXTRACTOR)
_MAIL = (fv.STATE_PROCESSING, fv.STAGE_EMAIL)
_SEEDED = (fv.STATE_UPLOADED, fv.STAGE_WAITING)
_DONE, _ERROR = (fv.STATE_DONE, fv.STATE_DONE), (fv.STATE_ERROR, fv.STATE_ERROR)
#: What writers do: a batch is seeded once, may start at any time when it is not running, and ends.
KNOWN = {
    None: {_SEEDED, _START, _ERROR},
    _SEEDED: {_START, _ERROR},
    _START: {_MAIL, _ERROR},
    _MAIL: {_DONE, _ERROR},
    _DONE: {_START, _SEEDED},
    _ERROR: {_START, _SEEDED},
}
ENDED = {_DONE, _ERROR}


def findings(changes: DataFrame, stuck_seconds: int, lateness: str) -> DataFrame:
    """``batch_id, state, stage, updated_at, seq`` as a stream, into one row for each finding:

    an unknown transition (a change that no writer makes after the one before it), a batch that stayed
    in a stage that is no end for ``stuck_seconds`` or longer (told once, when the watermark passes that
    moment or the next change shows it), and a change that came after a later one had been judged.
    Changes are judged by ``updated_at`` and ``seq``.  The state of a batch is its last change."""
    limit = stuck_seconds * 1_000_000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        last = state.get if state.exists else None  # state, stage, at, seq, told

        def stuck(until: int) -> bool:
            return last is not None and (last[0], last[1]) not in ENDED and not last[4] and until - last[2] >= limit

        if state.hasTimedOut:
            if stuck(last[2] + limit):
                found.append((key[0], STUCK, last[0], last[1], None, None, last[2], last[2] + limit, last[3]))
                state.update((*last[:4], True))
                yield pd.DataFrame(found, columns=_columns(FINDING))
            return
        rows = [r for f in frames for r in zip(f["state"], f["stage"], f["at"].tolist(), f["seq"].tolist())]
        for to_state, to_stage, at, seq in sorted(rows, key=lambda r: (r[2], r[3])):
            before = (last[0], last[1]) if last else (None, None)
            if last is not None and (at, seq) < (last[2], last[3]):
                found.append((key[0], LATE, *before, to_state, to_stage, last[2], at, seq))
                continue
            if stuck(at):
                found.append((key[0], STUCK, *before, None, None, last[2], last[2] + limit, last[3]))
            if (to_state, to_stage) not in KNOWN.get(before if last else None, set()):
                found.append((key[0], UNKNOWN, *before, to_state, to_stage, last[2] if last else None, at, seq))
            last = (to_state, to_stage, at, seq, False)
        if last is not None:
            state.update(last)
            if (last[0], last[1]) not in ENDED and not last[4]:
                # not before the watermark, which timers may not precede
                state.setTimeoutTimestamp(max((last[2] + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=_columns(FINDING)).astype({"since": "Int64"})

    timed = changes.withWatermark("updated_at", lateness)
    narrow = timed.select(F.col("batch_id").cast("string").alias("batch_id"), "state", "stage",
                          F.unix_micros("updated_at").alias("at"), "seq", "updated_at")
    return narrow.groupBy("batch_id").applyInPandasWithState(
        judge, FINDING, LAST, "append", GroupStateTimeout.EventTimeTimeout)


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def findings_of_table(changes: DataFrame, stuck_seconds: int, until: int) -> DataFrame:
    """The same for a whole table, with the watermark at ``until`` (microseconds), as windows: the batch form.
    No change of a table is late."""
    order = Window.partitionBy("batch_id").orderBy("at", "seq")
    rows = changes.select(F.col("batch_id").cast("string").alias("batch_id"), "state", "stage",
                          F.unix_micros("updated_at").alias("at"), "seq")
    pairs = rows.select("*", *[F.lag(c).over(order).alias(f"_{c}") for c in ("state", "stage", "at")],
                        F.lead("at").over(order).alias("_next"))
    known = F.lit(False)
    for before, after in KNOWN.items():
        same = F.col("_at").isNull() if before is None else (
            F.col("_at").isNotNull() & (F.col("_state") == before[0]) & (F.col("_stage") == before[1]))
        for state, stage in sorted(after):
            known = known | (same & (F.col("state") == state) & (F.col("stage") == stage))
    unknown = pairs.filter(~F.coalesce(known, F.lit(False))).select(
        "batch_id", F.lit(UNKNOWN).alias("finding"), F.col("_state").alias("from_state"), F.col("_stage").alias("from_stage"),
        F.col("state").alias("to_state"), F.col("stage").alias("to_stage"), F.col("_at").alias("since"), "at", "seq")
    limit = stuck_seconds * 1_000_000
    ended = F.lit(False)
    for state, stage in sorted(ENDED):
        ended = ended | ((F.col("state") == state) & (F.col("stage") == stage))
    stuck = pairs.filter(~ended & (F.coalesce("_next", F.lit(until)) - F.col("at") >= limit)).select(
        "batch_id", F.lit(STUCK).alias("finding"), F.col("state").alias("from_state"), F.col("stage").alias("from_stage"),
        F.lit(None).cast("string").alias("to_state"), F.lit(None).cast("string").alias("to_stage"),
        F.col("at").alias("since"), (F.col("at") + limit).alias("at"), "seq")
    return unknown.unionAll(stuck)
