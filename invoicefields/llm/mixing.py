"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in an order shuffled by a hash.  A document's virtual finish time
is the words of its source up to it, divided by the source's target, so at virtual time 1 every
source has given just its target.  A source whose target is larger than it is queues again, up to
MOST_PASSES times.  All queued documents are sorted by finish time, in ranges, and the mix ends at
the total budget: the document of each source that is being served at time 1 is cut there.

Every order is a range sort of the whole table: each task adds up its own range as it streams by,
and the sums of the ranges before are added.  So no source, no order and no tie is one task's work,
and a column of very many sources is ranked in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invoicefields.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
SEED = 11
TURN_BITS = 60


def size_of(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def turn(doc_id: Column, text: Column) -> Column:
    """A document's place in its source's shuffled order: the first 15 digits of a digest."""
    named = F.concat_ws("\n", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.left(F.md5(named.cast("binary")), F.lit(TURN_BITS // 4)), 16, 10).cast("long")


def with_sums_before(df: DataFrame, order: list[Column | str], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """Adds for each ``value: name`` of ``sums`` the sum of the integers ``value`` of all rows before,
    in ``order``, which must tell any two rows apart.

    The table is sorted by ranges; a task holds one batch of its range at a time.  What is stored has
    the number of its range, since range borders are sampled.  The sums of whole ranges are one row
    for each partition of the sort."""
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.LongType()) for n in sums.values()]
                          + [T.StructField("_range", T.IntegerType(), False)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = list(batch.columns)
            for value in sums:
                own = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own) + held[value]
                columns.append(pa.array(upto - own))
                held[value] = int(upto[-1]) if len(own) else held[value]
            columns.append(pa.array(np.full(batch.num_rows, number, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ranged = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{n}") for v, n in sums.items()]).select(
        "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums.values()])
    out = ranged.join(starts, "_range").select(
        *df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums.values()])
    out._stored_at = ranged._stored_at
    return out


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``source, source_size, source_no, words_before, target`` from ``source, size`` rows:
    ``source_no`` counts the sources in their order from 0, ``words_before`` the words of those before.

    Sources by code point (null last) weigh 5, 2, 1, repeating.  They share all words by weight; a
    target stops at MOST_PASSES times its source's size, and what is over is shared anew.  With
    sources by the ratio of that bound to the weight, the fill level is the highest of: words left
    after the bounds before, by the weights from there on.  One row per source takes part."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    named = with_sums_before(totals, [F.col("source").asc_nulls_last()],
                             {"one": "source_no", "source_size": "words_before"}, scratch)
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS)).cast("int"))
    weighed = scratch.save(named.drop("one").withColumn("weight", weight)
                           .withColumn("bound", F.col("source_size") * MOST_PASSES))
    scratch.free(named)
    words, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    filled = with_sums_before(weighed.select("source_no", "weight", "bound"), [F.col("bound") / F.col("weight"), "source_no"],
                              {"bound": "_bounds", "weight": "_weights"}, scratch)
    level = filled.agg(F.max((F.lit(words) - F.col("_bounds")) / (F.lit(weights) - F.col("_weights")))).first()[0]
    scratch.free(filled)
    share = F.lit(level).cast("double") * F.col("weight")
    return weighed.select("source", "source_size", "source_no", "words_before",
                          F.least(F.col("bound").cast("double"), share).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` for every row.

    ``taken``: the words the mix takes of the row, repeats counted; ``position``: how many words the
    mix has before its first copy, null if it takes none.  The row being served when a source
    reaches its target is taken in part, so each source gives its target, rounded down.  A null or
    wordless text has the size 0 and is not taken.  A null source is a source; rows that share an id
    are documents of their own; ties in the order are between equal rows.  Reruns agree."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"),
        turn(F.col("doc_id"), F.col("text")).alias("turn")).withColumn("row", F.monotonically_increasing_id()))
    base = scratch.save(
        sized.alias("d").join(targets(sized, scratch).alias("t"), F.equal_null("d.source", "t.source"))
        .select("row", "doc_id", "size", "source_no", "words_before", "source_size", "target", "turn"))
    scratch.free(sized)
    budget = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    queued = with_sums_before(base, ["source_no", "turn", "doc_id", "size", "row"], {"size": "before"}, scratch)
    passes = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    served = (passes.withColumn("start", F.col("before") - F.col("words_before") + F.col("pass") * F.col("source_size"))
              .withColumn("words", F.least("size", F.floor("target") - F.col("start")))
              .filter("words > 0")
              .withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))
              .select("row", "source_no", "turn", "doc_id", "size", "pass", "words", "finish"))
    order = ["finish", "source_no", "turn", "doc_id", "pass", "size", "row"]
    placed = with_sums_before(served, order, {"words": "mixed"}, scratch)
    scratch.free(queued)
    taken = (placed.filter(F.col("mixed") < budget).groupBy("row")
             .agg(F.sum(F.least("words", F.lit(budget) - F.col("mixed"))).alias("taken"),
                  F.min("mixed").alias("position")))
    return base.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "position")
