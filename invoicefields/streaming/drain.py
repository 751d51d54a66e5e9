"""A stream run until its input is used up, and its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from invoicefields.sources.storage import new_folder


def drained(stream: DataFrame, has_timers: bool = False) -> DataFrame:
    """``has_timers``: the stream waits for the wall clock.  It would keep triggering without
    input, so it is run for one trigger, which takes all the input there is."""
    spark = stream.sparkSession
    place = new_folder(spark, "drained")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{place}/checkpoint").trigger(**({"once": True} if has_timers else {"availableNow": True})).start(f"{place}/table")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/table")
