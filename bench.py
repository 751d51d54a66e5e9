"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from invoicefields.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "invoice_fields", "document_fields", "page_fields", "v17_fields", "page_assembly", "normalise_text",
    "number_tokens", "total_cascade", "batch_totals", "batch_summary", "batch_report", "admission_decision",
    "archive_expansion", "batch_ready", "batch_sessions", "status_latest", "status_with_default",
    "path_sort_rank", "notification_rows", "stream_closed_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("status_progress")  # start-up of the session, not of a query
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents_per_second": round(documents / seconds["document_fields"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
