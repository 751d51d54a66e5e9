"""Queries over real files: inboxes and archives that tasks write from the supplied tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.operators import batches, uploads
from invoicefields.operators.extract import rejection
from invoicefields.operators.notify import MailSettings
from invoicefields.plans import corpus
from invoicefields.plans.corpus import table
from invoicefields.sources.archives import map_rows
from invoicefields.sources.files import scan_inbox
from invoicefields.sources.listing import new_versions
from invoicefields.sources.storage import new_folder, shared_uri, stored
from invoicefields.streaming import closing, inbox, runs

SUMMARY = "batch_id STRING, count_files BIGINT, total_total_invoice STRING, epoch BIGINT"


def write_files(root: str, named: DataFrame) -> str:
    """Writes ``batch_id, rel_path, text`` as files below the root, where listings look for them.  A repeated
    task writes the same."""
    place_of_all = shared_uri(named.sparkSession, root)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(place_of_all)
        for frame in frames:
            for batch, path, text in zip(frame["batch_id"], frame["rel_path"], frame["text"]):
                place = f"{base}/{batch}/{path}"
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(place) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"files": [len(frame)]})

    named.select("batch_id", "rel_path", "text").mapInPandas(write, "files LONG").agg(F.sum("files")).first()
    return root


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each page: ordinary and hidden names, empty files, other types, and batches that
    hold nothing but a marker."""
    p, kind = F.col("page_id"), F.col("page_id") % 6
    name = (
        F.when(kind == 0, F.concat(p, F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("_"), p, F.lit(".pdf")))
        .when(kind == 2, F.concat(F.lit(".x/"), p, F.lit(".PDF"))).when(kind == 3, F.concat(F.lit("sub/"), p, F.lit(".pdf")))
        .when(kind == 4, F.concat(p, F.lit(".txt"))).otherwise(F.lit(fv.DONE_MARKER))
    )
    return table(spark, sf, "pages").select(
        "page_id", F.when(kind == 5, F.concat(F.lit("m"), p)).otherwise(F.concat(F.lit("b"), p % 20)).alias("batch_id"),
        name.alias("rel_path"), F.when(kind.isin(3, 5), F.lit("")).otherwise(F.coalesce("html", F.lit(""))).alias("text"),
    )


def page_inbox(spark: SparkSession, sf: str) -> str:
    return write_files(new_folder(spark, "inbox"), page_files(spark, sf))


def inbox_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_inbox(spark, page_inbox(spark, sf)).select("batch_id", "rel_path", "size")


def inbox_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.batch_activity(scan_inbox(spark, page_inbox(spark, sf))).drop("last_change")


def inbox_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What a run of every batch reads: the texts of its documents, or why there is none."""
    root = page_inbox(spark, sf)
    folder = inbox.Folder(root)
    texts = folder.texts(folder.files(scan_inbox(spark, root).select("batch_id")))
    return texts.select("batch_id", "file", F.md5("text").alias("digest"), rejection().alias("reason"))


def inbox_resend(spark: SparkSession, sf: str) -> DataFrame:
    """The files that a second listing takes for new: every fifth page was sent again, longer."""
    root = page_inbox(spark, sf)
    before = stored(scan_inbox(spark, root))
    again = page_files(spark, sf).filter("page_id % 5 = 0").withColumn("text", F.concat("text", F.lit("x")))
    write_files(root, again)
    return new_versions(scan_inbox(spark, root), before).select("batch_id", "rel_path", "size")


def batch_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of all batches from files to outcomes: a file for each invoice, every eleventh of them
    empty; every third batch has a marker; the batches of the nations hold a marker alone."""
    empty = F.col("k") % 11 == 0
    docs = corpus.invoice_documents(spark, sf).select(
        "batch_id", F.col("file").alias("rel_path"), F.when(empty, F.lit("")).otherwise(F.col("text")).alias("text"))
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % corpus.BATCHES).alias("b")).distinct()
    marked = orders.filter("b % 3 = 0").select(F.format_string("B%02d", "b").alias("batch_id"))
    lone = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("batch_id"))
    markers = marked.unionAll(lone).select("batch_id", F.lit(fv.DONE_MARKER).alias("rel_path"), F.lit("").alias("text"))
    root = write_files(new_folder(spark, "inbox"), docs.unionByName(markers))
    settings = runs.Settings(new_folder(spark, "results"), MailSettings("host", "from@x", "a@x", ""))
    landed = inbox.landed_now(scan_inbox(spark, root))
    closed = closing.closed_now(landed, F.current_timestamp() + F.expr("INTERVAL 1 HOUR"), 60)
    runs.process_epoch(spark, inbox.Folder(root), closed, settings, 1)
    outcomes = runs.latest_outcomes(spark, settings)
    summary = runs.of_latest_run(spark.read.schema(SUMMARY).json(settings.path("summary")), outcomes)
    states = runs.status_view(spark, settings).select("batch_id", "state", "processed_files")
    return (
        outcomes.join(states, "batch_id", "left").join(summary.drop("epoch"), "batch_id", "left")
        .select("batch_id", "outcome", "reason", "total_files", "rejected_files", "error", "notified", "state",
                "processed_files", "count_files", "total_total_invoice")
    )


def zipped(page_id: int, html: str) -> bytes:
    """An archive of a page, or for every ninth page none."""
    target = io.BytesIO()
    if page_id % 9 == 0:
        return b"no archive"
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr(f"in/{page_id}.pdf", html)
        archive.writestr(f"__MACOSX/{page_id}.pdf", b"x")
        archive.writestr("notes.txt", b"y")
        if page_id % 2:
            archive.writestr(f"more/{page_id}.PDF", html[: len(html) // 2])
    return target.getvalue()


def _packed(page_id: int, html: str) -> Iterator[tuple]:
    """An upload for each page, by ``page_id % 7``: archives that are good, damaged, escaping,
    without documents, no archives; a single document; an empty file."""
    kind, data = page_id % 7, (html or "").encode() + b"."
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as archive:
        archive.writestr(f"notes/{page_id}.txt", data)
        if kind != 3:
            archive.writestr("a/first.pdf", b"older")
            archive.writestr("b/first.pdf", data)
            archive.writestr("__MACOSX/b.pdf", b"junk")
        if kind == 2:
            archive.writestr("../out.pdf", b"out")
    packed = stream.getvalue()
    if kind == 1:
        packed = packed.replace(b"older", b"0lder", 1)
    content = data if kind in (4, 5) else b"" if kind == 6 else packed
    yield str(page_id), 0, f"up/{page_id}{'.pdf' if kind == 5 else '.zip'}", content


def _page_uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    made = map_rows(table(spark, sf, "pages").select("page_id", "html"), _packed,
                    "upload_id STRING, ordinal INT, filename STRING, content BINARY")
    return uploads.upload_documents(stored(made))


def upload_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _page_uploads(spark, sf)[0]


def upload_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of all accepted uploads, of equal names the last one."""
    return _page_uploads(spark, sf)[1].select(
        "upload_id", "file", "filename", F.octet_length("content").alias("size"), F.md5("content").alias("digest"))


INBOX_QUERIES = {f.__name__: f for f in (
    inbox_scan, inbox_batches, inbox_documents, inbox_resend, batch_run, upload_decisions, upload_documents)}
