"""One query per operator, over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions import finders, legacy, numbers
from invoicefields.functions import text as tx
from invoicefields.operators import admission, batches, notify, report, status, totals
from invoicefields.operators.extract import (
    assemble_pages, extract_invoices, select_documents, split_rejected,
)
from invoicefields.operators.legacy import extract_invoices_v17, select_documents_v17
from invoicefields.plans import corpus
from invoicefields.plans.corpus import eu_format, invoice_numbers, money, table, us_format
from invoicefields.plans.inbox_queries import INBOX_QUERIES, zipped
from invoicefields.plans.run_queries import RUN_QUERIES
from invoicefields.sources import sinks
from invoicefields.sources.archives import archive_documents, expand_archives, map_rows
from invoicefields.sources.files import with_batch, with_rank
from invoicefields.sources.storage import new_folder, stored
from invoicefields.streaming import closing, transitions, waiting
from invoicefields.streaming.drain import drained

QUIET_SECONDS = 6 * 3600
WAIT_SECONDS = 24 * 3600
STUCK_SECONDS = 36 * 3600
AS_OF = "2024-01-31 00:00:00"
STATUS_PREFIX = "/api/batches"
FIELDS = ["file", "invoice_no", "pallets", "boxes", "gross_weight", "net_weight", "total_invoice"]


DETAIL = (
    "batch_id STRING, file STRING, invoice_no STRING, pallets BIGINT, boxes BIGINT, gross_weight DOUBLE, "
    "net_weight DOUBLE, total_invoice DOUBLE"
)
SUMMARY = (
    "batch_id STRING, count_files BIGINT, count_with_gross_weight BIGINT, count_with_total_invoice BIGINT, "
    "total_gross_weight STRING, total_total_invoice STRING"
)


def _counts(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, for rows whose counts are known to be small."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("pallets", "boxes") else F.col(c) for c in df.columns])


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- extraction -------------------------------------------------------------------------------

def invoice_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(extract_invoices(corpus.invoice_documents(spark, sf)))


def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(extract_invoices(corpus.prose_documents(spark, sf), keep=("doc_id", "batch_id")))


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Assembled from pages: each line of an invoice text is a page of its document."""
    docs = corpus.invoice_documents(spark, sf)
    pages = docs.select("batch_id", "file", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return _counts(extract_invoices(assemble_pages(pages, ["batch_id", "file"])))


def page_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_pages(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.when(F.col("doc_id") % 2 == 0, F.lit("\u00a0")).otherwise(F.lit("\u202f"))
    marked = F.replace("text", F.lit("e"), F.lit("\u200be\ufeff\u202a\u2069"))
    noisy = F.replace(marked, F.lit(" "), blank)
    clean = tx.normalise_text(noisy)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(clean).alias("digest"), F.char_length(clean).alias("chars")
    )


def selected_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Live rule, live rule without waybills, and the earlier rule."""
    k = F.col("o_orderkey")
    name = F.concat(
        F.when(k % 5 == 0, F.lit("CMR")).when(k % 7 == 0, F.lit("cmr")).otherwise(F.lit("DM")), k,
        F.when(k % 3 == 0, F.lit(".PDF")).when(k % 11 == 0, F.lit(".txt")).otherwise(F.lit(".pdf")),
    )
    docs = table(spark, sf, "orders").select(name.alias("file"))
    live = select_documents(docs).select(F.lit("live").alias("rule"), "file")
    strict = select_documents(docs, case_sensitive_ext=True).select(F.lit("strict").alias("rule"), "file")
    earlier = select_documents_v17(docs).select(F.lit("v17").alias("rule"), "file")
    return live.unionByName(strict).unionByName(earlier)


def rejected_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("batch_id"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("/")).otherwise(corpus.file_name(F.col("doc_id"))).alias("file"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"),
    )
    kept, rejected = split_rejected(docs)
    return (
        kept.groupBy("batch_id").agg(F.count("*").alias("documents")).withColumn("reason", F.lit("kept"))
        .unionByName(rejected.groupBy("batch_id", "reason").agg(F.count("*").alias("documents")))
    )


# --- finders ----------------------------------------------------------------------------------

def invoice_no_from_file(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("in/x.y/inv "), "o_orderpriority", F.lit("_"), "o_orderkey", F.lit(".v2.pdf"))
    return table(spark, sf, "orders").select(
        "o_orderkey", finders.invoice_no(tx.stem(tx.base_name(path))).alias("invoice_no")
    )


def _finder(spark, sf, text: Column, **found: Callable[[Column], Column]) -> DataFrame:
    """The numbers of each invoice, a text made of them, and what the finders find in it."""
    return _counts(invoice_numbers(spark, sf).withColumn("text", text).select(
        "k", *[find(F.col("text")).alias(name) for name, find in found.items()]
    ))


def int_after_label(spark, sf):
    text = _say("Ref 7\nNombre  de\nPalettes : ", F.col("pallets"), "\nBOXES:", F.col("boxes"), " pcs")
    return _finder(spark, sf, text, pallets=lambda t: finders.int_after_label(t, fv.PALLET_LABELS),
                   boxes=lambda t: finders.int_after_label(t, fv.BOX_LABELS))


def int_repeated_layers(spark, sf):
    layers, copies = (F.col("k") % 4 + 1).cast("int"), (F.col("k") % 3 + 1).cast("int")
    text = _say(F.repeat(F.lit("Boxes:"), layers), " ", F.repeat(F.col("pallets").cast("string"), copies), "\n")
    return _finder(spark, sf, text, boxes=lambda t: finders.int_after_label(t, fv.BOX_LABELS))


def weight_after_label(spark, sf):
    text = _say("Poids  brut :\n", F.col("gross"), " kg\nNetWeight:", F.col("net"), "KGS\n")
    return _finder(spark, sf, text, gross_weight=lambda t: finders.weight_after_label(t, fv.GROSS_LABELS),
                   net_weight=lambda t: finders.weight_after_label(t, fv.NET_LABELS))


def weight_same_digit(spark, sf):
    run = F.repeat((F.col("k") % 10).cast("string"), (F.col("boxes")).cast("int"))
    text = _say("Gross Weight: ", run, " kg")
    return _finder(spark, sf, text, gross_weight=lambda t: finders.weight_after_label(t, fv.GROSS_LABELS))


def float_after_label(spark, sf):
    text = _say("Gross Weight: ", eu_format(F.col("total")), " kg\nEnd")
    return _finder(spark, sf, text, amount=lambda t: finders.float_after_label(t, fv.GROSS_LABELS))


def float_before_marker(spark, sf):
    text = _say("Lines ", F.col("boxes"), "\nSum ", us_format(F.col("total")), "\n VAT %")
    return _finder(spark, sf, text, amount=lambda t: finders.float_before_marker(t, fv.V17_TAXABLE_MARKER))


def total_tier1(spark, sf):
    text = _say("Total\n Invoices (2p) EUR ", us_format(F.col("total")), "\nEnd 5")
    return _finder(spark, sf, text, total_invoice=lambda t: finders.total_after_label(t))


def total_tier2(spark, sf):
    mark = F.when(F.col("k") % 2 == 0, F.lit(" : ")).otherwise(F.lit("  "))
    text = _say("5 lines\nTOTAL INVOICE", mark, us_format(F.col("total")), "\nEnd")
    return _finder(spark, sf, text, total_invoice=lambda t: finders.total_beside_label(t))


def total_tier3(spark, sf):
    far = F.repeat(F.lit("x"), F.lit(fv.EURO_WINDOW))
    text = _say("€ 11.22 ", far, eu_format(F.col("total")), "€\nTotal Facture en Euro* :", far, " 33.44€ end")
    return _finder(spark, sf, text, total_invoice=lambda t: finders.total_near_french_label(t))


def total_tier4(spark, sf):
    text = _say("Sum 7.50 in parts of € ", F.col("boxes"), " and € ", us_format(F.col("total")), "\nEnd")
    return _finder(spark, sf, text, total_invoice=lambda t: finders.total_anywhere(t))


def total_cascade(spark, sf):
    amount, style = F.col("total"), F.col("k") % 5
    text = (
        F.when(style == 0, _say("Total Invoices EUR ", amount, "\n"))
        .when(style == 1, _say("TOTAL INVOICE: 1,2,3 then ", us_format(amount), "€"))
        .when(style == 2, _say(eu_format(amount), "€ Total Facture en Euro:\n"))
        .when(style == 3, _say("Net ", us_format(amount), " €"))
        .otherwise(_say("Net ", amount))
    )
    return _finder(spark, sf, text, total_invoice=lambda t: finders.total_invoice(t))


def euro_amounts_last(spark, sf):
    mixed = _say("€ ", F.col("gross"), " x ", F.col("total"), "€ y € ", F.col("boxes"), " end")
    whole = _say("€ ", F.col("boxes"), " x ", F.col("gross"), " pieces")
    text = F.when(F.col("k") % 3 == 0, whole).otherwise(mixed)
    return _finder(spark, sf, text, amount=lambda t: finders.last_euro_amount(t))


# --- tokens -----------------------------------------------------------------------------------

def reduce_repetition(spark, sf):
    token = F.repeat(F.col("p_size").cast("string"), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tx.reduce_repetition(token).alias("unit"))


def number_tokens(spark, sf):
    amount = money(F.col("o_totalprice"))
    plain = amount.cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.parse_number(plain).alias("plain"),
        numbers.parse_number(us_format(amount)).alias("us"),
        numbers.parse_number(eu_format(amount)).alias("eu"),
        numbers.parse_number(_say(plain, " ", plain, plain, "\n", plain)).alias("layered"),
        numbers.parse_number(F.col("o_orderkey").cast("string")).alias("whole"),
        numbers.has_two_decimals(_say(plain, " \n")).alias("cents"),
    )


def weight_tokens(spark, sf):
    token = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.parse_weight(token).alias("once"),
        numbers.parse_weight(_say(token, " ", token)).alias("blank"),
        numbers.parse_weight(F.repeat(token, F.lit(2))).alias("twice"),
    )


def amount_tokens_v17(spark, sf):
    amount = money(F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.parse_amount_v17(us_format(amount)).alias("us"),
        numbers.parse_amount_v17(eu_format(amount)).alias("eu"),
        numbers.parse_amount_v17(F.translate(amount.cast("string"), ".", ",")).alias("comma"),
    )


# --- totals and reports -----------------------------------------------------------------------

def batch_totals(spark, sf):
    return _counts(totals.batch_totals(invoice_fields(spark, sf)))


def grand_totals(spark, sf):
    return _counts(totals.batch_totals(invoice_fields(spark, sf), keys=()))


def batch_summary(spark, sf):
    return totals.batch_summary(invoice_fields(spark, sf))


def batch_report(spark, sf):
    return _counts(report.batch_report(stored(invoice_fields(spark, sf))))


def batch_report_total_row(spark, sf):
    return _counts(report.batch_report(invoice_fields(spark, sf)).filter("is_total"))


def batch_report_v17(spark, sf):
    return _counts(report.batch_report_v17(stored(v17_fields(spark, sf))))


def exact_totals(spark, sf):
    """Amounts of up to 17 digits, added without loss and rounded once."""
    price = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        F.format_string("B%02d", F.col("o_custkey") % 50).alias("batch_id"),
        F.lit(1).alias("pallets"), F.lit(2).alias("boxes"), (price / 3).alias("gross_weight"),
        (price / 7e6).alias("net_weight"), (price * 1e7 / 3).alias("total_invoice"),
    )
    return _counts(totals.batch_totals(rows))


def _large_counts(spark, sf) -> DataFrame:
    """Counts of 21 digits and more, before a label that must not answer for them."""
    text = _say("Pallets: 12345678901234567890", F.col("k"), "\nNombre de Palettes: 5\nBoxes: 98765432109876543210", F.col("k"), "\n")
    docs = corpus.invoice_documents(spark, sf).withColumn("text", text)
    return extract_invoices(docs, keep=("k", "batch_id"))


def large_counts(spark, sf):
    return _large_counts(spark, sf).select(
        "k", F.col("pallets").cast("string").alias("pallets"), F.col("boxes").cast("string").alias("boxes"))


def large_count_totals(spark, sf):
    return totals.batch_totals(_large_counts(spark, sf)).select(
        "batch_id", "count_files", F.col("pallets").cast("string").alias("pallets"), F.col("boxes").cast("string").alias("boxes"))


def _written(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    path = new_folder(spark, name)
    write(path)
    return path


def detail_json_roundtrip(spark, sf):
    """The detail files of all batches, written and read back."""
    path = _written(spark, "detail", lambda p: sinks.write_detail_json(invoice_fields(spark, sf), p))
    return spark.read.schema(DETAIL).json(path)


def summary_json_roundtrip(spark, sf):
    path = _written(spark, "summary", lambda p: sinks.write_summary_json(batch_summary(spark, sf), p))
    return spark.read.schema(SUMMARY).json(path)


def rejected_roundtrip(spark, sf):
    """Rejected documents as they are written by batch: unreadable ones and ones without a name."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("batch_id"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("/")).otherwise(corpus.file_name(F.col("doc_id"))).alias("file"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"),
    )
    path = _written(spark, "rejected", lambda p: sinks.write_rejected(split_rejected(docs)[1], p))
    back = spark.read.schema("file STRING, reason STRING, batch_id STRING").parquet(path)
    return back.groupBy("batch_id", "file", "reason").agg(F.count("*").alias("documents"))


# --- admission --------------------------------------------------------------------------------

def _uploads(spark, sf) -> DataFrame:
    """Each order is a file of the upload of its customer; most uploads hold one or two."""
    k = F.col("o_orderkey")
    ext = F.when(k % 11 == 0, F.lit(".txt")).when(k % 11 < 5, F.lit(".ZIP")).otherwise(F.lit(".Pdf"))
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") * 8 + k % 8).alias("upload_id"), k.alias("ordinal"),
        F.concat(F.lit("in/f"), k, ext).alias("filename"), (k % 17).alias("length"),
    )


def _requests(spark, sf) -> DataFrame:
    idle = table(spark, sf, "customer").select((F.col("c_custkey") * 8).alias("upload_id"))
    return _uploads(spark, sf).select("upload_id").union(idle).distinct()


def admission_decision(spark, sf):
    uploads = _uploads(spark, sf)
    u = F.col("upload_id")
    verdicts = uploads.select("upload_id").distinct().select(
        u.alias("archive"), (u % 5 != 0).alias("is_zip"), (u % 7 == 0).alias("escapes"), (u % 4).alias("pdfs")
    )
    return admission.admit_uploads(uploads, verdicts, _requests(spark, sf))


def selection_precheck(spark, sf):
    return admission.precheck_selection(_uploads(spark, sf), _requests(spark, sf))


def upload_responses(spark, sf):
    decided = admission_decision(spark, sf)
    return admission.upload_responses(decided, STATUS_PREFIX, F.concat(F.lit("b"), "upload_id"))


def last_of_each_name(spark, sf):
    files = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("d"), F.col("o_orderkey") % 3, F.lit("/"), "o_orderpriority", F.lit(".pdf")).alias("filename"),
        F.col("o_totalprice").alias("length"),
    )
    return admission.last_of_each_name(files)


def _members(spark, sf) -> DataFrame:
    p = F.col("page_id")
    url = F.regexp_replace("url", "[:?&=#]", "_")
    name = (
        F.when(p % 8 == 0, F.concat(url, F.lit(".pdf")))
        .when(p % 8 == 1, F.concat(F.lit("__MACOSX/"), url, F.lit(".pdf")))
        .when(p % 8 == 2, F.concat(F.lit("../"), url, F.lit(".PDF")))
        .when(p % 8 == 3, F.concat(F.lit("a/../../"), url, F.lit(".pdf")))
        .when(p % 8 == 4, F.concat(url, F.lit(".pdf/")))
        .when(p % 8 == 5, F.concat(url, F.lit("/.DS_Store")))
        .when(p % 8 == 6, F.concat(F.lit("a/../"), url, F.lit(".Pdf")))
        .otherwise(F.concat(F.lit("../"), url, F.lit(".txt")))
    )
    return table(spark, sf, "pages").select(
        F.floor(p / 6).alias("archive"), F.lit(True).alias("is_zip"), "page_id",
        name.alias("member_name"), (p % 8 == 4).alias("is_dir"),
    )


def archive_members(spark, sf):
    name = F.col("member_name")
    return _members(spark, sf).select(
        "page_id", admission.is_admissible_member(name, F.col("is_dir")).alias("counted"),
        admission.escapes_target(name).alias("escapes"),
    )


def archive_verdicts(spark, sf):
    return admission.archive_verdicts(_members(spark, sf))


def _archives(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "html")
    return map_rows(pages, lambda page_id, html: iter([(str(page_id), zipped(page_id, html))]),
                    "archive STRING, content BINARY")


def archive_expansion(spark, sf):
    return archive_documents(expand_archives(_archives(spark, sf))).select(
        "archive", "member_name", "size", F.decode("content", "UTF-8").alias("text")
    )


def archive_validity(spark, sf):
    return admission.archive_verdicts(expand_archives(_archives(spark, sf), with_content=False))


# --- batches ----------------------------------------------------------------------------------

def _event_files(spark, sf) -> DataFrame:
    """Events as files of batches: the user is the batch, a signup its marker."""
    kind = F.col("event_type")
    path = F.concat(
        F.lit("/data/inbox/u"), "user_id", F.lit("/"),
        F.when(kind == "signup", F.lit(fv.DONE_MARKER))
        .when(kind == "error", F.concat(F.lit("sub/"), "event_id", F.lit(".PDF")))
        .when(kind == "view", F.concat(F.lit("sub/"), F.lit(fv.DONE_MARKER)))
        .otherwise(F.concat(F.lit("sub/"), "event_id", F.lit(".pdf"))),
    )
    return table(spark, sf, "events").select(
        path.alias("path"), F.col("ts").alias("modificationTime"), F.col("event_id"), F.col("user_id")
    )


def batch_activity(spark, sf):
    return batches.batch_activity(with_batch(_event_files(spark, sf), "/data/inbox"))


def batch_ready(spark, sf):
    """The sign-up of every third user is no marker but a file, so that quiet time decides for them."""
    no_marker = (F.col("user_id") % 3 == 0) & F.col("path").rlike(r"/u\d+/_DONE\z")
    files = _event_files(spark, sf).withColumn(
        "path", F.when(no_marker, F.concat("path", F.lit(".txt"))).otherwise(F.col("path")))
    activity = batches.batch_activity(with_batch(files, "/data/inbox"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return batches.batch_ready(activity, as_of, QUIET_SECONDS).select("batch_id", "ready")


def batch_sessions(spark, sf):
    files = table(spark, sf, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").alias("modificationTime"))
    return batches.batch_sessions(files, QUIET_SECONDS)


def batch_id_roundtrip(spark, sf):
    made = batches.new_batch_id(F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.left(made, F.lit(16)).alias("time_part"),
        batches.batch_id_time(made).alias("created"),
        made.rlike(r"\A\d{8}_\d{6}_[a-z0-9]{4}\z").alias("well_formed"),
        batches.iso_time(F.col("o_orderdate")).alias("iso"),
    )


def path_sort_rank(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return with_rank(pages, tx.path_order(F.col("url")), F.col("page_id")).select("page_id", "ord")


# --- status -----------------------------------------------------------------------------------

def _status_log(spark, sf) -> DataFrame:
    return corpus.status_changes(table(spark, sf, "events"))


def status_latest(spark, sf):
    return status.latest_status(_status_log(spark, sf)).drop("recipients")


def status_first_start(spark, sf):
    return status.with_first_start(_status_log(spark, sf)).select("batch_id", "seq", "started_at")


def status_with_default(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("batch_id"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    found = status.status_with_default(asked, status.latest_status(_status_log(spark, sf)), as_of)
    return found.withColumn("recipients", F.array_join("recipients", ","))


def status_seed_missing(spark, sf):
    activity = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("total_files"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    seeded = status.seed_missing(activity, _status_log(spark, sf), as_of, F.array(F.lit("a@x"), F.lit("b@x")))
    return seeded.withColumn("recipients", F.array_join("recipients", ",")).drop("seq")


def status_progress(spark, sf):
    total, done, stage = F.col("total_files"), F.col("processed_files"), F.col("stage")
    return _status_log(spark, sf).select(
        F.col("seq").alias("event_id"),
        status.progress_percent(total, done, stage).alias("percent"),
        status.progress_percent(total, done, stage, alias_stages=True).alias("percent_aliased"),
        status.progress_percent_uncapped(total, done).alias("percent_uncapped"),
    )


def status_terminal(spark, sf):
    return status.latest_status(_status_log(spark, sf)).select(
        "batch_id",
        status.is_terminal(F.col("state"), F.col("stage")).alias("terminal"),
        status.is_terminal_state(F.col("state")).alias("terminal_state"),
        status.status_url(STATUS_PREFIX, F.col("batch_id").cast("string")).alias("status_url"),
    )


# --- notifications ----------------------------------------------------------------------------

def recipients(spark, sf):
    listed = F.concat(F.lit(" "), "c_name", F.lit("@x , ,"), "c_mktsegment", F.lit(","))
    parsed = notify.parse_recipients(F.when(F.col("c_custkey") % 10 != 0, listed))
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(parsed, "|").alias("recipients"), F.size(parsed).alias("n")
    )


def notification_rows(spark, sf):
    mail = notify.MailSettings("mail.example", "from@example", "a@example, ,b@example", "[Test] ")
    done = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>"))
        .when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("own@example"))).alias("recipients"),
    )
    rows = notify.notification_rows(done, mail, ["r.JSON", "r.csv", "r.xlsx", "r.bin"])
    return rows.select(
        "batch_id", "subject", "body", F.array_join("recipients", "|").alias("recipients"),
        F.array_join(F.transform("attachments", lambda a: F.concat(a["name"], F.lit("="), a["media_type"])), "|").alias("attachments"),
    )


# --- earlier rules ----------------------------------------------------------------------------

def v17_fields(spark, sf):
    return _counts(extract_invoices_v17(corpus.invoice_documents(spark, sf)))


def v17_invoice_no(spark, sf):
    k, form = F.col("o_orderkey"), F.col("o_orderkey") % 9
    six = F.format_string("%06d", k)
    text = (
        F.when(form == 3, _say("Invoice Number: A-", six, "/x\n"))
        .when(form == 4, _say("x Invoice: Date :\n  inv-", six, " 21-Nov"))
        .when(form == 5, _say("Invoice : NUMBER\nref dm", six, "."))
        .when(form == 6, _say("N° Facture : F", six))
        .when(form == 7, _say("see INV-", six, " please"))
        .otherwise(_say("nothing ", six))
    )
    name = (
        F.when(form == 0, _say("dm", six)).when(form == 1, _say("INV-", six))
        .when(form == 2, F.format_string("%08d", k)).otherwise(F.lit("scan"))
    )
    return table(spark, sf, "orders").select("o_orderkey", legacy.invoice_no_v17(text, name).alias("invoice_no"))


def v17_taxable(spark, sf):
    style, total = F.col("k") % 5, F.col("total")
    text = (
        F.when(style == 0, _say("Base ", total, " Vat  %"))
        .when(style == 1, _say("taxable amount : ", total, "\n"))
        .when(style == 2, _say("Total HT: ", total, " Total TTC: ", F.col("gross"), "\n"))
        .when(style == 3, _say("10.00€ ", us_format(total), " € Total Facture"))
        .otherwise(_say("€ ", us_format(total), " net"))
    )
    return (
        invoice_numbers(spark, sf).withColumn("text", text)
        .withColumn("n", F.when(F.col("k") % 2 == 0, F.lit("inv-1")).otherwise(F.lit("DM1")))
        .withColumn("taxable_amount", legacy.taxable_amount_v17(F.col("text"), F.col("n")))
        .select("k", "taxable_amount",
                legacy.total_cascade_v17(F.col("text"), F.col("n"), F.col("taxable_amount")).alias("total_invoice"))
    )


def v17_max_euro(spark, sf):
    text = _say("€ ", us_format(F.col("total")), " and 99.50 € and ", us_format(F.col("total") / 2), "€.")
    return _finder(spark, sf, text, amount=lambda t: legacy.max_euro_amount_v17(t))


def v17_labels(spark, sf):
    text = _say("gross weight: ", F.col("total"), "\nNombre de Colis:", F.col("pallets"), "\n")
    return _finder(spark, sf, text, gross_weight=lambda t: legacy.float_after_label_v17(t, fv.V17_GROSS_LABELS),
                   boxes=lambda t: legacy.int_after_label_v17(t, fv.V17_BOX_LABELS))


# --- streams ----------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _utc(column: str) -> Column:
    """A time without zone as the moment it is in UTC, whatever zone the session runs in."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def stream_closed_batches(spark, sf):
    """Events as files of the batch of their user, landed in steps of an hour; all of them are long
    quiet by the clock.  A rare signup is a marker, so that some batches close by it, others by quiet."""
    marker = (F.col("event_type") == "signup") & (F.col("event_id") % 29 == 0)
    at = F.unix_micros(_utc("ts"))
    landed = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("batch_id"),
        F.when(marker, F.lit(fv.DONE_MARKER))
        .otherwise(F.concat("event_id", F.when(F.col("event_type") == "error", F.lit(".txt")).otherwise(F.lit(".pdf")))).alias("rel_path"),
        _utc("ts").alias("modificationTime"),
        F.timestamp_micros(at - F.pmod(at, F.lit(3_600_000_000))).alias("landed_at"),
    )
    closed = closing.closed_batches(closing.arrivals(landed), QUIET_SECONDS)
    return drained(closed, has_timers=True).drop("closed_at")


def stream_sessions(spark, sf):
    landed = _event_stream(spark, sf).select(F.col("user_id").alias("batch_id"), _utc("ts").alias("modificationTime"))
    sessions = drained(closing.activity_sessions(landed, QUIET_SECONDS, "1 hour"))
    return sessions.select(
        "batch_id", "files", F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("last_change").alias("last_change"),
    )


def stream_status(spark, sf):
    """The changes that end a batch, from the status log as a stream."""
    log = corpus.status_changes(_event_stream(spark, sf))
    ends = log.filter(status.is_terminal(F.col("state"), F.col("stage")))
    return drained(ends).select("batch_id", "seq", "state", "stage", "updated_at")


def stream_waiters(spark, sf):
    """Each signup waits a day for the next purchase or error of its user."""
    kind = F.col("event_type")
    waiters = _event_stream(spark, sf).filter(kind == "signup").select(
        F.col("event_id").alias("waiter"), F.col("user_id").alias("batch_id"), _utc("ts").alias("asked_at"))
    ends = _event_stream(spark, sf).filter(kind.isin("purchase", "error")).select(
        F.col("user_id").alias("batch_id"), kind.alias("state"), _utc("ts").alias("ended_at"))
    return drained(waiting.waited(waiters, ends, WAIT_SECONDS, "1 hour")).select(
        "waiter", "batch_id", "answer", "state", F.unix_micros("ended_at").alias("ended_at"))


def stream_findings(spark, sf):
    """Events as status changes of their user: which of them no writer makes, and who stayed too long."""
    kind = F.col("event_type")
    state = (F.when(kind == "signup", fv.STATE_UPLOADED).when(kind == "purchase", fv.STATE_DONE)
             .when(kind == "error", fv.STATE_ERROR).otherwise(fv.STATE_PROCESSING))
    stage = (F.when(kind == "signup", fv.STAGE_WAITING).when(kind == "purchase", fv.STATE_DONE)
             .when(kind == "error", fv.STATE_ERROR).when(kind == "view", fv.STAGE_EMAIL).otherwise(fv.STAGE_EXTRACTOR))
    changes = _event_stream(spark, sf).select(
        F.col("user_id").alias("batch_id"), state.alias("state"), stage.alias("stage"), _utc("ts").alias("updated_at"),
        F.col("event_id").alias("seq"))
    return drained(transitions.findings(changes, STUCK_SECONDS, "1 hour"))


QUERIES = {
    f.__name__: f
    for f in (
        invoice_fields, document_fields, page_fields, page_assembly, normalise_text,
        selected_documents, rejected_documents, invoice_no_from_file, int_after_label,
        int_repeated_layers, weight_after_label, weight_same_digit, float_after_label,
        float_before_marker, total_tier1, total_tier2, total_tier3, total_tier4, total_cascade,
        euro_amounts_last, reduce_repetition, number_tokens, weight_tokens, amount_tokens_v17,
        batch_totals, grand_totals, batch_summary, batch_report, batch_report_total_row,
        batch_report_v17, exact_totals, large_counts, large_count_totals, detail_json_roundtrip, summary_json_roundtrip, rejected_roundtrip,
        admission_decision, selection_precheck, upload_responses,
        last_of_each_name, archive_members, archive_verdicts, archive_expansion, archive_validity,
        batch_activity, batch_ready, batch_sessions, batch_id_roundtrip, path_sort_rank,
        status_latest, status_first_start, status_with_default, status_seed_missing,
        status_progress, status_terminal, recipients, notification_rows,
        v17_fields, v17_invoice_no, v17_taxable, v17_max_euro, v17_labels,
        stream_closed_batches, stream_sessions, stream_status, stream_waiters, stream_findings,
    )
} | INBOX_QUERIES | RUN_QUERIES
