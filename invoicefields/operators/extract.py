"""Documents into rows of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions import finders
from invoicefields.functions.text import base_name, is_cmr, is_pdf, normalise_text, stem

UNREADABLE = "unreadable text"
NAMELESS = "no file name"


def assemble_pages(pages: DataFrame, keys: list[str], page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Pages into documents: page texts in page order, joined by line ends, missing ones empty.
    One exchange; the document is one row, so its pages meet in one task in any case."""
    page = F.struct(F.col(page_no).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    pages_in_order = F.array_sort(F.collect_list(page))
    return pages.groupBy(*keys).agg(pages_in_order.alias("_pages")).select(
        *keys, F.array_join(F.transform("_pages", lambda x: x["t"]), "\n").alias("text"))


def select_documents(documents: DataFrame, exclude_cmr: bool = False,
                     case_sensitive_ext: bool = False) -> DataFrame:
    """Only documents named ``*.pdf``; waybills named ``CMR*`` too unless excluded."""
    kept = documents.filter(is_pdf(F.col("file"), case_sensitive_ext))
    return kept.filter(~is_cmr(base_name(F.col("file")))) if exclude_cmr else kept


def rejection(file: str = "file", text: str = "text") -> Column:
    """Why a document cannot be read; NULL if it can."""
    return F.when(F.col(text).isNull(), UNREADABLE).when(
        F.coalesce(base_name(F.col(file)), F.lit("")) == "", NAMELESS
    )


def split_rejected(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that can be read, rows ``file, reason`` of those that cannot)."""
    reason = rejection()
    kept = documents.filter(reason.isNull())
    keys = [c for c in ("batch_id", "run_id") if c in documents.columns]
    rejected = documents.filter(reason.isNotNull()).select(*keys, "file", reason.alias("reason"))
    return kept, rejected


def extract_invoices(documents: DataFrame, keep: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One row of seven fields per document.  Narrow: no shuffle, and a field not selected
    downstream is not searched for."""
    text = F.col("_text")
    name = base_name(F.col("file"))
    return documents.withColumn("_text", normalise_text(F.col("text"))).select(
        *keep,
        name.alias("file"),
        finders.invoice_no(stem(name)).alias("invoice_no"),
        finders.int_after_label(text, fv.PALLET_LABELS).alias("pallets"),
        finders.int_after_label(text, fv.BOX_LABELS).alias("boxes"),
        finders.weight_after_label(text, fv.GROSS_LABELS).alias("gross_weight"),
        finders.weight_after_label(text, fv.NET_LABELS).alias("net_weight"),
        finders.total_invoice(text).alias("total_invoice"),
    )
