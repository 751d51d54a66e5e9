"""Extraction by the rules of the earlier version (v17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions import legacy
from invoicefields.functions.text import base_name, stem
from invoicefields.operators.extract import select_documents


def select_documents_v17(documents: DataFrame) -> DataFrame:
    return select_documents(documents, exclude_cmr=True)


def extract_invoices_v17(documents: DataFrame, keep: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One row of seven fields per document, with the taxable amount in place of the net weight.
    Number and taxable amount feed the total, so they are columns of a step before it."""
    text = F.col("text")
    name = base_name(F.col("file"))
    return (
        documents.withColumn("invoice_no", legacy.invoice_no_v17(text, stem(name)))
        .withColumn("taxable_amount", legacy.taxable_amount_v17(text, F.col("invoice_no")))
        .select(
            *keep,
            name.alias("file"),
            "invoice_no",
            legacy.int_after_label_v17(text, fv.V17_PALLET_LABELS).alias("pallets"),
            legacy.int_after_label_v17(text, fv.V17_BOX_LABELS).alias("boxes"),
            legacy.float_after_label_v17(text, fv.V17_GROSS_LABELS).alias("gross_weight"),
            "taxable_amount",
            legacy.total_cascade_v17(text, F.col("invoice_no"), F.col("taxable_amount")).alias("total_invoice"),
        )
    )
