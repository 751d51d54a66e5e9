"""Field finders of the earlier version (v17), kept for results made with it.

Differences to ``finders``: text is not normalised, labels are literal, numbers know fewer
separators, and a total that is found but is no number ends the search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions.finders import ANY_CASE, ANY_CASE_D, int_after_label
from invoicefields.functions.numbers import parse_amount_v17
from invoicefields.functions.text import let, reduce_repetition, strip

AMOUNT = r"(\d{1,3}(?:[\s.,]\d{3})*(?:[.,]\d{2}))"


def literal(label: str) -> str:
    return rf"\Q{label}\E"


def int_after_label_v17(text: Column, labels: Sequence[str]) -> Column:
    return int_after_label(text, [f"(?:{literal(label)})" for label in labels])


def _plain_float(token: Column) -> Column:
    return let(token, lambda t: reduce_repetition(t).try_cast("double"))


def float_after_label_v17(text: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[
        _plain_float(F.regexp_extract(text, rf"{ANY_CASE}{literal(label)}\s*+:\s*+([0-9.]+)", 1))
        for label in labels
    ])


def float_before_marker_v17(text: Column, marker: str) -> Column:
    return _plain_float(F.regexp_extract(text, rf"{ANY_CASE}(?<![0-9.])\.*+([0-9][0-9.]++)\s*+{marker}", 1))


def invoice_no_v17(text: Column, file_stem: Column) -> Column:
    """From the file name if it is a known form, else by label, else by form anywhere in the text."""
    name = strip(file_stem)

    def by_label(pattern: str) -> Column:
        return let(
            F.regexp_extract(text, ANY_CASE + pattern, 1),
            lambda c: F.when((c != "") & ~F.lower(c).isin(fv.V17_NUMBER_STOP_WORDS), c),
        )

    def anywhere(pattern: str) -> Column:
        return let(F.regexp_extract(text, ANY_CASE + pattern, 0), lambda c: F.when(c != "", c))

    return F.coalesce(
        F.when(name.rlike(ANY_CASE + r"\ADM\d{6}\z"), F.upper(name))
        .when(name.rlike(ANY_CASE + r"\Ainv-\d{3,}\z"), F.lower(name))
        .when(name.rlike(r"(?U)\A\d{8}\z"), name),
        *[by_label(p) for p in fv.V17_NUMBER_PATTERNS],
        F.upper(anywhere(r"\bDM\d{6}\b")),
        F.lower(anywhere(r"\binv-\d{3,}\b")),
    )


def max_euro_amount_v17(text: Column) -> Column:
    """The largest amount with a euro sign before or after it."""
    tokens = F.concat(
        F.regexp_extract_all(text, F.lit(rf"(?U)\b{AMOUNT}\s*+€"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(rf"(?U)€\s*+{AMOUNT}\b"), F.lit(1)),
    )
    return F.array_max(F.transform(tokens, parse_amount_v17))


def total_invoice_v17(text: Column) -> Column:
    beside = F.regexp_extract(
        text, ANY_CASE + r"TOTAL\s+INVOICE(?:\s*+:\s*+|(?=\s* )\s++)([0-9][0-9.,]+)", 1
    )
    after = F.regexp_extract(text, ANY_CASE_D + r"\A(?>.*?Total\s+Invoices?).*?([0-9][0-9.,]+)", 1)
    return let(
        beside, lambda b: F.when(b != "", parse_amount_v17(b)).otherwise(let(after, parse_amount_v17))
    )


def is_simple_layout_v17(text: Column, number: Column) -> Column:
    return F.contains(text, F.lit(fv.V17_SIMPLE_TOTAL_TEXT)) | F.coalesce(
        F.startswith(number, F.lit(fv.V17_SIMPLE_NUMBER_PREFIX)), F.lit(False)
    )


def taxable_amount_v17(text: Column, number: Column) -> Column:
    return F.coalesce(
        float_before_marker_v17(text, fv.V17_TAXABLE_MARKER),
        float_after_label_v17(text, fv.V17_TAXABLE_LABELS),
        F.when(is_simple_layout_v17(text, number), max_euro_amount_v17(text)),
    )


def total_cascade_v17(text: Column, number: Column, taxable: Column) -> Column:
    return F.coalesce(
        total_invoice_v17(text),
        float_after_label_v17(text, fv.V17_TOTAL_LABELS),
        F.when(is_simple_layout_v17(text, number), taxable),
    )
