"""Field finders: each takes the document text and gives one value or NULL.

A search ignores case, takes the leftmost match, and tries the labels in order until one
gives a value.  All patterns run inside the JVM regex engine.  Where the rest of a pattern
cannot start with what a loop just took, the loop is possessive (``*+``, ``++``): the result
is the same, and a text with thousands of repeated labels, blanks or digits stays linear and
needs no deep stack.  Labels must start with a letter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions.numbers import has_two_decimals, parse_number, parse_weight
from invoicefields.functions.text import let, smallest_unit

# Unicode white space and word characters, any case; D: a dot matches line ends too.
ANY_CASE = "(?iU)"
ANY_CASE_D = "(?isU)"

AFTER_EURO = r"(?U)€\s*+([0-9][0-9.,\s]++)"
# Only the first digit of a run of digits and separators can start a match that the others miss.
BEFORE_EURO = r"(?U)(?<![0-9.,\s])[.,\s]*+([0-9][0-9.,\s]++)[^0-9]{0,5}€"
FRENCH_TOTAL = ANY_CASE + r"Total\s+Facture\s+en\s+Euro\*?\s*+:\s*+(?:[0-9][0-9.,\s]++)?"


def invoice_no(file_stem: Column) -> Column:
    """Invoice number from the file name alone."""
    return let(
        F.upper(F.regexp_replace(file_stem, "[^A-Za-z0-9_-]+", "")),
        lambda s: F.when(s != "", s),
    )


def _int_after(text: Column, label: str) -> Column:
    chain = rf"{ANY_CASE}(?:{label}\s*+:\s*+)++[0-9]+"

    def value(found: Column) -> Column:
        digits = F.regexp_extract(found, r"[0-9]+\z", 0)
        layers = F.regexp_count(F.regexp_replace(found, r"[0-9]+\z", ""), F.lit(ANY_CASE + label))
        return let(
            F.struct(digits.alias("d"), layers.alias("n")),
            lambda m: F.when(
                (m["n"] > 1) & (F.length(m["d"]) % m["n"] == 0),
                F.left(m["d"], (F.length(m["d"]) / m["n"]).cast("int")),
            )
            .otherwise(smallest_unit(m["d"]))
            .try_cast("decimal(38,0)"),
        )

    return let(F.regexp_extract(text, chain, 0), lambda found: F.when(found != "", F.struct(value(found).alias("v"))))


def int_after_label(text: Column, labels: Sequence[str]) -> Column:
    """Integer after ``label:``.  A label printed n times takes the n-th part of the digits.  The first
    label with a number decides; a number beyond 38 digits is NULL, and no later label answers for it."""
    return F.coalesce(*[_int_after(text, label) for label in labels])["v"]


def _number_run_after(text: Column, label: str) -> Column:
    """The run of digits, separators and blanks after ``label:``, up to a unit or a word border."""
    run = r"([0-9][0-9.,\s]*+(?=kgs?\b)|[0-9][0-9.,\s]*\b)"
    return F.regexp_extract(text, rf"{ANY_CASE}{label}\s*+:\s*+{run}", 1)


def float_after_label(text: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[let(_number_run_after(text, label), parse_number) for label in labels])


def weight_after_label(text: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[let(_number_run_after(text, label), parse_weight) for label in labels])


def float_before_marker(text: Column, marker: str) -> Column:
    """``marker`` must not start with a digit, separator or blank: then a match ends with its run, and
    of the starts in a run only the first digit has to be tried."""
    run = F.regexp_extract(text, rf"{ANY_CASE}(?<![0-9.,\s])[.,\s]*+([0-9][0-9.,\s]++){marker}", 1)
    return let(run, parse_number)


def last_euro_amount(text: Column) -> Column:
    """Amounts after a euro sign, then amounts before one: the last with two decimals, else the last."""
    tokens = F.concat(
        F.regexp_extract_all(text, F.lit(AFTER_EURO), F.lit(1)),
        F.regexp_extract_all(text, F.lit(BEFORE_EURO), F.lit(1)),
    )
    amounts = F.filter(
        F.transform(
            tokens,
            lambda t: F.struct(has_two_decimals(t).alias("cents"), parse_number(t).alias("v")),
        ),
        lambda a: a["v"].isNotNull(),
    )
    return let(
        amounts,
        lambda found: F.coalesce(
            F.try_element_at(F.filter(found, lambda a: a["cents"]), F.lit(-1))["v"],
            F.try_element_at(found, F.lit(-1))["v"],
        ),
    )


def total_after_label(text: Column) -> Column:
    """First tier: the first number of two or more characters anywhere after ``Total Invoice(s)``."""
    found = F.regexp_extract(
        text, ANY_CASE_D + r"\A(?>.*?Total\s+Invoices?).*?([0-9][0-9.,\s]++)", 1
    )
    return let(found, parse_number)


def total_beside_label(text: Column) -> Column:
    """Second tier: ``TOTAL INVOICE: 1,329.01``, with a colon or a blank between."""
    found = F.regexp_extract(
        text,
        ANY_CASE + r"TOTAL\s+INVOICE(?:\s*+:\s*+|(?=\s* )\s++)([0-9][0-9.,\s]++)",
        1,
    )
    return let(found, parse_number)


def total_near_french_label(text: Column) -> Column:
    """Third tier: the last euro amount within reach of ``Total Facture en Euro:``."""
    reach = F.lit(fv.EURO_WINDOW)

    # Wherever the label's own text stands, the pattern matches: its first place is that of the first match.
    def around(label: Column) -> Column:
        def window(at: Column) -> Column:
            before, after = F.left(text, at - 1), F.substring(text, at + F.length(label), F.length(text))
            return F.concat(F.right(before, reach), label, F.left(after, reach))

        return F.when(label != "", let(let(F.position(label, text), window), last_euro_amount))

    return let(F.regexp_extract(text, FRENCH_TOTAL, 0), around)


def total_anywhere(text: Column) -> Column:
    """Fourth tier: the last euro amount of the document."""
    return last_euro_amount(text)


def total_invoice(text: Column) -> Column:
    return F.coalesce(
        total_after_label(text),
        total_beside_label(text),
        F.when(
            F.contains(text, F.lit("€")),
            F.coalesce(total_near_french_label(text), total_anywhere(text)),
        ),
    )
