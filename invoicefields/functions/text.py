"""Text clean-up, repeated tokens and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    The bodies here are small; what they are given is often a search over a whole document.
    Binding keeps that search single even inside ``coalesce`` and ``CASE``, where common
    sub-expressions are not shared, and keeps it from running at all when an earlier
    alternative has already answered.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_text(text: Column) -> Column:
    """No-break spaces become blanks; zero-width and bidirectional marks are deleted.

    Most texts hold none of these, and a plain byte search tells so far faster than looking at
    every character; only texts with one of the lead bytes are rewritten.
    """
    raw = text.cast("binary")
    suspect = F.lit(False)
    for lead in fv.MARK_LEAD_BYTES:
        suspect = suspect | F.contains(raw, F.lit(lead))
    rewritten = F.translate(
        text, fv.BLANKED_CHARACTERS + fv.DELETED_CHARACTERS, " " * len(fv.BLANKED_CHARACTERS)
    )
    return F.when(suspect, rewritten).otherwise(text)


def strip(token: Column) -> Column:
    """Trim any white space, not only blanks, on both ends."""
    return F.regexp_replace(token, r"(?U)\A\s+|\s+\z", "")


def smallest_unit(token: Column) -> Column:
    """The smallest unit whose exact repetition gives the token: ``65656565`` -> ``65``.

    A text written twice in a row contains itself again at its smallest period (at its own
    length when it repeats nothing), so one substring search finds the unit.
    """
    return let(token, lambda s: F.left(s, F.position(s, F.concat(s, s), F.lit(2)) - 1))


def reduce_repetition(token: Column) -> Column:
    """``smallest_unit`` of the token without white space around it."""
    return smallest_unit(strip(token))


def base_name(path: Column) -> Column:
    """Last path element; empty for ``/`` and ``.``."""
    last = F.substring_index(F.regexp_replace(path, r"(?:/\.?)+\z", ""), "/", -1)
    return F.when(last == ".", F.lit("")).otherwise(last)


def stem(name: Column) -> Column:
    """File name without its last suffix: ``DM1.v2.pdf`` -> ``DM1.v2``."""
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")


def suffix(name: Column) -> Column:
    """Last suffix with its dot, in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def is_pdf(path: Column, case_sensitive: bool = False) -> Column:
    """PDF by extension; a name that is only ``.pdf`` has no extension."""
    return path.rlike(r"[^/]\.pdf\z" if case_sensitive else r"(?i)[^/]\.pdf\z")


def is_cmr(name: Column) -> Column:
    return F.startswith(name, F.lit(fv.CMR_PREFIX))


def path_order(path: Column) -> Column:
    """Sort key that orders paths element by element: ``a/b`` before ``a-b``."""
    return F.split(path, "/")
