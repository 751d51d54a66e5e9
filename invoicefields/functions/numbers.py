"""Numbers in noisy text: repeated layers, EU and US separators, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoicefields.functions.text import let, reduce_repetition, smallest_unit

NUMBER_RUN = r"[0-9][0-9.,]*"


def longest_number(token: Column) -> Column:
    """The longest number written in the token, the first of equals; NULL if it has none."""
    runs = F.regexp_extract_all(token, F.lit(NUMBER_RUN), F.lit(0))
    ranked = F.transform(
        runs, lambda run, i: F.struct(F.length(run).alias("n"), (-i).alias("back"), run.alias("run"))
    )
    return F.array_max(ranked)["run"]


def strip_unit(token: Column) -> Column:
    """``191kg`` -> ``191``.  For tokens as they stand: numbers are picked out without units."""
    return F.regexp_replace(token, r"(?i)(?:kg|kgs|g)\z", "")


def decimal_value(token: Column) -> Column:
    """The later of ``,`` and ``.`` is the decimal mark, the other one only groups digits."""
    comma_is_mark = F.contains(token, F.lit(",")) & ~F.contains(
        F.substring_index(token, ",", -1), F.lit(".")
    )
    plain = F.when(comma_is_mark, F.translate(token, ",.", ".")).otherwise(
        F.translate(token, ",", "")
    )
    return plain.try_cast("double")


def parse_number(token: Column) -> Column:
    """Number in a token that may hold the same value several times; NULL if it is none."""
    return let(smallest_unit(longest_number(token)), decimal_value)


def is_one_digit_repeated(token: Column) -> Column:
    return token.rlike(r"\A([0-9])\1+\z")


def parse_weight(token: Column) -> Column:
    """As ``parse_number``, but ``444`` stays 444: one repeated digit is taken by its length."""

    def value(s: Column) -> Column:
        n = F.length(s)
        kept = (
            F.when(n <= 5, s)
            .when((n % 3 != 0) & (n % 2 == 0), F.left(s, F.lit(2)))
            .otherwise(F.left(s, F.lit(3)))
        )
        return let(
            F.when(is_one_digit_repeated(s), kept).otherwise(smallest_unit(s)), decimal_value
        )

    return let(longest_number(token), value)


def parse_amount_v17(token: Column) -> Column:
    """Earlier rule: a ``,`` beside a ``.`` is dropped, alone it is the decimal mark."""
    return let(
        F.translate(reduce_repetition(token), " ", ""),
        lambda s: F.when(F.contains(s, F.lit(".")), F.translate(s, ",", ""))
        .otherwise(F.translate(s, ",", "."))
        .try_cast("double"),
    )


def has_two_decimals(token: Column) -> Column:
    return F.translate(token, " \u00a0", "").rlike(r"(?d)[.,]\d{2}$")


def thousandths(value: Column) -> Column:
    """The double in thousandths, if it is the one nearest to a decimal of three places below 10^12;
    otherwise NULL.  Up to 15 digits no two decimals share a double, so this is the decimal that the
    shortest text of the double shows, without making that text."""
    units = F.rint(value * 1000.0)
    return F.when((F.abs(value) < 1e12) & (units / 1000.0 == value), units.cast("bigint"))


def exact_parts(value: Column) -> tuple[Column, Column]:
    """The double by its shortest decimal text, as its whole part and the rest.  NULL beyond 28 digits
    before the point.  A double below a milliard has room for 28 places, a larger one needs 8 at most,
    so the parts hold all digits and so do their sums."""
    small = F.abs(value) < 1e9
    near, far = value.try_cast("decimal(38,28)"), value.try_cast("decimal(38,10)")
    whole = F.when(small, F.floor(near).cast("decimal(38,0)")).otherwise(F.floor(far).cast("decimal(38,0)"))
    rest = F.when(small, F.pmod(near, F.lit(1)).cast("decimal(29,28)")).otherwise(
        F.pmod(far, F.lit(1)).cast("decimal(29,28)"))
    return whole, rest
