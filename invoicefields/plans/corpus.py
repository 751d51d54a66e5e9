"""Invoice texts rendered from the supplied tables.

The tables hold numbers, not invoices, so the texts are written from those numbers in the
layouts the finders must read.  The check SQL works out the expected fields from the numbers
alone and never from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.operators import status

STYLES = 6
BATCHES = 50
ZERO_WIDTH, JOINER, NO_BREAK = "\u200b", "\u2060", "\u00a0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)")


def us_format(value: Column) -> Column:
    return F.format_number(value, 2)


def eu_format(value: Column) -> Column:
    return F.translate(us_format(value), ",.", ".,")


def invoice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of one invoice per order: k, boxes, pallets, gross, net, total."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.count("*").alias("boxes"),
            (F.sum("l_linenumber") % 40 + 1).alias("pallets"),
            F.sum("l_quantity").cast("bigint").alias("gross"),
            money(F.sum(money(F.col("l_extendedprice")))).alias("total"),
        )
        .withColumn("net", F.col("gross") - F.col("boxes"))
    )


def file_name(key: Column) -> Column:
    return F.format_string("DM%06d.pdf", key)


def _lines(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def invoice_text() -> Column:
    """The text of an invoice in the layout ``k % 6``."""
    boxes, pallets, gross, net = (F.col(c).cast("string") for c in ("boxes", "pallets", "gross", "net"))
    total, plain = F.col("total"), F.col("total").cast("string")
    thrice = lambda c: F.repeat(c, F.lit(3))
    layouts = [
        _lines("Invoice\nPallets: ", pallets, "\nBoxes: ", boxes, "\nGross Weight: ", gross,
               " kg\nNet Weight: ", net, " kg\nTotal Invoices EUR ", plain, "\n"),
        _lines("Pallets: ", pallets, "\nBoxes: ", boxes, "\nGross Weight: ", gross,
               "kg\nNet Weight: ", net, "kgs\nTotal Invoices: ", us_format(total), "\nThank you"),
        _lines("Facture\nNombre de Palettes : ", pallets, "\nBoxes : ", boxes, "\nPoids brut : ", gross,
               " kg\nPoids net : ", net, " kg\n", eu_format(total), "€ Total Facture en Euro*:\nMerci"),
        _lines("Pallets:Pallets:Pallets: ", thrice(pallets), "\nBoxes:Boxes:Boxes: ", thrice(boxes),
               "\nGross Weight:Gross Weight:Gross Weight: ", thrice(gross),
               " kg\nNet Weight:Net Weight:Net Weight: ", thrice(net),
               " kg\nTotal Invoices: ", plain, " ", plain, plain, " ", plain, "\nEnd"),
        _lines(f"Pal{ZERO_WIDTH}lets:{NO_BREAK}", pallets, f"\nBo{JOINER}xes: ", boxes,
               f"\nGross{NO_BREAK}Weight: ", gross, f" kg\nNet Wei{ZERO_WIDTH}ght: ", net,
               " kg\n€ ", plain, "\nEnd"),
        _lines("Boxes: ", boxes, "\nTotal Invoices: ",
               F.format_number((total * 100).cast("bigint"), 0), "\nEnd"),
    ]
    text = F.lit(None).cast("string")
    for style, layout in enumerate(layouts):
        text = F.when(F.col("k") % STYLES == style, layout).otherwise(text)
    return text


def invoice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, batch_id, file, text: one document per order that has lines, in the batch of its customer."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.format_string("B%02d", F.col("o_custkey") % BATCHES).alias("batch_id"),
    )
    return invoice_numbers(spark, sf_dir).join(orders, "k").select(
        "k", "batch_id", file_name(F.col("k")).alias("file"), invoice_text().alias("text")
    )


def prose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, text: an invoice block in the middle of each supplied document."""
    doc = F.col("doc_id")
    cents = (doc * 7919 + 100) % 10_000_000
    block = F.concat(
        F.lit("\nPallets: "), doc % 40 + 1, F.lit("\nBoxes: "), doc % 23 + 1,
        F.lit("\nGross Weight: "), doc % 977 + 10, F.lit(" kg\nNet Weight: "), doc % 97 + 10,
        F.lit(" kg\nTotal Invoices EUR "), us_format((cents / 100).cast("decimal(18,2)")), F.lit("\nEnd.\n"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("batch_id"), file_name(doc).alias("file"),
        F.concat("text", block, "text").alias("text"),
    )


def status_changes(events: DataFrame) -> DataFrame:
    """Events as status changes of the batch of their user."""
    kind, e = F.col("event_type"), F.col("event_id")
    state = (
        F.when(kind == "signup", F.lit(fv.STATE_UPLOADED)).when(kind == "purchase", F.lit(fv.STATE_DONE))
        .when(kind == "error", F.lit(fv.STATE_ERROR)).otherwise(F.lit(fv.STATE_PROCESSING))
    )
    stage = (
        F.when(kind == "signup", F.lit(fv.STAGE_WAITING)).when(kind == "purchase", F.lit("DONE"))
        .when(kind == "error", F.lit("ERROR")).when(kind == "view", F.lit("emailing"))
        .otherwise(F.lit(fv.STAGE_EXTRACTOR))
    )
    return events.select(
        F.col("user_id").alias("batch_id"),
        *status.status_row(state, stage, e % 5, e % 7, F.col("ts"), F.array(F.lit("a@x")), kind, e),
    )
