"""Golden cases of the column functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions import finders, legacy, numbers, text
from invoicefields.operators import batches, notify, status


def evaluate(spark, column, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.out for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, column, cases, type_="string"):
    got = evaluate(spark, column, list(cases), type_)
    assert dict(zip(cases, got)) == cases


def test_smallest_repetition_unit(spark):
    check(spark, text.reduce_repetition, {
        "3333": "3", "65656565": "65", "1212": "12", "11": "1", "6734.736734.73": "6734.73",
        " 33\n": "3", "": "", "abc": "abc", "aba": "aba", "é€é€": "é€",
    })


def test_smallest_unit_is_stable_and_exact(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choice("12.") for _ in range(rng.randint(1, 4))) * rng.randint(1, 4) for _ in range(200)]

    def direct(s):
        return next(s[:k] for k in range(1, len(s) + 1) if len(s) % k == 0 and s[:k] * (len(s) // k) == s)

    once = evaluate(spark, text.reduce_repetition, tokens)
    assert once == [direct(t) for t in tokens]
    assert evaluate(spark, text.reduce_repetition, once) == once


def test_number_tokens(spark):
    check(spark, numbers.parse_number, {
        "1,329.01": 1329.01, "1.329,01": 1329.01, "1329,01": 1329.01, "1329.01": 1329.01, "1,329": 1.329,
        "1.329": 1.329, "1,234,567": None, "1.234.567": None, "1,234,567.89": 1234567.89,
        "1.234.567,89": 1234567.89, "1 329,01": 329.01, "191 444": 191.0, "1329.": 1329.0, "1329,": 1329.0,
        "1,329.01,": None, "0,5": 0.5, "11": 1.0, "1212": 12.0, "444": 4.0, "007": 7.0, "22.2222.22": 22.22,
        "6734.73 6734.736734.73 6734.73": 6734.73, "191kg": 191.0, "808.88\n": 808.88, "abc": None, "": None,
    })


def test_weight_tokens(spark):
    check(spark, numbers.parse_weight, {
        "444": 444.0, "444444444": 444.0, "55555": 55555.0, "666666": 666.0, "77777777": 77.0, "8888888": 888.0,
        "4444444444": 44.0, "00": 0.0, "9": 9.0, "191 191": 191.0, "191191": 191.0, "1212": 12.0,
        "1,329.5": 1329.5, "x": None,
    })


def test_amounts_of_the_earlier_version(spark):
    check(spark, numbers.parse_amount_v17, {
        "1.329,01": 1.32901, "1,329.01": 1329.01, "1329,01": 1329.01, "1\n329.01": None, "": None, "33": 3.0,
    })


def test_units_and_decimals(spark):
    check(spark, numbers.strip_unit, {"191kg": "191", "191KGS": "191", "5g": "5", "kg5": "kg5"})
    check(spark, numbers.has_two_decimals, {"12.50": True, "12.50 \n": True, "12.5": False, "1,50": True, "12.50\r": False})


def test_normalised_text(spark):
    check(spark, text.normalise_text, {
        "A\u200bB\ufeff\u202eC": "ABC", "a\u00a0b\u202fc": "a b c", "\u2066x\u2069\u2060": "x", "plain": "plain",
        "“quoted” – été €": "“quoted” – été €",
    })


def test_file_names(spark):
    check(spark, lambda v: text.stem(text.base_name(v)), {
        "a/DM1.v2.pdf": "DM1.v2", "x.pdf": "x", ".pdf": ".pdf", "a.": "a.", "d/e/": "e", "/": "", "a/.": "a", ".": "",
    })
    check(spark, text.suffix, {"a.PDF": ".pdf", ".pdf": "", "a.": "", "a.tar.gz": ".gz"})
    check(spark, text.is_pdf, {"a.pdf": True, "a.PDF": True, ".pdf": False, "d/.pdf": False, "a.txt": False})
    check(spark, lambda v: finders.invoice_no(text.stem(v)), {
        "dm123456.pdf": "DM123456", "inv-211125.pdf": "INV-211125", "DM1.v2.pdf": "DM1V2", "é€.pdf": None,
    })


def test_paths_sort_by_element(spark):
    paths = spark.createDataFrame([("a-b",), ("a/b",), ("a",)], "p string")
    assert [r.p for r in paths.orderBy(text.path_order(F.col("p"))).collect()] == ["a", "a/b", "a-b"]


def test_integers_after_labels(spark):
    check(spark, lambda v: finders.int_after_label(v, fv.PALLET_LABELS), {
        "Pallets:Pallets:Pallets:Pallets: 11111111": 11, "Pallets: 11": 1, "Nombre de Palettes : 7": 7,
        "PALLETS\n:\n 12": 12, "Pallets 12": None, "none": None, "Pallets: 1 Pallets: 2": 1,
    })
    check(spark, lambda v: finders.int_after_label(v, fv.BOX_LABELS), {
        "Boxes: 12": 12, "Boxes:Boxes: 12": 1, "Boxes:Boxes: 123": 123, "Boxes:" * 20000 + " 5": 5,
    })


def test_weights_after_labels(spark):
    gross = lambda v: finders.weight_after_label(v, fv.GROSS_LABELS)
    check(spark, gross, {
        "Gross Weight: 191kg": 191.0, "Gross Weight: 191kgx": None, "Gross Weight: 191 EUR": 191.0,
        "Gross Weight: 191.\n": 191.0, "Gross Weight: 191.\nNet": 191.0, "Gross Weight: 191\n2026.01 x": 2026.01,
        "gross  weight :44 KGS": 44.0, "Poids brute: 5 kg": 5.0, "Poid brute: 5,5": 5.5,
        "Gross Weight: 1,2,3 Poids brut: 7": 7.0,
    })
    check(spark, lambda v: F.regexp_extract(v, finders.ANY_CASE + r"Gross\s+Weight\s*+:\s*+([0-9][0-9.,\s]*+(?=kgs?\b)|[0-9][0-9.,\s]*\b)", 1), {
        "Gross Weight: 191kg": "191", "Gross Weight: 191 EUR": "191 ", "Gross Weight: 191.\n": "191",
        "Gross Weight: 191.\nNet": "191.\n", "Gross Weight: 191\n2026.01 x": "191\n2026.01 ",
    })
    check(spark, lambda v: finders.float_after_label(v, fv.NET_LABELS), {"Net Weight: 1.329,01 kg": 1329.01, "NetWeight: 11": 1.0})
    check(spark, lambda v: finders.float_before_marker(v, "EUR"), {"a 1 329,01 eur": 329.01, "5EUR": None, "12EUR": 12.0})


def test_totals_by_tier(spark):
    check(spark, finders.total_after_label, {
        "Total Invoices (3 pages) EUR 99.10": 3.0, "TOTAL INVOICE: 1,329.01": 1329.01, "Total Invoices EUR 5€ then 12.40 x": 12.40,
        "12.40 Total Invoices": None, "Total Invoice x Total Invoices 7": None,
    })
    check(spark, finders.total_beside_label, {
        "TOTAL INVOICE: 1,329.01": 1329.01, "total invoice  12.5": 12.5, "TOTAL INVOICE\n12.5": None,
        "TOTAL INVOICE \n12.5": 12.5, "TOTAL INVOICES: 12.5": None,
    })
    far = "x" * 250
    check(spark, finders.total_near_french_label, {
        "808.88€ Total Facture en Euro*:": 808.88, "Total Facture en Euro*: 55.10": None,
        f"€ 9.99 {far}Total Facture en Euro:{far}€ 8.88": None, f"€ 9.99{far[:240]}Total Facture en Euro: 1": 9.99,
        "Total Facture en Euro: 12.00€ x": 12.0,
    })
    check(spark, finders.last_euro_amount, {
        "€ 10.00 x 20.00€ y € 30": 20.0, "€ 5 x": 5.0, "no": None, "Net: 180 kg\n€ 123.45": 123.45, ".5 12.00 abc€": 12.0,
    })
    check(spark, finders.total_invoice, {
        "808.88€ Total Facture en Euro*:": 808.88, "Total Facture en Euro*: 55.10": None,
        "Total Invoices 1,2,3 then 44.50€": 44.5, "": None,
    })


def test_linear_patterns_find_what_the_plain_ones_find(spark):
    """The possessive patterns against the plain ones, by Python's engine, on random noise."""
    rng = random.Random(7)
    parts = ["€", "1", "23", ".", ",", " ", "\n", "kg", "kgs", "x", "Gross Weight:", "gross weight : ", "Total Invoice", "s", ":"]
    noise = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    plain = {
        "before": (r"([0-9][0-9.,\s]+)\s*[^0-9]{0,5}€", finders.BEFORE_EURO),
        "after": (r"€\s*([0-9][0-9.,\s]+)", finders.AFTER_EURO),
    }
    for python_pattern, java_pattern in plain.values():
        got = evaluate(spark, lambda v: F.regexp_extract_all(v, F.lit(java_pattern), F.lit(1)), noise)
        assert got == [re.findall(python_pattern, t) for t in noise]

    def first(pattern, t):
        m = re.search(pattern, t, re.I | re.S)
        return m.group(1) if m else ""

    token = r"Gross\s+Weight\s*:\s*([0-9][0-9.,\s]*)(?:\s*(?:kg|kgs))?\b"
    got = evaluate(spark, lambda v: finders._number_run_after(v, r"Gross\s+Weight"), noise)
    assert got == [first(token, t) for t in noise]
    got = evaluate(spark, lambda v: F.regexp_extract(v, finders.ANY_CASE_D + r"\A(?>.*?Total\s+Invoices?).*?([0-9][0-9.,\s]++)", 1), noise)
    assert got == [first(r"Total\s+Invoices?.*?([0-9][0-9.,\s]+)", t) for t in noise]
    spaced = [t.replace("x", "Total Invoice") for t in noise]
    got = evaluate(spark, lambda v: F.regexp_extract(v, finders.ANY_CASE + r"TOTAL\s+INVOICE(?:\s*+:\s*+|(?=\s* )\s++)([0-9][0-9.,\s]++)", 1), spaced)
    assert got == [first(r"TOTAL\s+INVOICE\s*[: ]\s*([0-9][0-9.,\s]+)", t) for t in spaced]


def test_earlier_invoice_numbers(spark):
    rows = spark.createDataFrame([
        ("", "inv-211125", "inv-211125"), ("", "02348016", "02348016"), ("", "dm123456", "DM123456"),
        ("Invoice: NUMBER", "x", None), ("Invoice Number: A-12/3 x", "x", "A-12/3"), ("Invoice No. 77-1", "x", "77-1"),
        ("Invoice\nfoo Number: 123456", "x", "123456"), ("Invoice: Date: \n inv-211125 21-Nov", "x", "inv-211125"),
        ("Numéro Facture : F-9", "x", "F-9"), ("ref dm123456.", "x", "DM123456"), ("see INV-123", "x", "inv-123"),
    ], "t string, s string, want string")
    wrong = rows.withColumn("got", legacy.invoice_no_v17(F.col("t"), F.col("s"))).filter("not (want <=> got)")
    assert wrong.collect() == []


def test_earlier_amounts(spark):
    rows = spark.createDataFrame([
        ("12.50 Vat %", None, 12.5, None), ("Total HT: 80.5", None, 80.5, None),
        ("10.00€ 99.00€ Total Facture", None, 99.0, 99.0), ("€ 5.00 and 7.00 €", "inv-1", 7.0, 7.0),
        ("€ 5.00 and 7.00 €", "DM1", None, None), ("TOTAL INVOICE: 1,2,3 Total TTC: 6", None, None, 6.0),
    ], "t string, n string, taxable double, total double")
    got = rows.withColumn("x", legacy.taxable_amount_v17(F.col("t"), F.col("n"))).withColumn(
        "y", legacy.total_cascade_v17(F.col("t"), F.col("n"), F.col("x"))
    )
    assert got.filter("not (taxable <=> x and total <=> y)").collect() == []


def test_progress(spark):
    rows = spark.createDataFrame([
        (8, 1, "x", 13, 13), (8, 9, "x", 100, 113), (0, 0, "WAITING", 5, 0), (0, 0, "RUNNING_EXTRACTOR", 10, 0),
        (0, 0, "done", 100, 0), (None, None, None, 10, 0), (0, 5, "Emailing", 85, 0),
    ], "total int, done int, stage string, a int, b int")
    got = rows.select("a", "b", status.progress_percent(F.col("total"), F.col("done"), F.col("stage")).alias("x"),
                      status.progress_percent_uncapped(F.col("total"), F.col("done")).alias("y"))
    assert got.filter("a <> x or b <> y").collect() == []


def test_terminal_and_recipients(spark):
    assert evaluate(spark, lambda v: status.is_terminal(F.lit("PROCESSING"), v), ["done", "WAITING", None]) == [True, False, False]
    assert evaluate(spark, status.is_terminal_state, ["DONE", "done", None]) == [True, False, False]
    check(spark, notify.parse_recipients, {" a@x , ,b@y,": ["a@x", "b@y"], "": [], None: []})
    check(spark, notify.media_type, {"a.JSON": "application/json", "a.csv": "text/csv", "a": "application/octet-stream"})


def test_batch_ids(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-26 12:02:33.5' AS at, 'k' AS k").select(
        batches.new_batch_id(F.col("at"), F.col("k")).alias("id"),
        batches.iso_time(F.col("at")).alias("z"), batches.iso_time(F.col("at"), "+00:00").alias("o"),
    ).first()
    assert re.fullmatch(r"20260126_120233_[a-z0-9]{4}", row.id)
    assert (row.z, row.o) == ("2026-01-26T12:02:33.500000Z", "2026-01-26T12:02:33.500000+00:00")
    check(spark, lambda v: batches.batch_id_time(v).cast("string"), {"20260126_120233_ab12": "2026-01-26 12:02:33", "mi_lote_001": None})


@pytest.mark.parametrize("size", [200_000])
def test_long_runs_stay_cheap(spark, size):
    long_text = "Gross Weight: " + "1 " * size + "Pallets:" * 5000 + " 7 " + "€" + " " * size + "x " + "9." * size
    got = spark.createDataFrame([(long_text,)], "t string").select(
        finders.int_after_label(F.col("t"), fv.PALLET_LABELS).alias("p"), finders.last_euro_amount(F.col("t")).alias("e"),
    ).first()
    assert (got.p, got.e) == (7, 7.0)


def test_french_total_where_its_label_stands_twice(spark):
    """The label was split off by a pattern that was compiled again for each text; now by its first place."""
    label = "Total Facture en Euro*: "
    df = spark.createDataFrame([
        (f"{label}1,50 €",), (f"\U0001F4C4 3,00 € {label}7 {label}9,00 €",), (f"4,00 € {label}",), ("4,00 € Total",), (None,), ("",),
    ], "t string")
    plan = df.select(finders.total_near_french_label(F.col("t")).alias("v"))
    assert [r.v for r in plan.collect()] == [1.5, 9.0, 4.0, None, None, None]
    assert "split(" not in plan._jdf.queryExecution().toString()
