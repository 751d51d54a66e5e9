"""Operators, readers and writers on small tables."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.operators import admission, batches, status, totals
from invoicefields.operators.extract import assemble_pages, extract_invoices, split_rejected
from invoicefields.operators.report import batch_report
from invoicefields.sources import files, sinks
from invoicefields.sources.archives import archive_documents, expand_archives
from invoicefields.sources.status_files import read_status, split_unreadable

ROWS = "batch_id string, file string, invoice_no string, pallets long, boxes long, gross_weight double, net_weight double, total_invoice double"


def some_rows(spark):
    return spark.createDataFrame([
        ("b", "z/1.pdf", "1", 2, None, 1.00005, None, 0.1), ("b", "a-b.pdf", "2", None, 3, None, None, 0.2),
        ("b", "a/c.pdf", None, 1, 1, 2.0, None, None),
    ], ROWS)


def test_totals_are_exact_and_rounded_half_up(spark):
    row = totals.batch_totals(some_rows(spark)).first()
    assert (row.count_files, row.pallets, row.boxes) == (3, 3, 4)
    assert (row.gross_weight, row.net_weight, row.total_invoice) == ("3.0001", "0.0000", "0.30")
    s = totals.batch_summary(some_rows(spark)).first()
    assert (s.count_files, s.count_with_gross_weight, s.count_with_total_invoice) == (3, 2, 2)
    assert (s.total_gross_weight, s.total_total_invoice) == ("3.0001", "0.30")


def test_totals_over_nothing(spark):
    row = totals.batch_totals(some_rows(spark).limit(0), keys=()).first()
    assert (row.count_files, row.gross_weight, row.total_invoice) == (0, "0.0000", "0.00")


def test_a_total_beyond_all_digits_is_no_number(spark):
    rows = spark.createDataFrame([("b", "f.pdf", "1", 1, 1, 1e30, None, 5.0)], ROWS)
    row = totals.batch_totals(rows).first()
    assert row.gross_weight is None and row.total_invoice == "5.00"


def test_batch_totals_add_up_to_the_grand_total(spark):
    rows = spark.range(500).select(
        (F.col("id") % 7).cast("string").alias("batch_id"), F.lit("f.pdf").alias("file"), F.lit("1").alias("invoice_no"),
        F.col("id").alias("pallets"), F.lit(1).cast("long").alias("boxes"), (F.col("id") / 4).alias("gross_weight"),
        F.lit(0.5).alias("net_weight"), (F.col("id") * 0.01).alias("total_invoice"),
    )
    per_batch = totals.batch_totals(rows).agg(F.sum(F.col("total_invoice").cast("decimal(18,2)")).cast("string").alias("t")).first().t
    assert per_batch == totals.batch_totals(rows, keys=()).first().total_invoice == "1247.50"


def test_report_file_ends_with_total(spark, tmp_path):
    path = str(tmp_path / "report")
    for _ in range(2):
        sinks.write_report_csv(batch_report(some_rows(spark)), path)
    lines = [l for p in sorted((tmp_path / "report" / "batch_id=b").glob("part-*")) for l in p.read_text().splitlines()]
    body = [l for l in lines if not l.startswith("file,")]
    assert lines[0] == ",".join(fv.REPORT_COLUMNS)
    assert body == ["a/c.pdf,,1,1,2.0,,", "a-b.pdf,2,,3,,,0.2", "z/1.pdf,1,2,,1.00005,,0.1", "TOTAL,,3,4,3.0001,0.0000,0.30"]


def test_detail_json_keeps_nulls_and_replaces_only_its_batch(spark, tmp_path):
    path = str(tmp_path / "detail")
    sinks.write_detail_json(some_rows(spark).unionByName(some_rows(spark).withColumn("batch_id", F.lit("c"))), path)
    sinks.write_detail_json(some_rows(spark).filter("file = 'a-b.pdf'"), path)
    docs = [json.loads(l) for p in (tmp_path / "detail" / "batch_id=b").glob("part-*") for l in p.read_text().splitlines()]
    assert docs == [{"file": "a-b.pdf", "invoice_no": "2", "pallets": None, "boxes": 3, "gross_weight": None,
                     "net_weight": None, "total_invoice": 0.2}]
    assert len([l for p in (tmp_path / "detail" / "batch_id=c").glob("part-*") for l in p.read_text().splitlines()]) == 3


def test_pages_are_joined_in_order_across_blocks(spark):
    pages = spark.range(1000).select(
        F.lit("b").alias("batch_id"), F.lit("f.pdf").alias("file"), F.col("id").cast("int").alias("page_no"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("p"), "id")).alias("text"),
    ).repartition(7)
    want = "\n".join("" if i % 3 == 0 else f"p{i}" for i in range(1000))
    assert assemble_pages(pages, ["batch_id", "file"]).first().text == want


def test_rejected_documents(spark):
    docs = spark.createDataFrame([("b", "a.pdf", None), ("b", "", "t"), ("b", "c.pdf", "")], "batch_id string, file string, text string")
    kept, rejected = split_rejected(docs)
    assert [r.file for r in kept.collect()] == ["c.pdf"]
    assert {(r.file, r.reason) for r in rejected.collect()} == {("a.pdf", "unreadable text"), ("", "no file name")}
    row = extract_invoices(kept).first()
    assert row.invoice_no == "C" and row.pallets is None


def uploads(spark, *rows):
    return spark.createDataFrame([(u, i, n, s) for u, i, n, s in rows], "upload_id string, ordinal int, filename string, length long")


def test_admission_rules(spark):
    ups = uploads(
        spark, ("empty", 0, "a.pdf", 0), ("badzip", 0, "a.zip", 5), ("slip", 0, "a.zip", 5), ("nopdf", 0, "a.ZIP", 5),
        ("zip", 0, "d/a.zip", 5), ("pdf", 0, "a.PDF", 5), ("txt", 0, "a.txt", 5), ("noext", 0, "zip", 5),
        ("several_empty", 0, "a.pdf", 5), ("several_empty", 1, "b.txt", 0), ("several_empty", 2, "c.txt", 1),
        ("several_zip", 1, "b.txt", 5), ("several_zip", 0, "a.zip", 5), ("many", 0, "a.pdf", 5), ("many", 1, "a.pdf", 6),
    )
    verdicts = spark.createDataFrame([
        ("badzip", False, False, 0), ("slip", True, True, 1), ("nopdf", True, False, 0), ("zip", True, False, 4),
        ("several_zip", True, False, 4),
    ], "archive string, is_zip boolean, escapes boolean, pdfs long")
    asked = ups.select("upload_id").union(spark.createDataFrame([("none",)], "u string")).distinct()
    got = {r.upload_id: (r.accepted, r.extracted_pdfs, r.reason) for r in admission.admit_uploads(ups, verdicts, asked).collect()}
    assert got == {
        "none": (False, 0, "No se recibieron archivos."), "empty": (False, 0, "Archivo vacío."),
        "badzip": (False, 0, "El fichero no es un ZIP válido."),
        "slip": (False, 0, "ZIP contiene rutas no permitidas (zip slip)."),
        "nopdf": (False, 0, "No se encontraron PDFs en el ZIP."), "zip": (True, 4, None), "pdf": (True, 1, None),
        "txt": (False, 0, "Tipo de archivo no permitido: .txt. Solo se aceptan .pdf o .zip"),
        "noext": (False, 0, "Tipo de archivo no permitido: . Solo se aceptan .pdf o .zip"),
        "several_empty": (False, 0, "Archivo vacío detectado: b.txt"),
        "several_zip": (False, 0, "Cuando se suben múltiples archivos, todos deben ser PDF. Archivo inválido: a.zip"),
        "many": (True, 2, None),
    }
    kept = {(r.upload_id, r.file): r.length for r in admission.last_of_each_name(ups.filter("upload_id = 'many'")).collect()}
    assert kept == {("many", "a.pdf"): 6}
    answers = admission.upload_responses(admission.admit_uploads(ups, verdicts), "/api/x/batches/", F.col("upload_id"))
    assert answers.filter("batch_id = 'zip'").first().status_url == "/api/x/batches/zip/status"


def test_precheck(spark):
    ups = uploads(spark, ("a", 0, "x.zip", 1), ("b", 0, "x.zip", 1), ("b", 1, "y.pdf", 1), ("c", 0, "x.pdf", 1), ("c", 1, "y.TXT", 1))
    got = {r.upload_id: r.reason for r in admission.precheck_selection(ups).collect()}
    assert got == {"a": None, "b": fv.MSG_SELECT_ZIP_AMONG_SEVERAL, "c": "Archivo no permitido: y.TXT. Solo se aceptan .pdf o .zip"}


def test_archives(spark):
    def packed(*names):
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w") as z:
            for n in names:
                z.writestr(n, n.encode())
        return target.getvalue()

    archives = spark.createDataFrame([
        ("ok", packed("a.pdf", "__MACOSX/a.pdf", "n.txt", "d/B.PDF", "../x.txt", "d/", "d/.DS_Store", ".pdf")),
        ("slip", packed("a.pdf", "../x.pdf")), ("abs", packed("/etc/x.pdf")), ("inner", packed("a/../b.pdf")),
        ("deep", packed("a/../../b.pdf")), ("none", packed()), ("bad", b"x"), ("null", None),
    ], "archive string, content binary")
    members = expand_archives(archives)
    assert {r.member_name: bytes(r.content) for r in archive_documents(members).filter("archive = 'ok'").collect()} == {
        "a.pdf": b"a.pdf", "d/B.PDF": b"d/B.PDF",
    }
    got = {r.archive: (r.is_zip, r.escapes, r.pdfs) for r in admission.archive_verdicts(members).collect()}
    assert got == {
        "ok": (True, False, 2), "slip": (True, True, 2), "abs": (True, True, 1), "inner": (True, False, 1),
        "deep": (True, True, 1), "none": (True, False, 0), "bad": (False, False, 0), "null": (False, False, 0),
    }


def test_readiness(spark):
    rows = [
        ("marker", "_DONE", 1), ("young", "a.pdf", 29), ("old", "a.pdf", 30), ("sub", "x/_DONE", 5), ("mixed", "a.pdf", 100),
        ("mixed", "b.txt", 3),
    ]
    found = spark.createDataFrame(rows, "batch_id string, rel_path string, age int").withColumn(
        "modificationTime", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("age"))
    )
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    ready = batches.batch_ready(batches.batch_activity(found), as_of, 30)
    assert {r.batch_id: r.ready for r in ready.collect()} == {"marker": True, "young": False, "old": True, "sub": False, "mixed": False}


def test_folder_scans(spark, tmp_path):
    for name in ["in/b.pdf", "in/a.pdf", "in/c.PDF", "in/n.txt", "in/sub/d.pdf"]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    folder, single = str(tmp_path / "in"), str(tmp_path / "in" / "sub" / "d.pdf")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in files.in_scan_order(df).collect()]
    assert names(files.scan_paths(spark, [single, folder, single])) == ["d.pdf", "a.pdf", "b.pdf", "c.PDF", "d.pdf"]
    assert names(files.scan_paths(spark, [folder], case_sensitive=True)) == ["a.pdf", "b.pdf"]
    inbox = files.scan_inbox(spark, str(tmp_path))
    assert {(r.batch_id, r.rel_path) for r in inbox.select("batch_id", "rel_path").collect()} == {
        ("in", "b.pdf"), ("in", "a.pdf"), ("in", "c.PDF"), ("in", "n.txt"), ("in", "sub/d.pdf"),
    }
    assert [r.batch_id for r in files.inbox_batches(files.scan_inbox(spark, str(tmp_path), pdf_only=True)).collect()] == ["in"]


def test_rank_over_many_ranges(spark):
    table = spark.range(5000).select("id", F.concat(F.lit("p/"), F.col("id") % 13).alias("path")).repartition(9)
    ranked = files.with_rank(table, F.split("path", "/"), F.col("id"))
    want = sorted((["p", str(i % 13)], i) for i in range(5000))
    assert [r.id for r in ranked.orderBy("ord").collect()] == [i for _, i in want]
    assert ranked.agg(F.min("ord"), F.max("ord")).first()[:] == (1, 5000)


def test_status_documents_and_views(spark, tmp_path):
    def put(batch, body):
        d = tmp_path / batch
        d.mkdir()
        (d / "status.json").write_text(body)

    put("one", json.dumps({"batch_id": "one", "state": "DONE", "stage": "DONE", "total_files": 2, "processed_files": 2,
                           "started_at": "2026-01-26T12:02:33.5Z", "updated_at": "2026-01-26T12:03:00Z",
                           "recipients": ["a@x"], "message": "m"}, indent=2))
    put("two", "{broken")
    good, bad = split_unreadable(read_status(spark, str(tmp_path)).cache())
    assert [r.batch_id for r in good.collect()] == ["one"] and bad.count() == 1
    asked = spark.createDataFrame([("one",), ("new",)], "batch_id string")
    shown = status.status_with_default(asked, good, F.lit("2026-02-01").cast("timestamp"))
    by_id = {r.batch_id: r for r in shown.collect()}
    assert by_id["one"].state == "DONE" and by_id["new"].state == "PENDING" and by_id["new"].recipients == []
    assert by_id["new"].message == "Sin estado aún (pendiente)." and by_id["new"].started_at is None


def test_latest_status_takes_the_last_write(spark):
    log = spark.createDataFrame([("b", 1, 1, "UPLOADED"), ("b", 3, 5, "DONE"), ("b", 3, 4, "PROCESSING"), ("b", 2, 9, "ERROR")],
                                "batch_id string, t long, seq long, state string").select(
        "batch_id", "state", "seq", F.timestamp_seconds("t").alias("updated_at"), F.timestamp_seconds("t").alias("started_at"))
    row = status.latest_status(log).first()
    assert row.state == "DONE" and row.started_at.timestamp() == 1
    assert {r.started_at.timestamp() for r in status.with_first_start(log).collect()} == {1}


def test_damaged_archives_and_members(spark):
    import io
    import zipfile

    from invoicefields.sources.archives import archive_documents, expand_archives

    def made(**files):
        stream = io.BytesIO()
        with zipfile.ZipFile(stream, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return stream.getvalue()

    bad_sum = bytearray(made(**{"a.pdf": "hello world"}))
    at = bytes(bad_sum).index(b"hello world")
    bad_sum[at] ^= 1
    cut = made(**{"b.pdf": "x" * 50})
    archives = spark.createDataFrame(
        [("sum", bytes(bad_sum)), ("cut", cut[:40] + cut[-22:]), ("escapes", made(**{"a.pdf": "1", "../x.pdf": "2"})),
         ("good", made(**{"a.pdf": "3", "n.txt": "4"})), ("none", None)], "archive string, content binary")
    members = expand_archives(archives, only_documents=True)
    rows = {(r.archive, r.member_name): r for r in members.collect()}
    assert rows["sum", "a.pdf"].content is None and "BadZipFile" in rows["sum", "a.pdf"].error
    assert bytes(rows["good", "a.pdf"].content) == b"3" and rows["good", "n.txt"].content is None
    assert not rows["none", None].is_zip
    assert sorted((r.archive, r.member_name) for r in archive_documents(members).collect() if r.archive != "cut") == [
        ("good", "a.pdf"), ("sum", "a.pdf")]


def test_paths_given_by_hand(spark, tmp_path):
    from invoicefields.sources.files import scan_paths

    for name in ("x.Pdf", "y.PDF", "z.txt"):
        (tmp_path / name).write_text(name)
    one = scan_paths(spark, [f"{tmp_path}/x.Pdf", f"{tmp_path}/y.PDF", f"{tmp_path}/z.txt"], case_sensitive=True)
    assert sorted(r.path.rpartition("/")[2] for r in one.collect()) == ["x.Pdf", "y.PDF"]
    assert scan_paths(spark, [str(tmp_path)]).count() == 1


def test_counts_beyond_bigint(spark):
    from pyspark.sql import functions as F

    from invoicefields import fixed_values as fv
    from invoicefields.functions.finders import int_after_label
    from invoicefields.operators.totals import int_sum

    texts = spark.createDataFrame([("Pallets: 12345678901234567891\nNombre de Palettes: 5",)], "t string")
    assert texts.select(int_after_label(F.col("t"), fv.PALLET_LABELS)).first()[0] == 12345678901234567891
    longer = texts.select(F.concat(F.lit("Pallets: 7"), F.repeat(F.lit("01"), F.lit(20)), F.lit(" Nombre de Palettes: 5")).alias("t"))
    assert longer.select(int_after_label(F.col("t"), fv.PALLET_LABELS)).first()[0] is None
    sums = spark.createDataFrame([("a", 9 * 10**18), ("a", 9 * 10**18), ("b", 3)], "k string, n long")
    assert dict(sums.groupBy("k").agg(int_sum("n")).collect()) == {"a": 18 * 10**18, "b": 3}
    wide = spark.createDataFrame([("a", "9" * 38), ("a", "9" * 38), ("b", "3"), ("c", None)], "k string, n string")
    wide = wide.withColumn("n", F.col("n").cast("decimal(38,0)"))
    assert dict(wide.groupBy("k").agg(int_sum("n")).collect()) == {"a": None, "b": 3, "c": 0}


def test_long_runs_before_a_marker_stay_cheap(spark):
    import random
    import re
    import time

    from pyspark.sql import functions as F

    from invoicefields.functions.finders import float_before_marker
    from invoicefields.functions.legacy import float_before_marker_v17

    docs = spark.createDataFrame([("1" * 200_000,), ("1 " * 100_000,)], "t string")
    start = time.perf_counter()
    docs.select(float_before_marker(F.col("t"), "KG"), float_before_marker_v17(F.col("t"), "KG")).collect()
    assert time.perf_counter() - start < 20
    rng = random.Random(3)
    noise = ["".join(rng.choice("17.,  KGx\n") for _ in range(14)) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in noise], "t string").select(
        "t", F.regexp_extract("t", r"(?iU)([0-9][0-9.,\s]+)\s*KG", 1).alias("p"),
        F.regexp_extract("t", r"(?iU)(?<![0-9.,\s])[.,\s]*+([0-9][0-9.,\s]++)KG", 1).alias("q"),
        F.regexp_extract("t", r"(?iU)([0-9][0-9.]+)\s*KG", 1).alias("r"),
        F.regexp_extract("t", r"(?iU)(?<![0-9.])\.*+([0-9][0-9.]++)\s*+KG", 1).alias("s")).collect()
    assert all(r.p == r.q and r.r == r.s for r in rows) and any(r.p for r in rows) and re


def test_amounts_are_rounded_once(spark):
    def total(*amounts):
        rows = spark.createDataFrame([("b", float(a)) for a in amounts], "batch_id string, x double")
        return rows.agg(totals.decimal_sum("x", 4).alias("t")).first().t

    assert total(0.00004999999999999) == "0.0000" and total(0.00005) == "0.0001"
    assert total(0.00002499999999999, 0.000025) == "0.0000" and total(0.000025, 0.000025) == "0.0001"
    assert total(1e27, 1234567890.125, 0.00005) == "1000000000000000001234567890.1251"
    assert total(999999999.9999999, 0.0000001) == "1000000000.0000"
    assert total(1e28) is None and total(6e27, 6e27) is None and total(float("nan")) is None


def test_report_is_in_order_of_paths(spark):
    from invoicefields.operators.extract import extract_invoices
    from invoicefields.operators.report import in_report_order

    docs = spark.createDataFrame([("b", f, "Boxes: 1") for f in ("b.pdf", "c/a.pdf", "a/z.pdf")],
                                 "batch_id string, file string, text string")
    rows = extract_invoices(docs.withColumn("path", F.col("file")), keep=("batch_id", "path"))
    assert [r.file for r in in_report_order(batch_report(rows)).collect()] == ["z.pdf", "b.pdf", "a.pdf", "TOTAL"]


def test_listing_takes_every_file(spark, tmp_path):
    import os

    from invoicefields.sources import listing
    from invoicefields.streaming.inbox import Folder

    root = tmp_path / "in box"
    for name, data in {"a/_x.pdf": b"x", "a/.y.pdf": b"y", "a/e.pdf": b"", "a/.h/z.PDF": b"z", "b/_DONE": b"", "b/ü q.pdf": b"\xff",
                       "stray.pdf": b"s"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "none").mkdir()
    os.utime(root / "a/_x.pdf", (1e9, 1e9))
    one = files.scan_inbox(spark, str(root)).collect()
    assert {(r.batch_id, r.rel_path, r.size) for r in one} == {
        ("a", "_x.pdf", 1), ("a", ".y.pdf", 1), ("a", "e.pdf", 0), ("a", ".h/z.PDF", 1), ("b", "_DONE", 0), ("b", "ü q.pdf", 1)}
    assert listing.list_inbox(spark, str(tmp_path / "missing")).count() == 0
    folder = Folder(f"file://{str(root).replace(' ', '%20')}")
    found = folder.files(listing.batch_folders(spark, str(root)))
    assert {(r.file, r.text) for r in folder.texts(found).collect()} == {
        ("_x.pdf", "x"), (".y.pdf", "y"), ("e.pdf", None), ("ü q.pdf", None)}

    # A file that has grown and one that was written again are new versions, an untouched one is not.
    known = spark.createDataFrame(one)
    (root / "a/_x.pdf").write_bytes(b"xx")
    os.utime(root / "a/e.pdf", (2e9, 2e9))
    again = listing.new_versions(files.scan_inbox(spark, str(root)), known)
    assert {(r.rel_path, r.size) for r in again.collect()} == {("_x.pdf", 2), ("e.pdf", 0)}
    # One that is gone since it was listed stays as a document without text.
    listed = spark.createDataFrame([("a", "e.pdf")], "batch_id string, rel_path string")
    (root / "a/e.pdf").unlink()
    assert {r.file: r.text for r in folder.texts(listed).collect()} == {"e.pdf": None}
