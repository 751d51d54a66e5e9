"""Streams with state in several triggers against their batch forms; archives read by ranges."""

import io
import os
import random
import shutil
import zipfile

from pyspark.sql import functions as F

from invoicefields.sources.archives import expand_archive_files, expand_archives
from invoicefields.streaming import inbox, transitions, waiting

HOUR = 3_600_000_000
CHANGES = "batch_id STRING, state STRING, stage STRING, updated_at TIMESTAMP, seq LONG"
STATES = [("UPLOADED", "WAITING"), ("PROCESSING", "RUNNING_EXTRACTOR"), ("PROCESSING", "SENDING_EMAIL"), ("DONE", "DONE"),
          ("ERROR", "ERROR"), ("PROCESSING", "odd")]


def times(df, *names):
    return df.withColumns({n: F.timestamp_micros(n) for n in names})


def run(stream, place, name):
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/{name}-checkpoint")
             .trigger(availableNow=True).start(f"{place}/{name}"))
    assert query.awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/{name}")


def test_findings_in_parts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows, seq = [], 0
    for hour in range(0, 400, 3):
        for batch in rng.sample(range(12), 4):
            state, stage = rng.choice(STATES)
            rows.append((f"b{batch}", state, stage, (hour + 1) * HOUR + rng.randrange(HOUR), seq))
            seq += 1
    ddl = CHANGES.replace("TIMESTAMP", "LONG")
    for part in range(4):  # four files, one for each trigger
        some = [r for r in rows if r[3] // (101 * HOUR) == part]
        times(spark.createDataFrame(some, ddl), "updated_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(transitions.findings(stream, 20 * 3600, "10 minutes"), str(tmp_path), "findings")
    until = max(r[3] for r in rows) - 600_000_000
    until -= until % 1000
    want = transitions.findings_of_table(times(spark.createDataFrame(rows, ddl), "updated_at"), 20 * 3600, until)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.finding for r in got.select("finding").distinct().collect()} == {transitions.UNKNOWN, transitions.STUCK}


def test_waiters_get_the_first_end_or_a_timeout(spark, tmp_path):
    asked = [(1, "a", 1 * HOUR), (2, "a", 3 * HOUR), (3, "b", 1 * HOUR), (4, "c", 2 * HOUR), (5, "a", 90 * HOUR)]
    ends = [("a", "DONE", 2 * HOUR), ("a", "ERROR", 4 * HOUR), ("b", "DONE", 40 * HOUR), ("z", "DONE", 91 * HOUR)]
    w = times(spark.createDataFrame(asked, "waiter LONG, batch_id STRING, asked_at LONG"), "asked_at")
    e = times(spark.createDataFrame(ends, "batch_id STRING, state STRING, ended_at LONG"), "ended_at")
    rows = {r.waiter: (r.answer, r.state) for r in waiting.waited(w, e, 10 * 3600, "1 hour").collect()}
    assert rows == {1: ("ended", "DONE"), 2: ("ended", "ERROR"), 3: ("timeout", None), 4: ("timeout", None), 5: ("timeout", None)}
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n, df in (("w", w), ("e", e))]
    got = run(waiting.waited(*streams, 10 * 3600, "1 hour"), str(tmp_path), "waited")
    answers = {r.waiter: (r.answer, r.state) for r in got.collect()}
    assert answers == {k: v for k, v in rows.items() if k != 5}  # the fifth may still get its answer


def test_landing_goes_on_from_its_checkpoint(spark, tmp_path):
    root = tmp_path / "in box"
    for b in range(3):
        (root / f"b{b}" / "ü").mkdir(parents=True)
        for i in range(20):
            (root / f"b{b}" / "ü" / f"{i}.pdf").write_text("x" * i)

    def listing():
        query = inbox.start_landing(spark, str(root), str(tmp_path / "land"), str(tmp_path / "check"), {"once": True}, 0.001)
        assert query.awaitTermination(120) and query.exception() is None
        landed = inbox.landing_table(spark, str(tmp_path / "land")).groupBy("epoch").count().collect()
        return {r.epoch: r["count"] for r in landed}, query.lastProgress.stateOperators[0].numRowsTotal

    assert listing()[0] == {0: 60}
    assert listing()[0] == {0: 60}
    (root / "b1" / "ü" / "3.pdf").write_text("longer than it was")
    os.utime(root / "b1" / "ü" / "4.pdf", (1e9, 1e9))
    (root / "b1" / "_DONE").write_text("")
    (root / "b2" / "ü" / "5.pdf").unlink()
    (root / "stray.txt").write_text("in no batch")
    landed, states = listing()
    assert landed == {0: 60, 2: 3}
    shutil.move(root / "b0", tmp_path / "b0")
    names = spark.range(20).select(F.concat(F.lit("ü/"), "id", F.lit(".pdf")).alias("rel_path"))
    shares = names.select(F.pmod(F.xxhash64("rel_path"), F.lit(inbox.SHARES_OF_BATCH))).distinct().count()
    assert listing() == ({0: 60, 2: 3}, states - shares)  # the states of a batch that is gone are gone
    shutil.move(tmp_path / "b0", root / "b0")
    assert listing()[0] == {0: 60, 2: 3, 4: 20}


def test_archives_by_ranges_equal_whole_ones(spark, tmp_path):
    big = os.urandom(300_000)
    kinds = {}
    for name, method in {"stored": 0, "deflated": 8, "bzip2": 12, "lzma": 14}.items():
        stream = io.BytesIO()
        with zipfile.ZipFile(stream, "w", method) as z:
            z.writestr("a/ü.pdf", big)
            z.writestr("b.txt", b"text " * 1000)
            z.writestr("d/", b"")
            z.writestr("e.PDF", b"")
            with z.open("forced.pdf", "w", force_zip64=True) as f:
                f.write(b"wide")
        kinds[name] = stream.getvalue()
    kinds["prefixed"] = b"leading bytes" + kinds["deflated"]
    kinds["damaged"] = kinds["stored"].replace(big[1000:1020], bytes(20), 1)
    kinds["cut"] = kinds["deflated"][:-40]
    kinds["empty"], kinds["none"], kinds["other"] = b"PK\x05\x06" + bytes(18), b"", b"no archive"
    for name, data in kinds.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    files = spark.createDataFrame([(n, f"file://{tmp_path}/{n}.zip") for n in [*kinds, "gone"]], "archive string, uri string")
    whole = expand_archives(spark.createDataFrame([(n, bytearray(d)) for n, d in kinds.items()], "archive string, content binary"))

    def as_rows(df):
        return sorted(repr((r.archive, r.is_zip, r.member_name, r.is_dir, r.size, r.content, (r.error or "")[:10], r.member_no))
                      for r in df.filter("archive != 'gone'").collect())

    got = expand_archive_files(files)
    assert as_rows(got) == as_rows(whole)
    assert [r.is_zip for r in got.filter("archive = 'gone'").collect()] == [False]
    only = expand_archive_files(files, only_documents=True).filter("archive = 'bzip2' AND content IS NOT NULL")
    assert {r.member_name for r in only.collect()} == {"a/ü.pdf", "e.PDF", "forced.pdf"}
