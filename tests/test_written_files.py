"""Reports under sorts that spill, roots of inboxes, batches that cannot be listed."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from invoicefields.plans import inbox_queries
from invoicefields.sources import archives, listing, storage

HERE = Path(__file__).resolve().parent


def test_report_order_survives_spills(tmp_path):
    done = subprocess.run([sys.executable, str(HERE / "spill_report.py"), str(tmp_path)], capture_output=True, text=True,
                          timeout=300, cwd=HERE.parent, env={**__import__("os").environ, "PYTHONPATH": str(HERE.parent)})
    assert "in order" in done.stdout, done.stderr[-3000:]


class Cluster:
    """A session as far as the rule for roots looks at it, but on several machines."""

    def __init__(self, spark):
        self._jvm, self._jsc = spark._jvm, spark._jsc
        self.sparkContext = type("Context", (), {"master": "spark://many:7077"})()


def test_roots_without_scheme_follow_the_default_file_system(spark, tmp_path):
    assert storage.shared_uri(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert storage.shared_uri(spark, "hdfs://name/in") == "hdfs://name/in"
    assert storage.shared_uri(spark, "file:///a%20b") == "file:///a%20b"
    for root in (str(tmp_path), "file:///data/in"):
        with pytest.raises(ValueError, match="one machine"):
            storage.shared_uri(Cluster(spark), root)


def test_the_shared_folder_serves_a_cluster(spark):
    """Roots below spark.checkpoint.dir were refused as folders of one machine."""
    shared = spark.conf.get("spark.checkpoint.dir")
    root = storage.new_folder(spark, "inbox")
    for given in (root, f"file://{root}"):
        assert storage.shared_uri(Cluster(spark), given) == f"file://{root}"
    for other in (f"{shared}/../in", f"{shared}-of-another", f"file://{shared}/x/../../in"):
        with pytest.raises(ValueError, match="one machine"):
            storage.shared_uri(Cluster(spark), other)


def test_files_are_written_where_they_are_listed(spark, tmp_path):
    """Tasks took the root as it was given, so each machine of a cluster could write to its own disk."""

    class Files:
        sparkSession = Cluster(spark)

        def select(self, *columns):
            raise AssertionError("written")

    with pytest.raises(ValueError, match="one machine"):
        inbox_queries.write_files(str(tmp_path), Files())


def test_a_batch_that_cannot_be_listed_is_a_row(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.pdf").write_text("x")
    (tmp_path / "bad").write_text("a file")
    batches = spark.createDataFrame([("good",), ("bad",), ("gone",)], "batch_id string")
    rows = {(r.batch_id, r.rel_path, r.error) for r in listing.list_or_fail(batches, str(tmp_path)).collect()}
    assert rows == {("good", "x.pdf", None), ("bad", None, "listing failed: NotADirectoryError")}
    assert [r.batch_id for r in listing.list_files(batches, str(tmp_path)).collect()] == ["good"]


class Given:
    """Rows that are mapped here and not by Spark."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return run(iter(self.batches))


def test_rows_leave_a_task_in_bounded_frames():
    """Archives of pages left their task as one frame for each 10,000 pages, whatever their size."""
    count, size = 1000, 50_000
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(count)), "html": ["x" * size] * count})
    frames = archives.map_rows(Given(pages), lambda p, html: iter([(str(p), html.encode())] * (p % 3)),
                               "archive STRING, content BINARY")
    seen = []
    for frame in frames:
        assert frame.num_rows <= archives.ROWS_PER_FRAME and frame.nbytes < archives.BYTES_PER_FRAME + 2 * size
        seen += frame.column("archive").to_pylist()
    assert seen == [str(p) for p in range(count) for _ in range(p % 3)]


def test_uploads_of_pages_are_made_one_by_one():
    rows = [row for p in range(7) for row in inbox_queries._packed(p, None if p == 4 else "text")]
    assert [(r[0], r[1], r[2].rsplit(".", 1)[1]) for r in rows] == [(str(p), 0, "pdf" if p == 5 else "zip") for p in range(7)]
    assert rows[4][3] == b"." and rows[5][3] == b"text." and rows[6][3] == b"" and b"0lder" in rows[1][3]
