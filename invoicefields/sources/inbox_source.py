"""The inbox as a streaming source: every trigger takes one listing.

An offset is the number of a listing, the moment at which it was asked for.  Tasks share the
folders of the inbox among themselves by a hash of their names and list them; no name passes the
driver.  A listing says what is there now; ``streaming.inbox.fresh_versions`` keeps from it what
it has not seen.  If a trigger is repeated, it lists again and is compared with the same state as
before, so no version is landed twice and none is lost.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from invoicefields.sources.listing import LISTED
from invoicefields.sources.storage import shared_uri

NAME = "invoicefields_inbox"
ROWS_PER_BATCH = 4096
_ARROW = pa.schema([("batch_id", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])


@dataclass
class Share(InputPartition):
    """The folders whose hash leaves ``number`` of ``of``."""

    number: int
    of: int


class InboxSource(DataSource):
    """Options: ``root`` (a URI that all machines share), ``shares`` (tasks that list, 8 unless said)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> InboxReader:
        return InboxReader(self.options["root"], int(self.options.get("shares", "8")))


class InboxReader(DataSourceStreamReader):
    def __init__(self, root: str, shares: int):
        self.root, self.shares = root, shares

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [] if start == end else [Share(i, self.shares) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(self.root)
        base = base.rstrip("/")
        rows: list[tuple] = []
        for top in files.get_file_info(fs.FileSelector(base or "/", allow_not_found=True)):
            mine = zlib.crc32(top.base_name.encode("utf-8", "surrogateescape")) % partition.of == partition.number
            if not mine or top.type != fs.FileType.Directory:
                continue
            try:
                found = files.get_file_info(fs.FileSelector(top.path, allow_not_found=True, recursive=True))
            except OSError:
                continue  # this listing goes on without the folder; the next one asks again
            cut = len(top.path) + 1
            rows += [(top.base_name, f.path[cut:], f.size, f.mtime_ns // 1000) for f in found if f.type == fs.FileType.File]
            while len(rows) >= ROWS_PER_BATCH:
                yield _batch(rows[:ROWS_PER_BATCH])
                rows = rows[ROWS_PER_BATCH:]
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        """Nothing is held for listings that are done."""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def listing_stream(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """``batch_id, rel_path, size, changed`` of all files, once for each trigger."""
    spark.dataSource.register(InboxSource)
    wanted = shares or spark.sparkContext.defaultParallelism
    return spark.readStream.format(NAME).option("root", shared_uri(spark, root)).option("shares", str(wanted)).load()
