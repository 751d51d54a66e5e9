"""Archives into rows, one per member."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from invoicefields import schemas
from invoicefields.operators.admission import archive_verdicts, is_admissible_member

ROWS_PER_FRAME = 256
BYTES_PER_FRAME = 8 << 20


def expand_archives(archives: DataFrame, with_content: bool = True, only_documents: bool = False) -> DataFrame:
    """``archive, content`` into member rows.

    What is no ZIP gives one row with ``is_zip`` false, as does an archive whose directory is
    damaged; an empty ZIP gives one row without a name.  A member that cannot be unpacked
    (checksum, encryption, method) has no content and says why in ``error``.
    ``member_no`` counts in the order of the archive.
    Members leave the task in frames of bounded size; without ``with_content`` only the
    directory of the archive is read, with ``only_documents`` only documents are unpacked.
    """
    def unpacked(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        wanted = with_content and not info.is_dir() and (not only_documents or _may_be_document(info.filename))
        try:
            return (archive.read(info) if wanted else None), None
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, OSError,
                EOFError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    def members(name: str, data: bytes) -> Iterator[tuple]:
        stream = io.BytesIO(data or b"")
        try:
            archive = zipfile.ZipFile(stream) if zipfile.is_zipfile(stream) else None
        except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):
            archive = None
        if archive is None:
            yield (name, False, None, None, None, None, None, None)
            return
        with archive:
            listing = archive.infolist()
            if not listing:
                yield (name, True, None, None, None, None, None, None)
            for no, info in enumerate(listing):
                yield (name, True, info.filename, info.is_dir(), info.file_size, *unpacked(archive, info), no)

    return map_rows(archives.select(F.col("archive").cast("string"), "content"), members, schemas.MEMBERS)


def map_rows(given: DataFrame, make: Callable[..., Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows of the schema ``ddl`` that ``make`` gives for each row, one after the other: a task holds an
    Arrow batch as it came, the values of one row, and outgoing rows of bounded number and size."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                for row in make(*[column[i].as_py() for column in batch.columns]):
                    rows.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes | str))
                    if len(rows) >= ROWS_PER_FRAME or held >= BYTES_PER_FRAME:
                        yield _as_batch(rows, arrow)
                        rows, held = [], 0
            if rows:
                yield _as_batch(rows, arrow)

    return given.mapInArrow(run, schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


#: Where a member lies in its archive, and how it is packed there.
DIRECTORY = (
    "archive STRING, uri STRING, is_zip BOOLEAN, member_name STRING, is_dir BOOLEAN, size BIGINT, member_no INT, "
    "offset BIGINT, packed BIGINT, method INT, crc BIGINT, encrypted BOOLEAN"
)
LOCAL_HEADER = struct.Struct("<4s22xHH")  # fixed value: the signature, and how long name and extra field are


class _Seekable(io.RawIOBase):
    """A file of any storage as ``zipfile`` wants it: a place before its begin is an OSError."""

    def __init__(self, data):
        self.data = data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.data.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0 if whence == 0 else self.data.tell() if whence == 1 else self.data.size())
        if place < 0:
            raise OSError("a place before the begin of the file")
        return self.data.seek(place)

    def readinto(self, into) -> int:
        got = self.data.read(len(into))
        into[:len(got)] = got
        return len(got)


def archive_directories(archives: DataFrame) -> DataFrame:
    """``archive, uri`` into one row for each member, read from the directory at the archive's end alone;
    rows for what is no archive, or an empty one, as in ``expand_archives``."""
    columns = [part.split()[0] for part in DIRECTORY.split(", ")]

    def members(name: str, uri: str) -> Iterator[tuple]:
        nothing = (None,) * 9
        try:
            files, place = fs.FileSystem.from_uri(uri)
            with files.open_input_file(place) as opened, io.BufferedReader(_Seekable(opened)) as data:
                archive = zipfile.ZipFile(data) if zipfile.is_zipfile(data) else None
                listing = archive.infolist() if archive else None
        except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):
            listing = None
        if not listing:
            yield (name, uri, listing is not None, *nothing)
            return
        for no, info in enumerate(listing):
            yield (name, uri, True, info.filename, info.is_dir(), info.file_size, no, info.header_offset,
                   info.compress_size, info.compress_type, info.CRC, bool(info.flag_bits & 1))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, uri in zip(frame["archive"], frame["uri"]):
                rows = []
                for row in members(name, uri):
                    rows.append(row)
                    if len(rows) >= ROWS_PER_FRAME:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return archives.select("archive", "uri").mapInPandas(look, DIRECTORY)


def expand_archive_files(archives: DataFrame, only_documents: bool = False) -> DataFrame:
    """As ``expand_archives``, from files: ``archive, uri``.

    The directories are read first; then members are dealt over all tasks, and each is read from its
    range of the file.  An archive is never one value and its members are not one task's; the largest
    value is one member."""
    listed = archive_directories(archives)
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, 1)
    columns = ["archive", "is_zip", "member_name", "is_dir", "size", "content", "error", "member_no"]

    def unpacked(row) -> tuple[bytes | None, str | None]:
        if row.member_name is None or row.is_dir or (only_documents and not _may_be_document(row.member_name)):
            return None, None
        try:
            return _member(row), None
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, OSError,
                EOFError, ValueError, struct.error) as e:
            return None, f"{type(e).__name__}: {e}"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                content, error = unpacked(row)
                rows.append((row.archive, row.is_zip, row.member_name, row.is_dir, row.size, content, error, row.member_no))
                held += len(content or b"")
                if len(rows) >= ROWS_PER_FRAME or held >= BYTES_PER_FRAME:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return listed.repartition(tasks, "archive", "member_no").mapInPandas(read, schemas.MEMBERS)


def _member(row) -> bytes:
    """The content of a member, from its range of the file."""
    if row.encrypted:
        raise RuntimeError(f"File {row.member_name!r} is encrypted, password required for extraction")
    files, place = fs.FileSystem.from_uri(row.uri)
    with files.open_input_file(place) as data:
        if row.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
            with zipfile.ZipFile(io.BufferedReader(_Seekable(data))) as archive:  # rare: read through the directory again
                return archive.read(archive.infolist()[int(row.member_no)])
        data.seek(int(row.offset))
        signature, name_size, extra_size = LOCAL_HEADER.unpack(data.read(LOCAL_HEADER.size))
        if signature != b"PK\x03\x04":
            raise zipfile.BadZipFile("Bad magic number for file header")
        data.seek(name_size + extra_size, 1)
        packed = data.read(int(row.packed))
    if len(packed) < row.packed:
        raise EOFError("the archive ends within a member")
    if row.method == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(packed, -15)
    else:
        content = bz2.decompress(packed) if row.method == zipfile.ZIP_BZIP2 else packed
    if zlib.crc32(content) != row.crc or len(content) != row.size:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {row.member_name!r}")
    return content


def _may_be_document(name: str) -> bool:
    """True for all that ``is_admissible_member`` takes, so nothing it takes is left packed."""
    return name.lower().endswith(".pdf")


def archive_documents(members: DataFrame) -> DataFrame:
    """The members that count as documents, of archives of which none leaves its folder.  A document
    without content (``error``) stays, to be reported as rejected."""
    admissible = members.filter(is_admissible_member(F.col("member_name"), F.col("is_dir")))
    escaping = archive_verdicts(members).filter("escapes").select("archive")
    return admissible.join(escaping, "archive", "left_anti").select(*members.columns)
