"""Removal of passages that an earlier document has too, with a count-min prefilter.

A window is WINDOW consecutive words.  Its anchor is the smallest hash among the runs of RUN
words inside it, so equal windows have equal anchors, and a text has far fewer anchors than
windows.  A count-min sketch counts the documents of each anchor: each task counts its own part,
the parts are merged by ranges of cells, and of the merged sketch one bit per cell is kept: two
or more.  As a sketch never counts too little, a window that occurs in two documents always has
its bits set.  Only such windows are then grouped exactly (by 96 bits of hash), whatever the
sketch let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import Scratch, WordHashes, blocks, map_blocks, mix, utf8

WINDOW = 50
RUN = 25
#: Cells of the sketch for each anchor expected, and the bounds of their number (powers of two).
#: One bit of each cell is sent to the tasks: at most 128 MB.  Beyond that number more windows
#: pass the prefilter; none is lost.
CELLS_PER_ANCHOR = 8
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 30
#: Cells in one range, merged as one array.
RANGE = 1 << 20
#: Anchors that a task gathers before it hands them on.
ANCHORS_HELD = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.pair = (np.uint64(base), np.uint64(pow(base, -1, 2**64)))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            self.up, self.down = (np.concatenate((x, x * (x[-1:] * step)))
                                  for x, step in zip((self.up, self.down), self.pair))
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of all runs of consecutive words, from sums over the words before."""

    def __init__(self):
        self.powers = [Powers(b) for b in _BASES]

    def sums(self, h: np.ndarray, which: int = 0) -> np.ndarray:
        _, down = self.powers[which].upto(len(h) + 1)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * down[:len(h)], dtype=np.uint64)))

    def runs(self, sums: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        up, _ = self.powers[which].upto(len(sums))
        return mix((sums[length:] - sums[:-length]) * up[:len(sums) - length])


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def anchors(h: np.ndarray, rolling: Rolling, window: int, run: int) -> np.ndarray:
    """The anchor of each window of a text of at least ``window`` words."""
    return smallest(rolling.runs(rolling.sums(h), run), window - run + 1)


def cells_of(anchor: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each anchor."""
    low = np.uint64(cells - 1)
    return mix(anchor) & low, mix(anchor ^ np.uint64(_BASES[1])) & low


SPARSE = "part INT, once BINARY, more BINARY"


class Cells:
    """Counts of cells that a task gathers, handed on by ranges."""

    def __init__(self, cells: int):
        self.cells, self.range, self.held, self.size = cells, min(RANGE, cells), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.held.extend(cells_of(keys, self.cells))
        self.size += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """By range: the places counted once and those counted more often."""
        if not self.held:
            return
        value, count = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        part = (value // np.uint64(self.range)).astype(np.int32)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(edges[:-1], edges[1:]):
            place = (value[a:b] % np.uint64(self.range)).astype(np.uint32)
            many = count[a:b] > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[a]], pa.int32()), pa.array([place[~many].tobytes()], pa.binary()),
                 pa.array([place[many].tobytes()], pa.binary())], names=["part", "once", "more"])


def sketch_size(keys: float, most: int) -> int:
    cells = min(LEAST_CELLS, most)
    while cells < most and cells < CELLS_PER_ANCHOR * keys:
        cells *= 2
    return cells


def merged_bits(parts: DataFrame, cells: int, least: int) -> np.ndarray:
    """One bit per cell: counted ``least`` (1 or 2) times or more by all tasks together."""
    size = min(RANGE, cells)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, more in zip(*[c.to_pylist() for c in batch.columns]):
                own = counts.setdefault(part, np.zeros(size, np.uint8))
                at = np.frombuffer(once, np.uint32)
                own[at] = np.minimum(own[at] + 1, 2)
                own[np.frombuffer(more, np.uint32)] = 2
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.packbits(own >= least).tobytes()], pa.binary())],
                names=["part", "bits"])

    bits = np.zeros(cells // 8, np.uint8)
    for part, some in parts.repartition("part").mapInArrow(merge, "part INT, bits BINARY").toLocalIterator():
        bits[part * (size // 8):(part + 1) * (size // 8)] = np.frombuffer(some, np.uint8)
    return bits


def has_bits(keys: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Which keys have the bits of both of their cells."""
    one, two = cells_of(keys, cells)
    seven, three = np.uint64(7), np.uint64(3)
    return ((bits[one >> three] >> (seven - (one & seven)).astype(np.uint8))
            & (bits[two >> three] >> (seven - (two & seven)).astype(np.uint8)) & 1).astype(bool)


def without_copies(docs: DataFrame, scratch: Scratch, most_cells: int) -> tuple[DataFrame, DataFrame, Broadcast]:
    """The later copies of texts (``doc_id, digest``); the first ones of texts that may have copies
    (``doc_id, text, digest``, stored); and bits that tell a task which texts may have copies."""
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _digest().alias("digest"))
    groups = (named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .filter("first < last").select("digest", "first"))
    groups = scratch.save(groups)
    cells = sketch_size(groups.count(), most_cells)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(cells)
        for batch in batches:
            own.add(_key_of(batch.column("digest").to_pylist()))
            if own.size >= ANCHORS_HELD:
                yield from own.rows()
        yield from own.rows()

    bits = docs.sparkSession.sparkContext.broadcast(
        (merged_bits(groups.select("digest").mapInArrow(gather, SPARSE), cells, 1), cells))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(has_bits(_key_of(block.column("digest").to_pylist()), *bits.value)))

    firsts = (named.mapInArrow(maybe, named.schema).join(groups, "digest", "left")
              .filter("first IS NULL OR first = doc_id").select("doc_id", "text", "digest"))
    later = named.select("doc_id", "digest").join(groups, "digest").filter("doc_id > first").select("doc_id", "digest")
    return later, scratch.save(firsts), bits


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _key_of(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)


def _mark(digest: Column) -> Column:
    """The first 16 bits of a digest."""
    return F.conv(F.substring(F.hex(digest), 1, 4), 16, 10).cast("long")


def find_repeats(docs: DataFrame, window: int = WINDOW, run: int | None = None,
                 most_cells: int = MOST_CELLS) -> DataFrame:
    """``doc_id, text, starts, copy`` for every row: ``starts`` are the numbers of the first words of
    the windows that also start in a document with a smaller id, null if there is none; ``copy``
    is true where the whole text is such a document's, and all windows are meant.

    A null or empty text and one of fewer than ``window`` words has no window.  Rows that share an
    id do not count as each other's earlier document, and each has its own starts.  A row without an
    id neither loses words nor is an earlier document.  Windows are judged on the texts as given.
    Other columns are ignored.
    """
    own = Own(window)

    def judge(block: pa.RecordBatch) -> dict:
        found = [own.starts(*row) for row in zip(utf8(block), *(block.column(c).to_pylist() for c in ("starts", "checks")))]
        return {"doc_id": block.column("doc_id"), "text": block.column("text"), "starts": found, "copy": block.column("copy")}

    return map_blocks(marked(docs, window, run, most_cells), judge, "doc_id LONG, text STRING, starts ARRAY<INT>, copy BOOLEAN")


class Own:
    """Which of the starts found for an id are those of one of its rows."""

    def __init__(self, window: int):
        self.window, self.rolling, self.hashes = window, Rolling(), WordHashes()

    def starts(self, text: bytes | None, starts: list[int] | None, checks: list[int] | None) -> list[int] | None:
        if checks is None or starts is None:
            return starts
        words = text.split() if text else []
        if len(words) < self.window:
            return None
        hashes = self.rolling.runs(self.rolling.sums(self.hashes.of(words)), self.window).view(np.int64)
        return [s for s, c in zip(starts, checks) if s < len(hashes) and hashes[s] == c] or None


def marked(docs: DataFrame, window: int, run: int | None, most_cells: int) -> DataFrame:
    """``doc_id, text, starts, checks, copy`` for every row.  Starts are found by id and 16 bits of the text.
    Where different texts share an id, ``checks`` has the hashes of the windows at the starts, by which a
    row knows its own; a copy is known by its whole digest."""
    run = run or max(1, window // 2)
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    later, firsts, copied = without_copies(docs, scratch, most_cells)
    single = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _digest().alias("digest"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch_size(size / 6 * 2 / (window - run + 2), most_cells)
    rolling, hashes = Rolling(), WordHashes()

    def texts(block: pa.RecordBatch, skip: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """Number, key and word hashes of the rows that take part and have a window."""
        keys = _key_of(block.column("digest").to_pylist())
        out = has_bits(keys, *copied.value) if skip else np.zeros(len(keys), bool)
        for doc_id, key, gone, text in zip(block.column("doc_id").to_pylist(), keys.tolist(), out.tolist(),
                                           utf8(block)):
            words = [] if gone else text.split()
            if len(words) >= window:
                yield doc_id, key >> 48, hashes.of(words)

    def counter(skip: bool):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Cells(cells)
            for block in blocks(batches):
                for _, _, h in texts(block, skip):
                    own.add(np.unique(anchors(h, rolling, window, run)))
                if own.size >= ANCHORS_HELD:
                    yield from own.rows()
            yield from own.rows()

        return count

    counted = single.mapInArrow(counter(True), SPARSE).unionAll(firsts.mapInArrow(counter(False), SPARSE))
    sent = spark.sparkContext.broadcast(merged_bits(counted, cells, 2))

    def emitter(skip: bool):
        def emit(block: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {"h1": [], "h2": [], "doc_id": [], "place": []}
            for doc_id, key, h in texts(block, skip):
                sums = rolling.sums(h)
                anchor = smallest(rolling.runs(sums, run), window - run + 1)
                at = np.flatnonzero(has_bits(anchor, sent.value, cells))
                if len(at):
                    out["h1"].append(rolling.runs(sums, window)[at].view(np.int64))
                    other = rolling.runs(rolling.sums(h, 1), window, 1)[at]
                    out["h2"].append((other >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    out["doc_id"].append(np.full(len(at), doc_id, np.int64))
                    out["place"].append(at + (key << 32))
            return {k: np.concatenate(v) for k, v in out.items()} if out["h1"] else None

        return emit

    # ``place``: the number of the first word, above it 16 bits of the text, which tell rows that
    # share an id apart
    ddl = "h1 LONG, h2 INT, doc_id LONG, place LONG"
    windows = map_blocks(single, emitter(True), ddl).unionAll(map_blocks(firsts, emitter(False), ddl))
    # Stored, so that the join below has plain exchanges, which can be split where a window is hot.
    groups = scratch.save(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                          .filter("first < last").select("h1", "h2", "first"))
    starts = (windows.join(groups, ["h1", "h2"]).filter("doc_id > first")
              .groupBy("doc_id", F.shiftright("place", 32).alias("key"))
              .agg(F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"), "h1")).alias("found")))
    shared = (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _digest().alias("digest"))
              .groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
              .filter("least < most").select("doc_id", F.lit(True).alias("shared")))
    copies = later.groupBy("doc_id", _mark(F.col("digest")).alias("key")).agg(F.collect_set("digest").alias("copies"))
    marks = (starts.join(copies, ["doc_id", "key"], "full_outer").join(shared, "doc_id", "left")
             .select("doc_id", "key", F.col("found.place").alias("starts"),
                     F.when(F.col("shared"), F.col("found.h1")).alias("checks"), "copies"))
    out = (docs.select("doc_id", "text", _digest().alias("digest")).withColumn("key", _mark(F.col("digest")))
           .join(marks, ["doc_id", "key"], "left")
           .select("doc_id", "text", "starts", "checks",
                   F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False)).alias("copy")))
    out._scratch = scratch
    return out


def removed(starts: list[int] | None, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words are covered by a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    if starts:
        at = np.unique(np.asarray(starts))
        steps[at] += 1
        steps[at + window] -= 1
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_cells: int = MOST_CELLS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that stay, joined by blanks."""
    own = Own(window)

    def cut(block: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, starts, checks, copy in zip(utf8(block), *(block.column(c).to_pylist() for c in ("starts", "checks", "copy"))):
            words = text.split() if text else []
            gone = removed(own.starts(text, starts, checks), len(words), window)
            if copy and len(words) >= window:
                gone[:] = True
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any()
                               else b" ".join(words))
        return {"doc_id": block.column("doc_id"), **out, "kept": pa.array(out["kept"], pa.binary())}

    return map_blocks(marked(docs, window, None, most_cells), cut, "doc_id LONG, n_words LONG, n_removed LONG, kept STRING")


def removal_report(docs: DataFrame, window: int = WINDOW, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per row: words, removed words, and the digest of what is kept."""
    return remove_repeats(docs, window, most_cells).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
