"""Fill-in-the-middle: a text cut at two of its unit boundaries, its parts put in another order.

The boundaries of a text (0 and the end of every unit, in code points) are a compressed set of
integers: one container for each 2^16 consecutive offsets, of the kind that is smallest for what
it holds, and the cumulative cardinalities of the containers.  The k-th boundary is found by a
search in these and a select inside one container.  Both cuts are answered from the same set.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import map_blocks

#: Members of an array container at most: beyond, a bitmap of 2^16 bits is smaller.
ARRAY_LIMIT = 4096
WORDS = 1024
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id LONG, n LONG, form STRING, prefix_chars LONG, middle_chars LONG, output STRING"


@dataclasses.dataclass(frozen=True)
class Marks:
    """What stands before the parts.  No mark may begin as another one or itself ends."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __iter__(self):
        return iter((self.prefix, self.suffix, self.middle))


class ArrayContainer:
    """The low halves of the members, in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each possible member, and how many bits are set up to the end of each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(WORDS * 64, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, side="right"))
        left = k - (int(self.upto[word - 1]) if word else 0)
        value = int(self.words[word])
        for _ in range(left):
            value &= value - 1  # clears the lowest bit that is set
        return word * 64 + (value & -value).bit_length() - 1


class RunContainer:
    """Runs of consecutive members: their starts, and how many members there are up to each end."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.starts = low[starts].astype(np.uint16)
        self.upto = np.append(starts[1:], len(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[run]) + k - (int(self.upto[run - 1]) if run else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for these members (ascending, below 2^16, one at least)."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    other = min(2 * len(low), 8 * WORDS)
    if 4 * len(starts) < other:
        return RunContainer(low, starts)
    return ArrayContainer(low) if len(low) <= ARRAY_LIMIT else BitmapContainer(low)


class BoundarySet:
    """Ascending distinct offsets (below 2^31) under select."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        if high[0] == high[-1]:
            self.keys, ends = high[:1], np.array([len(offsets)])
        else:
            ends = np.append(np.flatnonzero(np.diff(high)) + 1, len(offsets))
            self.keys = high[ends - 1]
        self.upto = ends
        self.containers = [container(offsets[a:b] & 0xFFFF) for a, b in zip([0, *ends[:-1]], ends)]

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        left = k - (int(self.upto[at - 1]) if at else 0)
        return int(self.keys[at]) << 16 | self.containers[at].select(left)


def boundaries(text: str, unit: str) -> BoundarySet:
    """0 and the ends of all lines (each with its line feed) or of all characters."""
    if unit == "char":
        return BoundarySet(np.arange(len(text) + 1))
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    last = [] if len(ends) and ends[-1] == len(text) or not text else [len(text)]
    return BoundarySet(np.concatenate(([0], ends, last)).astype(np.int64))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32, from the seed and the id alone; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def arrange(text: str, doc_id: int | None, seed: int, rate: int, spm_share: int, marks: Marks,
            unit: str) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    cuts = boundaries(text, unit)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select(first), cuts.select(second)
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        out = f"{marks.suffix}{after}{marks.prefix}{before}{marks.middle}{middle}"
        return n, SPM, a, b - a, out
    return n, PSM, a, b - a, f"{marks.prefix}{before}{marks.suffix}{after}{marks.middle}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, marks: Marks = Marks(),
                   unit: str = "line") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row.

    ``n`` is the number of units.  ``rate`` of 100 texts are rearranged, ``spm_share`` of 100 of these
    with the suffix first.  A null text counts as empty; empty texts, and texts that hold a mark, stay
    as they are (form ``plain``, no lengths).  Rows that share an id are cut by the same draws, equal
    rows alike; other columns are ignored.  Narrow: no row meets another one."""
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")

    def work(block: pa.RecordBatch) -> dict:
        ids = block.column("doc_id").to_pylist()
        rows = [arrange(t or "", i, seed, rate, spm_share, marks, unit)
                for i, t in zip(ids, block.column("text").to_pylist())]
        n, form, before, middle, out = zip(*rows)
        return {"doc_id": block.column("doc_id"), "n": list(n), "form": list(form), "prefix_chars": list(before),
                "middle_chars": list(middle), "output": list(out)}

    return map_blocks(docs.select("doc_id", "text"), work, SCHEMA)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text before it was rearranged, read from the output and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, F.substr(rest, F.char_length(two) + F.lit(len(marks.middle) + 1))

    before, after, middle = parts(marks.prefix, marks.suffix)
    after2, before2, middle2 = parts(marks.suffix, marks.prefix)
    return (F.when(form == PSM, F.concat(before, middle, after)).when(form == SPM, F.concat(before2, middle2, after2))
            .otherwise(output))


def fim_report(docs: DataFrame) -> DataFrame:
    """Digests of the output and of the text that is rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out, form = F.col("output"), F.col("form")
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                       sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))
