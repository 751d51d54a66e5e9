"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every sequence of words that occurs in an item.  Words of a training text
are streamed through it, and at each word it knows the longest sequence ending there that an
item has too.  Runs of words that no item uses reset it, so only runs of known words that are
long enough for a window are walked at all, which changes nothing in the result.

Test items are read in blocks of a bounded number of words.  A block's automaton is sent to the
tasks; with more blocks, texts are scanned once for each, and what was found is merged per row.
Texts are cut by the merged spans, so a result does not depend on the size of the blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import Scratch, map_blocks, rewrite, utf8

WINDOW = 10
#: Words of test items in one automaton, which has at most twice as many states.
BLOCK_WORDS = 100_000
#: A text of which this share of words is test material is dropped, not cut.
MOST_COVERED = 0.5
#: Bytes that make words; A-Z count as a-z, all others part words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Automaton:
    """States of a generalised suffix automaton over word numbers, and the items of its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        coded = []
        for name, words in items:
            code = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            if code:
                coded.append((name, code))
                self.shortest = min(self.shortest, len(code))
                last = 0
                for c in code:
                    last = self._extend(last, c)
        #: By state: items that have the window, or that are this text as a whole.
        self.windows: dict[int, set[str]] = {}
        self.wholes: dict[int, set[str]] = {}
        for name, code in coded:
            state = 0
            for i, c in enumerate(code):
                state = self.next[state][c]
                if i + 1 >= window:
                    state = self._suffix(state)
                    self.windows.setdefault(state, set()).add(name)
            if len(code) < window:
                self.wholes.setdefault(state, set()).add(name)
        #: The nearest state at or above each that is a whole short item; -1 without one.
        self.whole_above = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.whole_above[state] = state if state in self.wholes else self.whole_above[up] if up >= 0 else -1

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, c: int, target: int) -> int:
        """The part of ``target`` that is reached from ``state`` by its longest text."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        target = self.next[last].get(c)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, c, target)
        end, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = end
            state = self.link[state]
        if state >= 0:
            target = self.next[state][c]
            exact = self.length[target] == self.length[state] + 1
            self.link[end] = target if exact else self._split(state, c, target)
        return end

    def _suffix(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit stretches of word numbers (end exclusive), items with windows there, and the
        longest match in words."""
        if len(words) < self.shortest or not self.numbers:
            return [], set(), 0
        get = self.numbers.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        most = 0
        for start, stop in known.reshape(-1, 2).tolist():
            if stop - start >= self.shortest:
                most = max(most, self._walk(codes[start:stop].tolist(), start, spans, items))
        return merged(spans), items, most

    def _walk(self, codes: list[int], offset: int, spans: list, items: set[str]) -> int:
        state = matched = most = 0
        for i, c in enumerate(codes, offset + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= self.shortest:
                most = max(most, matched)
                if matched >= self.window:
                    spans.append((i - self.window, i))
                    items |= self.windows[self._suffix(state)]
                whole = self.whole_above[state]
                if whole == state and matched < self.length[state]:
                    whole = self.whole_above[self.link[state]]
                while whole > 0:
                    spans.append((i - self.length[whole], i))
                    items |= self.wholes[whole]
                    whole = self.whole_above[self.link[whole]]
        return most


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap, as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


Items = list[tuple[str, list[bytes]]]


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks, read one partition of items at a time; one empty block without items."""
    items, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for name, text in rows.toLocalIterator():
        words = words_of(text.encode() if text else None)
        if items and held + len(words) > block_words:
            yield items
            items, held = [], 0
        items.append((name, words))
        held += len(words)
    yield items


HITS = "row LONG, longest LONG, spans ARRAY<ARRAY<INT>>, items ARRAY<STRING>"


def hits_of_blocks(rows: DataFrame, blocks: Iterable[Items], window: int, scratch: Scratch) -> DataFrame:
    """``row, longest, spans, items`` of the rows (``row, text``) with a match in any block.

    What a block finds is stored before the next one is made, and its automaton is freed, so only
    one is held at a time.  ``spans`` and ``items`` of the blocks stand beside each other."""
    parts = []
    for block in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(Automaton(block, window))

        def scan(batch: pa.RecordBatch, sent=sent) -> dict:
            out = {k: [] for k in ("row", "longest", "spans", "items")}
            for row, text in zip(batch.column("row").to_pylist(), utf8(batch)):
                spans, items, most = sent.value.search(words_of(text))
                if most:
                    for k, v in zip(out, (row, most, spans, sorted(items))):
                        out[k].append(v)
            return out

        parts.append(scratch.save(map_blocks(rows.select("row", "text"), scan, HITS)))
        sent.destroy()
    merged_rows = scratch.save(together(parts).groupBy("row").agg(
        F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items")))
    scratch.free(*parts)
    return merged_rows


def together(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of one schema, as one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._stored_at for t in tables])


FOUND = "doc_id LONG, text STRING, n_words LONG, longest LONG, spans ARRAY<ARRAY<INT>>, items ARRAY<STRING>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text, n_words, longest, spans, items`` for every row of ``docs``.

    ``spans`` are stretches of words inside any occurrence of a window, ``items`` the ids (as
    strings, sorted) of items with an occurring window, ``longest`` the longest match in words.
    A window is ``window`` consecutive words of an item; an item with fewer words is one window.
    A null or wordless text has no words and no spans; a null or wordless item has no window;
    without items nothing is found.  Repeated rows are judged one by one; other columns are
    ignored.  An item whose id is null counts under the empty name.
    """
    blocks = item_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(first, window))

        def scan(block: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("n_words", "longest", "spans", "items")}
            for text in utf8(block):
                words = words_of(text)
                spans, names, most = sent.value.search(words)
                for k, v in zip(out, (len(words), most, spans, sorted(names))):
                    out[k].append(v)
            return {"doc_id": block.column("doc_id"), "text": block.column("text"), **out}

        return map_blocks(docs.select("doc_id", "text"), scan, FOUND)
    scratch = Scratch(docs.sparkSession, "contamination")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    hits = hits_of_blocks(rows, chain([first, second], blocks), window, scratch)

    def gather(block: pa.RecordBatch) -> dict:
        spans, items = block.column("spans").to_pylist(), block.column("items").to_pylist()
        return {"doc_id": block.column("doc_id"), "text": block.column("text"),
                "n_words": [len(words_of(t)) for t in utf8(block)],
                "longest": [n or 0 for n in block.column("longest").to_pylist()],
                "spans": [merged([*map(tuple, s or [])]) for s in spans],
                "items": [sorted(set(i or [])) for i in items]}

    out = map_blocks(rows.join(hits, "row", "left"), gather, FOUND)
    out._scratch = scratch
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: words, hit words, items, and whether there is any hit."""
    found = find_contamination(docs, benchmark)

    def digest(block: pa.RecordBatch) -> dict:
        spans, items = block.column("spans").to_pylist(), block.column("items").to_pylist()
        n_hit = [sum(b - a for a, b in s) for s in spans]
        return {
            "doc_id": block.column("doc_id"), "n_words": block.column("n_words"), "n_hit": n_hit,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in n_hit], "longest_match": block.column("longest"),
        }

    return map_blocks(found, digest, "doc_id LONG, n_words LONG, n_hit LONG, n_items LONG, items_sha256 STRING, "
                                     "contaminated BOOLEAN, longest_match LONG")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  most_covered: float = MOST_COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without test material: spans of ``window`` words or more (whole short items too)
    are cut out, and a row of which more than ``most_covered`` of the words is such material goes.

    A cut leaves a line break.  If the words around it make a new window, that is cut as well.
    Null and empty texts stay, as do rows without a hit, unchanged.  The blocks of items make no
    difference: a cut takes the spans of all of them, in the text that all of them have read."""
    blocks = item_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        return decontaminate_in_rounds(docs, benchmark, chain([first, second], blocks), window, most_covered, block_words)
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(first, window))
    return rewrite(docs, lambda texts: [without_hits(t, sent.value, most_covered) for t in texts])


def decontaminate_in_rounds(docs: DataFrame, benchmark: DataFrame, blocks: Iterable[Items], window: int,
                            most_covered: float, block_words: int) -> DataFrame:
    """``decontaminate`` with more than one block: each round reads the rows that the round before
    has cut (at first all) with every block, then cuts them once, until nothing is hit."""
    scratch, cuts = Scratch(docs.sparkSession, "decontamination"), []
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    left = rows.select("row", F.col("doc.text").alias("text"), F.lit(None).cast("long").alias("total"),
                       F.lit(0).cast("long").alias("gone"))

    def cut(block: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("row", "text", "total", "gone", "round")}
        for row, text, total, gone, spans, turn in zip(*[block.column(c).to_pylist() for c in (
                "row", "text", "total", "gone", "spans", "round")]):
            spans = merged([*map(tuple, spans)])
            total = len(words_of(text.encode())) if total is None else total
            gone += sum(b - a for a, b in spans)
            text = "" if gone > most_covered * total else cut_out(text, spans)
            for k, v in zip(out, (row, text, total, gone, turn)):
                out[k].append(v)
        return out

    while True:
        hits = hits_of_blocks(left, blocks, window, scratch)
        hit = left.join(hits.filter("size(spans) > 0"), "row").withColumn("round", F.lit(len(cuts)))
        cuts.append(scratch.save(map_blocks(hit, cut, "row LONG, text STRING, total LONG, gone LONG, round INT")))
        scratch.free(hits)
        left = cuts[-1].filter("text != ''").select("row", "text", "total", "gone")
        if left.isEmpty():
            break
        blocks = item_blocks(benchmark, block_words)
    last = together(cuts).groupBy("row").agg(F.max_by("text", "round").alias("new"))
    # A row that lost all of its text is no document any more.
    joined = rows.join(last, "row", "left").filter("new IS NULL OR new != ''")
    changed = {"text": F.col("new"), "n_chars": F.char_length("new")}
    out = joined.select(*[
        (F.coalesce(changed[f.name].cast(f.dataType), old) if f.name in changed else old).alias(f.name)
        for f in docs.schema for old in [F.col(f"doc.`{f.name}`")]])
    out._scratch = scratch
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a line break in place of each stretch of words."""
    places, parts, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for start, stop in spans:
        parts.append(text[at:places[start][0]])
        at = places[stop - 1][1]
    return "\n".join([*parts, text[at:]])


def without_hits(text: str | None, machine: Automaton, most_covered: float) -> str | None:
    """The text without hit spans; empty if too much of it is hit."""
    if not text:
        return text
    words = words_of(text.encode())
    total, gone = len(words), 0
    while True:
        spans, _, _ = machine.search(words)
        if not spans:
            return text
        gone += sum(b - a for a, b in spans)
        if gone > most_covered * total:
            return ""
        text = cut_out(text, spans)
        words = words_of(text.encode())
