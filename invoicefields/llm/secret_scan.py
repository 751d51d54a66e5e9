"""Secrets: fixed patterns, and a battery of randomness tests for long tokens.

A candidate is a token of at least LEAST characters whose encoding is inferred from its alphabet.
A chi-squared test of uniform symbols, a runs test and a serial-correlation test give its p-value
under "these symbols were drawn at random" (the smallest of the three, times three).  Longer
tokens give sharper tests, so candidates compete within their encoding and length class only:
Benjamini-Hochberg over all candidates of a class picks those that are not random, at a false
discovery rate of FDR, so that at most that share of what is discarded was random.  Candidates
that are not discarded are secrets.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import LOWER, map_blocks, rewrite, utf8

KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
#: Shortest candidate, and how finely p-values are counted: bins for each factor of ten.
LEAST, BINS_PER_TEN, MOST_BINS = 24, 20, 600
#: Longest token whose symbol counts are judged by their exact distribution, and the chances below which
#: its transform is only rounding; half the length up to which runs are.
EXACT, LEAST_P, MOST_EXACT_RUNS = 64, 1e-12, 512
MASK = "[SECRET]"
# The base patterns and the lengths that they must have.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))
_TOKEN_BYTES = bytes(120 if chr(b).isascii() and (chr(b).isalnum() or b in b"+/_-") else 32 for b in range(256))
_ENCODINGS = (
    ("hex", re.compile("[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile("[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", re.compile("[A-Za-z0-9]+"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile("[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the fixed patterns, in code points.  Searches are skipped where the
    bytes show that there can be no match."""
    out = []
    low = raw.translate(LOWER)
    if (b"=" in raw or b":" in raw) and any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in raw.translate(_HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return out


def encoding(token: str) -> tuple[str, str] | None:
    """Name and alphabet of what a token is taken for.  Digits alone or letters alone are words and
    numbers; a token in 62 or 64 symbols has capitals, small letters and digits."""
    letters, digits = any(c.isalpha() for c in token), any(c.isdigit() for c in token)
    if letters and digits:
        for name, pattern, alphabet in _ENCODINGS:
            if pattern.fullmatch(token):
                mixed = token.upper() != token and token.lower() != token
                return (name, alphabet) if mixed or name in ("hex", "base32") else None
    return None


@lru_cache(maxsize=None)
def _square_sums(k: int) -> list[np.ndarray]:
    """For each length up to EXACT of tokens of ``k`` symbols drawn at random: the chances of each sum of
    squared symbol counts, by the sum.

    Counts of symbols are independent Poisson counts of which the total is known.  With z marking the
    total and q the squares, the chances for all symbols together are the k-th power of the series of
    one symbol; it is taken at the roots of unity in place of q and brought back by a Fourier transform."""
    places, n = EXACT * EXACT + 1, np.arange(EXACT + 1)
    rate = EXACT / k
    one = np.array([math.exp(-rate + c * math.log(rate) - math.lgamma(c + 1)) for c in n])
    at = np.exp(-2j * np.pi * (np.outer(n * n, np.arange(places // 2 + 1)) % places) / places)

    def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros_like(left)
        for c in n:
            out[c:] += left[c] * right[: len(n) - c]
        return out

    base, power, rest = one[:, None] * at, None, k
    while rest:
        if rest & 1:
            power = base if power is None else times(power, base)
        rest >>= 1
        base = times(base, base) if rest else base
    weights = np.clip(np.fft.irfft(power, places, axis=1), 0.0, None)
    return [w / w.sum() for w in weights]


@lru_cache(maxsize=None)
def _square_tails(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chances of at most and of at least each sum.  What the transform cannot tell from none counts as LEAST_P."""
    chances = _square_sums(k)[n]
    up, down = np.cumsum(chances), np.cumsum(chances[::-1])[::-1]
    return np.maximum(up, LEAST_P), np.maximum(down, LEAST_P)


def uniform_p(counts: np.ndarray) -> float:
    """Two-sided p-value of Pearson's statistic for equal chances: exact up to EXACT symbols, then by the
    cube root of chi-squared, which is nearly normal."""
    k, n = len(counts), int(counts.sum())
    squares = int((counts.astype(np.int64) ** 2).sum())
    if n <= EXACT:
        up, down = _square_tails(k, n)
        return min(1.0, 2 * float(min(up[squares], down[squares])))
    chi, free = k / n * squares - n, k - 1
    z = ((max(chi, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return max(LEAST_P, math.erfc(abs(z) / math.sqrt(2)))


@lru_cache(maxsize=None)
def runs_p(n: int, changes: int) -> float:
    """Two-sided p-value of the number of changes between the lower and the upper half of the alphabet:
    every step is a change with the chance 1/2, on its own, so the count is binomial."""
    few = min(changes, n - 1 - changes)
    if n > 2 * MOST_EXACT_RUNS:
        return min(1.0, math.erfc((n - 1 - 2 * few - 1) / math.sqrt(2 * (n - 1))))
    return min(1.0, 2 * sum(math.comb(n - 1, i) for i in range(few + 1)) / 2 ** (n - 1))


def serial_p(x: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbours, with its mean and spread over all orders of
    the same symbols; one symbol alone has no order."""
    n, y = len(x), x - x.mean()
    power = float((y * y).sum())
    if power == 0:
        return 1.0
    mean = -1 / n
    # E of (sum of y_i y_i+1)^2 over all orders, from the power sums of the symbols
    two, four = power * power, float((y ** 4).sum())
    squares = (two - four) / (n * (n - 1))
    chained = (2 * four - two) / (n * (n - 1) * (n - 2))
    apart = (3 * two - 6 * four) / (n * (n - 1) * (n - 2) * (n - 3))
    second = (n - 1) * squares + 2 * (n - 2) * chained + (n - 2) * (n - 3) * apart
    spread = math.sqrt(max(second / two - mean * mean, 1e-12))
    return math.erfc(abs(float((y[1:] * y[:-1]).sum()) / power - mean) / spread / math.sqrt(2))


def p_value(token: str, name: str, alphabet: str) -> float:
    """The battery's p-value; small for what is too even, too uneven or too regular to be random."""
    plain = token.lower() if name == "hex" else token.replace("-", "+").replace("_", "/")
    x = np.array([alphabet.index(c) for c in plain])
    high = x >= len(alphabet) // 2
    uniform = uniform_p(np.bincount(x, minlength=len(alphabet)))
    alternate = runs_p(len(x), int((high[1:] != high[:-1]).sum()))
    return min(1.0, 3 * min(uniform, alternate, serial_p(x.astype(float))))


def length_class(n: int) -> int:
    """Lengths of 24 to 31, 32 to 47, 48 to 63, then doubling."""
    return 0 if n < 32 else 1 if n < 48 else n.bit_length() - 4


def p_bin(p: float) -> int:
    """The bin of a p-value: larger for smaller values, and open at the last."""
    return min(MOST_BINS, int(-math.log10(p) * BINS_PER_TEN)) if p > 0 else MOST_BINS


def candidates(text: str, raw: bytes) -> list[tuple[int, int, str, int, int]]:
    """``start, end, encoding, length class, bin`` of each candidate."""
    out = []
    if b"x" * LEAST in raw.translate(_TOKEN_BYTES):
        for m in _TOKEN.finditer(text):
            token = m.group().rstrip("=")
            if (found := encoding(token)) is not None:
                out.append((m.start(), m.end(), found[0], length_class(len(token)), p_bin(p_value(token, *found))))
    return out


def discard_limits(counts: dict[tuple[str, int], dict[int, int]], fdr: float = FDR) -> dict[tuple[str, int], int]:
    """By class the first bin that is discarded (Benjamini-Hochberg with p at a bin's upper end)."""
    limits = {}
    for group, bins in counts.items():
        total, seen, limit = sum(bins.values()), 0, MOST_BINS + 1
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS_PER_TEN) <= fdr * seen / total:
                limit = b
        limits[group] = limit
    return limits


def fit_limits(docs: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """The limits from all candidates of all texts; only their counts by bin reach the driver."""
    def work(block: pa.RecordBatch) -> dict | None:
        rows = [c[2:] for text, raw in zip(block.column("text").to_pylist(), utf8(block)) if text
                for c in candidates(text, raw)]
        return {k: [r[i] for r in rows] for i, k in enumerate(("encoding", "size", "bin"))} if rows else None

    rows = map_blocks(docs.select("text"), work, "encoding STRING, size INT, bin INT")
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for name, size, b, n in rows.groupBy("encoding", "size", "bin").count().collect():
        counts.setdefault((name, size), {})[b] = n
    return discard_limits(counts, fdr)


def all_spans(text: str | None, raw: bytes | None, limits: dict[tuple[str, int], int]) -> list[tuple[int, int, str]]:
    """Base spans, and random tokens that overlap none of them, by start and kind."""
    if not text:
        return []
    base = base_spans(text, raw)
    found = [(a, b, "random") for a, b, name, size, p in candidates(text, raw)
             if p < limits.get((name, size), MOST_BINS + 1) and not any(a < y and x < b for x, y, _ in base)]
    return sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id, spans`` (``start, end, kind``; code points, end exclusive) for every row.

    A null or empty text has none.  Repeated rows are searched one by one and alike; repeated
    candidates count as often as they occur; other columns are ignored."""
    limits = fit_limits(docs, fdr)

    def work(block: pa.RecordBatch) -> dict:
        spans = [all_spans(t, r, limits) for t, r in zip(block.column("text").to_pylist(), utf8(block))]
        return {"doc_id": block.column("doc_id"),
                "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]}

    return map_blocks(docs.select("doc_id", "text"), work,
                      "doc_id LONG, spans ARRAY<STRUCT<start: INT, end: INT, kind: STRING>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: counts by base kind, the digest of the base spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = F.filter("spans", lambda s: s.kind != "random")
    return find_secrets(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: str | None, limits: dict[tuple[str, int], int]) -> str | None:
    """The text with MASK for each stretch that spans cover."""
    spans = all_spans(text, text.encode() if text else None, limits)
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``docs`` with MASK in place of secrets; rows without any stay as they are."""
    limits = fit_limits(docs, fdr)
    return rewrite(docs, lambda texts: [masked(t, limits) for t in texts])
