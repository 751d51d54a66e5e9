"""Toxicity: a bidirectional gated recurrent network with attention pooling, over windows of words.

A word enters with two vectors: one of its own, if it is among the words that the labelled rows
use most, and the sum of the vectors of its character sequences of three and four, which any word
has.  A gated recurrent layer reads the window in both directions, attention weighs its positions
and pools them, and a linear layer gives the window's logit.  A text is read whole, in windows
that overlap by a quarter; a small logistic layer makes its score of the highest logits, of the share
of marked windows and of how many there are.

Labels belong to documents, so the network first learns from any of their windows and then from
those that it itself finds worst.  Everything is numpy; the gradients are written out below.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import blocks, fold, map_blocks, mix

WINDOW, STRIDE = 48, 36
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 16, 16, 8
GATES = 3 * HIDDEN
KNOWN_WORDS, GRAM_SLOTS = 8192, 1 << 15
GRAMS = (3, 4)
#: A longer word is read in pieces of so many characters.
LONGEST = 32
#: At most so many rows of each label (those with the smallest hash of their id) fit the network,
#: each with at most so many windows, at even distances from begin to end.
ROWS_OF_LABEL, WINDOWS_OF_ROW = 2500, 64
BATCH, ROUNDS, WARM_UP, STEP, DROPPED = 256, 7, 3, 0.005, 0.3
#: Words whose inputs a task remembers, and windows that it scores at once.
WORDS_HELD, AT_ONCE = 1 << 18, 512
FOLDS, HELD_OUT = 4, 2
FLAG = 0.3
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡–—…"
_BEGIN, _END = "\x02", "\x03"


# --- words ------------------------------------------------------------------------------------

def words_of(text: str | None) -> list[str]:
    """What white space divides, without case; long words in pieces."""
    words = text.casefold().split() if text else []
    if words and max(map(len, words)) > LONGEST:
        words = [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def normal(word: str) -> str:
    """Without marks at its ends, unless it is nothing else."""
    return word.strip(_EDGES) or word


def window_starts(n: int) -> np.ndarray:
    """Where the windows of n words begin: every STRIDE, and one that ends with the last word."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    count = 1 - (WINDOW - n) // STRIDE
    return np.minimum(np.arange(count) * STRIDE, n - WINDOW)


@dataclasses.dataclass
class Grams:
    """Slots of the character sequences that begin at each character of some words (GRAM_SLOTS: none
    that ends within the word), where the words begin, and the scale of their sums."""

    slots: np.ndarray
    starts: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Grams:
        marked = [f"{_BEGIN}{w}{_END}" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        joined = "".join(marked).encode("utf-32-le", "surrogatepass")
        codes = np.concatenate((np.frombuffer(joined, np.uint32).astype(np.uint64), np.zeros(max(GRAMS), np.uint64)))
        left = np.repeat(ends, sizes) - np.arange(ends[-1])
        value, slots = np.zeros(len(left), np.uint64), []
        for i in range(max(GRAMS)):
            value = value * np.uint64(0x100000001B3) + codes[i:i + len(left)] + np.uint64(1)
            if i + 1 in GRAMS:
                found = (mix(value) & np.uint64(GRAM_SLOTS - 1)).astype(np.int32)
                slots.append(np.where(left > i, found, GRAM_SLOTS))
        counts = sum(np.maximum(sizes - n + 1, 0) for n in GRAMS)
        return cls(np.stack(slots), ends - sizes, (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """A row for each word, from a table whose last row is zero."""
        own = table[self.slots[0]]
        for slots in self.slots[1:]:
            own += table[slots]
        return np.add.reduceat(own, self.starts, axis=0) * self.scale[:, None]

    def slopes(self, grad: np.ndarray) -> np.ndarray:
        """The gradient of the table, from that of the sums."""
        sizes = np.diff(np.append(self.starts, self.slots.shape[1]))
        spread = np.repeat(grad * self.scale[:, None], sizes, axis=0)
        out = np.zeros((GRAM_SLOTS + 1, grad.shape[1]), np.float32)
        flat = self.slots.ravel()
        for j in range(grad.shape[1]):
            out[:, j] = np.bincount(flat, np.tile(spread[:, j], len(self.slots)), GRAM_SLOTS + 1)
        out[-1] = 0
        return out


# --- the network ------------------------------------------------------------------------------

def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = WORD_SIZE + CHAR_SIZE

    def normal_(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {
        "word": normal_(KNOWN_WORDS + 1, WORD_SIZE, scale=0.05), "gram": normal_(GRAM_SLOTS + 1, CHAR_SIZE, scale=0.05),
        "wx": normal_(2, size, GATES, scale=size**-0.5), "wh": normal_(2, HIDDEN, GATES, scale=HIDDEN**-0.5),
        "b": np.zeros((2, GATES), np.float32), "wa": normal_(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN)**-0.5),
        "ba": np.zeros(ATTENTION, np.float32), "va": normal_(ATTENTION, scale=1.0),
        "wo": normal_(2 * HIDDEN, scale=0.1), "bo": np.zeros(1, np.float32),
    }
    p["word"][0] = 0
    p["gram"][-1] = 0
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(p: dict, gx: np.ndarray, there: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States ``(T, B, 2 * HIDDEN)`` from gate inputs ``gx`` ``(2, T, B, GATES)``, of which the second is read
    from the end.  ``there`` ``(T, B)`` is 0 at padding, where states are zero."""
    steps, rows, h2 = gx.shape[1], gx.shape[2], 2 * HIDDEN
    out = np.empty((steps, rows, h2), gx.dtype)
    h = np.zeros((2, rows, HIDDEN), gx.dtype)
    for t in range(steps):
        x = np.stack((gx[0, t], gx[1, steps - 1 - t]))
        gh = h @ p["wh"]
        zr = sigmoid(x[..., :h2] + gh[..., :h2])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = np.tanh(x[..., h2:] + r * gh[..., h2:])
        new = c + z * (h - c)
        if there is not None:
            new *= np.stack((there[t], there[steps - 1 - t]))[..., None]
        if keep is not None:
            keep.append((h, gh, z, r, c))
        h = new
        out[t, :, :HIDDEN] = h[0]
        out[steps - 1 - t, :, HIDDEN:] = h[1]
    return out


def attend(p: dict, states: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled states ``(B, 2 * HIDDEN)``, the weights ``(T, B)`` and the hidden layer of the attention."""
    u = np.tanh(states @ p["wa"] + p["ba"])
    e = u @ p["va"]
    if there is not None:
        e = np.where(there > 0, e, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    return np.einsum("tb,tbh->bh", a, states), a, u


def logits(p: dict, gx: np.ndarray, there: np.ndarray | None) -> np.ndarray:
    pooled, _, _ = attend(p, recur(p, gx, there), there)
    return np.einsum("bh,h->b", pooled, p["wo"]) + p["bo"]


def quick_tanh(x: np.ndarray, x2: np.ndarray, low: np.ndarray) -> None:
    """tanh in place, by its continued fraction: off by less than 2e-3 anywhere.  The others are room."""
    np.clip(x, -5, 5, out=x)
    np.multiply(x, x, out=x2)
    np.add(x2, np.float32(210), out=low)
    low *= x2
    low += np.float32(4725)
    low *= x2
    low += np.float32(10395)
    high = x2 * np.float32(21)
    high += np.float32(1260)
    high *= x2
    high += np.float32(10395)
    x *= high
    x /= low


def by_gate(gates: np.ndarray) -> np.ndarray:
    """``(2, ..., GATES)`` as ``(3, 2, ..., HIDDEN)``, the sums for z and r halved."""
    out = np.stack(np.split(gates, 3, axis=-1))
    out[:2] *= np.float32(0.5)
    return out


class Reader:
    """``recur`` for windows of numbered words, with the same results up to rounding: gate inputs are fetched
    step by step, and everything is computed in place, gate by gate.  z and r come as tanh of halved sums."""

    def __init__(self, wh: np.ndarray):
        self.wh = by_gate(wh)
        self.wh[2] *= np.float32(0.5)
        self.rows = 0

    def states(self, gates: np.ndarray, ids: np.ndarray, there: np.ndarray | None) -> np.ndarray:
        """``gates`` ``(3, 2, words, HIDDEN)`` as ``by_gate`` has them; ``ids`` ``(T, B)``."""
        steps, rows = ids.shape
        if self.rows != rows:
            self.rows = rows
            self.x, self.gh = np.empty((3, 2, rows, HIDDEN), np.float32), np.empty((3, 2, rows, HIDDEN), np.float32)
        x, gh = self.x, self.gh
        zr, (z, r, c), (_, _, gc) = x[:2], x, gh
        room = np.empty((2, *zr.shape), np.float32)
        h = np.zeros((2, rows, HIDDEN), np.float32)
        out = np.empty((steps, rows, 2 * HIDDEN), np.float32)
        half = np.float32(0.5)
        for t in range(steps):
            back = steps - 1 - t
            for gate in range(3):
                np.take(gates[gate, 0], ids[t], axis=0, out=x[gate, 0], mode="clip")
                np.take(gates[gate, 1], ids[back], axis=0, out=x[gate, 1], mode="clip")
            np.matmul(h, self.wh, out=gh)
            zr += gh[:2]
            quick_tanh(zr, *room)
            r *= gc  # r * gc = (1 + tanh) * gc / 2
            c += gc
            c += r
            quick_tanh(c, *room[:, 0])
            np.subtract(h, c, out=gc)  # h' = ((c + h) + tanh * (h - c)) / 2
            gc *= z
            h += c
            h += gc
            h *= half
            if there is not None:
                h[0] *= there[t][:, None]
                h[1] *= there[back][:, None]
            out[t, :, :HIDDEN] = h[0]
            out[back, :, HIDDEN:] = h[1]
        return out


def slopes(p: dict, x: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the weighted log loss of windows: of the parameters, of the inputs ``x`` ``(T, B, size)``;
    and the logits."""
    steps, rows, _ = x.shape
    keep: list = []
    gx = np.stack([x @ p["wx"][d] + p["b"][d] for d in (0, 1)])
    states = recur(p, gx, there, keep)
    pooled, a, u = attend(p, states, there)
    out = pooled @ p["wo"] + p["bo"]
    error = (sigmoid(out) - y) * weight
    g = {"wo": pooled.T @ error, "bo": error.sum(keepdims=True)}
    d_pooled = error[:, None] * p["wo"]
    d_a = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_u = d_e[..., None] * p["va"] * (1 - u * u)
    flat = states.reshape(-1, 2 * HIDDEN)
    g["va"] = np.einsum("tb,tbk->k", d_e, u)
    g["wa"], g["ba"] = flat.T @ d_u.reshape(-1, ATTENTION), d_u.sum(axis=(0, 1))
    d_states = a[..., None] * d_pooled + d_u @ p["wa"].T
    g["wh"] = np.zeros_like(p["wh"])
    d_gx = np.empty_like(gx)
    d_h = np.zeros((2, rows, HIDDEN), x.dtype)
    for t in range(steps - 1, -1, -1):
        h, gh, z, r, c = keep[t]
        back = steps - 1 - t
        d_h = d_h + np.stack((d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]))
        d_h *= np.stack((there[t], there[back]))[..., None]
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (h - c) * z * (1 - z)
        d_r = d_c * gh[..., 2 * HIDDEN:] * r * (1 - r)
        d_x = np.concatenate((d_z, d_r, d_c), axis=-1)
        d_gh = np.concatenate((d_z, d_r, d_c * r), axis=-1)
        d_gx[0, t], d_gx[1, back] = d_x[0], d_x[1]
        g["wh"] += np.einsum("dbh,dbg->dhg", h, d_gh)
        d_h = d_h * z + d_gh @ p["wh"].transpose(0, 2, 1)
    inputs = x.reshape(-1, x.shape[-1])
    g["wx"] = np.stack([inputs.T @ d_gx[d].reshape(-1, GATES) for d in (0, 1)])
    g["b"] = d_gx.sum(axis=(1, 2))
    d_x = sum(d_gx[d] @ p["wx"][d].T for d in (0, 1))
    return g, d_x, out


# --- learning ---------------------------------------------------------------------------------

@dataclasses.dataclass
class Sample:
    """Windows of the labelled rows: numbers of words (0: padding) ``(windows, WINDOW)``, of which row each is."""

    vocabulary: list[str]
    ids: np.ndarray
    owner: np.ndarray
    windows_in_text: np.ndarray
    label: np.ndarray
    aside: np.ndarray


def sample(rows: list) -> Sample:
    """From ``doc_id, label, n_windows, windows`` (words divided by blanks, windows by line feeds)."""
    number: dict[str, int] = {}
    ids, owner = [], []
    for k, row in enumerate(rows):
        for window in row["windows"].split("\n") if row["windows"] else ():
            own = [number.setdefault(w, len(number) + 1) for w in window.split(" ")]
            ids.append(own + [0] * (WINDOW - len(own)))
            owner.append(k)
    aside = np.array([xxhash.xxh3_64_intdigest(str(r["doc_id"]), 5) % 4 == 0 for r in rows], bool)
    return Sample(list(number), np.array(ids, np.int32).reshape(-1, WINDOW), np.array(owner, np.int64),
                  np.array([r["n_windows"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), aside)


def known_words(s: Sample) -> dict[str, int]:
    """The words that most windows of the rows not set aside use, from 1."""
    rows = np.flatnonzero(~s.aside[s.owner]) if len(s.owner) else np.zeros(0, np.int64)
    counts = np.bincount(s.ids[rows].ravel(), minlength=len(s.vocabulary) + 1)
    total: dict[str, int] = {}
    for word, count in zip(s.vocabulary, counts[1:].tolist()):
        if count:
            key = normal(word)
            total[key] = total.get(key, 0) + count
    best = sorted(total, key=lambda w: (-total[w], w))[:KNOWN_WORDS]
    return {w: i for i, w in enumerate(best, 1)}


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.step = p, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def move(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        size = rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            m, v = self.moments[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            self.p[k] -= np.float32(size) * m / (np.sqrt(v) + np.float32(1e-7))


def learn_windows(s: Sample, known: dict[str, int]) -> dict[str, np.ndarray]:
    """Parameters from the windows of the rows not set aside."""
    rng = np.random.default_rng(11)
    p = fresh(rng)
    rows = np.flatnonzero(~s.aside[s.owner])
    label = s.label[s.owner].astype(np.float32)
    keys = [normal(w) for w in s.vocabulary]
    word_id = np.array([0] + [known.get(w, 0) for w in keys], np.int64)
    adam = Adam(p)
    docs = np.unique(s.owner[rows])
    toxic = int(s.label[docs].sum())
    heavier = np.float32(np.clip((len(docs) - toxic) / toxic, 1, 3))
    rounds = max(ROUNDS, ROUNDS * 1500 // len(docs))
    warm = rounds * WARM_UP // ROUNDS
    scores = None
    for turn in range(rounds):
        if turn >= warm and (turn - warm) % max(2, rounds // ROUNDS) == 0:
            scores = Scorer(p, known).windows(s.vocabulary, s.ids[rows])
        chosen = _choose(s, rows, scores, rng)
        rate = STEP * (1 - 0.8 * turn / rounds)
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
            ids = s.ids[part].T
            words, at = np.unique(ids, return_inverse=True)
            at = at.reshape(ids.shape)
            real = words[words > 0]
            pad = len(words) - len(real)
            grams = Grams.of([keys[w - 1] for w in real])
            own = word_id[words] * (rng.random(len(words)) >= DROPPED)
            char = np.zeros((len(words), CHAR_SIZE), np.float32)
            char[pad:] = grams.sums(p["gram"])
            table = np.concatenate((p["word"][own], char), axis=1)
            there = (ids > 0).astype(np.float32)
            weight = np.where(label[part] == 1, heavier, np.float32(1))
            g, d_x, _ = slopes(p, table[at], there, label[part], weight / weight.sum())
            order = np.argsort(at.ravel(), kind="stable")
            firsts = np.searchsorted(at.ravel()[order], np.arange(len(words)))
            d_table = np.add.reduceat(d_x.reshape(-1, d_x.shape[-1])[order], firsts, axis=0)
            g["gram"] = grams.slopes(d_table[pad:, WORD_SIZE:])
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], own, d_table[:, :WORD_SIZE])
            g["word"][0] = 0
            adam.move(g, rate)
    return p


def _choose(s: Sample, rows: np.ndarray, scores: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """Of each text three windows at random; once there are scores its two worst and, of clean texts, one at random."""
    owner = s.owner[rows]
    shuffled = rng.random(len(rows))
    first = shuffled if scores is None else -scores
    by_first = np.lexsort((first, owner))
    starts = np.flatnonzero(np.diff(owner[by_first], prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    picked = by_first[rank < (3 if scores is None else 2)]
    if scores is not None:
        by_chance = np.lexsort((shuffled, owner))
        clean = by_chance[np.flatnonzero(np.diff(owner[by_chance], prepend=-1))]
        picked = np.concatenate((picked, clean[s.label[owner[clean]] == 0]))
    return rows[np.unique(picked)]


class Numbers(dict):
    """Numbers from 1 for words, and those that got theirs since the last look."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        value = self[word] = len(self) + 1
        return value


class Scorer:
    """Logits of windows; what a word adds to the gates is computed once and remembered."""

    def __init__(self, p: dict[str, np.ndarray], known: dict[str, int]):
        self.p, self.known = p, known
        self.reader, self.wx, self.b = Reader(p["wh"]), by_gate(p["wx"]), by_gate(p["b"])
        self.numbers = Numbers()
        self.gates = np.zeros((3, 2, 1, HIDDEN), np.float32)

    def number(self, words: list[str]) -> np.ndarray:
        """A number from 1 for each word, under which its gate inputs are kept.  Beyond WORDS_HELD words
        it starts anew with the next block."""
        if len(self.numbers) > WORDS_HELD:
            self.numbers = Numbers()
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        new, self.numbers.new = self.numbers.new, []
        first, need = len(self.numbers) - len(new) + 1, len(self.numbers) + 1
        if need > self.gates.shape[2]:
            grown = np.zeros((3, 2, need * 3 // 2, HIDDEN), np.float32)
            grown[:, :, :first] = self.gates[:, :, :first]
            self.gates = grown
        for i in range(0, len(new), 1 << 13):
            keys = [normal(w) for w in new[i:i + (1 << 13)]]
            own = np.fromiter((self.known.get(k, 0) for k in keys), np.int32, len(keys))
            x = np.concatenate((self.p["word"][own], Grams.of(keys).sums(self.p["gram"])), axis=1)
            for gate in range(3):
                for d in (0, 1):
                    self.gates[gate, d, first + i:first + i + len(keys)] = x @ self.wx[gate, d] + self.b[gate, d]
        return out

    def batch(self, ids: np.ndarray) -> np.ndarray:
        """Logits of windows of numbered words ``(B, WINDOW)``, 0 where there is none."""
        # rows of zeros fill up to a multiple of 64, so that a row's sums do not depend on those beside it
        filled = np.zeros((-(-len(ids) // 64) * 64, WINDOW), np.int64)
        filled[:len(ids)] = ids
        turned = np.ascontiguousarray(filled.T)
        there = (turned > 0).astype(np.float32) if (ids == 0).any() or len(filled) > len(ids) else None
        pooled, _, _ = attend(self.p, self.reader.states(self.gates, turned, there), there)
        return (np.einsum("bh,h->b", pooled, self.p["wo"]) + self.p["bo"])[:len(ids)]

    def windows(self, vocabulary: list[str], ids: np.ndarray) -> np.ndarray:
        numbers = np.concatenate(([0], self.number(vocabulary)))
        parts = [self.batch(numbers[ids[i:i + AT_ONCE]]) for i in range(0, len(ids), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and how many windows each text has."""
        words, sizes, starts = [], [], []
        for text in texts:
            own = words_of(text)
            at = window_starts(len(own))
            starts.append(np.stack((at + len(words), np.full(len(at), len(words) + len(own)))))
            sizes.append(len(at))
            words += own
        begin, end = np.concatenate(starts, axis=1)
        numbers = np.concatenate((self.number(words), np.zeros(WINDOW, np.int32)))
        out = np.empty(len(begin), np.float32)
        for i in range(0, len(begin), AT_ONCE):
            at = begin[i:i + AT_ONCE, None] + np.arange(WINDOW)
            ids = np.where(at < end[i:i + AT_ONCE, None], numbers[at], 0)
            out[i:i + AT_ONCE] = self.batch(ids)
        return out, np.array(sizes, np.int64)


TEXT_FEATURES = 5


def text_features(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: the highest logit, the mean of the three highest, the mean probability, the log of the
    number of windows, and whether it has any."""
    out = np.zeros((len(sizes), TEXT_FEATURES))
    out[:, 0] = out[:, 1] = -10.0
    has = np.flatnonzero(sizes)
    if len(has):
        starts = np.concatenate(([0], np.cumsum(sizes[has])[:-1]))
        clipped = np.clip(scores.astype(np.float64), -10, 10)
        owner = np.repeat(np.arange(len(has)), sizes[has])
        order = np.lexsort((-clipped, owner))
        ranked = clipped[order]
        rank = np.arange(len(ranked)) - np.repeat(starts, sizes[has])
        top = rank < 3
        out[has, 0] = ranked[starts]
        out[has, 1] = np.bincount(owner[top], ranked[top], len(has)) / np.minimum(sizes[has], 3)
        out[has, 2] = np.add.reduceat(sigmoid(clipped), starts) / sizes[has]
        out[has, 3] = np.log(sizes[has])
        out[has, 4] = 1.0
    return out


def rate_alone(y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A layer that gives the rate of label 1, half if there are no rows."""
    rate = ((y * weight).sum() + 1) / (weight.sum() + 2)
    weights = np.zeros(TEXT_FEATURES + 1)
    weights[-1] = np.log(rate / (1 - rate))
    return np.zeros(TEXT_FEATURES), np.ones(TEXT_FEATURES), weights


def fit_texts(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last one constant) of a logistic layer, by Newton steps with a ridge; a
    row counts by its weight."""
    centre, scale, weights = rate_alone(y, weight)
    if len(np.unique(y)) < 2:
        return centre, scale, weights
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate(((x - centre) / scale, np.ones((len(x), 1))), axis=1)
    ridge = np.diag([1.0] * TEXT_FEATURES + [1e-3])
    for _ in range(30):
        q = sigmoid(z @ weights)
        curve = (z * (weight * q * (1 - q))[:, None]).T @ z + ridge
        weights = weights - np.linalg.solve(curve, z.T @ (weight * (q - y)) + ridge @ weights)
    return centre, scale, weights


@dataclasses.dataclass
class Model:
    known: dict[str, int]
    p: dict[str, np.ndarray]
    text_layer: tuple[np.ndarray, np.ndarray, np.ndarray]

    def score(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        centre, scale, weights = self.text_layer
        x = (text_features(scores, sizes) - centre) / scale
        return np.round(sigmoid(np.clip(np.einsum("ij,j->i", x, weights[:-1]) + weights[-1], -40, 40)), 5)


def learn(rows: list, of_label: dict[int, int]) -> Model:
    """The network from three quarters of the rows, the layer over texts from the rest.  ``of_label`` says
    how many rows there are of each label, of which ``rows`` may be a part."""
    s = sample(rows)
    known = known_words(s)
    taken = np.bincount(s.label, minlength=2)
    share = np.array([of_label.get(y, 0) / max(taken[y], 1) for y in (0, 1)])
    weight = share[s.label] * len(rows) / max((share * taken).sum(), 1e-9)
    if len(np.unique(s.label[s.owner[~s.aside[s.owner]]])) < 2:  # nothing to tell apart: the rate for every text
        return Model(known, fresh(np.random.default_rng(11)), rate_alone(s.label, weight))
    p = learn_windows(s, known)
    scores = Scorer(p, known).windows(s.vocabulary, s.ids)
    x = text_features(scores, np.bincount(s.owner, minlength=len(rows)))
    x[:, 3] = np.log(np.maximum(s.windows_in_text, 1))
    on = s.aside if len(np.unique(s.label[s.aside])) == 2 else np.ones(len(rows), bool)
    return Model(known, p, fit_texts(x[on], s.label[on], weight[on]))


# --- Spark ------------------------------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Labels of fold 2 are not read.  Labels of one id that differ count by majority (a tie as 1); null
    labels and ids, and labels of no document, are left out.  At most ROWS_OF_LABEL rows of each label
    reach the driver, each with at most WINDOWS_OF_ROW windows; the text layer counts them by how many
    rows of their label there are."""
    learned = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
               .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label")))
    of_label = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}

    some = [learned.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_OF_LABEL) for y in (0, 1)]

    def cut(block: pa.RecordBatch) -> dict:
        counts, windows = [], []
        for text in block.column("text").to_pylist():
            words = words_of(text)
            starts = window_starts(len(words))
            counts.append(len(starts))
            if len(starts) > WINDOWS_OF_ROW:
                starts = starts[np.linspace(0, len(starts) - 1, WINDOWS_OF_ROW).astype(np.int64)]
            windows.append("\n".join(" ".join(words[i:i + WINDOW]) for i in starts))
        return {"doc_id": block.column("doc_id"), "label": block.column("label"), "n_windows": counts, "windows": windows}

    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].unionAll(some[1])), "doc_id")
    cut_rows = map_blocks(chosen, cut, "doc_id LONG, label INT, n_windows LONG, windows STRING")
    # rows that share an id are as many as there are: of those, too, no more than the bound
    rows = cut_rows.orderBy(F.xxhash64("doc_id"), "doc_id", "windows").limit(2 * ROWS_OF_LABEL).collect()
    return learn(rows, of_label)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_windows, worst_logit`` for every row.

    A null, empty or wordless text has no windows and no ``worst_logit``; it gets the score that the
    text layer gives to such texts.  A null id is not held out.  Repeated rows are scored one by one
    and alike; other columns are ignored and never inputs of a score.  Without rows of both labels
    every score is the rate of label 1 among those there are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    held: list[Scorer] = []

    def work(block: pa.RecordBatch) -> dict:
        model = sent.value
        if not held:
            held.append(Scorer(model.p, model.known))
        scores, sizes = held[0].texts(block.column("text").to_pylist())
        score = model.score(scores, sizes)
        worst = text_features(scores, sizes)[:, 0].round(4)
        return {"doc_id": block.column("doc_id"), "held_out": block.column("held_out"), "score": score,
                "predicted": (score >= FLAG).astype(np.int32), "n_windows": sizes,
                "worst_logit": pa.array(worst, pa.float64(), mask=sizes == 0)}

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return map_blocks(docs.select("doc_id", "text", held_out.alias("held_out")), work,
                      "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT, n_windows LONG, worst_logit DOUBLE")
