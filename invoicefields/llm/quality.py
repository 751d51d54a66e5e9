"""A quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a fixed sparse index vector of a few +1 and -1, derived from its slot.  The
vector of a word is the sum of the index vectors of the words around it, over all documents.
Words share SLOTS slots by a hash, apart by shape (lower case, capitals, digits, ...), so the
table has the same size for any corpus; marks at the end of a word have slots of their own.
A document is the mean and the spread of its words' vectors and their mean distance to the next.
Two layers learn the label from these, and a temperature fitted on labelled rows set aside
calibrates the probability.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import WORDS_HELD, blocks, fold, map_blocks, rewrite, utf8

SHAPES, SLOTS_PER_SHAPE, SIZE, NONZERO, REACH = 8, 2048, 32, 4, 2
SLOTS = SHAPES * SLOTS_PER_SHAPE
#: Slots in one row of the merged table.
PART = 256
#: At most so many labelled rows (those with the smallest hash of their id) fit the network.
TRAINING_ROWS = 20_000
HIDDEN, ROUNDS, STEP = 32, 400, 0.01
FOLDS = 5
ACCEPT = 0.3
_END = re.compile(rb"[!-/:-@\[-`{-~]+\Z")


class Slots(dict):
    """Slot of a word and, shifted by 16 bits, of the marks at its end."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        end = _END.search(word)
        mark = end.group() if end else b""
        core = word[:len(word) - len(mark)].decode("utf-8", "replace")
        if not core:
            shape = 0
        elif core.islower():
            shape = 1
        elif core.isupper():
            shape = 2 if len(core) > 1 else 3
        elif core.istitle():
            shape = 4
        elif core.isdigit():
            shape = 5
        else:
            shape = 6
        slot = shape * SLOTS_PER_SHAPE + xxhash.xxh3_64_intdigest(core.encode()) % SLOTS_PER_SHAPE
        end_slot = 7 * SLOTS_PER_SHAPE + xxhash.xxh3_64_intdigest(mark) % SLOTS_PER_SHAPE
        value = self[word] = slot | end_slot << 16
        return value

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return both & 0xFFFF, both >> 16


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries, by slot."""
    rng = np.random.default_rng(7)
    return rng.integers(0, SIZE, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all slots, from the neighbours of all words of all texts."""
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, (places, signs) = Slots(), index_vectors()
        total = np.zeros(SLOTS * SIZE)

        def meet(a: np.ndarray, b: np.ndarray) -> None:
            """Words ``a`` occur near words ``b``."""
            total[:] += np.bincount((a[:, None] * SIZE + places[b]).ravel(), signs[b].ravel(), SLOTS * SIZE)

        seen = False
        for block in blocks(batches):
            words, doc = [], []
            for i, text in enumerate(utf8(block)):
                own = text.split() if text else []
                words += own
                doc.append(len(own))
            if not words:
                continue
            seen = True
            core, mark = slots.of(words)
            owner = np.repeat(np.arange(len(doc)), doc)
            meet(core, mark)
            meet(mark, core)
            for reach in range(1, REACH + 1):
                same = owner[reach:] == owner[:-reach]
                a, b = core[:-reach][same], core[reach:][same]
                meet(a, b)
                meet(b, a)
        if seen:
            table = np.rint(total).astype(np.int64).reshape(-1, PART * SIZE)
            for part in range(len(table)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([table[part].tobytes()], pa.binary())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, np.int64)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=schema)

    parts = docs.select("text").mapInArrow(gather, "part INT, data BINARY")
    table = np.zeros((SLOTS // PART, PART * SIZE))
    for part, data in parts.repartition("part").mapInArrow(merge, "part INT, data BINARY").toLocalIterator():
        table[part] = np.frombuffer(data, np.int64)
    table = table.reshape(SLOTS, SIZE)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = 3 * SIZE + 1


def pooled(texts: list[bytes | None], vectors: np.ndarray, slots: Slots) -> np.ndarray:
    """Features of each text; zeros without words."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(texts):
        words = text.split() if text else []
        if words:
            core, mark = slots.of(words)
            v = vectors[core] + vectors[mark]
            out[i, :SIZE] = v.mean(axis=0)
            out[i, SIZE:2 * SIZE] = v.std(axis=0)
            if len(words) > 1:
                out[i, 2 * SIZE:3 * SIZE] = np.abs(np.diff(v, axis=0)).mean(axis=0)
            out[i, -1] = np.log1p(len(words))
    return out


@dataclasses.dataclass
class Network:
    """Two layers over standardised features, and the temperature of its logits."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # einsum sums each row by itself: a row's score does not depend on the rows beside it
        hidden = np.tanh(np.einsum("ij,jk->ik", (x - self.centre) / self.scale, self.w1) + self.b1)
        return np.einsum("ij,j->i", hidden, self.w2) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    """Learns from the rows not set aside (Adam on the mean log loss), then the temperature from
    those set aside.  Without both labels the score is the rate of label 1 (half without rows)."""
    rng = np.random.default_rng(3)
    x = x.astype(np.float64)
    net = Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(rate / (1 - rate)))
    a, b = x[~aside], y[~aside].astype(np.float64)
    if len(np.unique(b)) < 2:
        return net
    net.centre, net.scale = a.mean(axis=0), a.std(axis=0) + 1e-6
    net.w1 = rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN))
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (a - net.centre) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(max(4, ROUNDS * 512 // len(z))):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 512)):
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -40, 40))) - b[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - hidden**2)
            slopes = [z[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2,
                      np.array([error.sum()])]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    if aside.any():
        logits, truth = net.logits(x[aside]), y[aside]
        tries = np.geomspace(0.25, 16, 97)
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t)) for t in tries]
        net.temperature = float(tries[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts; the network from labelled rows outside of fold 0.

    Labels of one id that differ count by majority (a tie as 1); null labels and ids, and labels
    of no document, are left out.  One fifth of the rows is set aside for the temperature."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    learn = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), FOLDS) != 0)
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    slots = Slots()

    def features(block: pa.RecordBatch) -> dict:
        x = pooled(utf8(block), sent.value, slots)
        return {"doc_id": block.column("doc_id"), "label": block.column("label"), "x": [r.tobytes() for r in x]}

    chosen = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id")
    rows = map_blocks(chosen, features, "doc_id LONG, label INT, x BINARY").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, WIDTH)
    aside = np.array([xxhash.xxh3_64_intdigest(str(i), 5) % 5 == 0 for i in rows["doc_id"]], bool)
    return vectors, fit(x, rows["label"].to_numpy(), aside)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.  A null, empty or wordless text gets
    the score of a document without words; a null id is not held out.  Repeated rows are scored
    one by one and alike; other columns are ignored and never inputs of a score."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    slots = Slots()

    def work(block: pa.RecordBatch) -> dict:
        vectors, network = sent.value
        score = network.score(pooled(utf8(block), vectors, slots))
        return {"doc_id": block.column("doc_id"), "held_out": block.column("held_out"), "score": score,
                "predicted": (score >= ACCEPT).astype(np.int32)}

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return map_blocks(docs.select("doc_id", "text", held_out.alias("held_out")), work,
                      "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows whose score is below ``accept``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    slots = Slots()

    def good(texts: list[str | None]) -> list[bool]:
        vectors, network = sent.value
        coded = [t.encode() if t else None for t in texts]
        return (network.score(pooled(coded, vectors, slots)) >= accept).tolist()

    return rewrite(docs, None, keep=good)
