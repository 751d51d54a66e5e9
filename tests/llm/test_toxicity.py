"""The recurrent network: its gradients, its scoring step against plain loops, held-out labels, odd rows."""

import math

import numpy as np
import pytest

from invoicefields.llm import toxicity
from llm import plain
from llm.conftest import SCHEMA, as_set

SIZE = toxicity.WORD_SIZE + toxicity.CHAR_SIZE


@pytest.fixture(scope="module")
def weights():
    return toxicity.fresh(np.random.default_rng(5))


def test_gradients_by_differences(weights):
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in weights.items()}
    x, there = rng.normal(size=(7, 5, SIZE)), np.ones((7, 5))
    there[4:, 1] = there[1:, 3] = 0
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([0.1, 0.3, 0.2, 0.2, 0.2])

    def loss():
        gx = np.stack([x @ p["wx"][d] + p["b"][d] for d in (0, 1)])
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * toxicity.logits(p, gx, there))).sum()

    g, d_x, _ = toxicity.slopes(p, x, there, y, weight)
    checked = [(p[k], g[k]) for k in ("wx", "wh", "b", "wa", "ba", "va", "wo", "bo")]
    for values, slope in [*checked, (x, d_x * there[..., None])]:
        flat, want = values.reshape(-1), np.asarray(slope).reshape(-1)
        for i in rng.choice(len(flat), min(15, len(flat)), replace=False):
            if values is x and not there.reshape(-1)[i // SIZE]:
                continue
            old, sides = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                sides.append(loss())
            flat[i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - want[i]) < 1e-7


def test_gradient_of_the_character_table():
    rng = np.random.default_rng(2)
    words = ["", "a", "abc", "übel", "abcabcabc", "語"]
    grams = toxicity.Grams.of(words)
    table = rng.normal(size=(toxicity.GRAM_SLOTS + 1, 3))
    table[-1] = 0
    back = rng.normal(size=(len(words), 3)).astype(np.float32)
    slope = grams.slopes(back)
    for i in np.unique(grams.slots)[:40]:
        if i == toxicity.GRAM_SLOTS:
            continue
        moved = table.copy()
        moved[i, 1] += 1
        assert np.isclose((back * (grams.sums(moved) - grams.sums(table))).sum(), slope[i, 1], atol=1e-4)
    assert not slope[-1].any()


def plain_logit(p, known, words):
    """One window by loops over positions and units."""
    grams = [toxicity.Grams.of([toxicity.normal(w)]).sums(p["gram"])[0] for w in words]
    x = [[*map(float, p["word"][known.get(toxicity.normal(w), 0)]), *map(float, c)] for w, c in zip(words, grams)]
    n = toxicity.HIDDEN
    sides = []
    for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        h, states = [0.0] * n, {}
        for t in order:
            gx = [sum(v * float(w) for v, w in zip(x[t], p["wx"][d][:, j])) + float(p["b"][d][j]) for j in range(3 * n)]
            gh = [sum(v * float(w) for v, w in zip(h, p["wh"][d][:, j])) for j in range(3 * n)]
            z = [1 / (1 + math.exp(-gx[j] - gh[j])) for j in range(n)]
            r = [1 / (1 + math.exp(-gx[n + j] - gh[n + j])) for j in range(n)]
            c = [math.tanh(gx[2 * n + j] + r[j] * gh[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
            states[t] = h
        sides.append(states)
    both = [sides[0][t] + sides[1][t] for t in range(len(x))]
    e = []
    for s in both:
        u = [math.tanh(sum(a * float(b) for a, b in zip(s, p["wa"][:, k])) + float(p["ba"][k])) for k in range(toxicity.ATTENTION)]
        e.append(math.exp(sum(a * float(b) for a, b in zip(u, p["va"]))))
    pooled = [sum(w * s[j] for w, s in zip(e, both)) / sum(e) for j in range(2 * n)]
    return sum(a * float(b) for a, b in zip(pooled, p["wo"])) + float(p["bo"][0])


def test_scoring_equals_plain_loops(weights, rows):
    known = {w: i for i, w in enumerate(["one", "w5", "a", "the", "of"], 1)}
    p = dict(weights, wo=weights["wo"] * 10)
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 2500][:30] + ["one w5 " * 45, "x" * 100, "ONE! one? (one)"]
    scores, sizes = toxicity.Scorer(p, known).texts(texts)
    want = []
    for text in texts:
        words = toxicity.words_of(text)
        last = max(0, len(words) - toxicity.WINDOW)
        starts = sorted({*range(0, last, toxicity.STRIDE), last}) if words else []
        want.append([plain_logit(p, known, words[i:i + toxicity.WINDOW]) for i in starts])
    assert sizes.tolist() == [len(w) for w in want]
    assert np.allclose(scores, [v for w in want for v in w], atol=0.02)


def test_every_word_is_in_a_window():
    for n in range(0, 300):
        starts = toxicity.window_starts(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and len(set(starts.tolist())) == len(starts)
        assert n <= toxicity.WINDOW or starts[-1] == n - toxicity.WINDOW


def test_long_words_are_read_whole():
    assert "".join(toxicity.words_of("x" * 100 + " " + "y" * 33)) == "x" * 100 + "y" * 33


def test_the_cache_may_overflow(weights, monkeypatch):
    texts = [" ".join(f"q{k}x{i}" for i in range(90)) for k in range(6)]
    want, _ = toxicity.Scorer(weights, {}).texts(texts)
    monkeypatch.setattr(toxicity, "WORDS_HELD", 100)
    small = toxicity.Scorer(weights, {})
    assert np.allclose(np.concatenate([small.texts([t])[0] for t in texts]), want, atol=1e-5)


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8), labels)
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (plain.fold(r["doc_id"], 4) == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    assert len(toxic) > 50
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["predicted"] for r in clean]) < 0.03


def test_toxicity_of_edge_rows(spark, docs, rows, labels, no_docs):
    out = toxicity.score_toxicity(docs, labels).drop("worst_logit").collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    assert len(out) == len(rows) and len({r["score"] for r in out if r["n_windows"] == 0}) == 1
    again = toxicity.score_toxicity(docs.repartition(2), labels).drop("worst_logit").collect()
    key = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_windows"]) for r in out]
    first = sorted(zip(key, [r["score"] for r in out]))
    second = sorted(zip([(r["doc_id"] is None, r["doc_id"] or 0, r["n_windows"]) for r in again], [r["score"] for r in again]))
    assert np.allclose([s for _, s in first], [s for _, s in second], atol=1e-3)
    assert toxicity.score_toxicity(no_docs, labels).collect() == []


def test_toxicity_without_both_labels(spark, docs, labels):
    none = toxicity.score_toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    one = toxicity.score_toxicity(docs, labels.selectExpr("doc_id", "quality", "0 AS toxic")).select("score").distinct().collect()
    assert len(one) == 1 and one[0]["score"] < 0.1


def test_many_rows_of_one_id_stay_within_the_bound(spark, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS_OF_LABEL", 5)
    taken = []
    monkeypatch.setattr(toxicity, "learn", lambda rows, of_label: taken.extend(rows) or toxicity.Model(
        {}, toxicity.fresh(np.random.default_rng(1)), toxicity.rate_alone(np.zeros(0), np.zeros(0))))
    some = [r["doc_id"] for r in labels.filter("toxic = 1 AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2").take(2)]
    docs = spark.createDataFrame([(i, f"text {k}", "en", "s", 1, "n", "z", "p") for i in some for k in range(50)], SCHEMA)
    toxicity.score_toxicity(docs, labels).collect()
    assert 0 < len(taken) <= 10
    assert as_set([(r["label"],) for r in taken])[0] == (1,)
