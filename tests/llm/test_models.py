"""Learned operators by held-out accuracy, round trips of formats, and the pipeline."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from invoicefields.llm import chat, langid, matroska, quality, secret_scan
from invoicefields.llm.common import components, Scratch
from llm import plain
from llm.conftest import as_set


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


# --- quality ---------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark, larger):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score_quality(larger, labels)
    rows = out.join(labels, "doc_id").filter("held_out").select("quality", "score", "predicted").collect()
    assert len(rows) > 50 and np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (plain.fold(r["doc_id"], 5) == 0) for r in out.select("doc_id", "held_out").collect())


def test_quality_of_edge_rows(docs, rows, labels, no_docs):
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (100_000, 100_001, 100_002)}
    assert len(empty) == 1
    assert as_set(map(tuple, quality.score_quality(docs.repartition(2), labels).collect())) == as_set(map(tuple, out))
    assert quality.score_quality(no_docs, labels).count() == 0
    unlabelled = quality.score_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in unlabelled] == [0.5]
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert as_set(r[:1] for r in good.select("doc_id").collect()) == as_set((r["doc_id"],) for r in out if r["predicted"])


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.WIDTH)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=4000) > 0).astype(int)
    net = quality.fit(x, y, np.arange(4000) % 4 == 0)
    fresh = rng.normal(size=(4000, quality.WIDTH))
    truth, score = fresh[:, 0] + rng.normal(size=4000) > 0, net.score(fresh)
    sure = score > 0.8
    assert net.temperature > 1 and abs(truth[sure].mean() - score[sure].mean()) < 0.12


# --- languages ---------------------------------------------------------------------------------------

def test_languages_on_held_out_rows(larger):
    out = langid.identify(larger).join(larger.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    sure = [r for r in out if not r["rejected"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in sure]) >= np.mean([r["lang"] == r["lang_pred"] for r in out])


def test_an_id_on_many_rows_is_one_text_among_others(spark):
    """One id stands on 20,000 rows; the bound is one of texts, and no text loses its share to it."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    one = next(i for i in range(9) if plain.fold(i, 3) != 1)
    rows = [(one, "again and again the same", "en")] * 20_000
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(300)), "en") for i in range(30)]
    docs = spark.createDataFrame([r for r in rows if plain.fold(r[0], 3) != 1], "doc_id long, text string, lang string")
    content = langid.dictionaries(docs)["en"]
    assert content.count(b"again and again") == 1 and len(content) > 37_000  # all texts, whole
    many = spark.createDataFrame([(one, f"text {chr(97 + i % 26)} number {chr(97 + i // 26)}", "en") for i in range(600)],
                                 "doc_id long, text string, lang string")
    assert len(langid.dictionaries(many)["en"].split()) == 4 * langid.TEXTS


def test_languages_of_edge_rows(docs, rows, no_docs):
    out = langid.identify(docs).collect()
    known = {r[2] for r in rows if r[2] is not None}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["lang_pred"] in known | {"und"} for r in out)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        if r["doc_id"] in range(100_000, 100_013):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
        assert r["held_out"] == (r["doc_id"] is not None and plain.fold(r["doc_id"], 3) == 1)
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_dictionaries_are_spread_over_each_text(spark):
    def words(name, n):
        return " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))

    rows = [(i, f"{words('head', 300)} {words(f'own{chr(97 + i % 26)}', 500)} {words('tail', 60)} last{chr(97 + i // 26)}x", "en")
            for i in range(330)] + [(900, "kort", "nl"), (901, "kort " * 50_000, "nl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if plain.fold(r[0], 3) != 1 and r[2] == "en"]
    content = langid.dictionaries(docs)
    english = content["en"]
    assert 95_000 < len(english) <= langid.DICTIONARY_BYTES and len(content.get("nl", b"")) <= langid.DICTIONARY_BYTES
    # every learned text has its end in it, and its middle
    assert english.count(b"last") == min(langid.TEXTS, len(learned)) and english.count(b"own") > 2 * langid.TEXTS
    assert langid.share_of([10, 10**6, 10**6]) == (langid.DICTIONARY_BYTES - 10) // 2
    assert langid.spread(b"abc", 3) == b"abc" and len(langid.spread(b"x" * 10**6, 400)) <= 400


# --- secrets ---------------------------------------------------------------------------------------

def test_random_tokens_are_told_from_words(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in range(28, 68)]
    dull = [f"Aa1{'Aa1' * (8 + i)}" for i in range(30)] + [f"Chapter{'0' * 20}{i}x" for i in range(30)]
    docs = spark.createDataFrame(
        [(i, f"see {t} there") for i, t in enumerate(keys + dull)] + [(999, "plain words only"), (998, None)],
        "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.find_secrets(docs).filter(F.size("spans") > 0).collect()}
    assert len(found & set(range(40))) >= 37 and not found & set(range(40, 100)) and 999 not in found
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(docs).collect()}
    assert sum(t == f"see {secret_scan.MASK} there" for t in hidden.values()) == len(found)
    assert hidden[998] is None and hidden[999] == "plain words only"


def test_p_values_keep_their_rate_in_the_tail():
    rng = random.Random(8)
    for name, _, alphabet in secret_scan._ENCODINGS:
        for n in (24, 33, 64, 90):
            found = [secret_scan.p_value("".join(rng.choices(alphabet, k=n)), name, alphabet) for _ in range(4000)]
            for limit, most in ((0.05, 0.058), (0.01, 0.014), (0.001, 0.0025)):
                assert sum(p <= limit for p in found) <= most * len(found), (name, n, limit)
            assert sum(p <= 0.05 for p in found) >= 0.02 * len(found)
    assert secret_scan.p_value("0" * 24, "hex", "0123456789abcdef") < 1e-6
    assert secret_scan.p_value("0f" * 12, "hex", "0123456789abcdef") < 1e-5
    assert secret_scan.p_value("0123456789abcdef" * 4, "hex", "0123456789abcdef") < 1e-4


def test_null_distributions_equal_all_tokens_counted():
    def squares(token):
        return sum(token.count(c) ** 2 for c in set(token))

    for k, n in ((2, 9), (3, 7), (4, 5)):
        tokens = list(itertools.product(range(k), repeat=n))
        every = [squares(t) for t in tokens]
        up, down = secret_scan._square_tails(k, n)
        for s in set(every):
            assert abs(up[s] - sum(e <= s for e in every) / len(every)) < 1e-9
            assert abs(down[s] - sum(e >= s for e in every) / len(every)) < 1e-9
    flips = [sum(a != b for a, b in zip(t, t[1:])) for t in itertools.product((0, 1), repeat=8)]
    for c in range(8):
        tail = min(sum(f <= c for f in flips), sum(f >= c for f in flips)) / len(flips)
        assert abs(secret_scan.runs_p(8, c) - min(1.0, 2 * tail)) < 1e-12
    # neighbours over all orders of the same symbols: the mean and the spread that the test takes
    x = np.array([0.0, 1.0, 1.0, 5.0, 2.0, 9.0])
    y = x - x.mean()
    r = np.array([(y[list(o)][1:] * y[list(o)][:-1]).sum() / (y * y).sum() for o in itertools.permutations(range(6))])
    z = abs(((y[1:] * y[:-1]).sum() / (y * y).sum() - r.mean()) / r.std())
    assert abs(secret_scan.serial_p(x) - math.erfc(z / math.sqrt(2))) < 1e-9
    assert secret_scan.serial_p(np.ones(24)) == 1.0


def test_random_keys_are_seldom_discarded():
    """Classes of random keys alone: by the false-discovery rule one class in twenty loses any key."""
    rng, lost = random.Random(3), 0
    for _ in range(120):
        bins = Counter(secret_scan.p_bin(secret_scan.p_value("".join(rng.choices("0123456789abcdef", k=24)), "hex",
                                                             "0123456789abcdef")) for _ in range(250))
        lost += secret_scan.discard_limits({("hex", 0): bins})["hex", 0] <= max(bins)
    assert lost <= 12


def test_false_discovery_limits():
    counts = {("hex", 0): {0: 96, 60: 4}, ("hex", 1): {0: 10}}
    limits = secret_scan.discard_limits(counts, 0.05)
    assert limits == {("hex", 0): 60, ("hex", 1): secret_scan.MOST_BINS + 1}


# --- chat ------------------------------------------------------------------------------------------

def test_conversations(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|turn|>x\\<|end|>"), (1, 2, None, None),
            (1, 3, "assistant", ""), (1, 4, "assistant", "é🙂\\"), (-7, 0, "user", own), (-7, 1, "assistant", own),
            (2, 0, "assistant", "<|im_start|>" * 3), (3, 0, "us<|says|>er\n", "\n"), (4, 1, "user", "b"),
            (4, 1, "user", "b"), (4, 0, "assistant", "long " * 50_000), (None, 0, "user", "whose?"),
            (None, 1, "assistant", "nobody's")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    rng = random.Random(1)
    rng.shuffle(rows)
    want = []
    for conv in (1, -7, 2, 3, 4, 5, None):
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        every = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns)
        want.append((conv, len(turns), plain.sha(every), len(loss), plain.sha(loss)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversation_report(table.withColumn("rank", F.lit("x")))
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert as_set(map(tuple, out.select(columns).collect())) == as_set(want)
    texts = [r["formatted"] for r in chat.format_trees(chat.linear_tree(table)).collect()]
    bare = "".join(texts).replace(chat.TURN, "").replace(chat.SAYS, "").replace(chat.END, "")
    assert not any(s in bare for s in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
    assert chat.conversation_report(table.limit(0)).count() == 0


def test_best_paths_of_trees(spark):
    rng = random.Random(9)
    nodes = []
    for conv in range(12):
        for node in range(1, 40):
            parent = rng.choice([None, *range(1, node)]) if node > 1 else None
            nodes.append((conv, node, parent if rng.random() > 0.05 else node + 5, float(rng.randrange(4)),
                          rng.choice(["user", "assistant"]), f"{conv}.{node}"))
    table = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, score double, role string, text string")
    want = []
    for conv in range(12):
        own = {n[1]: n for n in nodes if n[0] == conv}
        up = {i: n[2] if n[2] in own and n[2] < i else None for i, n in own.items()}
        leaves = []
        for leaf in set(own) - set(up.values()):
            path, at = [], leaf
            while at:
                path.append(at)
                at = up[at]
            leaves.append((-sum(own[i][3] for i in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(leaves)[:3], 1):
            want.append((conv, leaf, rank, [(own[i][4], own[i][5]) for i in path]))
    out = chat.format_trees(table, top=3).collect()
    assert as_set((r["conv_id"], r["leaf_id"], r["rank"], chat.read_back(r["formatted"])) for r in out) == as_set(want)


# --- Matroska --------------------------------------------------------------------------------------

def test_media(docs, rows, no_docs):
    out = {}
    for r in matroska.media_report(docs).collect():
        out.setdefault(r["payload_sha256"], []).append(r)
    for _, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        row = out[hashlib.sha256(payload).hexdigest()][0]
        assert row["payload_bytes"] == len(payload) and row["tail_crc32"] == zlib.crc32(payload[-16:])
        assert row["n_bytes"] <= len(payload) < row["media_bytes"]
    assert sum(map(len, out.values())) == len(rows)
    for same in out.values():
        assert len({tuple(r)[2:] for r in same}) == 1
    assert matroska.media_report(no_docs).count() == 0


def test_packet_table(spark):
    payload = bytes(range(256)) * 3 * 1000
    data = matroska.write(payload)
    table = matroska.packet_table(spark.createDataFrame(
        [(1, bytearray(data)), (2, bytearray(b"junk")), (3, None), (4, bytearray(data[:-9]))], "doc_id long, media binary"))
    rows = table.filter("doc_id = 1").orderBy("packet").collect()
    assert b"".join(data[r["offset"]:r["offset"] + r["size"]] for r in rows) == payload
    assert [r["timestamp"] for r in rows] == [24 * i for i in range(4000)]
    assert sum(r["cue"] for r in rows) == 4 and all(r["keyframe"] and r["track"] == 1 for r in rows)
    assert {r["doc_id"] for r in table.filter("error IS NOT NULL").collect()} == {2, 3, 4}


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing_and_unknown_sizes(lacing):
    sizes = [600] if lacing == 0 else [300] * 4 if lacing == 2 else [10, 700, 255, 254, 0, 300]
    frames = [bytes([65 + i]) * n for i, n in enumerate(sizes)]
    head = bytes([len(sizes) - 1]) if lacing else b""
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        head += matroska.vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            head += ((b - a + 8191) | 0x4000).to_bytes(2, "big")
    block = struct.pack(">BhB", 0x82, -5, lacing << 1) + head + b"".join(frames)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    cluster = matroska.unsigned(matroska.TIMESTAMP, 1000) + group
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    cue = matroska.element(matroska.CUES, matroska.element(
        matroska.CUE_POINT, matroska.unsigned(matroska.CUE_TIME, 995), matroska.element(
            matroska.CUE_POSITIONS, matroska.unsigned(matroska.CUE_TRACK, 2), matroska.unsigned(matroska.CUE_CLUSTER, 0))))
    segment = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + cluster + unknown + cluster + cue
    data = matroska.element(matroska.EBML) + segment
    packets, cues = matroska.parse(data)
    assert [data[p.offset:p.offset + p.size] for p in packets] == frames * 2
    assert packets[0].timestamp == 995 and packets[0].track == 2 and cues == [matroska.Cue(995, 2, 0, -1)]


def test_deep_nesting_is_an_error_row(spark):
    inner = matroska.element(matroska.BLOCK_GROUP)
    for _ in range(3000):
        inner = matroska.element(matroska.BLOCK_GROUP, inner)
    deep = matroska.element(matroska.EBML) + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, inner))
    good = matroska.write(b"x" * 192)
    rows = matroska.packet_table(spark.createDataFrame(
        [(1, bytearray(deep)), (2, bytearray(good))], "doc_id long, media binary")).collect()
    assert {(r["doc_id"], r["packet"], (r["error"] or "")[:13]) for r in rows} == {(1, None, "nested deeper"), (2, 0, "")}
    assert {(r["track_type"], r["codec"]) for r in rows if r["doc_id"] == 2} == {(2, "A_PCM/INT/LIT")}


def test_times_by_the_scale_and_frame_time_of_the_file():
    block = struct.pack(">BhB", 0x81, 3, 0x84) + bytes([1]) + b"ab"
    tracks = matroska.element(matroska.TRACKS, matroska.element(
        matroska.TRACK_ENTRY, matroska.unsigned(matroska.TRACK_NUMBER, 1), matroska.unsigned(matroska.TRACK_TYPE, 1),
        matroska.unsigned(matroska.FRAME_TIME, 40_000_000), matroska.element(matroska.CODEC, b"V_X\0")))
    other = struct.pack(">BhB", 0x82, 0, 0x84) + bytes([1]) + b"cd"
    cluster = matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIMESTAMP, 100),
                               matroska.element(matroska.SIMPLE_BLOCK, block), matroska.element(matroska.SIMPLE_BLOCK, other))
    info = matroska.element(matroska.INFO, matroska.unsigned(matroska.SCALE, 2_000_000))
    data = matroska.element(matroska.EBML) + matroska.element(matroska.SEGMENT, info, tracks, cluster)
    packets, _, found = matroska.parse_file(data)
    assert [p.timestamp for p in packets] == [206, 246, 200, 200]
    assert found == {1: matroska.Track(1, "V_X", 40_000_000)}


def rounds_of(spark, edges):
    scratch = Scratch(spark, "rounds")
    found = components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    return {r["node"]: r["component"] for r in found}, (scratch.saved - 2) // 2


@pytest.mark.parametrize("order", ["shuffled", "last is first", "alternating"])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, order):
    n = 1000
    nodes = list(range(n))
    if order == "shuffled":
        random.Random(8).shuffle(nodes)
    elif order == "last is first":
        nodes = [*range(1, n), 0]
    else:
        nodes = [i // 2 if i % 2 else n - 1 - i // 2 for i in range(n)]
    found, rounds = rounds_of(spark, list(zip(nodes, nodes[1:])))
    assert found == dict.fromkeys(range(n), 0) and rounds <= 20


# --- shared, pipeline ----------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    links += [tuple(rng.sample(range(300, 400), 2)) for _ in range(45)]
    top = {n: n for link in links for n in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    rng.shuffle(links)
    out = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    assert as_set(map(tuple, out)) == as_set(top.items())


def test_pipeline(spark, docs, labels, benchmark, tmp_path):
    """Each stage on the result of the one before, against plain versions of its decision."""
    for name, table in (("documents", docs.drop("node", "size", "spans")), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    before = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in benchmark.collect()]
    predicted = {r["doc_id"]: r["predicted"] for r in quality.score_quality(before, labels).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{sf}/{k}")
        after = spark.read.parquet(f"{sf}/{k}")
        old = [(r["doc_id"], r["text"]) for r in before.collect()]
        new = [(r["doc_id"], r["text"]) for r in after.collect()] if name != "mixing" else None
        if name != "mixing":
            assert after.columns == before.columns
        if name == "quality":
            assert {d for d, _ in new} == {d for d, p in predicted.items() if p} and len(new) < len(old)
        elif name == "near_dedup":
            kept = {d for d, _, c, own in plain.near_duplicates(old, 5, 80) if own or d is None}
            assert as_set(new) == as_set(r for r in old if r[0] in kept) and len(new) < len(old)
        elif name == "decontamination":
            dirty = {r[0] for r in plain.contamination(old, items) if r[-1]}
            assert dirty and not any(r[-1] for r in plain.contamination(new, items))
            assert as_set(r for r in new if r[0] not in dirty) == as_set(r for r in old if r[0] not in dirty)
        elif name == "secrets":
            assert not any(plain.base_spans(t) for _, t in new) and len(new) == len(old)
            assert all(t == u for (_, t), (_, u) in zip(sorted(old, key=str), sorted(new, key=str)) if not plain.base_spans(t))
        else:
            sizes = as_set((r["doc_id"], r["size"]) for r in after.collect())
            assert sizes == as_set((d, len(plain.WHITE.findall(t or ""))) for d, t in old)
        before = after
    whole = corpus_pipeline.run(spark, sf)
    assert as_set(map(tuple, whole.collect())) == as_set(map(tuple, after.collect()))
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
