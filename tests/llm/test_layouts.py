"""Fill-in-the-middle and the Merkle manifest against plain versions, and their layouts alone."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoicefields.llm import fim, merkle
from llm.conftest import SCHEMA, as_set
from llm.plain import LOWER, sha


# --- boundary sets -------------------------------------------------------------------------------

def offsets(rng, top, singles, runs):
    found = {0} | {rng.randrange(top) for _ in range(singles)}
    for _ in range(runs):
        start = rng.randrange(top)
        found |= set(range(start, min(top, start + rng.randrange(9000))))
    return np.array(sorted(found), np.int64)


@pytest.mark.parametrize("top, singles, runs, kinds", [
    (10, 0, 0, {"ArrayContainer"}), (65_536, 3000, 0, {"ArrayContainer"}), (65_536, 30_000, 0, {"BitmapContainer"}),
    (65_536, 0, 4, {"RunContainer"}), (10**6, 20_000, 0, {"ArrayContainer"}), (300_000, 40_000, 3, None)])
def test_select_of_every_member(top, singles, runs, kinds):
    values = offsets(random.Random(top + singles), top, singles, runs)
    held = fim.BoundarySet(values)
    assert len(held) == len(values)
    assert [held.select(k) for k in range(len(values))] == values.tolist()
    assert kinds is None or {type(c).__name__ for c in held.containers} == kinds


def test_all_kinds_of_containers_in_one_set():
    run, dense, few = np.arange(70_000), 2 * 65_536 + 2 * np.arange(30_000), np.array([9 * 65_536 + 5, 9 * 65_536 + 900])
    values = np.concatenate([run, dense, few])
    held = fim.BoundarySet(values)
    assert [type(c).__name__ for c in held.containers] == ["RunContainer", "RunContainer", "BitmapContainer", "ArrayContainer"]
    assert [held.select(k) for k in range(0, len(values), 7)] == values[::7].tolist()


# --- fill in the middle ----------------------------------------------------------------------------

def plain_fim(doc_id, text):
    import re
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(rows):
    rng = random.Random(2)
    more = ["\n", "\n\n\n", "a\n", "\na", "x <P> y\nz", "<S", "<M><", "<\nP>\n<S\n>", "é\n語\n\U0001f600\n\r\n", "a\r\nb\rc"]
    more += ["".join(rng.choice(["a", "\n", "é", "<", ">", "P", "S", "M"]) for _ in range(60)) for _ in range(80)]
    more += ["\n" * 70_000, "\n".join("é" * rng.randrange(3) for _ in range(90_000)), "x\n" * 50_000]
    return [*rows, *((10**6 + i, t, "en", "s", 1) for i, t in enumerate(more))]


@pytest.fixture(scope="module")
def cut_docs(spark, rows):
    return spark.createDataFrame([(*r, "n", "z", "p") for r in fim_rows(rows)], SCHEMA).repartition(5).cache()


def test_fim_equals_plain(cut_docs, rows):
    got = as_set(fim.fill_in_middle(cut_docs).collect())
    assert got == as_set(plain_fim(r[0], r[1]) for r in fim_rows(rows))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_is_undone_from_output_and_form(cut_docs, rows):
    out = fim.fill_in_middle(cut_docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert as_set(out.collect()) == as_set((r[0], r[1] or "") for r in fim_rows(rows))


def test_fim_by_characters_with_other_marks_and_rates(cut_docs, rows):
    marks = fim.Marks("[pre]", "[suf]", "[mid]")
    out = fim.fill_in_middle(cut_docs, seed=3, rate=60, spm_share=100, marks=marks, unit="char")
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert as_set(back.collect()) == as_set((r[0], r[1] or "") for r in fim_rows(rows))
    forms = [r["form"] for r in out.select("form").collect()]
    assert set(forms) == {"plain", "spm"} and 0.4 < forms.count("spm") / len(forms) < 0.75
    assert all(r["n"] == len(r["output"]) for r in out.filter("form = 'plain'").collect())
    with pytest.raises(ValueError):
        fim.fill_in_middle(cut_docs, unit="word")


def test_fim_of_no_rows(no_docs):
    assert fim.fim_report(no_docs).collect() == []


# --- the layout of a block ---------------------------------------------------------------------------

@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_addresses_are_a_permutation(height):
    all_of_them = np.concatenate([merkle.addresses(height, d) for d in range(height)])
    assert sorted(all_of_them) == list(range(merkle.size(height)))


def test_halves_lie_together():
    """Four levels: 17 nodes above, then each subtree of the lower half in one stretch of 17."""
    assert merkle.addresses(4, 0).tolist() == [0] and sorted(merkle.addresses(4, 1)) == list(range(1, 17))
    for tree in (0, 1, 100, 255):
        inside = [merkle.addresses(4, 2)[tree], *merkle.addresses(4, 3)[16 * tree:16 * tree + 16]]
        assert inside == list(range(17 + 17 * tree, 34 + 17 * tree))


def parents(digests):
    return [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 256, 257, 1000, 4096])
def test_block_against_plain_levels(n):
    leaves = [sha(str(i)) for i in range(n)]
    block = merkle.Block.build([bytes.fromhex(x) for x in leaves], merkle.height_of(n))
    again = merkle.Block(bytearray(block.packed()), block.height, n)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(parents(levels[-1]))
    assert block.height == len(levels)
    for depth, level in enumerate(reversed(levels)):
        assert [again.get(depth, i) for i in range(len(level))] == level
    for i, path in enumerate(again.paths()):
        assert merkle.fold(leaves[i], path) == levels[-1][0]


# --- the manifest -------------------------------------------------------------------------------------

def leaf(row):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row
    return sha("".join(part(v) for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """The root, and for each leaf its steps (siblings on the left, on the right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        level, at = parents(level), [i // 16 for i in at]
    return level[0], paths


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for r, path in zip(own, paths):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            folded = leaf((r[0], text, *r[2:]))
            steps = path + up
            for a, b in steps:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in steps))
            out.append((r[0], leaf(r), subroot, root, proof, folded, folded == root))
    return out


def test_manifest_equals_plain(docs, rows):
    got = as_set(merkle.manifest_report(docs).collect())
    assert got == as_set(plain_manifest(rows))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_large_and_many_sources(spark):
    """A source of several blocks whose last has one leaf, one of exactly one block, and 300 of one row."""
    rows = [(i, f"T{i}", None, "big", i) for i in range(2 * merkle.LEAVES + 1)]
    rows += [(i, f"T{i}", None, "even", None) for i in range(merkle.LEAVES)]
    rows += [(-i, "Row", "x", f"one{i}" if i else None, 3) for i in range(300)] + [(5, "Row", "x", "", 3)]
    docs = spark.createDataFrame([(*r, "n", "z", "p") for r in rows], SCHEMA).repartition(7)
    assert as_set(merkle.manifest_report(docs).collect()) == as_set(plain_manifest(rows))


def test_manifest_without_changes_verifies(docs):
    out = merkle.manifest(docs)
    assert out.filter("NOT verified OR folded_root != root").count() == 0


def test_manifest_of_one_row_and_of_none(spark, no_docs):
    assert merkle.manifest_report(no_docs).collect() == []
    one = spark.createDataFrame([(3, "AB", None, None, 2, "n", "z", "p")], SCHEMA)
    row = merkle.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf((3, "AB", None, None, 2))
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
