"""Near-duplicates by b-bit MinHash, links confirmed on full shingle sets.

1. Each text becomes its set of shingle hashes.  Texts with equal sets are one class.
2. Minima under HASHES functions give a band key for every ROWS of them; of each minimum only
   the lowest BITS bits are kept, as bit planes packed into longs.
3. In each band, a class is paired with the smallest class of its bucket only.  The packed
   signatures tell the similarity (agreeing positions by bit counts, corrected for chance
   agreement); pairs far below the limit go, the rest is compared on full sets.
4. A bucket is settled when all its classes are in one component or each pair was compared.
   Others are dealt out in blocks of bounded size, each pair of blocks to a task, which counts
   common shingles of classes in different components and returns only confirmed links.
So no bucket is capped, no bucket is expanded into all of its pairs, and no two classes that
share a band key and are in different components stay uncompared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicefields.llm.common import LOWER, Scratch, WordHashes, components, map_blocks, mix, utf8

WORDS = 5
LIMIT = 0.8
#: At a similarity of 0.8, bands of 4 among 128 miss a pair in 1 of 10 million cases.
HASHES, ROWS, BITS = 128, 4, 4
#: Standard deviations by which an estimate may lie below the limit before a pair goes.
SLACK = 5
#: Shingles that a block of an unsettled bucket has about.
BLOCK_SHINGLES = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, HASHES, dtype=np.uint64))


def shingles(text: bytes | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``n`` words; with fewer words, one."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h, take = hashes.of(words), min(n, len(words))
    total = np.full(len(h) - take + 1, take, np.uint64)
    for i in range(take):
        total = mix(total * _BASE + h[i:len(h) - take + 1 + i])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and bit planes, a row for each set; sets must not be empty."""
    a, b = _functions()
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    minima = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    bands = np.zeros((len(sets), HASHES // ROWS), np.uint64)
    bands += np.arange(HASHES // ROWS, dtype=np.uint64)
    for r in range(ROWS):
        bands = mix(bands * _BASE + minima[:, r::ROWS])
    planes = [np.packbits(((minima >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
              for bit in range(BITS)]
    return bands.view(np.int64), np.concatenate(planes, axis=1)


SIGNED = "doc_id LONG, n_shingles LONG, node BINARY, bands ARRAY<LONG>, planes ARRAY<LONG>"


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Set size, class, band keys and packed signature of each row; a row without words has the
    size 0 and no class."""
    def work(block: pa.RecordBatch, hashes=WordHashes()) -> dict:
        sets = [shingles(t, hashes, n) for t in utf8(block)]
        full = [s for s in sets if len(s)]
        bands, planes = signatures(full) if full else ([], [])
        rows = iter(zip(bands, planes))
        each = [next(rows) if len(s) else (None, None) for s in sets]
        return {
            "doc_id": block.column("doc_id"), "n_shingles": [len(s) for s in sets],
            "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [x[0] for x in each], "planes": [x[1] for x in each],
        }

    return map_blocks(docs.select("doc_id", "text"), work, SIGNED)


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed signatures: agreeing positions, less those that agree by chance."""
    longs = HASHES // 64
    agree = None
    for i in range(longs):
        differs = None
        for bit in range(BITS):
            one = F.get(x, F.lit(bit * longs + i)).bitwiseXOR(F.get(y, F.lit(bit * longs + i)))
            differs = one if differs is None else differs.bitwiseOR(one)
        same = 64 - F.bit_count(differs)
        agree = same if agree is None else agree + same
    chance = 2.0**-BITS
    return (agree / HASHES - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, n: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: texts are linked if their sets of
    ``n``-word shingles have a Jaccard similarity of ``limit`` (two decimals count) or more.

    A null, empty or wordless text has the empty set and is linked with nothing.  Rows that share
    an id are one document each by its text and may share a component.  A row without an id is
    linked with nothing, its component is null and it is kept.  Other columns are ignored.
    """
    percent = round(limit * 100)
    scratch = Scratch(docs.sparkSession, "minhash")
    sign = scratch.save(signed(docs, n))
    known = sign.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.save(known.dropDuplicates(["node"]).select("doc_id", "node", "n_shingles", "bands", "planes"))
    rows = classes.select(F.explode("bands").alias("band"), "node", "n_shingles")
    buckets = (rows.groupBy("band")
               .agg(F.min("node").alias("centre"), F.count("*").alias("members"), F.sum("n_shingles").alias("mass"))
               .filter("members > 1"))
    shared = scratch.save(rows.join(buckets, "band"))

    def sized(a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_n"),
                              F.col("planes").alias(f"{name}_planes"))

    p = limit + (1 - limit) * 2.0**-BITS
    slack = SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)
    stars = scratch.save(
        shared.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        .join(side("a"), "a").join(side("b"), "b").filter(sized("a_n", "b_n"))
        .filter(estimate(F.col("a_planes"), F.col("b_planes")) >= limit - slack)
        .select("a", "b", "a_n", "b_n"))
    wanted = (stars.select(F.explode(F.array("a", "b")).alias("node"))
              .unionAll(shared.filter("members > 2").select("node")).distinct())
    ids = classes.join(wanted, "node", "left_semi").select("doc_id")

    def full(block: pa.RecordBatch, hashes=WordHashes()) -> dict:
        sets = [shingles(t, hashes, n) for t in utf8(block)]
        return {"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "elements": [s.view(np.int64) for s in sets]}

    sets = scratch.save(map_blocks(
        docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), full, "node BINARY, elements ARRAY<LONG>"))

    def elements(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("elements").alias(f"{name}_set"))

    common = F.size(F.array_intersect("a_set", "b_set"))
    links = scratch.save(
        stars.join(elements("a"), "a").join(elements("b"), "b")
        .filter(common * 100 >= (F.col("a_n") + F.col("b_n") - common) * percent).select("a", "b"))
    first = components(links, scratch)
    labels = first.select("node", F.col("component").alias("label"))
    placed = shared.filter("members > 2").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    unsettled = (placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                 .filter("low != high").select("band"))
    more = _block_links(placed.join(unsettled, "band", "left_semi"), sets, percent)
    every = scratch.save(links.unionAll(more).distinct())
    nodes = components(every, scratch)
    named = (known.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of_node = nodes.join(named, "component").select("node", "component_id")
    own = known.groupBy("node").agg(F.min("doc_id").alias("own_id"))
    of_class = own.join(of_node, "node", "left").select(
        "node", F.coalesce("component_id", "own_id").alias("component_id"))
    placed_rows = sign.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))).join(
        of_class, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return placed_rows.select("doc_id", "n_shingles", component.alias("component_id"),
                              F.equal_null("doc_id", component).alias("kept"))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between classes of different labels in the same band.

    A band is cut into blocks by a hash of the class; each pair of blocks is a group of bounded
    size.  Of the links found in a group only those that join what is not yet joined there are
    returned, fewer than the group has classes."""
    parts = F.ceil(F.col("mass") / BLOCK_SHINGLES).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    paired = (members.select("band", "node", "label", parts.alias("parts"), block.alias("block"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("band", "node", "label", "block",
                      F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        _, label = np.unique(np.array([x.hex() for x in frame["label"]]), return_inverse=True)
        if label.max(initial=0) > 0:
            values = [np.asarray(x, np.int64) for x in frame["elements"]]
            sizes = np.array([len(v) for v in values])
            owner = np.repeat(np.arange(len(values)), sizes)
            _, number = np.unique(np.concatenate(values), return_inverse=True)
            order = np.argsort(number, kind="stable")
            posts, ends = owner[order], np.cumsum(np.bincount(number))
            starts = np.concatenate(([0], ends[:-1]))
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            largest = np.argmax(np.bincount(label))
            joined = {i: i for i in range(label.max() + 1)}

            def top(i: int) -> int:
                while joined[i] != i:
                    i = joined[i]
                return i

            for x in np.flatnonzero(label != largest).tolist():
                mine = number[offsets[x]:offsets[x + 1]]
                near = np.concatenate([posts[starts[s]:ends[s]] for s in mine.tolist()])
                common = np.bincount(near, minlength=len(values))
                hit = (common * 100 >= (sizes + sizes[x] - common) * percent) & (label != label[x])
                for y in np.flatnonzero(hit).tolist():
                    if (p := top(label[x])) != (q := top(label[y])):
                        joined[p] = q
                        found.append((frame["node"].iloc[x], frame["node"].iloc[y]))
        return pd.DataFrame(found, columns=["a", "b"])

    return (paired.join(sets, "node").groupBy("band", "i", "j")
            .applyInPandas(compare, "a BINARY, b BINARY"))


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.  Rows that share
    an id count as one document: they stay or go together."""
    gone = near_duplicates(docs, n, limit).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(
        *["`" + c.replace("`", "``") + "`" for c in docs.columns])
