"""A Merkle tree over rows, kept in blocks that are laid out in van Emde Boas order.

Every source is a tree of fan-out 16 over its rows; the roots of the sources are the leaves of
one more such tree.  A tree is cut into aligned blocks of four node levels (4,096 leaves).  The
nodes of a block lie in one array: the subtree is split at half its height, the top half comes
first, the bottom subtrees follow in order, and each of them is laid out in the same way.  Where
a node lies is plain arithmetic on its depth and its number, for writing as for reading siblings.
The roots of the blocks are the leaves of the next blocks, until each group has one root; the
paths from there to the blocks below then go the other way, so a leaf's proof is made where its
block lies.  No group is held whole by a task: a block is the largest thing that is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from invoicefields.llm.common import Scratch

FAN = 16
#: Node levels of a block: 16^3 leaves.
HEIGHT = 4
LEAVES = FAN ** (HEIGHT - 1)
DIGEST = 32
#: Bytes that a block keeps for each of its rows: id, whether there is one, digest to be verified.
ROW = 8 + 1 + DIGEST
FOLDS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATHS_AT_ONCE = 256
STEP = "array<struct<left: string, right: string>>"
#: In the tree over the sources, the one group that there is.
ALL = ""


# --- the layout of a block --------------------------------------------------------------------

def size(height: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**height - 1) // (FAN - 1)


@functools.cache
def addresses(height: int, depth: int) -> np.ndarray:
    """Where the nodes at a depth (0: the root) of a tree of ``height`` levels lie, left to right."""
    if height == 1:
        return np.zeros(1, np.int64)
    top = height // 2
    if depth < top:
        return addresses(top, depth)
    bottom = height - top
    inner = addresses(bottom, depth - top)
    starts = size(top) + size(bottom) * np.arange(FAN**top, dtype=np.int64)
    return (starts[:, None] + inner[None, :]).ravel()


class Block:
    """One aligned subtree: its levels are read and written through the addresses alone."""

    def __init__(self, nodes: bytearray, height: int, leaves: int):
        self.nodes, self.height = nodes, height
        counts = [leaves]
        for _ in range(height - 1):
            counts.append(-(-counts[-1] // FAN))
        self.counts = counts[::-1]

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        """Leaves first, then each level from the one below it."""
        block = cls(bytearray(DIGEST * size(height)), height, len(leaves))
        for i, digest in enumerate(leaves):
            block.put(height - 1, i, digest)
        for depth in range(height - 2, -1, -1):
            for i in range(block.counts[depth]):
                block.put(depth, i, hashlib.sha256("".join(block.run(depth + 1, i)).encode()).digest())
        return block

    def put(self, depth: int, i: int, digest: bytes) -> None:
        at = DIGEST * int(addresses(self.height, depth)[i])
        self.nodes[at:at + DIGEST] = digest

    def get(self, depth: int, i: int) -> str:
        at = DIGEST * int(addresses(self.height, depth)[i])
        return self.nodes[at:at + DIGEST].hex()

    def run(self, depth: int, parent: int) -> list[str]:
        """The children of a node, as hex."""
        return [self.get(depth, i) for i in range(FAN * parent, min(FAN * (parent + 1), self.counts[depth]))]

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each leaf the steps up to the root: at each, the siblings left of the node and those right of it."""
        above: list[list[tuple[str, str]]] = [[]]
        for depth in range(1, self.height):
            here = []
            for parent, path in enumerate(above):
                run = self.run(depth, parent)
                here += [[("".join(run[:at]), "".join(run[at + 1:])), *path] for at in range(len(run))]
            above = here
        return above

    def packed(self) -> bytes:
        """Up to the last node that there is."""
        last = max(int(addresses(self.height, d)[:c].max()) for d, c in enumerate(self.counts))
        return bytes(self.nodes[:DIGEST * (last + 1)])


def height_of(group_size: int) -> int:
    """Levels of the blocks of a group: all four if it has several blocks, else as many as its leaves need."""
    height, width = 1, 1
    while width < group_size and height < HEIGHT:
        height, width = height + 1, width * FAN
    return height


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with the siblings of its path."""
    for left, right in steps:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


# --- trees as tables --------------------------------------------------------------------------

def ranked(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``rank`` (from 0) in its ``grp`` and ``grp_size``.

    Sorted by ranges over all groups, so a group of any size is dealt over many tasks; each task
    numbers its part of a group, and what lies before it comes from one row per range and group."""
    schema = T.StructType([*nodes.schema, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                last, seen = grp, seen + 1 if grp == last else 0
                at[i] = seen
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], schema=arrow)

    ranges = nodes.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(
        *[F.asc_nulls_first(c) for c in order])
    numbered = scratch.save(ranges.mapInArrow(number, schema))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (numbered.groupBy("grp", "_part").agg(F.count("*").alias("_n"))
             .select("grp", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                     F.sum("_n").over(whole).alias("grp_size")))
    return (numbered.join(parts, ["grp", "_part"])
            .select(*nodes.columns, (F.col("_before") + F.col("_at")).alias("rank"), "grp_size"))


def by_block(df: DataFrame, work: Callable[[list[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """``work`` on the rows of one ``grp, block``, which are LEAVES at most, in the order of ``rank``."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["grp"], row["block"]) != (held[0]["grp"], held[0]["block"]):
                    yield pa.RecordBatch.from_pylist(list(work(held)), schema=arrow)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(work(held)), schema=arrow)

    dealt = df.withColumn("block", F.floor(F.col("rank") / LEAVES)).repartition("grp", "block")
    return dealt.sortWithinPartitions("grp", "block", "rank").mapInArrow(run, schema)


LEVEL = "grp STRING, block LONG, grp_size LONG, height INT, leaves INT, nodes BINARY, root BINARY, rows BINARY"


def build_level(nodes: DataFrame) -> DataFrame:
    """``grp, rank, grp_size, digest, row`` into blocks; ``row`` (equally long, or null) is carried along."""

    def build(rows: list[dict]) -> Iterator[dict]:
        first = rows[0]
        block = Block.build([r["digest"] for r in rows], height_of(first["grp_size"]))
        yield {"grp": first["grp"], "block": first["block"], "grp_size": first["grp_size"], "height": block.height,
               "leaves": len(rows), "nodes": block.packed(), "root": bytes.fromhex(block.get(0, 0)),
               "rows": b"".join(r["row"] or b"" for r in rows)}

    return by_block(nodes.select("grp", "rank", "grp_size", "digest", "row"), build, LEVEL)


def build(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of blocks, from the leaves up to one root for each group.  Groups that have come to
    one block take no part in further levels."""
    levels = [scratch.save(build_level(nodes))]
    while True:
        open_groups = levels[-1].filter(F.col("grp_size") > LEAVES)
        if open_groups.limit(1).count() == 0:
            return levels
        levels.append(scratch.save(build_level(open_groups.select(
            "grp", F.col("block").alias("rank"), F.ceil(F.col("grp_size") / LEAVES).alias("grp_size"),
            F.col("root").alias("digest"), F.lit(None).cast("binary").alias("row")))))


def roots(levels: list[DataFrame]) -> DataFrame:
    """``grp, root``: of each group the root of the level at which it came to one block."""
    tops = [level.filter(F.col("grp_size") <= LEAVES).select("grp", "root") for level in levels]
    return functools.reduce(DataFrame.unionAll, tops)


def full_paths(row: dict) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, whose path is given, the steps up to the root of the whole."""
    above = [(s["left"], s["right"]) for s in row["path"]]
    return [own + above for own in Block(bytearray(row["nodes"]), row["height"], row["leaves"]).paths()]


def child_paths(level: DataFrame) -> DataFrame:
    """``grp, block, path`` for the blocks whose roots are the leaves of the blocks of ``level``, which
    carry the ``path`` from their own roots upwards.  A path has at most 15 digests for each step."""
    schema = to_arrow_schema(T.StructType.fromDDL(f"grp STRING, block LONG, path {STEP}"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = full_paths(row)
                for start in range(0, len(paths), PATHS_AT_ONCE):
                    some = paths[start:start + PATHS_AT_ONCE]
                    yield pa.RecordBatch.from_pylist(
                        [{"grp": row["grp"], "block": row["block"] * LEAVES + start + i,
                          "path": [{"left": a, "right": b} for a, b in path]} for i, path in enumerate(some)], schema=schema)

    return level.select("grp", "block", "height", "leaves", "nodes", "path").mapInArrow(
        extend, f"grp STRING, block LONG, path {STEP}")


def with_paths(levels: list[DataFrame], above: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The blocks of the lowest level with the path from their roots to the root of the whole.

    ``above`` gives ``grp, path`` from the root of each group (without it that root is the whole's)."""
    none = F.array().cast(STEP)
    paths = None
    for level in reversed(levels):
        top = level.filter(F.col("grp_size") <= LEAVES)
        top = top.withColumn("path", none) if above is None else top.join(above, "grp")
        if paths is not None:
            lower = level.filter(F.col("grp_size") > LEAVES).join(paths, ["grp", "block"])
            top = top.unionByName(lower)
        if level is levels[0]:
            return top
        paths = scratch.save(child_paths(top))
    raise ValueError("no levels")


# --- rows as leaves ---------------------------------------------------------------------------

def field(column: Column) -> Column:
    """``-`` for null, else byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The digest of a row with this text, as hex."""
    parts = [field(text if c == "text" else F.col(c)) for c in FIELDS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suspect(doc_id: Column) -> Column:
    """Is the row one of those whose text is changed after the tree was made?"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


MANIFEST = ("doc_id LONG, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, "
            "verified BOOLEAN")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    ``tampered`` is the text that a row is said to have when it is verified (without it, its own).
    Rows of a source ascend by ``doc_id`` (null first), those that share it by their leaf, so equal
    rows are interchangeable; a null source is a source of its own, apart from an empty one.  Null
    fields are digested as ``-``, which no value is.  Further columns are ignored, an empty table
    gives no rows."""
    scratch = Scratch(docs.sparkSession, "merkle")
    hexed = leaf_of(F.col("text"))
    later = hexed if tampered is None else leaf_of(tampered)
    # a group's name: a source with a mark in front, which keeps null apart from it and before it
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    # the id, a byte that says whether there is one, and the digest that the row is said to have
    row = F.concat(F.to_binary(F.lpad(F.hex(F.coalesce("doc_id", F.lit(0))), 16, "0"), F.lit("hex")),
                   F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), F.unhex(later))
    leaves = scratch.save(docs.select(*FIELDS).select(
        grp.alias("grp"), "doc_id", F.unhex(hexed).alias("digest"), row.alias("row")))
    levels = build(ranked(leaves, ["grp", "doc_id", "digest"], scratch), scratch)

    subroots = roots(levels).select(F.lit(ALL).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"),
                                    F.lit(None).cast("binary").alias("row"))
    sources = scratch.save(ranked(subroots, ["grp", "name"], scratch))
    upper = build(sources, scratch)
    paths = child_paths(with_paths(upper, None, scratch)).withColumnRenamed("block", "rank")
    above = scratch.save(
        sources.join(paths, ["grp", "rank"]).join(F.broadcast(roots(upper)), "grp")  # one row: the root
        .select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root"))

    lowest = with_paths(levels, above.select("grp", "path"), scratch)
    return verified(lowest.join(above.select("grp", "subroot", F.col("root").alias("top")), "grp"))


def verified(blocks: DataFrame) -> DataFrame:
    """The rows of the lowest blocks (``rows, path, subroot, top``), with proofs, each checked by folding."""
    arrow = to_arrow_schema(T.StructType.fromDDL(MANIFEST))

    def prove(row: dict) -> Iterator[dict]:
        subroot, root = row["subroot"].hex(), row["top"].hex()
        block = Block(bytearray(row["nodes"]), row["height"], row["leaves"])
        for i, path in enumerate(full_paths(row)):
            own = row["rows"][ROW * i:ROW * (i + 1)]
            folded = fold(own[9:].hex(), path)
            yield {"doc_id": int.from_bytes(own[:8], "big", signed=True) if own[8] else None,
                   "leaf": block.get(block.height - 1, i), "subroot": subroot, "root": root,
                   "proof_sha256": hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(),
                   "folded_root": folded, "verified": folded == root}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(prove(row)), schema=arrow)

    return blocks.select("height", "leaves", "nodes", "rows", "path", "subroot", "top").mapInArrow(run, MANIFEST)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Every fifth row, by its id, is said to have a text in lower case."""
    text = F.col("text")
    return manifest(docs, F.when(suspect(F.col("doc_id")), lowered(text)).otherwise(text))
