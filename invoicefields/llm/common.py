"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from invoicefields.sources.storage import shared_folder

#: Text that a task works on at once.  A longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Words whose hashes a task remembers before it starts anew.
WORDS_HELD = 1 << 19
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Scratch:
    """Stored tables of one job, in the folder that all machines share.

    What has been read for the last time is freed at once; what a returned table still reads
    goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved = 0
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.deleteOnExit(root)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.saved}"
        self.saved += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch, out._stored_at = self, path
        return out

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            self.files.delete(path, True)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts together have BLOCK_BYTES at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_blocks(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], ddl: str) -> DataFrame:
    """``work`` turns a block into columns (lists or arrays) of the schema ``ddl``."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            if (out := work(block)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array)
                     else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def rewrite(df: DataFrame, work: Callable[[list[str | None]], list[str | None]],
            keep: Callable[[list[str | None]], list[bool]] | None = None) -> DataFrame:
    """The same table with other texts, ``n_chars`` with them, or without the rows whose ``keep``
    is false.  Further columns pass through as they are, whatever they are called."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            if keep is not None:
                yield block.filter(pa.array(keep(texts), pa.bool_()))
                continue
            new = work(texts)
            arrays = list(block.columns)
            arrays[block.schema.get_field_index("text")] = pa.array(new, block.schema.field("text").type)
            at = block.schema.get_field_index("n_chars")
            if at >= 0:
                old = arrays[at].to_pylist()
                sizes = [o if a == b else None if b is None else len(b) for o, a, b in zip(old, texts, new)]
                arrays[at] = pa.array(sizes, block.schema.field(at).type)
            # A row that lost all of its text is no document any more.
            there = [bool(b) or not a for a, b in zip(texts, new)]
            yield pa.RecordBatch.from_arrays(arrays, schema=block.schema).filter(pa.array(there, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def utf8(block: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return block.column(column).cast(pa.large_binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(column, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b`` (links) to ``node, component``, the smallest node reachable.

    Every node has a label, at first its smallest neighbour or itself.  In each round a node looks at
    the labels of its neighbours' labels; the smallest of them becomes its own label and also that of
    the node that is its label, so whole trees are hooked at once, and labels of labels are taken over.
    The rounds grow with the logarithm of a component, whatever the order of its nodes.  A hot node is
    met by partial minima and by joins that adaptive execution splits.
    """
    edges = scratch.save(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct())
    labels = scratch.save(edges.groupBy(F.col("a").alias("node"))
                          .agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        tops = scratch.save(labels.select("node", "component").join(up, "component"))
        near = (edges.join(tops.select(F.col("node").alias("b"), "top"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near")))
        own = F.struct("node", F.least("component", "top", "near").alias("label"), F.col("component").alias("old"))
        hooked = F.struct(F.col("component").alias("node"), F.col("near").alias("label"), F.lit(None).alias("old"))
        moved = scratch.save(
            tops.join(near, "node").select(F.explode(F.array(own, hooked)).alias("_")).select("_.*")
            .groupBy("node").agg(F.min("label").alias("component"), F.min("old").alias("old")))
        changed = moved.filter("component != old").limit(1).count()
        scratch.free(labels, tops)
        labels = moved
        if not changed:
            scratch.free(edges)
            return labels.drop("old")
