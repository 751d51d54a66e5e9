"""Token counts by a digest cache.

The key of a count is the digest of the content and that of the tokenizer's file.  Contents are
joined to the stored counts; each distinct content that has none is encoded once and appended.
Only digests are joined to the cache.  Texts cross the network once, after each task has dropped its
own repeats and, where there is a cache, what a Bloom filter of the missing digests rules out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicefields.llm.common import WORDS_HELD, Scratch, blocks
from invoicefields.sources.storage import exists

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
COUNTS = "content_digest STRING, tokenizer_digest STRING, n_tokens LONG"
#: Bits of the Bloom filter for each missing digest, and in all (16 MB, broadcast): beyond 8 million
#: misses the filter rules out less, and loses none.
BITS_EACH = 16
MOST_BITS = 1 << 27
PROBES = 4
BITMAP_BITS = 32768  # fixed value: bits of one of Spark's bitmaps
_SEGMENT = re.compile(" +[^ ]*")


class Counter:
    """Counts tokens of a SentencePiece model.

    If no piece has a blank after another character, blanks start pieces only, and a text may be
    counted in segments (blanks and what follows up to the next blank), each remembered.  That is
    looked up in the model; otherwise texts are counted whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        blank, spec = "▁", proto.normalizer_spec
        self.segments = (
            spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces and spec.escape_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and any(p.piece == blank for p in proto.pieces)
            and not any(p.type == p.USER_DEFINED for p in proto.pieces)
            and not any(blank in p.piece.lstrip(blank) for p in proto.pieces))
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.segments or "▁" in text or "\0" in text:
            return len(self.model.encode(text, num_threads=1))
        parts = _SEGMENT.findall(" " + text)
        try:
            return sum(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) >= WORDS_HELD:
                self.known.clear()
            new = [p for p in dict.fromkeys(parts) if p not in self.known]
            for part, pieces in zip(new, self.model.encode([p[1:] for p in new], num_threads=1)):
                self.known[part] = len(pieces) if len(part) > 1 else 1
            return sum(map(self.known.__getitem__, parts))


def tokenizer_digest(name: str) -> str:
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _digest():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def _cached(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], COUNTS)


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, one count for each key; empty where there is none yet."""
    return _cached(spark, cache).groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def bloom_filter(digests: DataFrame, count: int) -> np.ndarray:
    """Bytes of a Bloom filter of ``content_digest`` (hex): a power of two of bits, MOST_BITS at most.
    A digest sets PROBES bits, named by its groups of eight digits."""
    bits = min(MOST_BITS, max(BITMAP_BITS, 1 << (count * BITS_EACH - 1).bit_length()))
    digits = [F.substring("content_digest", 1 + 8 * k, 8) for k in range(PROBES)]
    at = F.explode(F.array(*[F.conv(d, 16, 10).cast("long") % bits + 1 for d in digits]))
    maps = (digests.select(at.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")))
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for row in maps.toLocalIterator():
        out[row["bucket"] - 1] = np.frombuffer(row["map"], np.uint8)
    return out.reshape(-1)


def may_hold(bloom: np.ndarray, digests: list[str]) -> np.ndarray:
    """Which digests the filter does not rule out."""
    at = np.frombuffer(bytes.fromhex("".join(d[:8 * PROBES] for d in digests)), ">u4").reshape(-1, PROBES)
    at = at.astype(np.int64) % (8 * len(bloom))
    return ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def add_misses(docs: DataFrame, cache: str, model: str = MODEL) -> None:
    """Encodes each distinct text without a stored count once and appends the counts.

    Where there is a cache, digests are joined to it first; the misses are stored, and texts that
    are none of them stay where they are, but for the few that the Bloom filter lets through, which the
    exact join behind it drops.  Two jobs that append the same key store the same count twice, which
    readers merge."""
    spark, version = docs.sparkSession, tokenizer_digest(model)
    texts = docs.select(_digest().alias("content_digest"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = missing = bloom = None
    if exists(spark, cache):
        scratch = Scratch(spark, "token-misses")
        known = _cached(spark, cache).filter(F.col("tokenizer_digest") == version).select("content_digest")
        missing = scratch.save(texts.select("content_digest").distinct().join(known, "content_digest", "left_anti"))
        count = missing.count()
        if not count:
            scratch.free(missing)
            return
        bloom = spark.sparkContext.broadcast(bloom_filter(missing, count))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests, new = batch.column("content_digest").to_pylist(), []
            wanted = may_hold(bloom.value, digests).tolist() if bloom else [True] * len(digests)
            for digest, ask in zip(digests, wanted):
                if len(seen) >= WORDS_HELD:
                    seen.clear()
                new.append(ask and digest not in seen)
                if ask:
                    seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))

    misses = texts.mapInArrow(once, texts.schema).repartition("content_digest")
    if missing is not None:
        misses = misses.join(missing, "content_digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = Counter(public_tokenizers.path(model)), set()
        for block in blocks(batches):
            rows = []
            for digest, text in zip(block.column("content_digest").to_pylist(), block.column("text").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, counter.count(text)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([version] * len(rows)),
                     pa.array([r[1] for r in rows], pa.int64())],
                    names=["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, COUNTS).write.mode("append").parquet(cache)
    if scratch is not None:
        bloom.unpersist()
        scratch.free(missing)


def count_tokens(docs: DataFrame, cache: str | None = None, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, from the cache at ``cache`` (a folder
    that all machines share; without one, a new cache is made for this call).

    A null text counts as empty and has no tokens.  Repeated texts, null ids and repeated ids are
    counted row by row; other columns are ignored.
    """
    scratch = None
    if cache is None:
        scratch = Scratch(docs.sparkSession, "token-cache")
        cache = f"{scratch.root}/counts"
    add_misses(docs, cache, model)
    counts = stored_counts(docs.sparkSession, cache).filter(F.col("tokenizer_digest") == tokenizer_digest(model))
    out = (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       _digest().alias("content_digest"))
           .join(counts, "content_digest", "left")
           .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
    out._scratch = scratch
    return out
