"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from labelled text.  A text is
compressed with every dictionary, and the language whose dictionary leaves the fewest bytes is
chosen.  The margin to the second is the score; narrow margins are marked as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invoicefields.llm.common import fold, map_blocks

FOLDS, HELD_OUT = 3, 1
#: A dictionary has at most so many bytes, from at most so many labelled texts of its language
#: (those with the smallest hash of their id).  All of them have a part in it; of a text that is
#: longer than its share, so many pieces at even distances from its begin to its end.
DICTIONARY_BYTES, TEXTS, PIECES = 100 << 10, 256, 4
LEVEL = 6
#: Bytes compressed at once; a longer text is compressed in pieces, all of them.
PIECE = 16 << 10
LEAST_MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: A-Z as a-z; other ASCII that is no letter as a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case without punctuation, digits and repeated blanks."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def share_of(sizes: list[int]) -> int:
    """The largest share with which texts of these sizes, each up to the share, fill a dictionary."""
    left = DICTIONARY_BYTES
    for i, size in enumerate(sorted(sizes)):
        if size > (share := left // (len(sizes) - i)):
            return share
        left -= size
    return DICTIONARY_BYTES


def spread(raw: bytes, share: int) -> bytes:
    """All of a text, or pieces of ``share`` bytes in all, the first at its begin, the last at its end."""
    if len(raw) <= share:
        return raw
    size = (share - PIECES) // PIECES
    if size < 1:
        return raw[:max(share, 0)]
    starts = [k * (len(raw) - size) // (PIECES - 1) for k in range(PIECES)]
    return b" ".join(raw[i:i + size] for i in starts)


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, of rows outside of the held-out fold that have a language,
    an id and a letter.  Texts are read whole where they are; only their shares are collected."""
    learn = docs.filter(
        "lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    hashed = learn.select("lang", "text", F.xxhash64("doc_id").alias("turn"), "doc_id",
                          F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    # Distinct texts are ranked, not ids: an id may stand on any number of rows, a text too.
    texts = hashed.groupBy("lang", "digest").agg(F.min(F.struct("turn", "doc_id")).alias("first"))
    first = Window.partitionBy("lang").orderBy("first", "digest")
    chosen = (texts.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TEXTS)
              .select("lang", "digest", F.col("first.turn").alias("turn")))
    rows = (hashed.select("lang", "digest", "text").join(F.broadcast(chosen), ["lang", "digest"])
            .groupBy("lang", "digest").agg(F.first("text").alias("text"), F.first("turn").alias("turn")))

    def measure(block: pa.RecordBatch) -> dict:
        return {"lang": block.column("lang"), "size": [
            len(plain(t)) + 1 if _LETTER.search(t) else 0 for t in block.column("text").to_pylist()]}

    sizes: dict[str, list[int]] = {}
    for lang, size in map_blocks(rows.select("lang", "text"), measure, "lang STRING, size LONG").filter("size > 0").collect():
        sizes.setdefault(lang, []).append(size)
    shares = {lang: share_of(own) - 1 for lang, own in sizes.items()}

    def take(block: pa.RecordBatch) -> dict:
        texts = zip(block.column("lang").to_pylist(), block.column("text").to_pylist())
        return {"lang": block.column("lang"), "turn": block.column("turn"), "part": [
            spread(plain(t), shares[lang]) if _LETTER.search(t) else None for lang, t in texts]}

    parts = map_blocks(rows.select("lang", "turn", "text"), take, "lang STRING, turn LONG, part BINARY")
    content: dict[str, bytes] = {}
    for lang, _, part in sorted((r[0], r[1], bytes(r[2])) for r in parts.filter("part IS NOT NULL").collect()):
        content[lang] = (content.get(lang, b"") + part + b" ")[:DICTIONARY_BYTES]
    return content


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.languages = sorted(content)
        self.compressors = []
        for lang in self.languages:
            shared = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is narrow."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = plain(text)
        sizes = [sum(len(c.compress(raw[i:i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self.compressors]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        score = 1.0 if len(order) == 1 else (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.languages[order[0]], score, score < LEAST_MARGIN


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row.

    ``score``: by which share the best dictionary beats the second (1 with one language).
    ``rejected``: the margin is below LEAST_MARGIN.  A null text and one without a letter are
    ``und`` with score 0, rejected, and so is every text if no language was learned.  Equal sizes go to
    the language first by code point.  A null id is not held out.  Repeated rows are judged alike;
    other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries(docs))
    made: list[Classifier] = []

    def work(block: pa.RecordBatch) -> dict:
        if not made:
            made.append(Classifier(sent.value))
        found = [made[0].predict(t) for t in block.column("text").to_pylist()]
        return {"doc_id": block.column("doc_id"), "held_out": block.column("held_out"),
                **{k: [f[i] for f in found] for i, k in enumerate(("lang_pred", "score", "rejected"))}}

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return map_blocks(docs.select("doc_id", "text", held_out.alias("held_out")), work,
                      "doc_id LONG, held_out BOOLEAN, lang_pred STRING, score DOUBLE, rejected BOOLEAN")
