"""Operator 7: token counts of whole texts, huge ones by overlapping chunks.

A subword merge never crosses a pair of neighbouring characters that no piece of
the vocabulary holds side by side, so a cut at such a pair leaves the tokens on
both sides as they are in the whole text: the boundary is proven stable. A huge
document is encoded in overlapping chunks with offsets. Two neighbours are spliced
at a boundary inside their overlap that both encodings have and that is proven
stable; where there is none, the overlap is widened, up to the rest of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import in_slices, table, thrifty

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Texts of more characters than this are encoded in chunks.
CHUNK = 16_384
OVERLAP = 256
SPACE = "▁"


class Pieces:
    """A sentencepiece model with the neighbouring characters that its pieces hold."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i) and not self.model.is_control(i)]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def stable(self, before: str, after: str) -> bool:
        """No merge can cross from one character to the next."""
        return before.replace(" ", SPACE) + after.replace(" ", SPACE) not in self.pairs


def huge_count(text: str, pieces: Pieces, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded chunk by chunk with splices at proven boundaries.

    A chunk after the first is encoded together with the character before it,
    whose tokens end at the splice and are left out.
    """
    total, start, size = 0, 0, len(text)
    while True:
        end, wide = min(size, start + chunk), overlap
        if end == size:
            return total + len(starts(text, start, size, pieces))
        while True:
            head_end = min(size, end + wide)
            cut = splice(text, start, end - min(wide, (end - start) // 2), head_end, pieces)
            if cut is not None:
                total += cut[1]
                start = cut[0]
                break
            if head_end == size:
                return total + len(starts(text, start, size, pieces))
            wide *= 2


def splice(text: str, start: int, low: int, high: int, pieces: Pieces) -> tuple[int, int] | None:
    """The first splice in [low, high): its offset and the tokens of [start, offset).

    The left chunk is [start, high), the right one begins at a candidate and
    reaches to high too; the splice stands if the pair of characters there is
    proven stable, whatever they are, if the left encoding has a token boundary
    between them, and if left and right agree on every boundary of the overlap
    after it.
    """
    left: list[int] | None = None
    for at in range(max(low, start + 1), high):
        if pieces.stable(text[at - 1], text[at]):
            if left is None:
                left = starts(text, start, high, pieces)
            k = bisect_left(left, at)
            if left[k : k + 1] == [at] and starts(text, at, high, pieces) == left[k:]:
                return at, k
    return None


def starts(text: str, start: int, end: int, pieces: Pieces) -> list[int]:
    """Offsets in text at which the tokens of [start, end) begin; byte tokens of one character share theirs and all count."""
    first = max(0, start - 1)  # the space that the model adds stands before the character before start
    raw = np.frombuffer(text[first:end].encode(), np.uint8)
    if not len(raw):
        return []
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1  # the model gives byte offsets
    begins = np.array([p.begin for p in pieces.model.encode(text[first:end], return_type="proto").pieces])
    out = first + chars[np.minimum(begins, len(raw) - 1)]
    return out[out >= start].tolist()


@lru_cache(maxsize=4)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens). Null and empty texts have no tokens; rows may repeat, ids may be null; an empty table stays empty; extra columns don't matter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in in_slices(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            small = [i for i, x in enumerate(texts) if len(x) <= chunk]
            counts = dict(zip(small, pieces.counts([texts[i] for i in small])))
            tokens = [counts[i] if i in counts else huge_count(x, pieces, chunk, overlap) for i, x in enumerate(texts)]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counted.selectExpr("*", f"n_tokens > {LIMIT} AS over_limit")
