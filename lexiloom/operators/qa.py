"""Question answering: overlapping features, span labels, offsets and n-best answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiloom.functions.alignment import aligned
from lexiloom.operators.wordpiece import CONTINUED
from lexiloom.storage import fresh


def overflow_features(rows: DataFrame, question: str, context: str, offsets: str, length: int, stride: int, specials: int = 3, overlapping: bool = True) -> DataFrame:
    """A row a chunk: feature_idx, chunk and chunk_offsets of the context's tokens.

    Only the context is cut; neighbouring chunks share `stride` tokens. Without
    overlapping there is one truncated chunk.
    """
    room = F.lit(length - specials) - F.size(question)
    step = room - stride
    size = F.size(context)
    last = F.greatest(F.ceil((size - room) / step).cast("int"), F.lit(0)) if overlapping else F.lit(0)
    first = lambda i: i * step + 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.slice(context, first(i), room).alias("chunk"), F.slice(offsets, first(i), room).alias("chunk_offsets")))
    # each chunk is cut before it becomes a row: no row takes the whole context along unless it is asked for
    found = fresh(rows, "cut")
    out = rows.select("*", F.posexplode(cut).alias("feature_idx", found))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "feature_idx", F.col(found)["chunk"].alias("chunk"), F.col(found)["chunk_offsets"].alias("chunk_offsets"))


def span_labels(offsets: Column, start: Column, end: Column, shift: int | Column = 0, cls: int = 0) -> Column:
    """struct<start_position, end_position>: tokens that hold an answer's first and last character; cls for both if the chunk doesn't hold all of it."""
    inside = (start >= F.get(offsets, F.lit(0))["start"]) & (end <= F.element_at(offsets, -1)["end"])
    first = F.size(F.filter(offsets, lambda o: o["start"] <= start)) - 1
    last = F.size(F.filter(offsets, lambda o: o["end"] < end))
    pick = lambda c: F.when((F.size(offsets) > 0) & inside, c + shift).otherwise(F.lit(cls)).cast("int")
    return F.struct(pick(first).alias("start_position"), pick(last).alias("end_position"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Bytes of text whose tokens are placed at a time.
SLICE = 1 << 20


@F.arrow_udf(SPANS)
def token_offsets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Where tokens stand in a text that normalization may have changed, by alignment of characters (functions.alignment), in time that grows with the text's length.

    Tokens that align with nothing take the gap between their neighbours; special tokens are (0, 0).
    A task holds the spans of some texts at a time, as two numbers each.
    """
    for texts, tokens in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE, "right")))
            yield _placed(texts.slice(at, to - at), tokens.slice(at, to - at))
            at = to


def _folded(s: str) -> str:
    """Lower case where that keeps every character's place."""
    low = s.lower()
    if len(low) == len(s) and "\u03a3" not in s:  # no character grew, and none is a sigma, whose lower case depends on its place
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _placed(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    """token_offsets of some rows."""
    known = pc.and_(pc.is_valid(texts), pc.is_valid(tokens))
    sizes = pc.if_else(known, pc.fill_null(pc.list_value_length(tokens), 0), 0)
    tokens = pc.if_else(known, tokens, pa.scalar(None, tokens.type))
    flat = tokens.flatten()
    special = pc.and_(pc.and_(pc.starts_with(flat, "["), pc.ends_with(flat, "]")), pc.greater(pc.utf8_length(flat), 2))
    plain = pc.if_else(special, "", pc.if_else(pc.starts_with(flat, CONTINUED), pc.utf8_slice_codeunits(flat, len(CONTINUED)), flat))
    rows = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows), plain), "")
    widths = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    starts, ends = (np.zeros(len(flat), np.int32) for _ in range(2))
    for k, (text, own) in enumerate(zip(texts, joined)):
        here = slice(rows[k], rows[k + 1])
        if rows[k] < rows[k + 1]:
            starts[here], ends[here] = _spans(text.as_py(), own.as_py(), widths[here])
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(rows), spans, mask=pc.invert(known))


def _spans(text: str, joined: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of these widths, which make up joined, begin and end in the text."""
    place = aligned(_folded(joined), _folded(text))
    met = place >= 0
    before = np.concatenate([[0], np.cumsum(met)])
    # what the characters around begin and end at, beyond the text's first and last too
    hits = place[met]
    begins, ends = np.concatenate([hits, [len(text)]]), np.concatenate([[0], hits + 1])
    last = np.cumsum(widths)
    first, end = before[last - widths], before[last]
    some = end > first
    start = np.where(some, begins[first], ends[first])
    stop = np.where(some, ends[end], np.maximum(ends[first], begins[first]))
    return np.where(widths > 0, start, 0), np.where(widths > 0, stop, 0)


def _aligned(text: str, tokens: list[str]) -> list[dict]:
    """token_offsets of one text."""
    return _placed(pa.array([text]), pa.array([tokens], pa.list_(pa.string())))[0].as_py()


def answers(features: DataFrame, contexts: DataFrame, n_best: int = 20, max_length: int = 30, threshold: float = 0.0, with_null: bool = True) -> DataFrame:
    """n-best answers of every example: (id, rank, text, score, probability, chosen).

    features: (id, feature_idx, start_logits, end_logits, offsets), offsets null at
    tokens outside the context; contexts: (id, context). Candidates are pairs of a
    feature's n_best starts and ends that lie in the context in order and within
    max_length tokens. The null answer has the least sum of first logits of an
    example's features. chosen is the best text, or empty where null wins by more
    than the threshold. Ties stand by start and end.
    """
    def best(logits: str) -> Column:
        tokens = F.transform(F.arrays_zip(F.col(logits).alias("logit"), F.col("offsets").alias("place")), lambda x, i: F.struct((-x["logit"]).alias("order"), i.alias("at"), x["logit"].alias("logit"), x["place"].alias("place")))
        return F.slice(F.array_sort(F.filter(tokens, lambda x: x["logit"].isNotNull())), F.lit(1), F.lit(n_best))

    def pair(s: Column, e: Column) -> Column:
        score = s["logit"] + e["logit"]
        return F.struct((-score).alias("order"), s["at"].alias("s"), e["at"].alias("e"), s["place"].alias("a"), e["place"].alias("b"), score.alias("score"))

    def follows(p: Column) -> Column:
        return (p["e"] >= p["s"]) & (p["e"] - p["s"] + 1 <= max_length) & p["a"].isNotNull() & p["b"].isNotNull()

    # An example's best pairs are among each feature's: these are found within its row, and no others become rows.
    tops = features.select("id", best("start_logits").alias("starts"), best("end_logits").alias("ends"))
    pairs = F.flatten(F.transform("starts", lambda s: F.transform("ends", lambda e: pair(s, e))))
    pairs = tops.select("id", F.explode(F.slice(F.array_sort(F.filter(pairs, follows)), F.lit(1), F.lit(n_best))).alias("p")).select("id", "p.s", "p.e", "p.a", "p.b", "p.score")
    nulls = features.groupBy("id").agg(F.min(F.get("start_logits", F.lit(0)) + F.get("end_logits", F.lit(0))).alias("null_score"))
    spans = pairs.join(contexts, "id").select("id", "s", "e", F.substring("context", F.col("a.start") + 1, F.col("b.end") - F.col("a.start")).alias("text"), "score", F.lit(False).alias("is_null"))
    nobody = nulls.select("id", F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit("").alias("text"), F.col("null_score").alias("score"), F.lit(True).alias("is_null"))
    rows = spans.union(nobody) if with_null else spans
    order = Window.partitionBy("id").orderBy(F.desc("score"), "s", "e")
    rows = rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n_best) | F.col("is_null"))
    own = Window.partitionBy("id")
    only_empty = F.max(F.when(F.col("text") != "", 1).otherwise(0)).over(own) == 0
    rows = rows.withColumn("__empty", only_empty)
    fallback = rows.where("__empty").select("id").distinct().select("id", F.lit(-2).alias("s"), F.lit(-2).alias("e"), F.lit("empty").alias("text"), F.lit(0.0).alias("score"), F.lit(False).alias("is_null"), F.lit(0).alias("rank"), F.lit(True).alias("__empty"))
    rows = rows.unionByName(fallback)
    top = F.max("score").over(own)
    rows = rows.withColumn("__exp", F.exp(F.col("score") - top)).withColumn("probability", F.col("__exp") / F.sum("__exp").over(own))
    first = F.min_by(F.struct("text", "score"), F.when(~F.col("is_null") & (F.col("text") != ""), F.col("rank"))).over(own)
    chosen = F.col("__first.text")
    rows = rows.withColumn("__first", first).join(nulls, "id")
    if with_null:
        chosen = F.when(F.col("null_score") - F.col("__first.score") > threshold, "").otherwise(chosen)
    return rows.select("id", "rank", "text", "score", "probability", F.coalesce(chosen, F.lit("")).alias("chosen"))
