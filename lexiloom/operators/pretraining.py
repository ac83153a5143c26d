"""Masked examples for pretraining: documents packed into sequences, words of each hidden for a model to predict."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.encoding import Lookup
from lexiloom.operators.vocab import CONTINUED


def cuts(sizes: Sequence[int], room: int) -> list[int]:
    """Lengths of the sequences that sentences of these sizes fill, one after another.

    A sentence that doesn't fit begins the next sequence; one longer than a sequence
    is cut, and its rest is filled up by those that follow.
    """
    out, filled = [], 0
    for n in sizes:
        if filled and filled + n > room:
            out.append(filled)
            filled = 0
        while filled + n > room:
            out.append(room)
            n -= room
        filled += n
    return [*out, filled] if filled else out


def sequences(sentences: Column, room: int) -> Column:
    """array<array<string>> of a document's tokens by sentence -> its tokens by sequence of at most `room`, in order, none lost."""
    if room < 1:
        raise ValueError(f"no room for tokens in a sequence: {room}")

    @F.arrow_udf("array<array<string>>")
    def packed(docs: pa.Array) -> pa.Array:
        inner = docs.flatten()
        sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
        per_doc = pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False)
        found = [cuts(part.tolist(), room) for part in np.split(sizes, np.cumsum(per_doc)[:-1])] if len(docs) else []
        ends = np.cumsum([0, *[n for own in found for n in own]])
        rows = np.cumsum([0, *map(len, found)])
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner.flatten().cast(pa.string()))
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values, mask=docs.is_null())

    return packed(sentences)


def _number(digest: bytes, at: int) -> int:
    return int.from_bytes(digest[at : at + 4], "big")


def hidden_positions(name: bytes, begins: Sequence[int], sizes: Sequence[int], most: int) -> list[int]:
    """Positions of the tokens to predict, ascending: groups in the order of their draws, each if it still fits into `most`.

    A draw is a hash of what names it: the same in any partition, run and engine.
    """
    drawn = sorted([(md5(name + b":word:%d" % k).digest(), k) for k in range(len(begins))])
    out: list[int] = []
    for _, k in drawn:
        if len(out) + sizes[k] <= most:
            out += range(begins[k], begins[k] + sizes[k])
            if len(out) == most:
                break
    return sorted(out)


def masked(name: Column, sequence_idx: Column, tokens: Column, ids: Column, dupes: int, share: float, most: int, whole_words: bool, cls: int, sep: int, mask: int, n_ids: int) -> Column:
    """array<struct<dupe, input_ids, masked_positions, masked_ids>> of a sequence, a struct a dupe."""

    @F.arrow_udf("array<struct<dupe:int,input_ids:array<int>,masked_positions:array<int>,masked_ids:array<int>>>")
    def found(names: pa.Array, numbers: pa.Array, lists: pa.Array, coded: pa.Array) -> pa.Array:
        flat = coded.flatten()
        known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        inside = pc.fill_null(pc.starts_with(lists.flatten(), CONTINUED), True).to_numpy(zero_copy_only=False)
        # every dupe's tokens between its two specials, one after the other
        lengths = np.repeat(counts + 2, dupes)
        ends = np.cumsum(lengths)
        inputs, valid = np.full(int(lengths.sum()), sep, np.int32), np.ones(int(lengths.sum()), bool)
        places: list[int] = []
        hidden: list[int | None] = []
        chosen = [0]
        first = row = 0
        for own, q, n in zip(names.to_pylist(), numbers.to_pylist(), counts.tolist()):
            here = slice(first, first + n)
            begins = np.flatnonzero(~inside[here]) if whole_words else np.arange(n)
            begins = np.union1d(begins, [0])  # a sequence may begin inside a word
            sizes, begins = np.diff(begins, append=n).tolist(), begins.tolist()
            wanted = min(most, max(1, floor((n + 2) * share + 0.5)))
            for dupe in range(dupes):
                stem = f"{own}:{dupe}:{q}".encode()
                at = hidden_positions(stem, begins, sizes, wanted)
                to = int(ends[row]) - n - 1
                inputs[to - 1], inputs[to : to + n], valid[to : to + n] = cls, values[here], known[here]
                for i in at:
                    digest = md5(stem + b":token:%d" % i).digest()
                    kind = _number(digest, 0) % 10
                    if kind != 8:
                        inputs[to + i], valid[to + i] = mask if kind < 8 else _number(digest, 4) % n_ids, True
                    places.append(i + 1)
                    hidden.append(int(values[first + i]) if known[first + i] else None)
                chosen.append(len(places))
                row += 1
            first += n
        lists_of = lambda offsets, items: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
        columns = {
            "dupe": pa.array(np.tile(np.arange(dupes, dtype=np.int32), len(lists))),
            "input_ids": lists_of(np.concatenate([[0], ends]), pa.array(inputs, mask=~valid)),
            "masked_positions": lists_of(chosen, pa.array(places, pa.int32())),
            "masked_ids": lists_of(chosen, pa.array(hidden, pa.int32())),
        }
        return lists_of(np.arange(len(lists) + 1) * dupes, pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    return found(name, sequence_idx, tokens, ids)


def masked_examples(
    docs: DataFrame,
    key: str,
    vocab: Lookup,
    tokens: str = "tokens",
    max_length: int = 512,
    share: float = 0.15,
    most: int = 80,
    dupes: int = 10,
    whole_words: bool = True,
    seed: int = 12345,
    cls: str = "[CLS]",
    sep: str = "[SEP]",
    mask: str = "[MASK]",
) -> DataFrame:
    """A row a masked sequence: key, dupe, sequence_idx, input_ids, masked_positions, masked_ids.

    docs holds a unique key and each document's tokens by sentence, array<array<string>>.
    Documents are packed once and masked `dupes` times. Of a sequence, `share` of its
    tokens, at least one and at most `most`, are to be predicted; whole words at a
    time unless told otherwise. Of these, eight in ten become `mask`, one in ten any
    token, one stays. Draws are hashes of seed, key, dupe and place, so reruns agree
    under any partition layout. A document without tokens gives no rows, and only the
    key is kept of its other columns. Nothing is shuffled.
    """
    for t in (cls, sep, mask):
        if t not in vocab.known:
            raise ValueError(f"the vocabulary lacks {t}")
    if dupes < 1 or not 0 < share <= 1:
        raise ValueError("dupes must be at least 1, share above 0 and at most 1")
    packed = docs.select(F.col(f"`{key}`").alias("of"), sequences(F.col(f"`{tokens}`"), max_length - 2).alias("packed"))
    # an inner explode would have Spark pack once more, to drop documents without tokens beforehand
    rows = packed.select("of", F.posexplode_outer("packed").alias("sequence_idx", "own")).where("own IS NOT NULL").withColumn("ids", vocab.ids(F.col("own")))
    rows = rows.withColumn("name", F.concat_ws(":", F.lit(str(seed)), F.col("of").cast("string")))
    n_ids = max(vocab.known.values()) + 1
    found = masked(F.col("name"), F.col("sequence_idx"), F.col("own"), F.col("ids"), dupes, float(share), most, whole_words, *[vocab.known[t] for t in (cls, sep, mask)], n_ids)
    # the names given here are not those read above: a key may be called like either
    return rows.select("of", "sequence_idx", F.explode(found).alias("found")).select(
        F.col("of").alias(key), F.col("found.dupe").alias("dupe"), "sequence_idx", *[F.col(f"found.{c}").alias(c) for c in ("input_ids", "masked_positions", "masked_ids")]
    )
