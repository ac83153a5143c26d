"""Column functions from word forms to model inputs.

Vocabularies are looked up in tasks: a batch's distinct tokens once each, so a large
vocabulary costs no more than a small one. (A map column would be searched entry by
entry for every token.)
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.morphology import pos_tag

#: Stands between parts that are joined to be split again: no character, so in no text.
BETWEEN = "\uffff"


def each_value(lists: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Lists with their values changed, all at once; null lists stay null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, change(lists.flatten()), mask=lists.is_null())


def by_distinct(values: pa.Array, one: Callable[[str | int | None], str | int | None], kind: pa.DataType) -> pa.Array:
    """one() of every value, called once a distinct value."""
    coded = values.dictionary_encode("encode")
    return pa.array(list(map(one, coded.dictionary.to_pylist())), kind).take(coded.indices)


class Lookup:
    """A vocabulary, token -> id, of bounded size; it travels with the functions that it gives."""

    def __init__(self, ids: Mapping[str, int], unk: str = "[UNK]"):
        self.known, self.unk = dict(ids), unk

    @classmethod
    def of(cls, tokens: Sequence[str], unk: str = "[UNK]") -> Lookup:
        """Ids are places; of equal tokens the last counts."""
        return cls({t: i for i, t in enumerate(tokens)}, unk)

    def ids(self, tokens: Column) -> Column:
        """Each token's id, that of unk where the vocabulary lacks it."""
        get, other = self.known.get, self.known.get(self.unk)

        @F.arrow_udf("array<int>")
        def found(lists: pa.Array) -> pa.Array:
            return each_value(lists, lambda x: by_distinct(x, lambda t: get(t, other), pa.int32()))

        return found(tokens)

    def tokens(self, ids: Column) -> Column:
        """Each id's token, unk where none has it; of several tokens with an id the last counts."""
        get, other = {i: t for t, i in self.known.items()}.get, self.unk

        @F.arrow_udf("array<string>")
        def found(lists: pa.Array) -> pa.Array:
            return each_value(lists, lambda x: by_distinct(x, lambda i: get(i, other), pa.string()))

        return found(ids)

    def kept(self, tokens: Column) -> Column:
        """Tokens that the vocabulary lacks become unk."""
        known, other = frozenset(self.known), self.unk

        @F.arrow_udf("array<string>")
        def found(lists: pa.Array) -> pa.Array:
            return each_value(lists, lambda x: by_distinct(x, lambda t: t if t in known else other, pa.string()))

        return found(tokens)

    def either(self, first: Column, second: Column) -> Column:
        """Of two arrays of equal lengths, the first's token if the vocabulary has it, else the second's, else unk."""
        known, other = frozenset(self.known), self.unk

        @F.arrow_udf("array<string>")
        def found(one: pa.Array, two: pa.Array) -> pa.Array:
            a = by_distinct(one.flatten(), lambda t: t if t in known else None, pa.string())
            b = by_distinct(two.flatten(), lambda t: t if t in known else other, pa.string())
            return each_value(one, lambda _: pc.coalesce(a, b))

        return found(first, second)


def rolled(lists: pa.ListArray, base: int, modulus: int) -> pa.Array:
    """For each list the sum a that a = (a * base + number) % modulus gives, from 0 and number by number, all lists at once; a modulus under 2^31, no null lists."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes, numbers = np.diff(offsets), lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    offsets -= offsets[0]
    powers, step = np.ones(1, np.int64), base % modulus
    while len(powers) < sizes.max(initial=0):
        powers, step = np.concatenate([powers, powers * step % modulus]), step * step % modulus
    after = np.repeat(offsets[1:], sizes) - 1 - np.arange(len(numbers))
    parts = numbers % modulus * powers[after] % modulus
    total = np.concatenate([[0], np.cumsum(parts)])[offsets]
    return pa.array(np.diff(total) % modulus)


def running_sums(numbers: Column) -> Column:
    """array<int> -> array<int>: the sum of each number and those before it."""

    @F.arrow_udf("array<int>")
    def summed(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        total = pc.cumulative_sum(lists.flatten().cast(pa.int64()))
        ends = pc.cumulative_sum(sizes.cast(pa.int64()))
        # What stands before a list's first number, for each of its numbers.
        before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(pc.subtract(ends, sizes))
        at = pc.list_parent_indices(lists)
        return each_value(lists, lambda _: pc.subtract(total, before.take(at)).cast(pa.int32()))

    return summed(numbers)


def character_subwords(words: Column, vocab: Lookup) -> Column:
    """Each word's characters; those outside the vocabulary become unk."""
    return vocab.kept(F.flatten(F.transform(words, lambda w: F.filter(F.split(w, ""), lambda c: c != ""))))


def pos_substituted(words: Column, morphemes: Column, vocab: Lookup) -> Column:
    """A word of the vocabulary stays; else its part-of-speech tag if the vocabulary has that; else unk."""
    return vocab.either(words, F.transform(morphemes, lambda m: pos_tag(m["pos"])))


def to_text(tokens: Column) -> Column:
    """Tokens with spaces between, continuations joined to what they continue."""
    return F.trim(F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit("")))


def with_specials(a: Column, b: Column | None = None, cls: str | int = "[CLS]", sep: str | int = "[SEP]") -> Column:
    """cls a sep, or cls a sep b sep; tokens or ids."""
    parts = [F.array(F.lit(cls)), a, F.array(F.lit(sep))]
    return F.concat(*parts, *([] if b is None else [b, F.array(F.lit(sep))]))


def special_mask(a: Column, b: Column | None = None) -> Column:
    parts = [F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size(a)), F.array(F.lit(1))]
    return F.concat(*parts, *([] if b is None else [F.array_repeat(F.lit(0), F.size(b)), F.array(F.lit(1))]))


def token_types(a: Column, b: Column | None = None) -> Column:
    first = F.array_repeat(F.lit(0), F.size(a) + 2)
    return first if b is None else F.concat(first, F.array_repeat(F.lit(1), F.size(b) + 1))


def attention_mask(ids: Column, length: int | None = None) -> Column:
    ones = F.array_repeat(F.lit(1), F.size(ids))
    return ones if length is None else padded(ones, length, 0)


def padded(ids: Column, length: int, pad: int | str = 0) -> Column:
    """Cut to `length`, or filled up to it."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def word_index(tokens: Column) -> Column:
    """0-based index of the word each subword belongs to: continuations count with what they continue."""
    begins = F.transform(tokens, lambda t: F.when(t.startswith("##"), 0).otherwise(1))
    return F.transform(running_sums(begins), lambda n: n - 1)


def joined_runs(parts: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """Strings of an array joined in runs; begins(part, index) says where a run begins, and the first part always does."""
    marked = F.transform(parts, lambda x, i: F.when((i > 0) & begins(x, i), F.concat(F.lit(BETWEEN), x)).otherwise(x))
    return F.when(F.size(parts) == 0, parts).otherwise(F.split(F.array_join(marked, ""), BETWEEN, -1))


def merge_space_tokens(tokens: Column) -> Column:
    """White-space tokens join the token before them, leading ones the first other token."""
    solid = F.array_position(F.transform(tokens, lambda t: F.trim(t) != ""), True)
    return joined_runs(tokens, lambda t, i: (F.trim(t) != "") & (i + 1 > solid))
