"""Long lists of literal words, found by an automaton: a text is passed over once, however many words are listed."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make an entry a pattern.
SPECIAL = frozenset("\\^$.|?*+()[]{}")
SPANS = "array<struct<begin:int,end:int>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def are_literal(words: Sequence[str]) -> bool:
    return not any(SPECIAL & set(w) for w in words)


def automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    """Of words in list order, right-trimmed, blank ones left out; of equal ones the first."""
    out = ahocorasick.Automaton()
    for i, w in enumerate(dict.fromkeys(w.rstrip() for w in words if w.strip())):
        out.add_word(w, (i, len(w)))
    out.make_automaton()
    return out


def spans_in(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """(begin, end) as alternatives of a pattern give them: leftmost, at one place the word listed first, without overlaps."""
    first: dict[int, tuple[int, int]] = {}
    for last, (i, size) in found.iter(text):
        begin = last + 1 - size
        if begin not in first or i < first[begin][0]:
            first[begin] = (i, last + 1)
    out, at = [], 0
    for begin in sorted(first):
        if begin >= at:
            at = first[begin][1]
            out.append((begin, at))
    return out


def listed_spans(s: Column, words: Sequence[str]) -> Column:
    """array<struct<begin, end>> of listed words, literal ones, in a text; the list travels with the function, not with the plan."""
    known = automaton(words)
    if not len(known):
        raise ValueError("the word list is empty: it would match between any two words")

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"begin": a, "end": b} for a, b in spans_in(t, known)] for t in texts.to_pylist()]
        return pa.array(rows, _SPANS)

    return found(s)
