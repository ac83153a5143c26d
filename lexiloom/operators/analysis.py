"""Analyzers: text to arrays of morphemes.

A morpheme is struct<surface, dictionary_form, normalized_form, reading_form: string,
pos: array<string> of six levels, '*' where unset, begin, end: int>, offsets in
characters. The analyzers here need no dictionary; one with a dictionary is a
pandas UDF that returns the same array. An analyzer that knows several split modes
takes one as `mode` (see `in_mode`).
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from functools import partial
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import morphology
from lexiloom.functions.encoding import running_sums
from lexiloom.functions.text import WORD
from lexiloom.storage import fresh

MORPHEMES = "array<struct<surface:string,dictionary_form:string,normalized_form:string,reading_form:string,pos:array<string>,begin:int,end:int>>"
PIECE = rf"[{WORD}]+|[^{WORD}\s]"


class SplitMode(Enum):
    A = "A"
    B = "B"
    C = "C"


def split_mode(name: str) -> SplitMode:
    """A, B or C in either case."""
    try:
        return SplitMode[name.upper()]
    except KeyError:
        raise ValueError(f"invalid split mode {name!r}: A, B or C") from None


Analyzer = Callable[[Column], Column]


def in_mode(analyzer: Callable[..., Column], name: str = "C") -> Analyzer:
    """The analyzer in a split mode: A gives the shortest units, C the longest. One without modes must be asked for none but C, its only one."""
    mode = split_mode(name)
    if "mode" in signature(analyzer).parameters:
        return partial(analyzer, mode=mode)
    if mode is not SplitMode.C:
        raise ValueError(f"the analyzer has no split mode {mode.value}")
    return analyzer


def regex_words(s: Column) -> Column:
    """The surfaces that regex_morphemes gives, alone: all that counting needs, and built of Spark's own functions."""
    return F.regexp_extract_all(s, F.lit(PIECE), F.lit(0))


def regex_kind(surface: Column) -> Column:
    """The part of speech of a surface, as far as its characters tell."""
    return F.when(surface.rlike(r"^\p{N}+$"), "number").when(surface.rlike(rf"^[{WORD}]"), "noun").otherwise("symbol")


def morphemes_of(s: Column, piece: str) -> Column:
    """Morphemes at the matches of a pattern; lower case stands for dictionary and normalized forms."""
    gaps, found = F.split(s, piece), F.regexp_extract_all(s, F.lit(piece), F.lit(0))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.char_length(g) + F.char_length(f))

    def morpheme(surface: Column, end: Column) -> Column:
        low = F.lower(surface)
        forms = [low.alias(f) for f in ("dictionary_form", "normalized_form", "reading_form")]
        pos = F.array(regex_kind(surface), *[F.lit("*")] * 5)
        return F.struct(surface.alias("surface"), *forms, pos.alias("pos"), (end - F.char_length(surface)).alias("begin"), end.alias("end"))

    return F.zip_with(found, running_sums(sizes), morpheme).cast(MORPHEMES)


def regex_morphemes(s: Column) -> Column:
    """Runs of word characters and single other characters."""
    return morphemes_of(s, PIECE)


def offsets_of(s: Column, piece: str = PIECE) -> Column:
    """array<struct<start, end>> of a pattern's matches: the places that regex_morphemes gives, alone."""
    gaps, found = F.split(s, piece), F.regexp_extract_all(s, F.lit(piece), F.lit(0))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct((F.char_length(g) + F.char_length(f)).alias("step"), F.char_length(f).alias("size")))
    ends = running_sums(F.transform(sizes, lambda x: x["step"]))
    return F.zip_with(sizes, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end")))


#: What mode A finds in a run of word characters: small letters with the capital before them, runs of capitals, of digits, underscores.
SHORT = r"\p{Lu}?[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+|\p{Lu}+|\p{N}+|_"
#: What each mode finds; C is the base.
PIECES = {SplitMode.A: rf"{SHORT}|[^{WORD}\s]", SplitMode.B: rf"[\p{{L}}_]+|\p{{N}}+|[^{WORD}\s]", SplitMode.C: PIECE}


def split_morphemes(s: Column, mode: SplitMode = SplitMode.C) -> Column:
    """regex_morphemes in split modes: C as it is; B parts letters from digits; A also parts compounds at underscores and capitals."""
    return morphemes_of(s, PIECES[mode])


def split_words(s: Column, mode: SplitMode = SplitMode.C) -> Column:
    """The surfaces that split_morphemes gives, alone."""
    return F.regexp_extract_all(s, F.lit(PIECES[mode]), F.lit(0))


#: Word forms that an analyzer has a shorter way to than its morphemes.
SHORT_WAYS: dict[Analyzer, dict[str, Analyzer]] = {
    regex_morphemes: {"surface": regex_words} | dict.fromkeys(("dictionary", "normalized"), lambda s: F.transform(regex_words(s), F.lower)),
}


def words_in_form(analyzer: Analyzer, name: str, form: Callable[[Column], Column]) -> Analyzer:
    """The function from a text to its words in the form of that name; only what the form needs is made."""
    short = SHORT_WAYS.get(analyzer, {}).get(name)
    return short or (lambda s: F.transform(analyzer(s), form))


def lexicon_morphemes(lexicon: Column, base: Analyzer = regex_morphemes) -> Analyzer:
    """The base analyzer with forms and parts of speech from lexicon, a map from surface to struct<dictionary_form, normalized_form, reading_form, pos>.

    For small lexicons: a map is searched entry by entry. Large ones meet exploded surfaces in a join.
    """

    def apply(s: Column) -> Column:
        def known(m: Column) -> Column:
            e = F.try_element_at(lexicon, m["surface"])
            pick = lambda f: F.coalesce(e[f], m[f]).alias(f)
            return F.struct(m["surface"].alias("surface"), *[pick(f) for f in ("dictionary_form", "normalized_form", "reading_form", "pos")], m["begin"].alias("begin"), m["end"].alias("end"))

        return F.transform(base(s), known)

    return apply


def conjugated_by_tables(rows: DataFrame, rules: DataFrame, types: DataFrame, morpheme: str = "m", name: str = "form") -> DataFrame:
    """rows with `name`, what morphology.conjugated() gives for a column of one morpheme each, by tables of any size.

    rules: (class, key, value), value array<struct<src, tgt>>; types: (class, key, value),
    value a type; as readers.rule_table gives them, a class and key once each. Keys meet
    in joins, which Spark broadcasts as far as their sizes allow; only morphemes that
    need an inflection look for a type. Other columns stay, but for one called `name`.
    """
    kept = [c for c in rows.columns if c != name]
    own, same, found = (fresh(rows, x) for x in ("changed type", "same rules", "rules found"))
    key = fresh(rows, "key of")
    m = F.col(f"`{morpheme}`")

    def met(df: DataFrame, where: Column, table: DataFrame, value: str) -> DataFrame:
        listed = table.select(F.concat_ws("|", "class", "key").alias(key), F.col("value").alias(value))
        asked = df.withColumn(key + "_", where)
        return asked.join(listed, F.col(f"`{key}_`") == F.col(f"`{key}`"), "left").drop(key, key + "_")

    out = met(rows, F.when(morphology.needs_inflection(m["pos"]), morphology.type_key(m)), types, own)
    changed = F.col(f"`{own}`")
    out = met(out, F.when(changed.isNotNull(), morphology.rule_key(m, changed, morphology.level(m["pos"], 5))), rules, same)
    kind, form = morphology.kind_and_form(m, changed, F.col(f"`{same}`"))
    out = met(out, F.when(morphology.needs_inflection(m["pos"]), morphology.rule_key(m, kind, form)), rules, found)
    return out.select(*[F.col(f"`{c}`") for c in kept], morphology.inflected(m, changed, form, F.col(f"`{found}`")).alias(name))
