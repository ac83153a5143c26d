"""Column functions on arrays of morphemes (see operators.analysis): parts of speech and word forms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import half_ascii

#: Texts cut at a time.
ROWS = 64
# The classes that conjugate, and the names that conjugation rules turn on.
CONJUGATIVE = ("動詞", "形容詞", "助動詞")
IRREGULAR, END_FORM, GENERAL = "サ行変格", "終止形-一般", "一般"


def level(pos: Column, i: int) -> Column:
    return F.get(pos, F.lit(i))


def is_conjugative(pos: Column) -> Column:
    return level(pos, 0).isin(*CONJUGATIVE)


def has_no_form(pos: Column) -> Column:
    return level(pos, 5) == "*"


def needs_inflection(pos: Column) -> Column:
    return is_conjugative(pos) & ((level(pos, 4) == IRREGULAR) | (level(pos, 5) != END_FORM))


def pos_tag(pos: Column) -> Column:
    """'[a-b-c]': levels up to the first unset one; the first always stands."""
    rest = F.slice(pos, 2, 5)
    unset = F.array_position(rest, "*")
    n = F.when(unset == 0, F.size(pos)).otherwise(unset).cast("int")
    return F.concat(F.lit("["), F.array_join(F.slice(pos, F.lit(1), n), "-"), F.lit("]"))


def inflection_rules(nested: Mapping[str, Mapping[str, Sequence[Sequence[str]]]]) -> Column:
    """A map 'class|type|form' -> array<struct<src, tgt>> of {class: {"type|form": [[src, tgt], ...]}}; rules keep their order."""
    return _literal_map({f"{c}|{k}": v for c, inner in nested.items() for k, v in inner.items()}, lambda rules: F.array(*[F.struct(F.lit(s).alias("src"), F.lit(t).alias("tgt")) for s, t in rules]), "map<string,array<struct<src:string,tgt:string>>>")


def conjugation_types(nested: Mapping[str, Mapping[str, str]]) -> Column:
    """A map 'class|surface|reading|normalized|type' -> new type of {class: {"surface|reading|normalized|type": new}}."""
    return _literal_map({f"{c}|{k}": v for c, inner in nested.items() for k, v in inner.items()}, F.lit, "map<string,string>")


def _literal_map(entries: dict, value: Callable, kind: str) -> Column:
    if not entries:
        return F.create_map().cast(kind)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*[value(v) for v in entries.values()]))


def conjugated(m: Column, rules: Column, types: Column) -> Column:
    """The normalized form inflected as the surface is.

    rules and types are maps as above; the key of a rule set is class, type and
    form. Where the type changes and the rules lack the new type with the same
    form, the form falls back to its general kind. The first rule whose source
    ends the word replaces that ending; no rule leaves the word.
    """
    changed = F.try_element_at(types, type_key(m))
    same = F.try_element_at(rules, rule_key(m, changed, level(m["pos"], 5)))
    kind, form = kind_and_form(m, changed, same)
    return inflected(m, changed, form, F.try_element_at(rules, rule_key(m, kind, form)))


def type_key(m: Column) -> Column:
    """What a change of type is listed under."""
    return F.concat_ws("|", level(m["pos"], 0), m["surface"], m["reading_form"], m["normalized_form"], level(m["pos"], 4))


def rule_key(m: Column, kind: Column, form: Column) -> Column:
    """What rules are listed under."""
    return F.concat_ws("|", level(m["pos"], 0), kind, form)


def kind_and_form(m: Column, changed: Column, same: Column) -> tuple[Column, Column]:
    """The type and form to inflect to; same: the rules of the changed type and the morpheme's own form, null where there are none."""
    general = F.concat(F.substring_index(level(m["pos"], 5), "-", 1), F.lit("-" + GENERAL))
    return F.coalesce(changed, level(m["pos"], 4)), F.when(changed.isNull() | same.isNotNull(), level(m["pos"], 5)).otherwise(general)


def inflected(m: Column, changed: Column, form: Column, found: Column) -> Column:
    """The normalized form by the first rule found whose source ends it."""
    word = m["normalized_form"]
    fitting = F.get(F.filter(F.coalesce(found, F.array().cast("array<struct<src:string,tgt:string>>")), lambda r: word.endswith(r["src"])), F.lit(0))
    replaced = F.concat(F.substring(word, F.lit(1), F.char_length(word) - F.char_length(fitting["src"])), fitting["tgt"])
    return F.when(~needs_inflection(m["pos"]) | (form == END_FORM) & changed.isNotNull() | fitting.isNull(), word).otherwise(replaced)


def _either(conjugates: Callable[[Column], Column], other: str) -> Callable[[Column], Column]:
    return lambda m: F.when(conjugates(m["pos"]), m["surface"]).otherwise(m[other])


WORD_FORMS: dict[str, Callable[[Column], Column]] = {
    "surface": lambda m: m["surface"],
    "dictionary": lambda m: m["dictionary_form"],
    "normalized": lambda m: m["normalized_form"],
    "dictionary_and_surface": _either(is_conjugative, "dictionary_form"),
    "normalized_and_surface": _either(is_conjugative, "normalized_form"),
    "normalized_nouns": _either(lambda pos: ~has_no_form(pos), "normalized_form"),
    "surface_half_ascii": lambda m: half_ascii(m["surface"]),
    "dictionary_half_ascii": lambda m: half_ascii(m["dictionary_form"]),
    "dictionary_and_surface_half_ascii": lambda m: half_ascii(_either(is_conjugative, "dictionary_form")(m)),
}


def word_form(name: str, rules: Column | None = None, types: Column | None = None) -> Callable[[Column], Column]:
    """The function from a morpheme to the named form; normalized_conjugation needs rules and types."""
    if name == "normalized_conjugation":
        if rules is None or types is None:
            raise ValueError("normalized_conjugation needs inflection rules and conjugation types")
        return lambda m: conjugated(m, rules, types)
    if name not in WORD_FORMS:
        raise ValueError(f"unknown word form {name!r}; known: {', '.join(sorted([*WORD_FORMS, 'normalized_conjugation']))}")
    return WORD_FORMS[name]


def word_forms(morphemes: Column, name: str, **tables: Column) -> Column:
    return F.transform(morphemes, word_form(name, **tables))


def pretokens(morphemes: Column, text: Column, name: str, **tables: Column) -> Column:
    """Pieces of a text before subword training: morphemes of some width, as text or, unless surface, in a word form."""
    wide = F.filter(morphemes, lambda m: m["begin"] < m["end"])
    if name == "surface":
        return slices(text, F.transform(wide, lambda m: F.struct(m["begin"].cast("int").alias("start"), m["end"].cast("int").alias("end"))))
    return F.transform(wide, word_form(name, **tables))


def slices(text: Column, spans: Column) -> Column:
    """array<string>: the parts of a text at array<struct<start, end: int>>, in one pass; a substring of its own would walk the text up to each."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.string()))]
        for at in range(0, len(texts), ROWS):
            some = places.slice(at, ROWS)
            flat, sizes = some.flatten(), pc.fill_null(pc.list_value_length(some), 0)
            starts, ends = (flat.field(i).to_pylist() for i in range(2))
            rows = [0, *accumulate(sizes.to_pylist())]
            own = texts.slice(at, ROWS).to_pylist()
            found = [None if t is None else t[a:b] for t, i, j in zip(own, rows, rows[1:]) for a, b in zip(starts[i:j], ends[i:j])]
            missing = pc.or_(some.is_null(), texts.slice(at, ROWS).is_null())
            parts.append(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(found, pa.string()), mask=missing))
        return pa.concat_arrays(parts)

    return cut(text, spans)


def normalized_text(morphemes: Column, text: Column, name: str, **tables: Column) -> Column:
    """A text of word forms joined without separator; surface leaves the text as it is."""
    return text if name == "surface" else F.array_join(word_forms(morphemes, name, **tables), "")


def segmented(morphemes: Column) -> Column:
    """Surfaces with spaces between, as space-separating tokenizers give them."""
    return F.array_join(F.transform(morphemes, lambda m: m["surface"]), " ")
