"""Tokenizers: from text columns to tokens, ids and model inputs."""

from __future__ import annotations

import json

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import encoding, morphology, text
from lexiloom.functions.encoding import Lookup
from lexiloom.operators.analysis import in_mode, regex_morphemes, words_in_form
from lexiloom.operators.vocab import MOST_WORD_CHARS, SPECIALS
from lexiloom.operators.wordpiece import CONTINUED, PieceTrie
from lexiloom.storage import fresh

SUBWORDS = ("wordpiece", "character", "pos_substitution", "none")
#: Words whose pieces a task remembers.
REMEMBERED = 200_000
#: Characters of a text that are encoded where a maximum length is asked for.
MOST_CHARS = 1 << 14


@dataclass
class Tokenizer:
    """Normalize, analyse, project to a word form, split to subwords, encode.

    vocab lists the tokens, whose ids are their places, of duplicates the last, or maps
    them to their ids. It is of bounded size and travels with the plan. The analyzer is any function from a
    text column to morphemes; split_mode is for one that knows several.
    """

    vocab: Sequence[str] | Mapping[str, int] | None = None
    word_form: str = "surface"
    subword: str = "wordpiece"
    do_strip: bool = False
    do_lower_case: bool = False
    do_nfkc: bool = False
    analyzer: Callable[[Column], Column] = regex_morphemes
    unk: str = "[UNK]"
    cls: str = "[CLS]"
    sep: str = "[SEP]"
    pad: str = "[PAD]"
    split_mode: str = "C"
    tables: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.subword not in SUBWORDS:
            raise ValueError(f"unknown subword type {self.subword!r}; known: {', '.join(SUBWORDS)}")
        if self.vocab is None and self.subword != "none":
            raise ValueError("subwords need a vocabulary")
        self.ids = dict(self.vocab) if isinstance(self.vocab, Mapping) else {t: i for i, t in enumerate(self.vocab or [])}
        if self.vocab is not None and self.unk not in self.ids:
            raise ValueError(f"the vocabulary lacks {self.unk}")
        self.form = morphology.word_form(self.word_form, **self.tables)
        self.analyze = in_mode(self.analyzer, self.split_mode)
        self.lookup = Lookup(self.ids, self.unk)

    @property
    def vocab_size(self) -> int:
        """Distinct tokens."""
        return len(self.ids)

    @property
    def specials(self) -> list[str]:
        """The special tokens that the vocabulary has."""
        return [t for t in SPECIALS if t in self.ids]

    def config(self) -> dict:
        """What describes the tokenizer, for other programs to read; the analyzer isn't part of it."""
        model = {"type": "WordPiece", "unk_token": self.unk, "continuing_subword_prefix": CONTINUED, "max_input_chars_per_word": MOST_WORD_CHARS, "vocab": self.ids}
        normal = {"strip": self.do_strip, "lowercase": self.do_lower_case, "nfkc": self.do_nfkc}
        named = {"unk": self.unk, "cls": self.cls, "sep": self.sep, "pad": self.pad}
        out = {"normalizer": normal, "pre_tokenizer": None, "word_form": self.word_form, "subword": self.subword, "split_mode": self.split_mode}
        return out | {"special_tokens": self.specials, "named_tokens": named, "model": model}

    def words(self, s: Column) -> Column:
        tidy = text.input_normalizer(self.do_strip, self.do_lower_case, self.do_nfkc)
        return words_in_form(self.analyze, self.word_form, self.form)(tidy(s))

    def tokens(self, s: Column) -> Column:
        if self.subword == "none":
            return self.words(s)
        if self.subword == "wordpiece":
            return self._pieces(self.words(s))
        if self.subword == "character":
            return encoding.character_subwords(self.words(s), self.lookup)
        tidy = text.input_normalizer(self.do_strip, self.do_lower_case, self.do_nfkc)
        found = self.analyze(tidy(s))
        return encoding.pos_substituted(F.transform(found, self.form), found, self.lookup)

    def token_ids(self, s: Column) -> Column:
        """The ids of a text's tokens; words become ids in one step where pieces are asked for."""
        return self._pieces(self.words(s), self.ids) if self.subword == "wordpiece" else self.lookup.ids(self.tokens(s))

    def _pieces(self, words: Column, ids: Mapping[str, int] | None = None) -> Column:
        """The pieces of an array of words, or their ids; a task works out each word once, up to REMEMBERED of them."""
        trie = PieceTrie(list(self.ids), self.unk, MOST_WORD_CHARS)

        kind = pa.string() if ids is None else pa.int32()

        @F.arrow_udf("array<string>" if ids is None else "array<int>")
        def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            memory: dict[str, list] = {}

            def pieces(w: str) -> list:
                if w not in memory:
                    if len(memory) > REMEMBERED:
                        memory.clear()
                    found = [] if not w.strip() else trie.pieces(w)
                    memory[w] = found if ids is None else [ids[p] for p in found]
                return memory[w]

            for lists in batches:
                coded = lists.flatten().dictionary_encode("encode")
                own = pa.array(list(map(pieces, coded.dictionary.to_pylist())), pa.list_(kind)).take(coded.indices)
                # where a row's words end among all words, their pieces end among all pieces
                words = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends[words]), own.flatten(), mask=lists.is_null())

        return split(words)

    def encode(self, rows: DataFrame, a: str, b: str | None = None, max_length: int | None = None, padded: bool = False) -> DataFrame:
        """Add input_ids, token_type_ids, attention_mask and special_tokens_mask of one text column or a pair.

        With max_length the longer text gives way until both fit, of equals the
        second; padded fills up to max_length.
        """
        for name in (self.cls, self.sep):
            if name not in self.ids:
                raise ValueError(f"the vocabulary lacks {name}")
        first_ids, second_ids = fresh(rows, "first_ids"), fresh(rows, "second_ids")
        names = rows.columns
        rows = rows.withColumn(first_ids, self.token_ids(F.col(a)))
        if b is not None:
            rows = rows.withColumn(second_ids, self.token_ids(F.col(b)))
        first, second = F.col(first_ids), None if b is None else F.col(second_ids)
        if max_length is not None:
            first, second = (F.slice(first, 1, max_length - 2), None) if second is None else fitting(first, second, max_length - 3)
        ids = encoding.with_specials(first, second, F.lit(self.ids[self.cls]), F.lit(self.ids[self.sep]))
        out = {
            "input_ids": (ids, self.ids.get(self.pad, 0)),
            "token_type_ids": (encoding.token_types(first, second), 0),
            "attention_mask": (encoding.attention_mask(ids), 0),
            "special_tokens_mask": (encoding.special_mask(first, second), 1),
        }
        fill = padded and max_length is not None
        columns = [(encoding.padded(c, max_length, pad) if fill else c).alias(n) for n, (c, pad) in out.items()]
        return rows.select(*[F.col(f"`{c}`") for c in names], *columns)


def fitting(first: Column, second: Column, room: int) -> tuple[Column, Column]:
    """Two arrays cut to `room` together, item by item from the longer, of equals from the second."""
    a, b = F.size(first), F.size(second)
    over = F.greatest(a + b - room, F.lit(0))
    longer = F.least(over, F.abs(a - b))
    rest = over - longer
    less_a = F.when(a > b, longer).otherwise(0) + F.floor(rest / 2)
    less_b = F.when(b > a, longer).otherwise(0) + F.ceil(rest / 2)
    return F.slice(first, F.lit(1), (a - less_a).cast("int")), F.slice(second, F.lit(1), (b - less_b).cast("int"))


def normalize_columns(rows: DataFrame, columns: Sequence[str], word_form: str, analyzer: Callable[[Column], Column] = regex_morphemes, mode: str = "C", **tables: Column) -> DataFrame:
    """Text columns in a word form without separators, NFKC first; surface changes nothing."""
    if word_form == "surface":
        return rows
    analyzer = in_mode(analyzer, mode)
    form = morphology.word_form(word_form, **tables)
    for c in columns:
        rows = rows.withColumn(c, F.array_join(F.transform(analyzer(text.nfkc(F.col(c))), form), ""))
    return rows


SEGMENTERS: dict[str | None, Callable[[Column, Callable[[Column], Column]], Column]] = {
    None: lambda s, analyzer: s,
    "spaced": lambda s, analyzer: F.array_join(words_in_form(analyzer, "surface", morphology.word_form("surface"))(s), " "),
    "wide": lambda s, analyzer: text.drop_surrogates(F.replace(morphology.segmented(analyzer(text.full_width(s))), F.lit("　"), F.lit(" "))),
}


def segment_columns(rows: DataFrame, columns: Sequence[str], name: str | None, analyzer: Callable[[Column], Column] = regex_morphemes) -> DataFrame:
    """Text columns as space-separated surfaces; 'wide' makes characters full-width first, None changes nothing."""
    if name not in SEGMENTERS:
        raise ValueError(f"unknown segmenter {name!r}")
    for c in columns:
        rows = rows.withColumn(c, SEGMENTERS[name](F.col(c), analyzer))
    return rows


def classification_features(
    rows: DataFrame, tokenizer: Tokenizer, texts: Sequence[str], label: str, labels: Sequence[str], max_length: int = 512, most_chars: int = MOST_CHARS
) -> DataFrame:
    """Encoded text columns, one or two, and the label's id in `labels`; unlabelled rows, -1, stay -1. Texts are cut to most_chars first."""
    known = F.array(*[F.lit(x) for x in labels])
    number = F.when(F.col(label).cast("string") == "-1", -1).otherwise(F.array_position(known, F.col(label).cast("string")) - 1)
    cut = rows.withColumn("label_id", number.cast("int")).withColumns({t: F.left(F.col(t), F.lit(most_chars)) for t in texts})
    return tokenizer.encode(cut, texts[0], texts[1] if len(texts) > 1 else None, max_length)


def choice_features(
    rows: DataFrame, tokenizer: Tokenizer, keys: Sequence[str], choices: Sequence[str], context: str = "context", max_length: int = 512, most_chars: int = MOST_CHARS
) -> DataFrame:
    """For each question, arrays with one encoding a choice, context first."""
    from lexiloom.operators.datasets import explode_choices, regroup_choices

    pairs = explode_choices(rows.select(*keys, context, *choices), choices, context)
    pairs = pairs.withColumns({t: F.left(F.col(t), F.lit(most_chars)) for t in ("text_a", "text_b")})
    return regroup_choices(tokenizer.encode(pairs, "text_a", "text_b", max_length), keys, ["input_ids", "token_type_ids", "attention_mask"])


def write_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str, overwrite: bool = False) -> None:
    """A tokenizer's configuration, one JSON document, under path/config, and its vocabulary, a token a line, under path/vocab."""
    from lexiloom.sources.sinks import write_vocabulary

    mode = "overwrite" if overwrite else "errorifexists"
    one = spark.createDataFrame([(json.dumps(tokenizer.config(), ensure_ascii=False),)], "value string")
    one.coalesce(1).write.mode(mode).text(f"{path}/config")
    write_vocabulary(spark.createDataFrame(list(tokenizer.ids.items()), "token string, id long"), f"{path}/vocab", overwrite)


def read_tokenizer(spark: SparkSession, path: str, analyzer: Callable[[Column], Column] = regex_morphemes, **tables: Column) -> Tokenizer:
    """The tokenizer that write_tokenizer wrote to a path; its analyzer and the tables of its word form aren't in files and are given again."""
    found = json.loads(spark.read.text(f"{path}/config", wholetext=True).where("value <> ''").first().value)
    normal, named = found["normalizer"], found["named_tokens"]
    flags = {"do_strip": normal["strip"], "do_lower_case": normal["lowercase"], "do_nfkc": normal["nfkc"]}
    vocab = found["model"]["vocab"] or None
    return Tokenizer(vocab, found["word_form"], found["subword"], analyzer=analyzer, split_mode=found["split_mode"], tables=tables, **flags, **named)
