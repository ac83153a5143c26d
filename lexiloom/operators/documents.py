"""Operators on documents, held as rows with an array of sentences.

Everything here is a projection or a filter of one row: nothing shuffles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.functions import text, wordlist
from lexiloom.functions.encoding import joined_runs
from lexiloom.operators.analysis import regex_morphemes
from lexiloom.storage import checkpoint_dir, discard, fresh, materialize, placed, running_total

ARTICLE, PARAGRAPH, NEWLINE = "_START_ARTICLE_", "_START_PARAGRAPH_", "_NEWLINE_"  # fixed values: the markers of article sources
#: White space after final punctuation: RE2's, as SQL has it; Java's has the vertical tab as well, and its $ also stands before a last line break of any kind.
BLANK = r"[\t\n\f\r ]"


# -- shaping -------------------------------------------------------------------


def article_paragraphs(article: Column) -> Column:
    """array<array<string>>: the paragraphs of a marked-up article and their parts.

    Markers and contents alternate from line 1 on; a line is kept if it has an even
    index of at least 2 and the line before it is the paragraph marker.
    """
    lines = F.split(article, "\n")
    wanted = F.filter(lines, lambda x, i: (i >= 2) & (i % 2 == 0) & (F.get(lines, i - 1) == PARAGRAPH))
    return F.transform(wanted, lambda p: F.split(p, NEWLINE))


def split_sentences(s: Column) -> Column:
    """Sentences by final punctuation: an approximation of a trained splitter, which can be given as a pandas UDF instead."""
    parts = F.split(F.regexp_replace(s, rf"([。！？!?]+|\.(?={BLANK}|\z)){BLANK}*", "$1\n"), "\n")
    return F.filter(parts, lambda x: x != "")


def article_lines(article: Column, splitter: Callable[[Column], Column] = split_sentences) -> Column:
    """Lines of a raw corpus: the article's marker, then for each paragraph its marker and the sentences of its parts; empty sentences go."""
    one = lambda p: F.concat(F.array(F.lit(PARAGRAPH)), F.filter(F.flatten(F.transform(p, lambda x: splitter(x))), lambda x: x != ""))
    return F.concat(F.array(F.lit(ARTICLE)), F.flatten(F.transform(article_paragraphs(article), one)))


def strip_markers(lines: Column) -> Column:
    """Lines of an article source without markers, runs of blank lines squeezed to one."""
    plain = F.transform(lines, lambda x: F.regexp_replace(x, f"^({ARTICLE}|{PARAGRAPH})$", ""))
    return F.filter(plain, lambda x, i: (x != "") | (i == 0) | (F.get(plain, i - 1) != ""))


def documents_of_lines(whole: Column) -> Column:
    """array<array<string>> of a text whose blank lines end documents.

    Lines are stripped. A blank line ends a document even if nothing stands before
    it, so runs of blanks give empty documents; what follows the last blank line
    is no document. What follows the last line break is no line if it is empty.
    """
    parts = F.split(whole, "\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0))
    lines = F.transform(parts, lambda x: text.strip(x))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", "\0").otherwise(x)), "\n")
    ended = F.split(marked, "\0")  # stripped lines hold no such character unless the text does
    kept = F.slice(ended, F.lit(1), F.size(ended) - 1)
    return F.transform(kept, lambda d: F.filter(F.split(d, "\n"), lambda x: x != ""))


def explode_sentences(docs: DataFrame, sentences: str = "sentences") -> DataFrame:
    """One row a sentence, with its 0-based sent_idx."""
    others = [c for c in docs.columns if c != sentences]
    return docs.select(*others, F.posexplode(sentences).alias("sent_idx", "sentence"))


def nest_sentences(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse of explode_sentences: sentences in the order of sent_idx."""
    pairs = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["sentence"]).alias("sentences"))


def flatten_documents(rows: DataFrame, nested: str = "documents") -> DataFrame:
    """A row for each element of a struct array: other columns repeated, doc_id from 1, fields as '<nested>.<field>'. Empty arrays give none."""
    fields = rows.schema[nested].dataType.elementType.names
    others = [c for c in rows.columns if c != nested]
    out = rows.select(*others, F.posexplode(nested).alias("__at", "__one"))
    return out.select(*others, (F.col("__at") + 1).alias("doc_id"), *[F.col("__one")[f].alias(f"{nested}.{f}") for f in fields])


# -- normalizers ---------------------------------------------------------------


def concat_short_sentences(sentences: Column, n: int = 2) -> Column:
    """Join each sentence of at most n characters to the one before it; the first stays first however short."""
    return joined_runs(sentences, lambda s, i: F.char_length(s) > n)


DOCUMENT_NORMALIZERS: dict[str, Callable[..., Column]] = {"concat_short_sentence": concat_short_sentences}


def document_normalizer(names: Sequence[str], concat_char_num: int = 2) -> Callable[[Column], Column]:
    steps = [text._named(DOCUMENT_NORMALIZERS, n, "document normalizer") for n in names]
    return lambda sentences: reduce(lambda c, f: f(c, concat_char_num), steps, sentences)


# -- filters: true means drop ----------------------------------------------------


def is_short(sentences: Column, least: int = 5) -> Column:
    return F.size(sentences) < least


def any_script(sentences: Column) -> Column:
    return F.exists(sentences, text.has_script)


def ng_pattern(words: Sequence[str]) -> str:
    """One pattern of the listed words, in list order; the words are patterns themselves."""
    kept = [w.rstrip() for w in words if w.strip()]
    if not kept:
        raise ValueError("the word list is empty: it would match between any two words")
    return "|".join(kept)


def has_ng_word(sentence: Column, morphemes: Column, words: Sequence[str]) -> Column:
    """Whether a match of the word list spans exactly one morpheme.

    Matches are leftmost and don't overlap, so a longer listed word can hide a
    shorter one. A list of literal words is found by an automaton, at the cost of a
    short one however long it is; where an entry is a pattern, the whole list is one,
    and offsets of matches come from the text between them.
    """
    own = F.transform(morphemes, lambda m: F.struct(m["begin"].cast("int").alias("begin"), m["end"].cast("int").alias("end")))
    if wordlist.are_literal(words):
        return F.coalesce(F.arrays_overlap(wordlist.listed_spans(sentence, words), own), F.lit(False))
    pattern = ng_pattern(words)
    gaps, found = F.split(sentence, pattern), F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(F.char_length(g).alias("gap"), F.char_length(f).alias("size")))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["size"], F.lit(0))
        span = F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(p["size"].isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return sentence.rlike(pattern) & F.arrays_overlap(spans, own)


def any_ng_word(sentences: Column, words: Sequence[str], analyzer: Callable[[Column], Column] = regex_morphemes) -> Column:
    """Whether any sentence has a listed word as one morpheme; words don't match line breaks. Only documents in which a listed word is found at all are analysed."""
    joined = F.array_join(sentences, "\n")
    met = F.size(wordlist.listed_spans(joined, words)) > 0 if wordlist.are_literal(words) else joined.rlike(ng_pattern(words))
    worth = F.when(met, joined).otherwise("")
    return has_ng_word(worth, analyzer(worth), words)


def drop_ng_documents(docs: DataFrame, morphemes: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """The join form: documents none of whose morphemes (key, surface) is in words (word). Overlapping words don't hide each other here."""
    listed = words.select(text.strip_right(F.col("word")).alias("surface")).where("surface <> ''").distinct()
    hit = morphemes.join(listed, "surface", "left_semi").select(key).distinct()
    return docs.join(hit, key, "left_anti")


def document_filter(
    names: Sequence[str], least: int = 5, ng_words: Sequence[str] | None = None, analyzer: Callable[[Column], Column] = regex_morphemes
) -> Callable[[Column], Column]:
    """True where any of the named filters says drop; ng_words needs its list."""
    steps = document_filters_of(names, least, ng_words, analyzer)
    return lambda sentences: reduce(lambda a, b: a | b, [f(sentences) for f in steps], F.lit(False))


def document_filters_of(names: Sequence[str], least: int, ng_words: Sequence[str] | None, analyzer: Callable[[Column], Column]) -> list[Callable[[Column], Column]]:
    """The named filters, each by itself."""
    if "ng_words" in names and ng_words is None:
        raise ValueError("the filter ng_words needs a word list")
    known = {"short_document": lambda s: is_short(s, least), "script": any_script, "ng_words": lambda s: any_ng_word(s, ng_words, analyzer)}
    return [text._named(known, n, "document filter") for n in names]


# -- the pipeline ----------------------------------------------------------------


def clean(
    docs: DataFrame,
    sentence_normalizers: Sequence[str] = (),
    document_normalizers: Sequence[str] = (),
    sentence_filters: Sequence[str] = (),
    document_filters: Sequence[str] = (),
    least_chars: int = 10,
    most_chars: int = 200,
    least_sentences: int = 5,
    concat_char_num: int = 2,
    ng_words: Sequence[str] | None = None,
    analyzer: Callable[[Column], Column] = regex_morphemes,
) -> DataFrame:
    """Sentence normalizers, document normalizers, sentence filters, document filters, in this order; needs `sentences`."""
    tidy = text.sentence_normalizer(sentence_normalizers)
    whole = document_normalizer(document_normalizers, concat_char_num)
    bad = text.sentence_filter(sentence_filters, least_chars, most_chars)
    drop = document_filter(document_filters, least_sentences, ng_words, analyzer)
    steps = [lambda s: F.transform(s, tidy)] if sentence_normalizers else []
    steps += [whole] if document_normalizers else []
    steps += [lambda s: F.filter(s, lambda x: ~bad(x))] if sentence_filters else []
    docs = reduce(lambda d, f: d.withColumn("sentences", f(F.col("sentences"))), steps, docs)
    return docs.where(~drop(F.col("sentences"))) if document_filters else docs


def _judged(docs: DataFrame, document_filters: Sequence[str], least_sentences: int, ng_words: Sequence[str] | None, analyzer: Callable[[Column], Column], **shape) -> tuple[DataFrame, Column, list[Column]]:
    """docs as clean() shapes them, with one array that holds each document filter's answer; the column that keeps, and the counts."""
    answers = fresh(docs, "answers")
    size = fresh(docs, "size before")
    shaped = clean(docs.withColumn(size, F.size("sentences").cast("long")), **shape)
    steps = document_filters_of(document_filters, least_sentences, ng_words, analyzer)
    drops = F.array(*[F.coalesce(f(F.col("sentences")), F.lit(False)) for f in steps]) if steps else F.array().cast("array<boolean>")
    shaped = shaped.withColumn(answers, drops)
    kept = ~F.array_contains(answers, True)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    counts = [F.count(F.lit(1)).alias("n_before"), total(kept.cast("long"), "n_after")]
    counts += [total(F.get(answers, F.lit(i)).cast("long"), f"n_{name}") for i, name in enumerate(document_filters)]
    counts += [total(F.col(size), "n_sentences_before"), total(F.when(kept, F.size("sentences")), "n_sentences_after")]
    return shaped, kept, counts


def clean_counts(docs: DataFrame, document_filters: Sequence[str] = (), least_sentences: int = 5, ng_words: Sequence[str] | None = None, analyzer: Callable[[Column], Column] = regex_morphemes, **shape) -> DataFrame:
    """One row about what clean() does with these settings, from one pass over docs.

    n_before and n_after count documents, n_<filter> those that each document filter
    would drop, whatever others say of them, n_sentences_before and n_sentences_after
    the sentences of all documents and of those kept.
    """
    shaped, _, counts = _judged(docs, document_filters, least_sentences, ng_words, analyzer, **shape)
    return shaped.agg(*counts)


def clean_observed(docs: DataFrame, observation: Observation, document_filters: Sequence[str] = (), least_sentences: int = 5, ng_words: Sequence[str] | None = None, analyzer: Callable[[Column], Column] = regex_morphemes, **shape) -> DataFrame:
    """clean(), whose counts (see clean_counts) are in observation.get once the result has been written or otherwise used: no second pass.

    What reads the result twice, as a sort by ranges does, counts twice.
    """
    shaped, kept, counts = _judged(docs, document_filters, least_sentences, ng_words, analyzer, **shape)
    return shaped.observe(observation, *counts).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def shard_ids(docs: DataFrame, key: str, lines_per_shard: int, sentences: str = "sentences") -> DataFrame:
    """Add shard_id, from 1: greedy bins of whole documents in the order of a unique key.

    A document takes its sentences and a blank line; a shard closes at the first
    blank line after strictly more than lines_per_shard lines. Only keys and line counts pass through this, in ranges, no task holds
    them all, and texts meet their shard in a join on the key.
    """
    sizes = docs.select(F.col(key).alias("key"), (F.size(sentences) + 1).cast("long").alias("lines"))
    ends = materialize(running_total(sizes, ["key"], "lines", "end", "ends").select("key", "end"), "ends")
    cuts = closing_ends(ends, lines_per_shard)
    # A document's shard is one more than the number of cuts before its end; a cut at its own end comes after it.
    both = ends.select("key", F.col("end").alias("at"), F.lit(0).cast("long").alias("cut")).union(cuts.select(F.lit(None), "end", F.lit(1).cast("long")))
    numbered = running_total(both, ["at", "cut"], "cut", "before", "shards").where("cut = 0")
    of = fresh(docs, "of")
    named = numbered.select(F.col("key").alias(of), (F.col("before") + 1).alias("shard_id"))
    return docs.join(named, docs[key] == named[of]).drop(of)


def closing_ends(ends: DataFrame, lines_per_shard: int) -> DataFrame:
    """(end) at which shards close: the first end over lines_per_shard after 0, the first over as many after that, and so on.

    Where a shard closes depends on the one before, so ranges of ends are walked one
    after another, each in a task that knows the last cut and skips from cut to cut;
    a task sees one range.
    """
    spark = ends.sparkSession
    rows = placed(ends.select("end"), ["end"], "points")
    path = f"{checkpoint_dir(spark)}/lexiloom/cuts-{uuid.uuid4().hex}"
    spark.createDataFrame([], "end long").write.parquet(path)
    found = lambda: spark.read.schema("end long").parquet(path)
    last = 0
    for r in rows.select("pid").distinct().orderBy("pid").collect():  # a row a range
        own = rows.where(F.col("pid") == r.pid).select("end").repartition(1).sortWithinPartitions("end")
        own.mapInArrow(_cuts_after(last, lines_per_shard), "end long").write.mode("append").parquet(path)
        last = found().agg(F.max("end")).first()[0] or 0
    discard(rows)
    return found()


def _cuts_after(last: int, lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last
        for batch in batches:
            ends, out = batch.column(0).to_numpy(), []
            while (i := int(np.searchsorted(ends, at + lines, "right"))) < len(ends):
                at = int(ends[i])
                out.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["end"])

    return run
