"""Vocabularies: word frequencies, ranked vocabularies, WordPiece encoding and training."""

from __future__ import annotations

from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.encoding import Lookup
from lexiloom.operators.wordpiece import CONTINUED, PieceTrie, train_distributed
from lexiloom.storage import fresh, ranked

SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
UNK = "[UNK]"
MOST_WORD_CHARS = 100
#: Distinct words up to which a vocabulary is trained on the driver, some 50 MB of it.
MOST_LOCAL_WORDS = 50_000
#: Distinct words a task counts before it passes its counts on, and rows it passes on at a time.
HELD, BATCH_ROWS = 250_000, 20_000


def word_counts(words: DataFrame, order: Sequence[str]) -> DataFrame:
    """(word, freq, first): counts and the least `order` at which a word stands, for ties in first-seen order."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct(*order)).alias("first"))


def array_counts(rows: DataFrame, words: str, order: Sequence[str]) -> DataFrame:
    """word_counts of rows that hold arrays of words: first is `order`, which tells rows apart, and pos, the place in the array.

    A task adds up its own rows' words before anything is shuffled, HELD distinct ones
    at a time; what meets is a row a word and task. Null arrays are empty, null words count as a word.
    """
    names = [fresh(rows, f"order {i}") for i in range(len(order))]
    own = rows.select(F.col(f"`{words}`").alias("words"), *[F.col(f"`{c}`").alias(n) for c, n in zip(order, names)])
    kinds = [own.schema[n].dataType.simpleString() for n in names]
    schema = f"word string, freq long, pos int, {', '.join(f'`{n}` {k}' for n, k in zip(names, kinds))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(_counted(pa.Table.from_batches([batch]), names))
            if sum(x.num_rows for x in held) > 2 * HELD:
                held = [_added(held, names)]
                if held[0].num_rows > HELD:
                    yield from held.pop().combine_chunks().to_batches(BATCH_ROWS)
        if held:
            yield from _added(held, names).combine_chunks().to_batches(BATCH_ROWS)

    parts = own.mapInArrow(run, schema)
    first = F.min(F.struct(*[F.col(f"`{n}`").alias(c) for c, n in zip(order, names)], "pos"))
    return parts.groupBy("word").agg(F.sum("freq").alias("freq"), first.alias("first"))


def _counted(rows: pa.Table, names: Sequence[str]) -> pa.Table:
    """A batch's words with their counts and the first place of each, by order and then pos."""
    rows = rows.sort_by([(n, "ascending") for n in names]).combine_chunks()
    lists = rows.column(0).combine_chunks()
    flat = lists.flatten()
    coded = flat.dictionary_encode("encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # of equal codes the last write, the first place, stays
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    of = np.searchsorted(ends, first, "right")
    columns = {"word": coded.dictionary, "freq": np.bincount(codes, minlength=len(first)), "pos": (first - (ends - sizes)[of]).astype(np.int32)}
    return pa.table(columns | {n: rows.column(n).take(pa.array(of)) for n in names})


def _added(parts: Sequence[pa.Table], names: Sequence[str]) -> pa.Table:
    """The counts of several, each word once."""
    rows = pa.concat_tables(parts).sort_by([(n, "ascending") for n in (*names, "pos")])
    coded = rows.column("word").combine_chunks().dictionary_encode("encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    freq = np.zeros(len(first), np.int64)
    np.add.at(freq, codes, rows.column("freq").to_numpy())
    kept = rows.select(["pos", *names]).take(pa.array(first))
    return pa.table({"word": coded.dictionary, "freq": freq, **{n: kept.column(n) for n in ("pos", *names)}})


def pos_tags(morphemes: DataFrame) -> DataFrame:
    """Distinct tags in ascending order of the tag; needs `tag`."""
    return morphemes.select("tag").distinct().orderBy("tag")


def top_words(counts: DataFrame, size: int | None = None, least: int = 1, most_characters: int | None = None) -> DataFrame:
    """(rank, word, freq): words of at least `least` occurrences; of one-character words only the most frequent
    `most_characters`; then the `size` most frequent. Ties stand in first-seen order."""
    kept = counts.where(F.col("freq") >= least)
    if most_characters is not None:
        # The cap's own ranking sees one-character words only, at most one a character.
        single = F.char_length("word") == 1
        capped = kept.where(single).orderBy(F.desc("freq"), "first").limit(most_characters)
        kept = kept.where(~single).unionByName(capped)
    if size is None:  # as many words as there are: no task sees them all
        out = ranked(kept, [], [F.desc("freq"), F.asc("first")], "rank", "words")
        return out.select((F.col("rank") - 1).alias("rank"), "word", "freq")
    ordered = kept.orderBy(F.desc("freq"), "first").limit(size)
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "first")).cast("long") - 1).select("rank", "word", "freq")


def assembled(spark: SparkSession, specials: Sequence[str], tags: DataFrame, words: DataFrame) -> DataFrame:
    """(id, token): special tokens, then tags, then ranked words; a word equal to a special stands twice."""
    parts = [
        spark.createDataFrame([(0, str(i).zfill(6), t) for i, t in enumerate(specials)], "section int, place string, token string"),
        tags.select(F.lit(1).alias("section"), F.col("tag").alias("place"), F.col("tag").alias("token")),
        words.select(F.lit(2).alias("section"), F.lpad(F.col("rank").cast("string"), 12, "0").alias("place"), F.col("word").alias("token")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select((F.row_number().over(Window.orderBy("section", "place")) - 1).alias("id"), "token")


def first_ids(vocab: DataFrame, n: int) -> DataFrame:
    """A character vocabulary: the entries before id n."""
    return vocab.where(F.col("id") < n)


def lookup(vocab: DataFrame, unk: str = UNK) -> Lookup:
    """The vocabulary (id, token) to look tokens up in; of duplicate tokens the last id counts. It has a chosen size, tens of thousands of tokens."""
    return Lookup({r.token: r.id for r in vocab.groupBy("token").agg(F.max("id").cast("int").alias("id")).collect()}, unk)


def greedy_pieces(word: str, vocab: set[str], unk: str = UNK) -> list[str]:
    """Longest pieces first, continuations marked; any failure makes the whole word unk. What PieceTrie gives, by trying every end."""
    if len(word) > MOST_WORD_CHARS:
        return [unk]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (CONTINUED if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return [unk]
    return out


def wordpiece_of_words(words: DataFrame, vocab: Sequence[str], unk: str = UNK) -> DataFrame:
    """(word) -> (word, pieces): each distinct word is split once, in one pass over its characters, with the vocabulary's trie sent to each task once."""
    known = words.sparkSession.sparkContext.broadcast(PieceTrie(vocab, unk, MOST_WORD_CHARS))

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(known.value.pieces)

    return words.select("word").distinct().withColumn("pieces", split("word"))


def wordpiece(words: DataFrame, vocab: Sequence[str], order: Sequence[str] = ("doc_id", "pos"), unk: str = UNK) -> DataFrame:
    """Rows (…, word) with their pieces; words are split once however often they stand."""
    return words.join(wordpiece_of_words(words, vocab, unk), "word")


def train_wordpiece(
    counts: DataFrame, size: int = 32000, least: int = 1, alphabet: int = 5000, specials: Sequence[str] = SPECIALS, most_local: int = MOST_LOCAL_WORDS
) -> list[str]:
    """A WordPiece vocabulary from (word, freq).

    Merging the most frequent neighbouring pair, over and over, is sequential. Up to
    most_local distinct words come to the driver, where pairs are kept in an index from
    pair to words, so a merge touches only the words that hold it. More stay in tables
    (operators.wordpiece), with the same vocabulary as the outcome. Ids: specials, kept
    characters by code point, their continuations as the sorted words have them, then
    merges; ties by the pair's ids.
    """
    if counts.count() > most_local:
        return train_distributed(counts, size, least, alphabet, specials)
    rows = [(r.word, r.freq) for r in counts.select("word", "freq").toLocalIterator() if r.word]
    chars: Counter = Counter()
    for w, f in rows:
        for c in w:
            chars[c] += f
    kept = {c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))[:alphabet]}
    vocab = list(dict.fromkeys([*specials, *sorted(kept)]))
    ids = {t: i for i, t in enumerate(vocab)}

    def name(token: str) -> int:
        if token not in ids:
            ids[token] = len(vocab)
            vocab.append(token)
        return ids[token]

    split: list[list[int]] = []
    for w, _ in sorted(rows):
        split.append([name((CONTINUED if i else "") + c) for i, c in enumerate(w) if c in kept])
    freqs = [f for _, f in sorted(rows)]
    pairs: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, word in enumerate(split):
        for p in zip(word, word[1:]):
            pairs[p] += freqs[k]
            where[p].add(k)
    heap = [(-n, p) for p, n in pairs.items()]  # entries whose count has changed since are passed over
    heapify(heap)
    while len(vocab) < size and heap:
        n, best = heappop(heap)
        if pairs.get(best) != -n:
            continue
        if -n < max(least, 1):
            break
        merged = name(vocab[best[0]] + vocab[best[1]].removeprefix(CONTINUED))
        changed = set()
        for k in list(where[best]):
            word = split[k]
            for p in zip(word, word[1:]):
                pairs[p] -= freqs[k]
                where[p].discard(k)
                changed.add(p)
            out, i = [], 0
            while i < len(word):
                if i + 1 < len(word) and (word[i], word[i + 1]) == best:
                    out.append(merged)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            split[k] = out
            for p in zip(out, out[1:]):
                pairs[p] += freqs[k]
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if pairs[p] <= 0 or p == best:
                del pairs[p]
            else:
                heappush(heap, (-pairs[p], p))
    return vocab[: max(size, len(specials))]


