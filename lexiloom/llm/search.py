"""Operator 11: ranked lexical search by best-first branch and bound over a hierarchical max tree.

The index is a table of shards, each some thousands of documents in a row: their ids
and sizes, and for each document its terms and how often they occur. Over a shard's
documents stands a tree of ranges, 16 to a range at every level, that holds for each
term the highest impact (the part of a score that a document decides) in each range. A
query's bound for a range is the sum of its terms' weights times those maxima. The
search opens the range of the highest bound first, scores the documents of the lowest
ranges exactly, and ends where no range left could hold a better document or, at an
equal score, one of a lower id: ranges whose bound equals the last score are opened.

Texts are read once and never shuffled: a task indexes the documents that it reads, and
a task of the search keeps the best of all the shards it has seen, whose last score
spares it ranges in the next. What meets in a shuffle is k rows a query and task.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import Batches, fresh, in_slices, materialize, ranked, table, thrifty

#: A term is a run of ASCII letters, digits and any character beyond ASCII, as bytes; A to Z are lowered, the rest becomes a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text whose terms are counted at a time.
PIECE = 1 << 20
#: A shard ends with the document that fills it: so many documents, or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 13, 1 << 18
FAN = 16
#: Cells of a tree's lowest level, terms by ranges; shards beyond it are searched in parts.
MOST_CELLS = 1 << 24
#: Terms up to which an index can be kept to those asked for; they go to each task.
MOST_TERMS = 1 << 18
#: (query, term) pairs that are searched at a time; they go to each task.
MOST_PAIRS = 1 << 18


def term_counts(text: memoryview | bytes) -> Counter:
    """How often each term occurs in a text's UTF-8 bytes, piece by piece: a piece ends where a term does."""
    plain, out, at = bytes(text).translate(BYTES), Counter(), 0
    while at < len(plain):
        to = plain.find(b" ", at + PIECE)
        to = len(plain) if to < 0 else to
        out.update(plain[at:to].split())
        at = to
    return out


def counted(batch: pa.RecordBatch, column: str) -> Iterator[Counter]:
    """term_counts of each row; a null text has none."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield term_counts(value.as_buffer()) if value.is_valid else Counter()


def index_documents(docs: DataFrame, terms: DataFrame | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of docs (doc_id, text): a row a shard, to be written and searched as often as needed.

    Documents without a term, of null or empty texts, are not in it; rows may repeat and
    ids may be null; other columns are not read. terms (term), if given and at most
    MOST_TERMS, are the only ones with postings; n and the totals count all terms anyway.
    """
    wanted: dict[bytes, int] | None = None
    if terms is not None:
        found = [bytes(r.term) for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        wanted = dict.fromkeys(found) if len(found) <= MOST_TERMS else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"n_docs long, n_terms long, doc_ids array<{kind}>, sizes array<long>, ends array<int>, terms array<binary>, codes array<int>, tfs array<int>"

    def run(batches: Batches) -> Batches:
        ids, sizes, ends, codes, tfs, known = [], [], [], [], [], {}

        def shard() -> pa.RecordBatch:
            columns = [[len(ids)], [sum(sizes)], [ids], [sizes], [ends], [list(known)], [codes], [tfs]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names, types = None, None
        for batch in in_slices(batches, "text"):
            if names is None:
                names = ["n_docs", "n_terms", "doc_ids", "sizes", "ends", "terms", "codes", "tfs"]
                types = [pa.int64(), pa.int64(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            for doc_id, counts in zip(batch.column("doc_id").to_pylist(), counted(batch, "text")):
                if not counts:
                    continue
                ids.append(doc_id)
                sizes.append(counts.total())
                held = counts.items() if wanted is None else [(t, n) for t, n in counts.items() if t in wanted]
                for t, n in held:
                    codes.append(known.setdefault(t, len(known)))
                    tfs.append(n)
                ends.append(len(codes))
                if len(ids) >= shard_docs or len(codes) >= shard_postings:
                    yield shard()
                    ids, sizes, ends, codes, tfs, known = [], [], [], [], [], {}
        if ids:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)


def item_terms(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, times) of every item's terms."""

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, "text"):
            keys, terms, times = [], [], []
            for k, counts in zip(batch.column("key").to_pylist(), counted(batch, "text")):
                keys += [k] * len(counts)
                terms += counts.keys()
                times += counts.values()
            columns = [pa.array(keys, batch.schema.field("key").type), pa.array(terms, pa.binary()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "term", "times"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(thrifty(run), f"key {kind}, term binary, times long")


class Tree:
    """Some documents of a shard: their postings in the order of documents, and above them the highest impact of each term in ranges of FAN, FAN * FAN, ... documents."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        self.n = len(starts) - 1
        ranges = -(-self.n // FAN)
        level = np.zeros((n_terms, ranges), np.int32)
        of = np.repeat(np.arange(self.n) // FAN, np.diff(starts))
        np.maximum.at(level.ravel(), terms * ranges + of, impacts.astype(np.int32))
        self.levels = [level]
        while level.shape[1] > 1:
            wide = -(-level.shape[1] // FAN) * FAN
            level = np.pad(level, ((0, 0), (0, wide - level.shape[1]))).reshape(n_terms, -1, FAN).max(2)
            self.levels.append(level)

    def search(self, rows: np.ndarray, weights: np.ndarray, dense: np.ndarray, ids: Sequence, best: list, k: int) -> None:
        """Put into best, at most k of (-score, whether the id is null, id) in order, this tree's documents that belong there.

        rows and weights: the query's terms; dense: zeros, a weight for each term of the tree.
        """
        dense[rows] = weights
        top = len(self.levels) - 1
        heap = [(-int(self.levels[top][rows, 0].astype(np.int64) @ weights), top, 0)]
        while heap:
            bound, level, at = heappop(heap)
            if bound == 0 or len(best) == k and bound > best[-1][0]:
                break
            if level:
                below = self.levels[level - 1]
                bounds = weights @ below[rows, at * FAN : (at + 1) * FAN].astype(np.int64)
                for i in np.flatnonzero(bounds):
                    if len(best) < k or -bounds[i] <= best[-1][0]:
                        heappush(heap, (-int(bounds[i]), level - 1, at * FAN + int(i)))
                continue
            first, last = at * FAN, min((at + 1) * FAN, self.n)
            a, b = self.starts[first], self.starts[last]
            scores = np.add.reduceat(dense[self.terms[a:b]] * self.impacts[a:b], self.starts[first:last] - a)
            for i in np.flatnonzero(scores >= (-best[-1][0] if len(best) == k else 1)):
                doc_id = ids[first + int(i)]
                insort(best, (-int(scores[i]), doc_id is None, 0 if doc_id is None else doc_id))
                del best[k:]
        dense[rows] = 0


def trees(shard: dict, known: dict[bytes, int], n_docs: int, n_terms: int) -> Iterator[tuple[Tree, list, np.ndarray]]:
    """A shard's documents that hold any known term, in trees of at most MOST_CELLS, with their ids and, for each known term, its row in the tree or -1."""
    asked = np.array([known.get(t.as_py(), -1) for t in shard["terms"].values], np.int64)
    if not (asked >= 0).any():
        return
    present = np.flatnonzero(asked >= 0)
    place, row = np.full(len(asked), -1, np.int64), np.full(len(known), -1, np.int64)
    place[present], row[asked[present]] = np.arange(len(present)), np.arange(len(present))
    plain = lambda name: shard[name].values.to_numpy(zero_copy_only=False).astype(np.int64)
    codes, tfs, sizes, ends = place[plain("codes")], plain("tfs"), plain("sizes"), plain("ends")
    of = np.repeat(np.arange(len(sizes)), np.diff(ends, prepend=0))
    held = codes >= 0
    codes, tfs, of = codes[held], tfs[held], of[held]
    norms = 25 + (75 * sizes * n_docs) // n_terms
    impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * norms[of])
    docs, starts = np.unique(of, return_index=True)
    starts = np.append(starts, len(of))
    step = max(MOST_CELLS // len(present), 1) * FAN
    for at in range(0, len(docs), step):
        part = starts[at : at + step + 1]
        a, b = part[0], part[-1]
        ids = shard["doc_ids"].values.take(pa.array(docs[at : at + step])).to_pylist()
        yield Tree(part - a, codes[a:b], impacts[a:b], len(present)), ids, row


def best_of(index: DataFrame, asked: Sequence[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score): for each query of asked, (key, term, weight), what each task's shards hold of its k best."""
    known: dict[bytes, int] = {}
    queries: dict[int, tuple[list[int], list[int]]] = {}
    for key, term, weight in asked:
        codes, weights = queries.setdefault(key, ([], []))
        codes.append(known.setdefault(bytes(term), len(known)))
        weights.append(weight)
    plain = {key: (np.array(c, np.int64), np.array(w, np.int64)) for key, (c, w) in queries.items()}
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Batches) -> Batches:
        found: dict[int, list] = {key: [] for key in plain}
        type_ = pa.int64()
        for batch in batches:
            type_ = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                shard = {name: batch.column(name)[i] for name in ("doc_ids", "sizes", "ends", "terms", "codes", "tfs")}
                for tree, ids, row in trees(shard, known, n_docs, n_terms):
                    dense = np.zeros(tree.levels[0].shape[0], np.int64)
                    for key, (codes, weights) in plain.items():
                        rows = row[codes]
                        if (rows >= 0).any():
                            tree.search(rows[rows >= 0], weights[rows >= 0], dense, ids, found[key], k)
        flat = [(key, None if null else doc_id, -score) for key, best in found.items() for score, null, doc_id in best]
        columns = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], type_), pa.array([x[2] for x in flat], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "score"])

    return index.mapInArrow(thrifty(run), f"key long, doc_id {kind}, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of an index for each row of items, those of a score above 0; of equal scores the lowest doc_id first, null last.

    An item without terms, null or empty, has no rows; items may repeat, each is ranked
    by itself; their other columns are not read. The index is read once for every
    most_pairs of (query, term), so any number of items can be asked. Scores are exact
    64-bit integers: a term's weight, floor(1000 ln((2N + 2) / (2df + 1))), times
    (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, summed over the item's
    terms, repeats included.
    """
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals.n or 0, totals.l or 0
    row = fresh(items, "row")
    asked = materialize(ranked(items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")), [], ["item", "text"], row, "items"), "items")
    words = item_terms(asked, row)
    # A posting is a document: counted by shards, then over them.
    held = index.select("terms", F.col("codes").alias("c")).mapInArrow(thrifty(_document_counts), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    pairs = materialize(words.join(held, "term").select("key", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"), "pairs")
    blocks = -(-pairs.count() // most_pairs)
    parts = []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block) if blocks > 1 else pairs
        parts.append(best_of(index, [tuple(r) for r in own.collect()], n_docs, n_terms, k))
    if not parts:
        kind = index.schema["doc_ids"].dataType.elementType.simpleString()
        parts = [spark.createDataFrame([], f"key long, doc_id {kind}, score long")]
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select(F.col(row).alias("key"), F.col("item").alias(key))
    return best.join(named, "key").select(key, "rank", "doc_id", "score")


def _document_counts(batches: Batches) -> Batches:
    for batch in batches:
        for i in range(batch.num_rows):
            terms = batch.column("terms")[i].values
            df = np.bincount(batch.column("c")[i].values.to_numpy(zero_copy_only=False), minlength=len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64())], ["term", "df"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of each benchmark item's 10 best documents; the index holds postings of the terms that any item asks for."""
    items = table(spark, sf_dir, "benchmark")
    asked = item_terms(items, "item_id").select("term")
    index = materialize(index_documents(table(spark, sf_dir, "documents"), asked), "index")
    return search(index, items)


SQL = {
    "op11_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), q AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), asked AS (
  SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM q) GROUP BY item, term
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), norms AS (
  SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, totals WHERE len(terms) > 0
), scores AS (
  SELECT item, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r) GROUP BY item, r
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
}
