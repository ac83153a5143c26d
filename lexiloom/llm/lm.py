"""Operator 2: language-model scoring with a log-bilinear model.

The model predicts a token from the two before it: h = sum of C_i r_i, first the
token's class by q . h + b over all classes, then the token by v . h + b over the
words of its class. Every word that stands often enough in the training corpus is a
word of the model, so its vocabulary and the number of its updates grow with the
corpus; the others share learnt unknown tokens, one a suffix. Classes are runs of the
words by frequency, of about equal mass. It is trained in numpy by noise-contrastive estimation inside tasks, on every training row, in
rounds: hashes deal the rows to trainers, whose parameters are averaged after each
round, so that scores don't depend on how the table is partitioned. Batched matrix products normalise it over all classes
and over a class's words. A word's share of its unknown token comes from the corpus
counts by absolute discounting, which leaves unseen words a share too, so that all
probabilities sum to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import in_slices, materialize, table, thrifty

#: Words of the model: seen this often at least and, of the training tokens, one in LEAST_SHARE, so there are at most as
#: many; of HEAD_BYTES at most. Every task knows them; counts of others are joined.
LEAST_COUNT, LEAST_SHARE, HEAD_BYTES = 2, 200_000, 48
#: At most so many of the most frequent other words have counts that every task knows too; they meet no join.
COUNTED = 1 << 18
#: Unknown tokens: one for each of the most frequent suffixes of other words, the last for all else.
SUFFIXES, SUFFIX = 32, 2
#: Numbers a vector; noise classes a batch, and noise words a token; how far a step goes; tokens a batch.
DIMS, NOISE, WORD_NOISE, LEARNING, BATCH = 12, 32, 2, 0.15, 8192
#: The parts of the training rows, in eighths, that the rounds take: each row is in one. Small corpora are gone over until so many tokens are.
PARTS, LEAST_UPDATES, MOST_PASSES = (1, 3, 4), 1_500_000, 60
#: Trainers of a round: one for so many tokens, and so many at most, which then see more tokens each.
TRAINER_TOKENS, TRAINERS = 1 << 20, 4096
SEED = 5
#: Distinct words a task counts before it passes its counts on, and words it remembers.
HELD = 400_000
#: Tokens scored at a time, by words and by classes, and tokens trained on; rows of parameters averaged at a time.
CHUNK, PIECE, STRETCH, ROWS = 32_768, 1024, 1 << 18, 4096

END = b"\0end"
#: Bytes of text handled at a time where each document gives many rows.
SLICE = 1 << 20


def token_key(word: bytes) -> bytes:
    """Words as keys: one more NUL before a leading NUL, so that no word is the end."""
    return b"\0" + word if word.startswith(b"\0") else word


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words (A-Z only; split at the ASCII white space of the contract), then the end."""
    return [*map(token_key, text.lower().split()), END] if text and b"\0" in text else [*text.lower().split(), END] if text else [END]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all training rows; tasks add up their own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in in_slices(batches, 0):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(tokens(text))
                if len(counts) > HELD:
                    yield out()
                    counts = Counter()
        yield out()

    return docs.where(~held_out()).select("text").mapInArrow(thrifty(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The model's tokens: 0, 1, ... its words by falling frequency, then the unknown tokens. Classes are runs of words, then each unknown token."""

    words: dict[bytes, int]
    counts: np.ndarray
    suffixes: dict[bytes, int]
    starts: np.ndarray  # of the classes of words, and the number of words last

    @property
    def n_words(self) -> int:
        return len(self.counts)

    @property
    def n_classes(self) -> int:
        return len(self.starts) - 1 + SUFFIXES

    def unknown(self, word: bytes) -> int:
        return self.n_words + self.suffixes.get(word[-SUFFIX:], SUFFIXES - 1)

    def class_of(self) -> np.ndarray:
        """The class of each token."""
        runs = len(self.starts) - 1
        return np.concatenate([np.repeat(np.arange(runs), np.diff(self.starts)), runs + np.arange(SUFFIXES)])


class Ids(dict):
    """Tokens of words: the model's words, counted ones by numbers after all tokens, and others as they come, HELD of them remembered."""

    def __init__(self, vocabulary: Vocabulary, counted: Sequence[bytes] = ()):
        self.vocabulary, self.counted = vocabulary, counted
        self.fill()
        self.least = len(self)

    def fill(self) -> None:
        self.update(self.vocabulary.words)
        self.update(zip(self.counted, count(self.vocabulary.n_words + SUFFIXES)))

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD + self.least:
            self.clear()
            self.fill()
        k = self[word] = self.vocabulary.unknown(word)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(itemgetter(*words)(self) if len(words) > 1 else (self[words[0]],), np.int64, len(words))


def vocabulary_of(head: list[tuple[bytes, int]], suffixes: list[bytes]) -> Vocabulary:
    """Classes of about equal mass, as many as the square root of the number of words: a token then meets few classes and few words."""
    counts = np.array([c for _, c in head], np.int64)
    n = max(1, round(len(counts) ** 0.5))
    at = (np.cumsum(counts) - counts) * n // max(1, counts.sum())
    starts = np.concatenate([np.unique(np.searchsorted(at, np.arange(n))), [len(counts)]])
    return Vocabulary({w: i for i, (w, _) in enumerate(head)}, counts, {x: i for i, x in enumerate(suffixes)}, np.unique(starts))


def contexts(found: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before the last, last, token) of texts' tokens, one after the other; ends stand before a text's beginning."""
    if not found:
        return (np.zeros(0, np.int64),) * 3
    pad = np.array([end, end])
    flat = np.concatenate([x for ids in found for x in (pad, ids)])
    firsts = np.cumsum([0, *(len(ids) + 2 for ids in found[:-1])])
    keep = np.ones(len(flat), bool)
    keep[firsts] = keep[firsts + 1] = False
    at = np.flatnonzero(keep)
    return flat[at - 2], flat[at - 1], flat[at]


class Parameters:
    """All parameters as rows of one matrix, the last column the biases: context vectors of tokens, vectors of classes, of words, and the two context matrices."""

    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray | None = None):
        v, k, t = vocabulary.n_words, vocabulary.n_classes, vocabulary.n_words + SUFFIXES
        self.places = {"r": slice(0, t), "q": slice(t, t + k), "v": slice(t + k, t + k + v), "c1": slice(t + k + v, t + k + v + DIMS), "c2": slice(t + k + v + DIMS, t + k + v + 2 * DIMS)}
        if rows is None:
            rng = np.random.default_rng(SEED)
            rows = rng.normal(0, 0.1, (t + k + v + 2 * DIMS, DIMS + 1)).astype(np.float32)
            rows[:, -1] = 0
            rows[self.places["c1"], :-1], rows[self.places["c2"], :-1] = np.eye(DIMS) * 0.5, np.eye(DIMS)
        self.rows = rows

    def of(self, name: str) -> np.ndarray:
        return self.rows[self.places[name]]


class Trainer:
    """Noise-contrastive estimation of a task's rows, from given parameters; Adagrad scales the steps of each row."""

    def __init__(self, vocabulary: Vocabulary, class_tokens: np.ndarray, rows: np.ndarray, seed: int):
        self.parameters = Parameters(vocabulary, rows.copy())
        self.squares = np.full(len(rows), 1e-3, np.float32)
        self.touched = np.zeros(len(rows), np.float32)
        self.rng = np.random.default_rng([SEED, seed])
        self.class_of, self.n_words, self.starts = vocabulary.class_of(), vocabulary.n_words, vocabulary.starts
        share = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
        self.class_sums, self.class_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        ends = np.concatenate([[0.0], np.cumsum(vocabulary.counts + 0.5)])
        self.word_sums, self.low, self.high = ends[1:], ends[self.starts[:-1]], ends[self.starts[1:]]
        inside = np.log((vocabulary.counts + 0.5) / np.repeat(self.high - self.low, np.diff(self.starts)))
        self.word_noise = (np.log(WORD_NOISE) + inside).astype(np.float32)

    def move(self, name: str, rows: np.ndarray, sums: np.ndarray, times: np.ndarray, rate: float) -> None:
        """Move rows, each given once, by their summed gradients of so many places."""
        rows = rows + self.parameters.places[name].start
        self.squares[rows] += np.einsum("nd,nd->n", sums, sums) / sums.shape[1]
        self.touched[rows] += times
        sums *= (rate / np.sqrt(self.squares[rows]))[:, None]
        self.parameters.rows[rows] += sums

    def order(self, at: np.ndarray) -> np.ndarray:
        return np.argsort(at.astype(np.uint16) if len(self.squares) < 1 << 16 else at, kind="stable")  # by digits, where they are few

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rate: float) -> None:
        """One batch: contexts (a, b) and their tokens, in the order of the tokens, which is that of their classes."""
        p, n = self.parameters, len(w)
        r, q, v, c1, c2 = (p.of(x) for x in ("r", "q", "v", "c1", "c2"))
        square = np.zeros((2, DIMS + 1, DIMS + 1), np.float32)
        square[0, :-1, :-1], square[1, :-1, :-1] = c1[:, :-1], c2[:, :-1]
        ra, rb = r.take(a, axis=0), r.take(b, axis=0)
        known = ra @ square[0]
        known += rb @ square[1]
        known[:, -1] = 1  # the last column meets the biases
        # classes: the token's own against noise that the batch shares
        k = self.class_of[w]
        qk = q.take(k, axis=0)
        noise = np.searchsorted(self.class_sums, self.rng.random(NOISE) * self.class_sums[-1]).clip(max=len(self.class_sums) - 1)
        own = 1 - sigmoid(np.einsum("nd,nd->n", known, qk) - self.class_noise[k])
        other = -sigmoid(known @ q[noise].T - self.class_noise[noise])
        to_hidden = other @ q[noise]
        qk *= own[:, None]
        to_hidden += qk
        begins = starts_of(k)
        sums = np.zeros_like(q)
        sums[k[begins]] = np.add.reduceat(own[:, None] * known, begins, axis=0)
        np.add.at(sums, noise, other.T @ known)
        times = np.bincount(k, minlength=len(q)) + np.bincount(noise, minlength=len(q))
        rows = np.flatnonzero(times)
        moves = [("q", rows, sums[rows], times[rows])]
        # words within their class, against noise words of the same class
        some = np.flatnonzero((w < self.n_words) & (np.diff(self.starts, append=self.starts[-1] + 1)[np.minimum(k, len(self.starts) - 1)] > 1))
        if len(some):
            ks, spread, context = k[some], self.rng.random((len(some), WORD_NOISE)), known.take(some, axis=0)
            drawn = np.searchsorted(self.word_sums, self.low[ks][:, None] + spread * (self.high - self.low)[ks][:, None], "right")
            drawn = drawn.clip(self.starts[ks][:, None], self.starts[ks + 1][:, None] - 1)
            both = np.concatenate([w[some][:, None], drawn], axis=1)
            vectors = v.take(both, axis=0)
            delta = -sigmoid(np.einsum("nkd,nd->nk", vectors, context) - self.word_noise[both])
            delta[:, 0] += 1
            to_hidden[some] += np.einsum("nk,nkd->nd", delta, vectors)
            both = both.ravel()
            order = self.order(both)
            grads = context.take(order // (1 + WORD_NOISE), axis=0)
            grads *= delta.ravel()[order][:, None]
            moves.append(("v", *summed(both[order], grads)))
        to_hidden[:, -1] = 0
        both = np.concatenate([a, b])
        order = self.order(both)
        moves.append(("r", *summed(both[order], np.concatenate([to_hidden @ square[0].T, to_hidden @ square[1].T]).take(order, axis=0))))
        each = np.arange(DIMS)
        for name, x in (("c1", ra), ("c2", rb)):
            moves.append((name, each, (x.T @ to_hidden)[:-1], 1))
        for name, rows, sums, times in moves:
            self.move(name, rows, sums, times, rate)

    def train(self, found: list[np.ndarray], end: int, passes: int) -> None:
        a, b, w = contexts(found, end)
        size = min(BATCH, max(256, len(w) // 8))
        for turn in range(passes):
            order = self.rng.permutation(len(w))
            for i in range(0, len(w), size):
                at = order[i : i + size]
                at = at[self.order(w[at])]
                self.step(a[at], b[at], w[at], LEARNING * (1 - 0.7 * turn / passes))


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])


def summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, with repeats, and their gradients -> each row, its sum and its number of places."""
    begins = starts_of(rows)
    return rows[begins], np.add.reduceat(grads, begins, axis=0), np.diff(begins, append=len(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: 1 / (1 + exp(-x))."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def averaged(docs: DataFrame, vocabulary: Vocabulary, class_tokens: np.ndarray, rows: np.ndarray, passes: int, trainers: int) -> np.ndarray:
    """One round over all rows of docs (trainer, place, text): each trainer learns its rows by place from the same parameters, whose rows are averaged, weighted by how often a trainer moved them.

    Sums are added up in two steps, by run of rows and a share of the trainers, then
    by run alone; a table as large as the parameters comes to the driver. Shares are
    the square root of the trainers, so that the second step meets few sums.
    """
    shares = max(1, round(trainers**0.5))
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, class_tokens, rows))
    width = rows.shape[1]

    def learnt(trainer: Trainer, number: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), ROWS):
            n = trainer.touched[i : i + ROWS]
            if n.any():
                sums = (trainer.parameters.rows[i : i + ROWS] - known.value[2][i : i + ROWS]) * n[:, None]
                yield record([i], [number % shares], [number], [n.tobytes()], [sums.tobytes()])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, class_tokens, rows = known.value
        trainer, number, ids, end = None, -1, Ids(vocabulary), vocabulary.words[END]
        found, size = [], 0
        for batch in in_slices(batches, 2, SLICE):
            for here, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if here != number or size >= STRETCH:
                    if found:
                        trainer.train(found, end, passes)
                        found, size = [], 0
                    if here != number:
                        if trainer is not None:
                            yield from learnt(trainer, number)
                        trainer, number = Trainer(vocabulary, class_tokens, rows, here), here
                found.append(ids.of(tokens(text)))
                size += len(found[-1])
        if trainer is not None:
            trainer.train(found, end, passes)
            yield from learnt(trainer, number)

    kinds = {"first": pa.int32(), "share": pa.int32(), "trainer": pa.int32(), "n": pa.binary(), "sums": pa.binary()}

    def record(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            (first, share), n, sums = held
            return record([first], [share], [share], [n.tobytes()], [sums.tobytes()])

        for batch in in_slices(batches, 4):
            for first, share, _, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] != (first, share):
                    yield out()
                    held = []
                n, sums = np.frombuffer(n, np.float32), np.frombuffer(sums, np.float32)
                held = [held[0], held[1] + n, held[2] + sums] if held else [(first, share), n, sums]
        if held:
            yield out()

    schema = "first int, share int, trainer int, n binary, sums binary"
    parts = docs.repartition("trainer").sortWithinPartitions("trainer", "place").mapInArrow(thrifty(learn), schema)
    parts = parts.repartition("first", "share").sortWithinPartitions("first", "share", "trainer").mapInArrow(thrifty(add), schema)
    parts = parts.select("first", F.lit(0).alias("share"), "trainer", "n", "sums").repartition("first").sortWithinPartitions("first", "trainer").mapInArrow(thrifty(add), schema)
    out = rows.copy()
    for first, _, _, n, sums in parts.collect():  # as large as the parameters
        n, sums = np.frombuffer(n, np.float32), np.frombuffer(sums, np.float32).reshape(-1, width)
        out[first : first + len(n)] += sums / np.maximum(n, 1)[:, None]
    return out


@dataclass
class Model:
    """The trained model, and what the corpus counts give to the base score and to the words behind the unknown tokens."""

    vocabulary: Vocabulary
    rows: np.ndarray
    n: int
    v: int
    discount: float
    unknown_tokens: np.ndarray
    unknown_words: np.ndarray
    counted: list[bytes]
    counts: np.ndarray  # of the counted words
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        p = Parameters(self.vocabulary, self.rows)
        r = p.of("r")[:, :-1]
        # The last column of a context meets the biases in the product: 1 for the first token's, 0 for the second's.
        self.first = np.hstack([r @ p.of("c1")[:, :-1], np.ones((len(r), 1), np.float32)])
        self.second = np.hstack([r @ p.of("c2")[:, :-1], np.zeros((len(r), 1), np.float32)])
        self.q, self.words, self.class_of = p.of("q"), p.of("v"), self.vocabulary.class_of()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))

    def behind(self, unknown: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 share of words with training count c in their unknown token, of its unseen words together if c is 0."""
        total, words = self.unknown_tokens[unknown], self.unknown_words[unknown]
        share = np.where(c > 0, c - self.discount, self.discount * words) / np.maximum(total, 1)
        return np.log10(np.where((words == 0) | (share <= 0), 1.0, share))

    def log_probabilities(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of each token w after (a, b): of its class among all, and of a word among its class.

        Tokens are taken by context, so that the classes of one that recurs are
        scored and normalised once.
        """
        out, starts, runs = np.empty(len(w)), self.vocabulary.starts, len(self.vocabulary.starts) - 1
        key = a * len(self.first) + b
        order = np.argsort(key)
        a, b, w, fresh = a[order], b[order], w[order], np.ones(len(w), bool)
        fresh[1:] = np.diff(key[order]) != 0
        for i in range(0, len(w), CHUNK):
            here = slice(i, i + CHUNK)
            token, new = w[here], fresh[here].copy()
            new[0] = True
            heads = np.flatnonzero(new)
            context = np.cumsum(new) - 1
            hidden = self.first[a[here][heads]] + self.second[b[here][heads]]
            k = self.class_of[token]
            # classes in pieces that stay in a processor's cache
            found = np.concatenate([scored(hidden, self.q, j, context, heads, k) for j in range(0, len(heads), PIECE)])
            hidden = hidden[context]
            some = np.argsort(k)
            ends = np.searchsorted(k[some], np.arange(runs + 1))
            for c in np.flatnonzero(np.diff(ends) * (np.diff(starts) > 1)).tolist():
                at = some[ends[c] : ends[c + 1]]
                found[at] += picked(hidden[at], self.words[starts[c] : starts[c + 1]], np.arange(len(at)), token[at] - starts[c])
            out[order[here]] = found
        return out / np.log(10)


def scored(hidden: np.ndarray, outputs: np.ndarray, first: int, context: np.ndarray, heads: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax, at one output each, of the tokens of the PIECE contexts from the first on; heads are the contexts' first tokens."""
    last = min(first + PIECE, len(heads))
    of = slice(heads[first], heads[last] if last < len(heads) else None)
    return picked(hidden[first:last], outputs, context[of] - first, at[of])


def picked(hidden: np.ndarray, outputs: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of hidden rows over the outputs, at (row, output) pairs: a batched product, normalised."""
    score = hidden @ outputs.T
    own = score[rows, at]
    with np.errstate(over="ignore"):
        total = np.exp(score, out=score).sum(axis=1)
    if np.isfinite(total).all() and total.all():
        return own - np.log(total)[rows]
    score = hidden @ outputs.T  # rare: scores so large or small that they must be shifted first
    most = score.max(axis=1)
    return own - (most + np.log(np.exp(score - most[:, None]).sum(axis=1)))[rows]


def most_frequent(counts: DataFrame) -> DataFrame:
    """The words (word, c) from the least count on, by eighths of its logarithm, that leaves COUNTED at most: no task sorts them, or sees them all."""
    level = F.floor(F.log2("c") * 8)
    least, words = 1 << 20, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # eight for each power of two
        words += r["count"]
        if words > COUNTED:
            break
        least = r.level
    return counts.where(level >= least).select("word", "c")


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs' training rows, and their word counts, written once. Null texts are empty; an empty table gives a model that knows the end alone."""
    counts = materialize(count_words(docs), "words")
    total = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("c") == 1, 1)), F.sum(F.when(F.col("c") == 2, 1))).first()
    n, v, once, twice = (x or 0 for x in total)
    least = max(LEAST_COUNT, -(-n // LEAST_SHARE))
    often = (F.col("c") >= least) & (F.length("word") <= HEAD_BYTES) | (F.col("word") == F.lit(END))
    rows = counts.where(often).agg(F.collect_list(F.struct("word", "c")).alias("rows")).select(F.expr("transform(rows, r -> r.word)"), F.expr("transform(rows, r -> r.c)"))
    words, times = rows.first()  # LEAST_SHARE short words at most
    head = sorted(zip(map(bytes, words), times), key=lambda x: (-x[1], x[0])) or [(END, 0)]
    other = counts.where(~often)
    tail = other.groupBy(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})").alias("s")).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words"))
    best = tail.orderBy(F.desc("tokens"), "s").limit(SUFFIXES - 1).collect()
    all_tokens, all_words = (x or 0 for x in tail.agg(F.sum("tokens"), F.sum("words")).first())
    unknown = np.zeros((2, SUFFIXES))
    unknown[:, : len(best)] = np.array([(r.tokens, r.words) for r in best], float).reshape(-1, 2).T
    unknown[:, -1] += (all_tokens, all_words) - unknown.sum(axis=1)
    vocabulary = vocabulary_of(head, [bytes(r.s) for r in best])
    more = most_frequent(other.where(F.length("word") <= HEAD_BYTES)).toArrow()  # COUNTED short words at most
    class_tokens = np.concatenate([np.add.reduceat(vocabulary.counts, vocabulary.starts[:-1]), unknown[0]])
    weights = trained(docs, vocabulary, class_tokens, n)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return Model(vocabulary, weights, n, v, discount, unknown[0], unknown[1], more.column(0).to_pylist(), more.column(1).to_numpy()), counts


def trained(docs: DataFrame, vocabulary: Vocabulary, class_tokens: np.ndarray, n: int) -> np.ndarray:
    """Parameters after all rounds; biases begin as the logarithms of the counted shares."""
    start = Parameters(vocabulary)
    start.of("q")[:, -1] = np.log((class_tokens + 1.0) / (class_tokens + 1.0).sum())
    inside = np.repeat(np.add.reduceat(vocabulary.counts + 0.5, vocabulary.starts[:-1]), np.diff(vocabulary.starts))
    start.of("v")[:, -1] = np.log((vocabulary.counts + 0.5) / inside)
    rows, before = start.rows, 0
    passes = int(np.clip(LEAST_UPDATES // max(1, n), 1, MOST_PASSES))
    place = F.xxhash64("doc_id", "text")  # equal rows, which no order tells apart, are alike to a trainer
    part, rest = F.pmod(place, F.lit(sum(PARTS))), F.shiftrightunsigned(place, 8)
    for size in PARTS if n else ():
        trainers = int(np.clip(-(-n * size // (sum(PARTS) * TRAINER_TOKENS)), 1, TRAINERS))
        own = docs.where(~held_out() & part.between(before, before + size - 1))
        own = own.select(F.pmod(rest, F.lit(trainers)).cast("int").alias("trainer"), place.alias("place"), "text")
        rows, before = averaged(own, vocabulary, class_tokens, rows, passes, trainers), before + size
    return rows


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and held_out of each row of docs (doc_id, text).

    Documents are added up by a key of their own, so ids may repeat or be null. Null
    texts are empty; an empty table stays empty; extra columns don't matter.
    """
    return added_up(uncounted(docs, model), model, counts)


def uncounted(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each word of a document whose count the tasks don't know, the first of them with the sums over all tokens; one for a document without such words."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = known.value
        ids, size, end = Ids(m.vocabulary, m.counted), m.vocabulary.n_words, m.vocabulary.words[END]
        # By word of the model, unknown token and counted word: its token, its base score, its share of the token, whether training has it.
        unknown = np.array([m.vocabulary.unknown(w) for w in m.counted], np.int64)
        zeros = np.zeros(SUFFIXES)
        token = np.concatenate([np.arange(size + SUFFIXES), unknown])
        base = np.concatenate([m.base(m.vocabulary.counts.astype(float)), zeros, m.base(m.counts.astype(float))])
        share = np.concatenate([np.zeros(size), zeros, m.behind(unknown - size, m.counts)])
        joined = np.concatenate([np.zeros(size, bool), np.ones(SUFFIXES, bool), np.zeros(len(unknown), bool)])
        for batch in in_slices(batches, "text", SLICE):
            found, at, words, tf = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                spelled = tokens(text)
                own = ids.of(spelled)
                rest = Counter(spelled[j] for j in np.flatnonzero(joined[own]).tolist())
                found.append(own)
                at += [i] * max(1, len(rest))
                words += list(rest) or [None]
                tf += list(rest.values()) or [0]
            own = np.concatenate(found) if found else np.zeros(0, np.int64)
            a, b, w = contexts([token[x] for x in found], end)
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            add = lambda x: np.bincount(doc, weights=x, minlength=len(found))
            rows = (add(np.ones(len(w))), add(~joined[own]), add(base[own]), add(m.log_probabilities(a, b, w) + share[own]))
            where = np.array(at, np.int64)
            lead = np.ones(len(where), bool)
            lead[1:] = where[1:] != where[:-1]
            sums = [x[where] * lead for x in rows]
            take = pa.array(where)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(take), batch.column("doc_id").take(take), batch.column("held_out").take(take), pa.array(sums[0].astype(np.int64)),
                 pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.array(words, pa.binary()), pa.array(tf, pa.int64())], names,
            )

    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out().alias("held_out"), "text")
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return keyed.mapInArrow(thrifty(run), f"{schema}, word binary, tf long")


def added_up(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Documents from rows of uncounted(): the words meet their counts in a join, which documents without such words don't enter."""
    known = rows.sparkSession.sparkContext.broadcast(replace(model, counted=[], counts=model.counts[:0]))
    names = rows.columns
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[:7])
    # A null word would be one key of all documents without other words: they get keys of their own, which no word has.
    key = F.coalesce("word", F.concat(F.lit(b"\0none"), F.col("uid").cast("string").cast("binary")))
    met = rows.withColumn("key", key).join(counts.select(F.col("word").alias("w"), "c"), F.col("key") == F.col("w"), "left")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = known.value
        first = m.vocabulary.n_words
        for batch in batches:
            col = lambda x: batch.column(x).to_numpy(zero_copy_only=False)
            times, c = col("tf"), np.nan_to_num(col("c").astype(float)).astype(np.int64)
            unknown = np.fromiter((m.vocabulary.unknown(w) - first if w is not None else 0 for w in batch.column("word").to_pylist()), np.int64, batch.num_rows)
            some = times > 0
            base = col("base_score") + np.where(some, times * m.base(c), 0)
            total = col("score") + np.where(some, times * m.behind(unknown, c), 0)
            out = [batch.column(x) for x in ("uid", "doc_id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(col("n_known") + np.where(c > 0, times, 0), pa.int64()), pa.array(base), pa.array(total)], names[:7])

    added = met.select(*names, "c").mapInArrow(thrifty(add), schema)
    return added.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    ).drop("uid")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs)
    return score(docs, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
