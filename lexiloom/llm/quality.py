"""Operator 3: quality classifier, a regularised quadratic discriminant.

Every document becomes a vector of transformed statistics of its text. Tasks sum
counts, vectors and outer products of the labelled rows by class; those few sums
give each class its mean and a covariance shrunk towards its diagonal and the
pooled one. The covariances' Cholesky factors are inverted once; a document's score
is the logistic of the difference of its two Mahalanobis log densities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiloom.llm.common import discard, fresh, in_slices, materialize, table, thrifty

FEATURES = (
    "word_length", "long_words", "upper", "digits", "symbols", "pipes", "exclamations", "commas", "stops",
    "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "ended_words", "marked_words", "entropy",
)
#: Shares of the class's diagonal and of the pooled covariance in each covariance.
TO_DIAGONAL, TO_POOLED = 0.1, 0.1
RIDGE = 1e-3
#: The log-odds are held to this, so that scores stay inside (0, 1).
MOST_LOG_ODDS = 30.0
#: Texts count as they are; only the distinct-pair share is taken in stretches of this many words, so that long texts compare with short ones.
STRETCH = 512

_KIND = np.zeros((5, 256))
_KIND[0, ord("A") : ord("Z") + 1] = 1
_KIND[1, ord("0") : ord("9") + 1] = 1
for _c in b"#$%&*+<=>@^_`~\\/{}[]":
    _KIND[2, _c] = 1
_KIND[3, ord("|")] = 1
_KIND[4, ord("!")] = 1
_ENDS = np.zeros((2, 256))
_ENDS[0, [*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1
_ENDS[1, [*b"#$%&*+<=>@^_`~\\/{}[]|!"]] = 1
#: What a share is taken to be where a text is too short to tell, and how many characters or words that counts for.
USUAL = {
    "upper": 0.03, "digits": 0.002, "symbols": 0.001, "pipes": 0.0005, "exclamations": 0.0005, "commas": 0.01, "stops": 0.015,
    "long_words": 0.03, "distinct_words": 0.7, "distinct_pairs": 0.98, "distinct_lines": 0.98, "top_word": 0.07, "ended_words": 0.85, "marked_words": 0.01,
}
CHARACTERS, WORDS, LINES = 120, 30, 8


def logit(hits: float, size: float, name: str, strength: float) -> float:
    """Log-odds of a share, drawn towards the usual one."""
    share = (hits + USUAL[name] * strength) / (size + strength)
    return float(np.log(share / (1 - share)))


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a text, in UTF-8. Defined for empty texts."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words = len(raw), raw.split()
    n = len(words)
    letters = size - int(counts[9:14].sum()) - int(counts[32])
    upper, digits, symbols, pipes, exclamations = _KIND @ counts
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    fresh_pairs = pairs = 0
    for a in range(0, max(n - 1, 0), STRETCH):
        part = words[a : a + STRETCH + 1]
        fresh_pairs += len(set(zip(part, part[1:])))
        pairs += len(part) - 1
    ended, marked = _ENDS @ np.bincount(np.frombuffer(bytes([w[-1] for w in words]), np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, size)
    return [
        float(np.log((lengths.sum() + 6 * WORDS) / (n + WORDS))),
        logit((lengths > 14).sum(), n, "long_words", WORDS),
        logit(upper, letters, "upper", CHARACTERS),
        logit(digits, letters, "digits", CHARACTERS),
        logit(symbols, letters, "symbols", CHARACTERS),
        logit(pipes, letters, "pipes", CHARACTERS),
        logit(exclamations, letters, "exclamations", CHARACTERS),
        logit(int(counts[ord(",")]), letters, "commas", CHARACTERS),
        logit(int(counts[ord(".")]), letters, "stops", CHARACTERS),
        logit(len(seen), n, "distinct_words", WORDS),
        logit(fresh_pairs, pairs, "distinct_pairs", WORDS),
        logit(len(set(lines)), len(lines), "distinct_lines", LINES),
        logit(max(seen.values(), default=0), n, "top_word", WORDS),
        logit(ended, n, "ended_words", WORDS),
        logit(marked, n, "marked_words", WORDS),
        float(-(share * np.log2(share)).sum()) * letters / (letters + CHARACTERS) + 4.2 * CHARACTERS / (letters + CHARACTERS) if size else 4.2,
    ]


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors, log determinants and log priors; classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(rows, 2) log density plus log prior."""
        out = np.empty((len(x), 2))
        for k in range(2):
            z = (x - self.means[k]) @ self.factors[k].T
            out[:, k] = self.offsets[k] - 0.5 * (z * z).sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.log_density(x)
        return 1 / (1 + np.exp(-np.clip(d[:, 1] - d[:, 0], -MOST_LOG_ODDS, MOST_LOG_ODDS)))


def fitted(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], dims: int) -> Discriminant | float:
    """The discriminant of {class: (rows, sum, sum of outer products)}; a constant score where a class has no rows."""
    if len(sums) < 2:
        return 0.5 if not sums else float(next(iter(sums)))
    rows = np.array([sums[k][0] for k in (0, 1)])
    means = np.array([sums[k][1] / sums[k][0] for k in (0, 1)])
    covs = [sums[k][2] / sums[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (covs[0] * rows[0] + covs[1] * rows[1]) / rows.sum()
    scale = np.diag(pooled).clip(1e-12)
    factors, offsets = [], []
    for k in (0, 1):
        shrunk = (1 - TO_DIAGONAL - TO_POOLED) * covs[k] + TO_DIAGONAL * np.diag(np.diag(covs[k])) + TO_POOLED * pooled
        shrunk += np.diag(RIDGE * scale + 1e-9)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(rows[k] / rows.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    return np.array([statistics(x or b"") for x in texts], float).reshape(-1, len(FEATURES))


def in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, statistics), the statistics as the bytes of their doubles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            rows = pa.array([x.tobytes() for x in vectors(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "statistics"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, statistics binary")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, len(FEATURES))


def train(described: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Fit on all labelled rows of described (doc_id, statistics) and labels (doc_id, quality).

    A doc_id with several labels is used once a label; null ids, and labels that
    are neither 0 nor 1, aren't used. Labels meet statistics, not texts, in a join;
    tasks return one row of sums a class.
    """
    wanted = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).distinct()
    rows = described.where(in_training()).join(wanted, F.col("doc_id") == F.col("id")).select("statistics", "quality")
    dims = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x, y = unpacked(batch.column("statistics")), batch.column("quality").to_numpy(zero_copy_only=False)
            for k in np.unique(y):
                part = x[y == k]
                s = sums.setdefault(int(k), [0.0, np.zeros(dims), np.zeros((dims, dims))])
                s[0], s[1], s[2] = s[0] + len(part), s[1] + part.sum(axis=0), s[2] + part.T @ part
        if sums:
            flat = [[s[0], *s[1], *s[2].ravel()] for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["quality", "sums"])

    parts = rows.mapInArrow(thrifty(run), "quality int, sums array<double>")
    width = 1 + dims + dims * dims
    summed = parts.groupBy("quality").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    found = {}
    for k, flat in summed.collect():  # two rows at most
        v = np.array(flat)
        found[k] = (v[0], v[1 : 1 + dims], v[1 + dims :].reshape(dims, dims))
    return fitted(found, dims)


def score(rows: DataFrame, model: Discriminant | float, name: str = "score", ready: bool = False) -> DataFrame:
    """rows with a score column, from their text or, if ready, from the statistics that described() gives.

    Null and empty texts are scored as empty; rows may repeat; an empty table stays
    empty; extra columns pass through, but for one called `name`.
    """
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    columns = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "statistics" if ready else "text"):
            x = unpacked(batch.column("statistics")) if ready else vectors(batch, "text")
            got = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], columns)

    return rows.mapInArrow(thrifty(run), schema)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs; learnt from their labels.

    Statistics for the training are written first, so that no task runs two Python
    stages, each with a worker of its own, at once. Rows that repeat stay or go
    together; null and empty texts are scored as empty; an empty table stays empty.
    """
    name = fresh(docs, "score")
    rows = materialize(described(docs), "statistics")
    model = train(rows, table(spark, sf_dir, "labels"))
    discard(rows)
    return score(docs, model, name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; statistics are computed once and written."""
    rows = materialize(described(table(spark, sf_dir, "documents")), "statistics")
    scored = score(rows, train(rows, table(spark, sf_dir, "labels")), "score", ready=True)
    return scored.select(
        "doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
