"""Operator 4: document fingerprints from improbable features.

Every window of WINDOW bytes has an entropy. How rare an entropy level is, counted
over all windows of the corpus, ranks the windows; in each run of NEIGHBOURS windows
the rarest is marked, and windows marked often enough are features. Their hashes go
into a chain of Bloom filters of fixed fill. Two fingerprints are as alike as their
filters' bits overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiloom.llm.common import fresh, in_slices, table, thrifty

WINDOW = 32
NEIGHBOURS = 64
MARKS = 16
LEVELS = 512
BITS, HASHES, PER_FILTER = 2048, 5, 128
#: Bytes of text handled at a time; longer texts go in overlapping parts.
BLOCK = 1 << 18
#: Documents a range of ids should hold where ranges are cut for the next-document step, and most ranges: their bounds come to the driver.
PER_RANGE, MOST_RANGES = 2000, 32_768

# What the sum over a window of count * log2(count) gains when a byte already there k times comes, as integers so that sums are exact.
_UNIT = 1 << 16
_K = np.arange(WINDOW + 1, dtype=float)
_GAIN = np.rint(_UNIT * ((_K + 1) * np.log2(_K + 1) - np.where(_K > 0, _K * np.log2(np.maximum(_K, 1)), 0))).astype(np.int64)
_OF_COUNT = np.concatenate(([0], np.cumsum(_GAIN)))  # what all k copies of a byte come to


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS - 1, of each window of WINDOW bytes.

    before[i] counts the earlier bytes equal to byte i within a window, after[i]
    the later ones; sliding a window by a byte changes its sum by the gains of the
    byte that comes and of the one that goes.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(n, bool)
    for lag in range(1, WINDOW):
        hit = np.equal(data[lag:], data[:-lag], out=same[: n - lag]).view(np.uint8)
        np.add(before[lag:], hit, out=before[lag:])
        np.add(after[:-lag], hit, out=after[:-lag])
    counts = np.bincount(data[:WINDOW], minlength=256)
    first = int(_OF_COUNT[counts].sum())
    steps = _GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]]
    total = np.concatenate(([first], first + np.cumsum(steps)))
    most = WINDOW * int(np.log2(WINDOW)) * _UNIT
    return ((most - total) * (LEVELS - 1) // most).astype(np.int64)


def blocks(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a text that together have every run of NEIGHBOURS windows, and how many starts of runs each adds."""
    step = BLOCK - WINDOW - NEIGHBOURS + 1
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, max(1, len(raw) - WINDOW - NEIGHBOURS + 2), step):
        yield raw[a : a + BLOCK - 1], a


def features(data: bytes, rarity: np.ndarray) -> list[bytes]:
    """The selected windows of a text, in order; a text shorter than a window is its only feature. Only an empty text has none."""
    if len(data) < WINDOW:
        return [data] if data else []
    places, marks = [], []
    for part, start in blocks(data):
        ranks = rarity[entropy_levels(part)]
        width = min(NEIGHBOURS, len(ranks))
        keys = ranks << 40 | np.arange(len(ranks))  # the lowest rank, leftmost of equals
        have = 1
        while have < width:
            more = min(have, width - have)
            keys = np.minimum(keys[:-more], keys[more:])
            have += more
        at, n = np.unique(keys & (1 << 40) - 1, return_counts=True)
        places.append(at + start)
        marks.append(n)
    at, n = places[0], marks[0]
    if len(places) > 1:
        at, of = np.unique(np.concatenate(places), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(marks))
    least = min(MARKS, max(1, len(data) - WINDOW - NEIGHBOURS + 2))
    if n.max() < least:  # marks lie too evenly: the most-marked windows, each content once
        return list(dict.fromkeys(data[i : i + WINDOW] for i in at[n == n.max()].tolist()))
    return [data[i : i + WINDOW] for i in at[n >= least].tolist()]


def filters(found: list[bytes]) -> np.ndarray:
    """(filters, BITS / 8) bytes: distinct features fill one filter after another."""
    found = list(dict.fromkeys(found))
    hashes = np.frombuffer(b"".join(hashlib.sha1(x).digest() for x in found), ">u4").reshape(-1, HASHES) % BITS
    out = np.zeros((-(-len(found) // PER_FILTER), BITS), bool)
    out[np.repeat(np.arange(len(found)) // PER_FILTER, HASHES), hashes.ravel()] = True
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of the shorter chain's filters, the mean of the best overlap beyond chance with the other's."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    both, nx, ny = x @ y.T, x.sum(axis=1)[:, None], y.sum(axis=1)[None]
    chance, most = nx * ny / BITS, np.minimum(nx, ny)
    return float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1).mean())


def encoded(chain: np.ndarray) -> str:
    return ".".join(base64.b64encode(x.tobytes()).decode() for x in chain)


def rarity_of(docs: DataFrame) -> np.ndarray:
    """Ranks of entropy levels, rarest first, counted over every window of every text; LEVELS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in in_slices(batches, 0):
            for data in joined(batch.column(0).cast(pa.binary()).to_pylist()):
                counts += np.bincount(data, minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(counts, pa.int64())], ["level", "n"])

    counts = np.zeros(LEVELS, np.int64)
    for level, n in docs.select("text").mapInArrow(thrifty(run), "level int, n long").groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    order = np.lexsort((np.arange(LEVELS), counts))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def joined(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Entropy levels of all windows that lie within a text, many short texts at a time."""
    held: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if text is not None and len(text) < WINDOW:
            continue
        if held and (text is None or size + len(text) > BLOCK):
            levels = entropy_levels(np.frombuffer(b"".join(held), np.uint8))
            inside = np.ones(len(levels), bool)
            for end in np.cumsum([len(x) for x in held])[:-1].tolist():
                inside[end - WINDOW + 1 : end] = False
            yield levels[inside]
            held, size = [], 0
        if text is not None:
            if len(text) > BLOCK:
                for a in range(0, len(text) - WINDOW + 1, BLOCK):
                    yield entropy_levels(np.frombuffer(text[a : a + BLOCK + WINDOW - 1], np.uint8))
            else:
                held.append(text)
                size += len(text)


def fingerprint(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """docs with a fingerprint column; needs text. Equal texts get equal fingerprints; null and empty ones an empty one."""
    name = fresh(docs, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = [encoded(filters(features(x or b"", rarity))) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(thrifty(run), StructType([*docs.schema.fields, StructField(name, StringType())]))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of ids: rows (__range, doc_id, text, __lead), where a lead row is the next range's first document.

    Ids are cut into ranges at approximate quantiles (a bounded number of longs).
    A range's first document goes to the range before as well; the first of all
    also follows the last. Within a range, rows sorted by id then hold each
    document's successor, so texts are shuffled once. Null ids come last.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = min(MOST_RANGES, max(1, n // PER_RANGE))
    cuts = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0)
            at = np.searchsorted(bounds, some.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at[some.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], ["doc_id", "r"])

    firsts = ids.mapInArrow(place, "doc_id long, r int").groupBy("r").agg(F.min("doc_id").alias("first")).orderBy("r").collect()  # one row a range
    first = {r.r: r.first for r in firsts}
    order = sorted(first)
    leads = {first[r]: order[i - 1] for i, r in enumerate(order) if first[r] is not None}
    lead_ids = np.array(sorted(leads), np.int64)
    lead_to = np.array([leads[i] for i in lead_ids.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            none = key.is_null().to_numpy(zero_copy_only=False)
            ids = key.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, ids, "right").astype(np.int32)
            at[none] = len(bounds)
            k = np.searchsorted(lead_ids, ids).clip(0, max(0, len(lead_ids) - 1))
            also = np.flatnonzero((lead_ids[k] == ids) & ~none) if len(lead_ids) else np.array([], np.int64)
            rows = pa.array(np.concatenate([np.arange(len(ids)), also]))
            where = np.concatenate([at, lead_to[k[also]] if len(also) else np.array([], np.int32)])
            flag = np.concatenate([np.zeros(len(ids), bool), np.ones(len(also), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), key.take(rows), text.take(rows), pa.array(flag)], ["__range", "doc_id", "text", "__lead"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "__range int, doc_id long, text string, __lead boolean")
    # A lead row sorts after its range's own rows: its id is larger, or it is the first of all, which follows the last.
    return dealt.repartition("__range").sortWithinPartitions("__range", "__lead", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints_with_edits(docs: DataFrame, rarity: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each of docs (doc_id long, text).

    The edited text ends in the next document's beginning, by ascending id; after the
    last comes the first. Null texts are empty. Rows of one id follow one another in
    the order of their texts; null ids come last, and where no id is there at all
    nothing follows the last. An empty table stays empty.
    """
    docs = docs.select("doc_id", "text")
    rarity = rarity_of(docs) if rarity is None else rarity
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def described(row: tuple, after: tuple) -> tuple:
            doc_id, text, own = row
            half = len(text) // 2
            edited = text[: len(text) - half] + after[1][:half]
            raw = edited.encode()
            new = filters(features(raw, rarity))
            return (doc_id, len(text), hashlib.sha256(raw).hexdigest(), encoded(own), encoded(new), likeness(own, new), likeness(own, after[2]))

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        nothing = (None, "", filters([]))
        held: tuple | None = None  # the document before, with its fingerprint
        held_range, done = None, False
        for batch in in_slices(batches, 2):
            out = []
            for where, doc_id, text, lead in zip(*(c.to_pylist() for c in batch.columns)):
                if where != held_range:
                    if held is not None and not done:
                        out.append(described(held, nothing))  # no id follows it, and none comes first
                    held, held_range, done = None, where, False
                if done:
                    continue  # further rows of the next range's first id
                text = text or ""
                row = (doc_id, text, filters(features(text.encode(), rarity)))
                if held is not None:
                    out.append(described(held, row))
                held, done = row, lead
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if held is not None and not done:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(described(held, nothing), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(thrifty(run), schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))
