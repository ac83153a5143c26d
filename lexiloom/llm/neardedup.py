"""Operator 8: near-duplicates by SuperMinHash, banding, verification and union-find.

Documents with equal shingle sets form one class from the start. Classes that agree
on a band of their signatures share a bucket; a bucket's members are first compared,
on full sets, with its earliest document alone, so a group of any size costs one
comparison a member. Verified links make components. Only buckets that still hold
several components are looked at again. Those of many members are split by a further
band, and again, so that unlike members part; in what remains, of bounded size,
signatures rule out the pairs that cannot link, and the rest are verified on full sets
until their components are one. With 31 bands of 4, a pair at the threshold of 0.8
shares no band with probability 1e-7, and under two with 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, fresh, in_slices, materialize, table, thrifty
from lexiloom.llm.components import connected_components
from lexiloom.llm.shingles import BANDS, ROWS, SIZE, WordHashes, band_keys, lanes, links, mixed, set_key, shingle_set, signature

PERCENT = 80
WIDTH = 5
#: Pairs whose signatures agree on less than this share are not compared in the second look: five deviations below 0.8.
LEAST_AGREEMENT = 0.62
#: Members that one task compares with a bucket's first.
STAR = 500
#: Members, and bytes of their full sets, that a block of the second look holds about.
BLOCK, BLOCK_BYTES = 1024, 1 << 25
#: A bucket's blocks meet pairwise, which copies each member once a block. Buckets of more members than SPLIT are split by
#: further bands instead, so copies stay few; DEPTH bands at most: what is large even then, members alike that aren't linked, stays whole.
SPLIT, DEPTH = 8192, 4


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, th, key, n, sig): each row's set as a 128-bit key, its size and stored signature; th is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in in_slices(batches, 2):
            keys, sizes, sigs = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, width, hashes)
                keys.append(set_key(s) if len(s) else empty)
                sizes.append(len(s))
                sigs.append(lanes(signature(s)) if len(s) else None)
            columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "th", "key", "n", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(thrifty(run), f"doc_id {kind}, th long, key binary, n long, sig binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, rep, sig) -> (bucket, key, rep), one row a band."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2, 1 << 18):  # 31 rows come of each
            buckets = [band_keys(s) for s in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], ["bucket", "key", "rep"])

    return classes.select("key", "rep", "sig").mapInArrow(thrifty(run), f"bucket long, key binary, rep {kind}")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full sets of the wanted (key, rep, th), recomputed from the representatives' texts: (key, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in in_slices(batches, 1):
            items = [shingle_set(x, width, hashes).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["key", "items"])

    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    found = wanted.join(texts, F.col("rep").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("key", "text")
    return found.mapInArrow(thrifty(run), "key binary, items binary").dropDuplicates(["key"])


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The verified ones of (pivot, key): each pivot's set meets its members' as they stream by, a bounded number of members a run."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("runs"))
    members = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("key"), F.col("runs")).cast("int").alias("run"), "key")
    members = members.join(sets, "key").select("pivot", "run", "key", "items")
    heads = sizes.join(sets, sizes.pivot == sets.key).select("pivot", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("binary").alias("key"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, np.zeros(0, np.uint64)
        for batch in in_slices(batches, 3):
            out = []
            for pivot, _, key, items in zip(*(c.to_pylist() for c in batch.columns)):
                here = np.frombuffer(items, np.uint64)
                if key is None:
                    held, head = pivot, here
                elif held == pivot and links(head, here, percent):
                    out.append((pivot, key))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    rows = heads.union(members).repartition("pivot", "run").sortWithinPartitions("pivot", "run", F.col("key").asc_nulls_first())
    return rows.mapInArrow(thrifty(run), "a binary, b binary")


def agreement(sigs: np.ndarray, size: np.ndarray, comp: np.ndarray, last: int, depth: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows it may link to: other component, sizes and signatures close enough, and no bucket before this one to meet in.

    The rows agree on `depth` bands, `last` being the latest of them; a pair belongs here if these are the first bands that it shares.
    """
    bands = sigs[:, : BANDS * ROWS].copy().view("<u8")[:, : last + 1]
    for i in range(len(sigs) - 1):
        rest = slice(i + 1, None)
        low, high = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
        may = np.flatnonzero((comp[rest] != comp[i]) & (100 * low >= percent * high))
        if len(may):
            may += i + 1
            may = may[(sigs[may] == sigs[i]).sum(axis=1) >= LEAST_AGREEMENT * SIZE]
            may = may[(bands[may] == bands[i]).sum(axis=1) == depth]
            if len(may):
                yield i, may


def groups(batches: Iterator[pa.RecordBatch], keys: int, sizes: int) -> Iterator[list[tuple]]:
    """Rows of batches sorted by their first `keys` columns, one list a key; `sizes` is the column that takes most room."""
    held: list[tuple] = []
    for batch in in_slices(batches, sizes):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def open_members(rows: DataFrame) -> DataFrame:
    """rows (bucket, key, comp, n, ...) of buckets that hold several components, with their members' number and bytes (m, bytes)."""
    sums = rows.groupBy(F.col("bucket").alias("b")).agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), (F.sum("n") * 8).alias("bytes")
    )
    return rows.join(sums.where("x <> y").select("b", "m", "bytes"), F.col("bucket") == F.col("b")).drop("b")


def with_band(rows: DataFrame) -> DataFrame:
    """(bucket, key, comp, n, sig) -> (bucket, last, depth, key, comp, n, sig): which band a bucket is of, and that it is one of one band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4, 1 << 18):
            keys = np.array([band_keys(s) for s in batch.column(4).to_pylist()])
            band = (keys == batch.column(0).to_numpy(zero_copy_only=False)[:, None]).argmax(axis=1)
            columns = [pa.array(band, pa.int32()), pa.array(np.ones(len(band)), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[1:]], ["bucket", "last", "depth", "key", "comp", "n", "sig"])

    return rows.select("bucket", "key", "comp", "n", "sig").mapInArrow(thrifty(run), "bucket long, last int, depth int, key binary, comp binary, n long, sig binary")


def split_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, last, depth, key, comp, n, sig): for each band after the last, the bucket of those that agree on it too."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 6, 1 << 16):  # up to 30 rows come of each
            last = batch.column(1).to_numpy(zero_copy_only=False)
            keys = np.array([band_keys(s) for s in batch.column(6).to_pylist()]).view(np.uint64)
            at, band = np.nonzero(np.arange(BANDS) > last[:, None])
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            found = mixed(path[at] ^ mixed(keys[at, band])).view(np.int64)
            depth = batch.column(2).to_numpy(zero_copy_only=False)[at] + 1
            take = pa.array(at)
            rest = [batch.column(i).take(take) for i in (3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(band, pa.int32()), pa.array(depth, pa.int32()), *rest], names)

    return rows.mapInArrow(thrifty(run), rows.schema)


def second_look(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket and that the first look, with each bucket's pivot alone, can't have seen."""
    rows = members.where("key <> pivot").select("bucket", "key").join(comps, F.col("key") == F.col("v"), "left")
    rows = rows.select("bucket", "key", F.coalesce("l", "key").alias("comp"))
    several = rows.groupBy(F.col("bucket").alias("b")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    rows = rows.join(several, F.col("bucket") == F.col("b"), "left_semi").join(classes.select("key", "n", "sig"), "key")
    rows, looked, columns = open_members(with_band(rows)), [], ["bucket", "last", "depth", "key", "comp", "n", "sig"]
    while True:
        rows = materialize(rows.select(*columns, "m", "bytes"), "open")
        looked.append(rows)
        large = rows.where((F.col("m") > SPLIT) & (F.col("depth") < DEPTH))
        if not large.limit(1).count():
            break
        rows = open_members(split_buckets(large.select(columns)))
    done = reduce(DataFrame.union, [x.where((F.col("m") <= SPLIT) | (F.col("depth") == DEPTH)) for x in looked])
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = done.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "last", "depth", "key", "comp", "n", "sig")

    def prepared(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        names: dict[bytes, int] = {}
        comp = np.array([names.setdefault(r[6], len(names)) for r in group])
        sigs = np.frombuffer(b"".join(r[8] for r in group), "<u2").reshape(len(group), SIZE)
        return sigs, np.array([r[7] for r in group]), comp, group[0][3], group[0][4]

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = dealt.columns

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3, 8):
            found: set[int] = set()
            for i, may in agreement(*prepared(group), percent):
                found.add(i)
                found.update(may.tolist())
            if found:
                keep = [group[i] for i in sorted(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*keep), kinds)], names)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3, 9):
            sigs, size, comp, last, depth = prepared(group)
            sets_ = [np.frombuffer(r[9], np.uint64) for r in group]
            out = []
            for i, may in agreement(sigs, size, comp, last, depth, percent):
                for j in may.tolist():
                    if comp[i] != comp[j] and links(sets_[i], sets_[j], percent):
                        out.append((group[i][5], group[j][5]))
                        comp[comp == comp[j]] = comp[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")

    some = together(dealt).mapInArrow(thrifty(likely), dealt.schema)
    full = some.join(sets, "key").select(*names, "items")
    found = materialize(together(full).mapInArrow(thrifty(verified), "a binary, b binary"), "links")
    discard(*looked)
    return found


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, th, n_shingles, component_id), a row for each row.

    component_id is the least doc_id reachable over links between rows whose sets
    satisfy 100 * common >= percent * union. Null, empty and wordless texts have no
    shingles and link with nothing; rows may repeat, with equal or other texts. Null
    ids never represent a group that has another id. Extra columns don't matter.
    """
    docs = docs.select("doc_id", "text")
    base = materialize(described(docs, width), "shingled")
    least = F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("least")
    classes = base.where("n > 0").groupBy("key").agg(least, F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("key", F.col("least.doc_id").alias("rep"), F.col("least.th").alias("th"), "n", "sig"), "classes")
    bands = banded(classes)
    first = F.min_by("key", F.struct(F.col("rep").isNull(), "rep", "key")).alias("pivot")
    shared = bands.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("m"), first).where("m > 1").select("b", "pivot")
    members = materialize(bands.join(shared, F.col("bucket") == F.col("b")).select("bucket", "key", "pivot"), "members")
    wanted = classes.join(members.select("key").distinct(), "key").select("key", "rep", "th")
    sets = materialize(sets_of(docs, wanted, width), "sets")
    pairs = members.where("key <> pivot").select("pivot", "key").distinct()
    found = materialize(star_links(pairs, sets, percent), "links")
    comps = connected_components(found)
    more = second_look(members, comps, classes, sets, percent)
    discard(members, sets)
    if more.limit(1).count():
        comps = connected_components(found.union(more))
    discard(found, more)
    owners = comps.join(classes.select(F.col("key").alias("v"), "rep"), "v")
    least_ids = owners.groupBy("l").agg(F.min("rep").alias("component")).withColumnRenamed("l", "root")
    joined = comps.join(least_ids, F.col("l") == F.col("root")).select(F.col("v").alias("at"), "component")
    named = classes.select(F.col("key").alias("of"), "rep").join(joined, F.col("of") == F.col("at"), "left").select("of", F.coalesce("component", "rep").alias("component"))
    out = base.join(named, F.col("key") == F.col("of"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the rows whose doc_id is their component's; columns of docs, whatever their names.

    Repeated rows, of one doc_id and text, become one. Rows without shingles all
    stay, null and empty texts among them, and so do rows with null ids that no
    other id represents. An empty table stays empty.
    """
    found = near_duplicates(docs, width, percent).where("doc_id <=> component_id")
    kept = found.groupBy("doc_id", "th").agg(F.max(F.col("n_shingles") > 0).alias("has"), F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept, "kept")
    has, id_, th = fresh(docs, "has"), fresh(docs, "id"), fresh(docs, "th")
    named = kept.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("has").alias(has))
    rows = docs.join(named, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(th)))
    same = [F.col(f"`{c}`") for c in docs.columns]
    if not kept.where("has AND rows > 1").limit(1).count():
        return rows.select(*same)  # no row repeats: the texts need no second exchange
    once = rows.where(F.col(has)).dropDuplicates([id_, th])
    return once.select(*same).union(rows.where(~F.col(has)).select(*same))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, by shingles of four words."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
