"""Operator 1: mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import WORD, fresh, materialize, ranked, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources: (source, source_size) -> (source, source_size, target, rate, start).

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes. No target exceeds `most` times its source's size: with
    sources sorted by cap over weight, capped ones come first, so the common
    level of the others is the largest of (total - caps before) / (weights from
    here on). One row per source is all these windows see. `rate` is the number
    of copies expected of each document; `start` is one random offset in [0, 1).
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / F.sum("weight").over(rest))
    rows = rows.withColumn("level", F.max("level").over(every))
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    seed = F.concat(F.lit(f"{SEED}:"), F.coalesce("source", F.lit("\0")))
    return rows.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("start"),
    )


def with_copies(
    docs: DataFrame, size: str, names: Sequence[str] = ("source_size", "target", "copies"), weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Add three columns, called `names`, to rows with doc_id, source and the column named by size: the source's size and target, and the row's copies.

    Within a source, rows in a fixed order are given the prefix sum of their
    expected copies, rate * rank, plus one random offset; a row is emitted once for
    each integer boundary that its step crosses. The order rises through the
    sizes of one half of the rows, by hash of doc_id, and falls through those of
    the other, so each stretch of equal sizes contributes its share and what the
    offset adds on the way up it takes on the way down. Rows may repeat; null and
    empty texts have size 0; an empty table stays empty; extra columns pass
    through, whatever their names, but for ones called like the three.
    """
    tie, wave = fresh(docs, "tie"), fresh(docs, "wave")
    rank = fresh(docs, "rank")
    rows = docs.withColumn(tie, F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    rows = rows.withColumn(wave, F.when(F.col(tie) < "8", F.col(size) - (1 << 60)).otherwise(-F.col(size)))
    rows = ranked(rows, ["source"], [wave, tie], rank, "mix")
    plan = source_targets(rows.groupBy("source").agg(F.sum(size).alias("source_size")), weights, most).alias("plan")
    here = rows.alias("here")
    joined = here.join(plan, F.col("here.source").eqNullSafe(F.col("plan.source")))
    step = lambda r: F.floor(F.col("plan.start") + F.col("plan.rate") * r)
    at = F.col(f"here.{rank}")
    copies = F.least(step(at) - step(at - 1), F.lit(most)).cast("long")
    kept = [F.col(f"here.`{c}`") for c in docs.columns if c not in names]
    return joined.select(*kept, F.col("plan.source_size").alias(names[0]), F.col("plan.target").alias(names[1]), copies.alias(names[2]))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: each row of docs as often as the sampling emits it, with the columns of docs, whatever their names.

    Rows without words, of null or empty texts, cost nothing and are drawn like the
    others of their source. Ranks go by size, which would bring the longest texts
    together: so only keys and sizes are ranked, and texts meet their copies in a
    join by doc_id and a hash of the row. Rows that are equal in all columns share
    what is drawn for them together.
    """
    same = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*same)
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("row"))
    drawn = with_copies(slim, "size", weights=weights, most=most).groupBy("doc_id", "row")
    drawn = materialize(drawn.agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"), "drawn")
    mine, nth = fresh(docs, "row"), fresh(docs, "nth")
    copies, rows = fresh(docs, "copies"), fresh(docs, "rows")
    keyed, found = docs.withColumn(mine, row), drawn.select(F.col("doc_id").alias("of"), "row", F.col("copies").alias("n"), F.col("rows").alias("m")).alias("found")
    met = keyed.alias("here").join(found, F.col("here.doc_id").eqNullSafe(F.col("found.of")) & (F.col(f"here.{mine}") == F.col("found.row")))
    met = met.select(*[F.col(f"here.`{c}`") for c in docs.columns], F.col(f"here.{mine}"), F.col("found.n").alias(copies), F.col("found.m").alias(rows))
    if drawn.where("rows > 1").limit(1).count():
        met = met.where(F.col(rows) == 1).union(met.where(F.col(rows) > 1).dropDuplicates(["doc_id", mine]))
    return met.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*same)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = with_copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "size")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SIZED = """
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM sources
), levels AS (
  SELECT a.source, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0))::DOUBLE
    / sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM weighed a CROSS JOIN weighed b GROUP BY a.source
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM weighed
), ranks AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN tie < '8' THEN size - 1152921504606846976 ELSE -size END, tie) AS r
  FROM (SELECT *, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS tie FROM sized)
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), starts AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM rates
)
"""

SQL = {
    "op1_mixing": f"""
WITH {_SIZED}
SELECT doc_id, size, source_size, target, CAST(least(floor(start + rate * r) - floor(start + rate * (r - 1)), 3) AS BIGINT) * size AS taken
FROM ranks JOIN starts ON ranks.source IS NOT DISTINCT FROM starts.source
"""
}
