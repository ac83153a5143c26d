"""Operator 9: line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, materialize, table

#: A line that more than this part of a host's pages contain is boilerplate ...
MAX_RATIO = 0.1
#: ... if so many pages do: a line of one page alone isn't repeated, however few pages its host has.
MIN_PAGES = 2
#: Bytes of line digests that are broadcast to every task; beyond, rows meet them in a join, a host's dealt to SALTS tasks.
MOST_BROADCAST = 8 << 20
SALTS = 64
#: Where HTML begins a new line: after these tags and at line breaks.
BREAKS = r"(?i)</(?:p|div|li|h[1-6]|tr|title|nav|footer|header|article|section|ul|ol|script|style)>|<br ?/?>|\n"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def digest(line: Column) -> Column:
    """Stands for a line in every shuffle: 16 bytes, however long it is."""
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(rows: DataFrame, page: str, host: Column, lines: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): each host's boilerplate lines, as digests; hosts without any have no row.

    Rows of one page id count as one page, and a page that repeats a line counts
    once. Only digests are shuffled. A host's array is short by itself: each line is
    on max_ratio of its pages, so there are at most (mean lines a page) / max_ratio.
    """
    of = rows.select(host.alias("host"), F.col(page).alias("page"), lines.alias("lines"))
    worth = F.array_distinct(F.filter("lines", lambda x: F.trim(x) != ""))
    seen = of.select("host", "page", F.explode(F.transform(worth, digest)).alias("line")).distinct()
    totals = of.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).alias("t")
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).alias("c")
    often = counts.join(totals, F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > F.col("pages") * max_ratio)
    return often.groupBy(F.col("c.host").alias("host")).agg(F.collect_set("line").alias("drop"))


def drop_boilerplate(
    rows: DataFrame, page: str, host: Column, lines: Column, names: tuple[str, str] = ("lines", "kept"),
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Add two columns, called `names`, to rows: the lines of a row before and after dedup.

    `lines` gives a row's array of lines, null for a null text (whose kept lines are
    null too); blank lines are never boilerplate. Null hosts are a host of their
    own. Rows may repeat; an empty table stays empty; extra columns pass through,
    whatever their names, but for ones called like the two. The hosts' digests are
    written and measured: up to most_broadcast bytes go to every task, and no text
    is shuffled; beyond, rows meet them by host and a salt, so that no host is one task's.
    """
    drops = materialize(boilerplate(rows, page, host, lines, max_ratio, min_pages), "drops")
    size = drops.agg(F.sum(F.size("drop") * 16 + F.coalesce(F.octet_length("host"), F.lit(0)))).first()[0] or 0
    at, salt = fresh(rows, "at"), fresh(rows, "salt")
    mine = rows.withColumn(names[0], lines).withColumn(at, host)
    if size <= most_broadcast:
        there, same = F.broadcast(drops).alias("there"), F.lit(True)
    else:
        mine = mine.withColumn(salt, F.pmod(F.xxhash64(page, names[0]), F.lit(SALTS)))
        there = drops.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("there")
        same = F.col(f"here.{salt}") == F.col("there.salt")
    joined = mine.alias("here").join(there, F.col(f"here.{at}").eqNullSafe(F.col("there.host")) & same, "left")
    own, drop = F.col(f"here.`{names[0]}`"), F.col("there.drop")
    kept = F.when(drop.isNull(), own).otherwise(F.filter(own, lambda x: ~F.array_contains(drop, digest(x)) | (F.trim(x) == "")))
    return joined.select(*[F.col(f"here.`{c}`") for c in rows.columns if c not in names], own.alias(names[0]), kept.alias(names[1]))


def dedup_lines(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Documents without their source's boilerplate lines; the source is the host.

    Returns the columns of docs, whatever their names: text loses its boilerplate
    lines and n_chars, if there, is the new length where a line went. A null text
    stays null, a document may become empty, and none goes.
    """
    before, after = names = fresh(docs, "lines"), fresh(docs, "kept")
    rows = drop_boilerplate(docs, "doc_id", F.col("source"), F.split("text", "\n"), names, max_ratio, min_pages)
    changed = F.size(after) < F.size(before)
    rows = rows.withColumn("text", F.when(changed, F.array_join(after, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_chars, kept_sha256 of each of pages (page_id, url, html): host by URL, lines by HTML's line breaks.

    A null page has no lines; a null URL is a host of its own.
    """
    host = F.lower(F.regexp_extract("url", HOST, 1))
    rows = drop_boilerplate(pages.select("page_id", "html", host.alias("host")), "page_id", F.col("host"), F.split("html", BREAKS))
    kept = F.array_join("kept", "\n")
    return rows.select(
        "page_id",
        "host",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.char_length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_chars, kept_sha256 of every page."""
    return page_lines(table(spark, sf_dir, "pages"))


SQL = {
    "op9_line_dedup": rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_split_to_array(html, '{BREAKS}') AS ls FROM pages
), seen AS (
  SELECT DISTINCT host, page_id, line FROM (SELECT host, page_id, unnest(ls) AS line FROM p) WHERE trim(line, ' ') <> ''
), totals AS (SELECT host, count(DISTINCT page_id) + max(CASE WHEN page_id IS NULL THEN 1 ELSE 0 END) AS pages FROM p GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line),
often AS (
  SELECT c.host, c.line FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE n >= {MIN_PAGES} AND n > pages * CAST({MAX_RATIO} AS DOUBLE)
), parts AS (
  SELECT page_id, host, i, ls[i] AS line FROM (SELECT page_id, host, ls, unnest(range(1, len(ls) + 1)) AS i FROM p)
), kept AS (
  SELECT q.page_id, q.i, q.line, o.line IS NOT NULL AS gone FROM parts q LEFT JOIN often o ON q.host IS NOT DISTINCT FROM o.host AND q.line = o.line
), joined AS (
  SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM kept GROUP BY page_id
)
SELECT p.page_id, p.host, n_lines, n_dropped, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM p JOIN joined USING (page_id)
"""
}
