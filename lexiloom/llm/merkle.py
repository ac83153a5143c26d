"""Operator 12: a Merkle manifest of a dataset, its buckets hashed by DuckDB inside tasks.

Rows are leaves; the leaves of a source stand in the order of doc_id, and every three
neighbours become one node until one is left. Ranks cut a source into aligned buckets
of 3 ** HEIGHT leaves: each is a whole subtree, so an executor hashes it by itself,
level by level, with ordered string_agg and sha256 in DuckDB on the bucket's Arrow
table, and gives each leaf its siblings and the bucket its root. Bucket roots are the
leaves of the next round, until every source has one; the sources' roots are the
leaves of the last tree. Spark joins each round's proofs to those below. Only hashes
pass through all this: texts are read once and never shuffled.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, give_back, materialize, ranked, table

FAN = 3
#: Levels of a bucket; it has FAN ** HEIGHT leaves, some 2 MB with their proofs.
HEIGHT = 7
#: Bytes of a round's proofs up to which they are broadcast; larger ones meet the leaves in a shuffle.
MOST_BROADCAST = 8 << 20
#: What a leaf commits to, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<before:string,after:string>>"


def spelled(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """A row's leaf hash; changed: columns to take in place of the row's own."""
    return F.sha2(F.concat(*[spelled(changed.get(f, F.col(f"`{f}`"))) for f in FIELDS]), 256)


def bucket_levels(height: int) -> str:
    """SQL over nodes (pos, node), pos from 0 without gaps: each node's proof up to `height` levels above it, and the top. A level is one ordered aggregate of the one below."""
    run, parts, joins = f"pos // {FAN}", ["level0 AS (SELECT pos, node FROM nodes)"], ""
    for i in range(height):
        parts.append(f"level{i + 1} AS (SELECT {run} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM level{i} GROUP BY {run})")
        sides = [f"coalesce(string_agg(node, '') OVER (PARTITION BY {run} ORDER BY pos ROWS BETWEEN {rows}), '')" for rows in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING")]
        parts.append(f"beside{i} AS (SELECT pos, struct_pack(before := {sides[0]}, after := {sides[1]}) AS pair FROM level{i})")
        joins += f" JOIN beside{i} ON beside{i}.pos = level0.pos // {FAN**i}"
    proof = f"[{', '.join(f'beside{i}.pair' for i in range(height))}]::STRUCT(before VARCHAR, after VARCHAR)[]"
    joins += f" JOIN level{height} ON level{height}.pos = level0.pos // {FAN**height}" if height else ""
    return f"WITH {', '.join(parts)} SELECT {proof} AS proof, level{height}.node AS top FROM level0{joins} ORDER BY level0.pos"


def height_of(total: int) -> int:
    """Levels above `total` leaves until one node is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


def _hashed(found: pa.Table) -> pa.Table:
    """One bucket: its nodes with their proofs, and its root beside the first of them."""
    found = found.sort_by("at")
    nodes = pa.table({"pos": pa.array(range(found.num_rows), pa.int64()), "node": found["node"]})
    height = min(HEIGHT, height_of(found["total"][0].as_py()))
    with duckdb.connect(config={"threads": 1}) as db:
        db.register("nodes", nodes)
        out = db.sql(bucket_levels(height)).to_arrow_table()
    top = pa.array([out["top"][0].as_py() if i == 0 else None for i in range(found.num_rows)], pa.string())
    kept = ["source", "at", "bucket", "node", "total"]
    columns = {**{c: found[c] for c in kept}, "proof": out["proof"].cast(_PROOF_TYPE), "top": top}
    give_back()
    return pa.table(columns)


_PROOF_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def climbed(nodes: DataFrame, label: str) -> DataFrame:
    """(source, at, node, total) -> (source, at, proof, top): every node's siblings up to its source's root, and that root; at counts from 0 within a source, which has `total` nodes.

    A round hashes buckets of FAN ** HEIGHT nodes; the next has their roots. A source of
    10 ** 10 nodes takes four rounds. No task holds more than a bucket.
    """
    size = FAN**HEIGHT
    rows = nodes.withColumn("bucket", F.floor(F.col("at") / size).cast("long"))
    schema = f"source string, at long, bucket long, node string, total long, proof {PROOF}, top string"
    done = materialize(rows.select("source", "at", "bucket", "node", "total").groupBy("source", "bucket").applyInArrow(_hashed, schema), label)
    roots = done.where("top IS NOT NULL").select("source", F.col("bucket").alias("at"), F.col("top").alias("node"), F.ceil(F.col("total") / size).cast("long").alias("total"))
    most = nodes.agg(F.max("total")).first()[0] or 0
    if most > size:
        above = climbed(roots, label)
    else:
        above = roots.select("source", "at", F.array().cast(PROOF).alias("proof"), F.col("node").alias("top"))
    here, there = done.alias("here"), small(above).alias("there")
    met = here.join(there, F.col("here.source").eqNullSafe(F.col("there.source")) & (F.col("here.bucket") == F.col("there.at")))
    return met.select("here.source", "here.at", F.concat("here.proof", "there.proof").alias("proof"), "there.top")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows of proofs, at some 150 bytes a level, are few enough."""
    levels = F.coalesce(F.max(F.size("proof")), F.lit(0))
    n, most = df.agg(F.count(F.lit(1)), levels).first()
    return F.broadcast(df) if n * (200 + 150 * most) <= MOST_BROADCAST else df


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf leads to with its siblings."""
    return F.aggregate(proof, start, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def manifest(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """rows (doc_id, source, leaf, ...) with subroot, root and proof, array<struct<before, after>> from the leaf's level to the root's; the manifest of the dataset that rows are of.

    Within a source leaves stand by doc_id, null first, of equal ids by leaf; sources by
    their UTF-8 bytes, null first, an empty source apart from null. Rows that repeat are
    leaves each, with a proof each. An empty table stays empty. Other columns stay,
    whatever their names, but for ones called like the three.
    """
    kept = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    at = fresh(rows, "at")
    placed = ranked(rows.select(*[F.col(f"`{c}`") for c in kept]), ["source"], [F.asc_nulls_first("doc_id"), leaf], at, "leaves")
    placed = materialize(placed, "leaves")
    totals = small(placed.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("total"), F.array().cast(PROOF).alias("proof"))).select("of", "total")
    nodes = placed.select("source", (F.col(at) - 1).alias("at"), F.col(f"`{leaf}`").alias("node"))
    nodes = nodes.join(totals, F.col("source").eqNullSafe(F.col("of"))).select("source", "at", "node", "total")
    inner = climbed(nodes, "buckets")
    tops = materialize(inner.where("at = 0").select("source", F.col("top").alias("node")), "subroots")
    order = ranked(tops, [], [F.asc_nulls_first("source")], "at", "sources")
    n = tops.count()
    sources = materialize(order.select("source", (F.col("at") - 1).alias("at"), "node", F.lit(n).cast("long").alias("total")), "sources")
    outer = climbed(sources.select(F.lit(None).cast("string").alias("source"), "at", "node", "total"), "roots")
    outer = sources.alias("s").join(outer.alias("o"), F.col("s.at") == F.col("o.at")).select("s.source", F.col("s.node").alias("subroot"), F.col("o.top").alias("root"), "o.proof")
    here, up, out = placed.alias("here"), inner.alias("up"), small(outer).alias("out")
    met = here.join(up, F.col("here.source").eqNullSafe(F.col("up.source")) & (F.col(f"here.{at}") == F.col("up.at") + 1))
    met = met.join(out, F.col("here.source").eqNullSafe(F.col("out.source")))
    return met.select(*[F.col(f"here.`{c}`") for c in kept], "out.subroot", "out.root", F.concat("up.proof", "out.proof").alias("proof"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, half of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = leaf(text=F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    rows = docs.select("doc_id", "source", leaf().alias("leaf"), tampered.alias("tampered"))
    found = manifest(rows)
    again = folded(F.col("tampered"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """
list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8,
  list_reduce([(xor(c, b) & 255)::BIGINT] || [0::BIGINT for i in range(8)], lambda t, k: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)))"""
_SPELLED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS_SQL = " || ".join(_SPELLED.format(f) for f in FIELDS[:-1])


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs over leaves (g, pos, node, total): all nodes by level, and the siblings of each."""
    return f"""
{name}_up AS (
  SELECT g, 0 AS level, pos, node, total FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), max((total + {FAN - 1}) // {FAN}) FROM {name}_up WHERE total > 1 GROUP BY g, level, pos // {FAN}
), {name}_beside AS (
  SELECT g, level, pos,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}_up WHERE total > 1 WINDOW w AS (PARTITION BY g, level, pos // {FAN} ORDER BY pos)
), {name}_path AS (
  SELECT g, leaf, list({{'before': before, 'after': after}} ORDER BY level) AS proof FROM (
    SELECT a.g, a.pos AS leaf, b.level, b.before, b.after FROM {leaves} a JOIN {name}_beside b ON a.g = b.g AND b.pos = a.pos // ({FAN} ** b.level)::BIGINT
  ) GROUP BY g, leaf
)"""


SQL = {
    "op12_merkle": f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS g, sha256({_FIELDS_SQL} || {_SPELLED.format("text")}) AS leaf,
    sha256({_FIELDS_SQL} || CASE WHEN {_CRC} % 2 = 1 THEN {_SPELLED.format("replace(text, chr(10), '')")} ELSE {_SPELLED.format("text")} END) AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, count(*) OVER (PARTITION BY g) AS total FROM hashed
), {_tree_sql("sub", "leaves")}, tops AS (
  SELECT g AS of, node FROM sub_up WHERE total = 1
), sources AS (
  SELECT of, 0 AS g, row_number() OVER (ORDER BY encode(of)) - 1 AS pos, node, count(*) OVER () AS total FROM tops
), {_tree_sql("top", "sources")}, proofs AS (
  SELECT l.doc_id, l.leaf, l.tampered, s.node AS subroot, (SELECT node FROM top_up WHERE total = 1) AS root,
    list_concat(coalesce(i.proof, []), coalesce(o.proof, [])) AS proof, row_number() OVER () AS r
  FROM leaves l JOIN sources s ON l.g = s.of LEFT JOIN sub_path i ON i.g = l.g AND i.leaf = l.pos LEFT JOIN top_path o ON o.leaf = s.pos
), folds AS (
  SELECT r, 0 AS level, tampered AS node FROM proofs
  UNION ALL
  SELECT f.r, level + 1, sha256(proof[level + 1].before || f.node || proof[level + 1].after) FROM folds f JOIN proofs p ON f.r = p.r WHERE level < len(proof)
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(proof, lambda p: p.before || p.after)), 'string_agg', '')) AS proof_sha256,
  f.node AS folded_root, f.node = root AS verified
FROM proofs p JOIN folds f ON f.r = p.r AND f.level = len(proof)
"""
}
