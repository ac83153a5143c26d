"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, l): each vertex with the least vertex of its component. No edge, no row.

    Large and small stars in turn, on links (hi, lo) with lo < hi. Let m(v) be the least
    of v and its neighbours. A large star hands each vertex's higher neighbours to m, a
    small star its lower ones and itself, so links of a component stay links of that
    component, their number doesn't grow, and paths shorten by a factor each round
    whatever the order of their vertices. It ends when the links are stars, and only
    then. Minima are pre-aggregated before each shuffle, which spreads a hub's
    neighbours; each round's links are written, so lineage doesn't grow.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = materialize(links, "links")
    while not stars(links):
        lower = links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        large = links.join(lower, F.col("lo") == F.col("v"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        halfway = materialize(large.distinct(), "links")
        discard(links)
        lower = halfway.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        small = halfway.join(lower, F.col("hi") == F.col("v")).where("lo <> m").select("lo", "m")
        links = materialize(small.union(lower).distinct().toDF("hi", "lo"), "links")
        discard(halfway)
    vertices = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    labels = materialize(vertices.join(links, F.col("v") == F.col("hi"), "left").select("v", F.coalesce("lo", "v").alias("l")), "labels")
    discard(edges, links)
    return labels


def stars(links: DataFrame) -> bool:
    """Whether every hi has one lo that is itself no hi."""
    twice = links.groupBy("hi").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least <> most")
    if twice.limit(1).count():
        return False
    return not links.select("lo").distinct().join(links.select("hi"), F.col("lo") == F.col("hi"), "left_semi").limit(1).count()
