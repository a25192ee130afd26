"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import groups, store


def with_least(edges: DataFrame) -> DataFrame:
    """The edges (u, v) with ``m``, the smallest neighbour of u; by (u, salt of v), so that a node with a third of all edges is no hot key."""
    salted = edges.withColumn("_salt", groups.salt(F.col("v")))
    least = groups.partial_then_total(salted, ["u"], {"m": F.min("v")}, {"m": F.min("m")})
    return salted.join(least, ["u", "_salt"]).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = with_least(both).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    known = with_least(edges)
    linked = known.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(known.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge (a, b): the label is the smallest node of its component.

    Each round is written to the shared folder, and the one before it deleted.  Neighbours are never gathered: minima are
    aggregated on the map side and joined back, so a node with any number of neighbours is no hot task."""
    spark = edges.sparkSession
    start = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = store.write_table(start, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        after, after_path = store.write_table(small_star(large_star(now)), "edges")
        store.drop(spark, path)
        now, path = after, after_path
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
