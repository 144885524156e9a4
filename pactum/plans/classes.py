"""Equivalence classes of a symmetric, transitive relation (such as owl:sameAs), as one row for each member.

The relation's closure has a row for each pair of a class, so a class of n costs n * n rows; a class costs n rows here, and
statements are rewritten to representatives once instead of being joined with the closure.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.plans.stage import dropped, stage_folder, staged


def _least(e: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours, pre-aggregated before the shuffle."""
    return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def equivalence_classes(edges: DataFrame) -> DataFrame:
    """node, representative (the least member of its class), for each node of an edge; edges: a, b of one type that is ordered.

    Rows with a null are ignored; a node related to itself alone is a class of one. In each round every node's larger
    neighbours, and then its smaller ones, are tied to the least node it knows, so paths shrink to stars in a logarithmic number
    of rounds. Edges never grow in number. A node with very many edges is a skewed key of a join, which Spark deals out at run time.
    """
    spark, folder = edges.sparkSession, stage_folder(edges.sparkSession)
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{folder}/nodes")
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges")
    before = None
    for k in count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").unionByName(low)
        e = staged(small.filter("u <> m").select("u", F.col("m").alias("v")).distinct(), f"{folder}/{k}")
        if k:
            dropped(spark, f"{folder}/{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("representative"))


def contracted(statements: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct statements with representatives in these columns; what is in no class stays."""
    order = statements.columns
    for c in columns:
        known = classes.select(F.col("node").alias(c), F.col("representative").alias("__r"))
        statements = statements.join(known, c, "left").withColumn(c, F.coalesce("__r", c)).drop("__r")
    return statements.select(*order).distinct()
