"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


#: A node with more edges than a share of all is a hub, and than this; there are at most 2 * HUBS hubs.
HUBS, LEAST_HUB = 20_000, 200


def _least(e: DataFrame) -> DataFrame:
    """u, m (the least of u's neighbours and u), n (neighbours); pre-aggregated before the shuffle."""
    return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))


def _hubs(low: DataFrame, many: int) -> DataFrame | None:
    """u, m of the nodes with more than `many` edges, or None; few enough for the driver and a broadcast, as degrees add up to twice the edges."""
    found = low.filter(F.col("n") > many).select("u", F.col("m").alias("hub")).toArrow()
    return low.sparkSession.createDataFrame(found, "u long, hub long") if found.num_rows else None


def _with_least(e: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """u, v, m for each edge, by a join on u; edges of hubs get their m from a broadcast, so that no task gets all edges of one."""
    if hubs is None:
        return e.join(low.select("u", "m"), "u").select("u", "v", "m")
    tagged = e.join(F.broadcast(hubs), "u", "left")
    rest = tagged.filter(F.col("hub").isNull()).join(low.select("u", "m").hint("merge"), "u").select("u", "v", "m")
    return tagged.filter(F.col("hub").isNotNull()).select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, component (the smallest node reachable), for every node of an edge; edges has u and v (long).

    Self-loops and repeated edges are ignored; no edges give no rows. Rounds are written to the shared folder; each takes the place
    of the one before.
    """
    spark = edges.sparkSession
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, f"{name}-edges")
    last, before = f"{folder}/{name}-edges", None
    total = e.count()
    for k in count():  # rounds are logarithmic in the longest path
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many, low = max(LEAST_HUB, total // HUBS), _least(both)
        hubs = _hubs(low, many)
        large = _with_least(both.filter("v > u"), low, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        if hubs is not None:  # without hubs before, there are none after this step
            large = written(large, folder, f"{name}-large")
        low = _least(large)
        small = _with_least(large, low, _hubs(low, many) if hubs is not None else None).select(F.col("v").alias("u"), "m").unionByName(low.select("u", "m"))
        e = written(small.filter("u <> m").select("u", F.col("m").alias("v")).distinct(), folder, f"{name}-{k}")
        remove(spark, last)
        last = f"{folder}/{name}-{k}"
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        total, before = now[0], now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
