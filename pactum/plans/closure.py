"""Transitive closure with provenance."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.plans.stage import dropped, stage_folder, staged

#: Up to so many edges and paths are closed on the driver (a vocabulary); more go through joins.
SMALL, SMALL_PATHS = 10_000, 200_000
#: Changes after which a closure is written anew.
REWRITE = 8
EDGES = "a string, b string, rel string"
_PAIR = ["a", "b", "rel"]


def _paths(edges: list[tuple[str, str, str]], limit: int) -> set[tuple[str, str, str]] | None:
    """(a, b, rel) for every path of two edges or more within a relation; None if there are more than `limit`."""
    after: dict[tuple[str, str], set[str]] = defaultdict(set)
    for a, b, rel in edges:
        after[rel, a].add(b)
    out = set()
    for rel, a in list(after):
        reached: set[str] = set()
        front = {c for b in after[rel, a] for c in after.get((rel, b), ())}
        while front:
            reached |= front
            front = {c for b in front for c in after.get((rel, b), ())} - reached
        out |= {(a, c, rel) for c in reached}
        if len(out) > limit:
            return None
    return out


def _then(x: DataFrame, y: DataFrame) -> DataFrame:
    """a, b, rel for each pair of x that is followed by one of y; not distinct."""
    return x.join(y.select(F.col("a").alias("b"), F.col("b").alias("c"), "rel"), ["b", "rel"]).select("a", F.col("c").alias("b"), "rel")


def paths(edges: DataFrame) -> DataFrame:
    """Distinct (a, b, rel) joined by a path of two edges or more; relations don't mix, and cycles end."""
    edges = edges.select("a", "b", "rel").distinct()
    some = edges.limit(SMALL + 1).collect()
    if len(some) <= SMALL and (found := _paths([tuple(r) for r in some], SMALL_PATHS)) is not None:
        return edges.sparkSession.createDataFrame(sorted(found), EDGES)
    return _paths_by_joins(edges)


def _paths_by_joins(edges: DataFrame) -> DataFrame:
    """Paths of two edges or more: what isn't an edge, and the edges that a longer path joins as well."""
    reach, again = _reach(edges)
    return reach.filter("NOT is_edge").select(*_PAIR).unionByName(again)


def _reach(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, rel, is_edge) joined by one edge or more, each once, and the edges that are joined by two or more as well.

    Lengths double each round: what k edges reach at most, and what exactly k reach, give the same for 2k. Joining the exact
    lengths with the rest keeps intermediate rows to those of the result, where joining the rest with itself would find each path
    once for every place to cut it. A round writes only what it finds, and ends it if nothing has exactly k edges, or it finds no pair.
    """
    spark, folder = edges.sparkSession, stage_folder(edges.sparkSession)
    exact = staged(edges.select(*_PAIR).distinct(), f"{folder}/edges")
    reach = exact.withColumn("is_edge", F.lit(True))
    again = []
    for k in count():
        found = _then(exact, reach).distinct().join(reach.withColumnRenamed("is_edge", "known"), _PAIR, "left")
        found = staged(found.filter("known IS NULL OR known"), f"{folder}/found{k}")
        fresh = found.filter("known IS NULL").select(*_PAIR, F.lit(False).alias("is_edge"))
        again.append(found.filter("known").select(*_PAIR))
        if fresh.isEmpty():
            break
        reach, exact = reach.unionByName(fresh), staged(_then(exact, exact).distinct(), f"{folder}/exact{k}")
        if k:
            dropped(spark, f"{folder}/exact{k - 1}")
        if exact.isEmpty():
            break
    return reach, reduce(DataFrame.unionByName, again).distinct()


class Closure:
    """The pairs (a, b, rel) joined by a path of one edge or more, kept up to date while edges come and go.

    A change joins only what it touches with the pairs there are: paths through new edges are put together from the pairs before
    and behind them, and pairs whose paths went through deleted edges are taken out and looked for again among the edges left.
    What is found is written once, and added to what there is without writing that again.
    """

    def __init__(self, edges: DataFrame):
        self.folder, self.step, self.changes = stage_folder(edges.sparkSession), 0, 0
        self.edges = self._kept(edges.select(*_PAIR).distinct(), "edges")
        self.pairs = _reach(self.edges)[0].select(*_PAIR)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        return staged(df, f"{self.folder}/{name}-{self.step}")

    def _changed(self, edges: DataFrame, pairs: DataFrame) -> None:
        """Takes these; after some changes writes them, so that the parts they are made of don't grow in number."""
        self.changes += 1
        if self.changes % REWRITE == 0:
            edges, pairs = self._kept(edges, "edges"), self._kept(pairs, "pairs")
        self.edges, self.pairs = edges, pairs

    def _through(self, edges: DataFrame) -> DataFrame:
        """The pairs with a path that has one of these edges, between pairs that there are."""
        to = edges.unionByName(_then(self.pairs, edges)).distinct()
        return to.unionByName(_then(to, self.pairs)).distinct()

    def insert(self, new: DataFrame) -> DataFrame:
        """Adds edges; returns the pairs that this has added."""
        new = self._kept(new.select(*_PAIR).distinct().join(self.edges, _PAIR, "left_anti"), "new")
        fresh = new.join(self.pairs, _PAIR, "left_anti")  # an edge between what is joined already joins nothing more
        found = front = self._kept(self._through(fresh).join(self.pairs, _PAIR, "left_anti"), "found")
        while not front.isEmpty():  # paths through twice as many new edges
            longer = _then(front, found).unionByName(_then(found, front)).distinct()
            front = self._kept(longer.join(found, _PAIR, "left_anti").join(self.pairs, _PAIR, "left_anti"), "front")
            found = found.unionByName(front)
        self._changed(self.edges.unionByName(new), self.pairs.unionByName(found))
        return found

    def delete(self, gone: DataFrame) -> DataFrame:
        """Takes edges out; returns the pairs that this has taken out."""
        gone = self._kept(gone.select(*_PAIR).distinct().join(self.edges, _PAIR, "left_semi"), "gone")
        left = self._kept(self.edges.join(gone, _PAIR, "left_anti"), "edges")
        doubted = self._kept(self._through(gone), "doubted")
        sure = self._kept(self.pairs.join(doubted, _PAIR, "left_anti"), "sure")
        # a doubted pair is there if it is an edge, or an edge leads to where a sure or found one begins
        by_edge = _then(left.join(doubted.select("a", "rel").distinct(), ["a", "rel"], "left_semi"), sure)
        front = found = self._kept(doubted.join(left.unionByName(by_edge).distinct(), _PAIR, "left_semi"), "again")
        while not front.isEmpty():
            more = _then(left, front).distinct().join(doubted, _PAIR, "left_semi").join(found, _PAIR, "left_anti")
            front = self._kept(more, "front")
            found = found.unionByName(front)
        self._changed(left, sure.unionByName(found))
        return doubted.join(found, _PAIR, "left_anti")


def relations(dep_edges: DataFrame, kinds: tuple[str, ...], symmetric: tuple[str, ...] = ("owl:sameAs",)) -> DataFrame:
    """a, rel, b, r: given edges labelled 'dependencygraph', paths 'derived'; a pair may carry both labels.

    Relations in `symmetric` hold both ways from the start.
    """
    base = dep_edges.filter(F.col("rel").isin(*kinds)).select("a", "b", "rel")
    back = base.filter(F.col("rel").isin(*symmetric)).select(F.col("b").alias("a"), F.col("a").alias("b"), "rel")
    base = base.unionByName(back).distinct()
    return base.withColumn("r", F.lit("dependencygraph")).unionByName(paths(base).withColumn("r", F.lit("derived"))).select("a", "rel", "b", "r")


def closed_graph(dep_edges: DataFrame, kinds: tuple[str, ...], symmetric: tuple[str, ...] = ("owl:sameAs",)) -> DataFrame:
    """a, rel, b: the graph with all its closures, without loops; other relations pass unchanged."""
    return relations(dep_edges, kinds, symmetric).filter("a <> b").select("a", "rel", "b").unionByName(dep_edges.filter(~F.col("rel").isin(*kinds)).select("a", "rel", "b")).distinct()
