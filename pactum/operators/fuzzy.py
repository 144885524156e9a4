"""The best titles for each of many keywords, by the fuzzy ratio, without comparing every pair.

Keywords are a request: they are counted first and go to the tasks in blocks of a bounded size. Titles are dealt
to all cores. A task keeps the k best titles of each keyword, and computes the ratio only where its upper bound, which follows from how
often each letter occurs in both strings, reaches the worst of those. What tasks kept is merged in two steps.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from pactum.functions.scalar import ratio
from pactum.plans.stage import staged

#: Keywords, and bytes of them, in a block; each block reads the titles once.
BLOCK, BLOCK_BYTES = 4_096, 16 << 20
#: Cells of the matrix of upper bounds that a task holds.
CELLS = 1 << 21
#: Tasks that share the titles, for each core there is; more even out their speeds, and each task holds a heap for each word.
TASKS_PER_CORE = 2
#: Groups that the rows of a keyword are merged in first.
SPREAD = 256
#: Letters of a word whose places fit a machine word, with one bit to spare.
LANE = 63
#: Letters are told apart by their remainder; a prime that keeps small letters, digits and blanks apart.
CLASSES = 97


def _letters(text: str) -> list[int]:
    return [ord(c) % CLASSES for c in text]


def _marks(text: str) -> list[tuple[int, int]]:
    """(letter, i) for the i-th occurrence of each letter; two strings share at least as many as their common subsequence is long."""
    seen: Counter = Counter()
    out = []
    for c in _letters(text):
        seen[c] += 1
        out.append((c, seen[c]))
    return out


class Best:
    """The k best (-score, id, title) of each word among the titles added; ties go to the smaller id, then title.

    One title meets all words that its bounds leave at once, on bit vectors, as `ratio` does for one. Words of more than LANE letters,
    which don't fit, go through `ratio` itself. `compared` counts the pairs.
    """

    def __init__(self, words: list[str], k: int, least: int):
        self.k, self.least, self.compared = k, least, 0
        self.words = sorted(words, key=lambda w: len(w.lower()))
        self.kept: list[list[tuple]] = [[] for _ in words]
        self.floor = np.full(len(words), float(least))
        low = [w.lower() for w in self.words]
        self.low, self.lengths = low, np.array([len(w) for w in low], dtype=np.int64)
        self.short = int((self.lengths <= LANE).sum())
        self.columns: dict[tuple[int, int], int] = {}
        places = [[self.columns.setdefault(m, len(self.columns)) for m in _marks(w)] for w in low]
        self.has = np.zeros((len(self.columns), len(low)), dtype=np.float32)
        for j, p in enumerate(places):
            self.has[p, j] = 1
        self.where: dict[str, np.ndarray] = {}  # for a letter, its places in each short word
        for j, w in enumerate(low[: self.short]):
            for i, c in enumerate(w):
                self.where.setdefault(c, np.zeros(self.short, dtype=np.uint64))[j] |= np.uint64(1 << i)
        self.full = (np.uint64(1) << self.lengths[: self.short].astype(np.uint64)) - np.uint64(1)

    def add(self, ids: list, titles: list[str]) -> None:
        step = max(1, CELLS // max(1, len(self.words), len(self.columns)))
        for at in range(0, len(ids), step):
            low = [t.lower() for t in titles[at : at + step]]
            bounds = self._bounds(low)
            for i, t in enumerate(low):
                if (near := self._near(bounds[i], ids[at + i])).size:
                    self._keep(near, self._scores(t, near), ids[at + i], titles[at + i])

    def _percent(self, common: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ratio of subsequences of these lengths, rounded as `ratio` does."""
        return np.where(lengths > 0, np.rint(200 * common.astype(np.float64) / np.maximum(lengths, 1)), 100)

    def _bounds(self, low: list[str]) -> np.ndarray:
        """A row for each title: an upper bound of its ratio with each word."""
        has = np.zeros((len(low), len(self.columns)), dtype=np.float32)
        for i, t in enumerate(low):
            has[i, [self.columns[m] for m in _marks(t) if m in self.columns]] = 1
        return self._percent(has @ self.has, np.array([len(t) for t in low], dtype=np.int64)[:, None] + self.lengths)

    def _near(self, bounds: np.ndarray, id_) -> np.ndarray:
        """Words that the title may be kept for: those whose worst score its bound exceeds, or equals with an id that isn't greater."""
        near = bounds > self.floor
        for j in np.flatnonzero(bounds == self.floor).tolist():
            kept = self.kept[j]
            near[j] = len(kept) < self.k or id_ <= kept[-1][1]
        return np.flatnonzero(near)

    def _scores(self, title: str, near: np.ndarray) -> np.ndarray:
        self.compared += near.size
        short = near[near < self.short]
        line = full = self.full[short]
        for c in title:
            if (places := self.where.get(c)) is not None:
                hit = line & places[short]
                line = ((line + hit) | (line - hit)) & full
        common = self.lengths[short] - np.bitwise_count(line)
        long = [ratio(title, self.low[j]) for j in near[short.size :].tolist()]
        return np.concatenate([self._percent(common, self.lengths[short] + len(title)), np.array(long, dtype=np.float64)])

    def _keep(self, near: np.ndarray, scores: np.ndarray, id_, title: str) -> None:
        good = scores >= self.floor[near]
        for j, score in zip(near[good].tolist(), scores[good].astype(int).tolist(), strict=True):
            kept, found = self.kept[j], (-score, id_, title)
            if (len(kept) < self.k or found < kept[-1]) and found not in kept:
                insort(kept, found)
                del kept[self.k :]
                if len(kept) == self.k:
                    self.floor[j] = -kept[-1][0]


def _block(titles: DataFrame, shared: Broadcast, k: int, least: int) -> DataFrame:
    """Up to k rows of each word for each task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(shared.value, k, least)
        for b in batches:
            best.add(b["id"].tolist(), b["title"].tolist())
        for at in range(0, len(best.words), 256):
            part = zip(best.words[at : at + 256], best.kept[at : at + 256], strict=True)
            yield pd.DataFrame([(w, i, t, -s) for w, kept in part for s, i, t in kept], columns=["keyword", "id", "title", "score"])

    schema = StructType().add("keyword", StringType()).add("id", titles.schema["id"].dataType).add("title", StringType()).add("score", IntegerType())
    return titles.mapInPandas(scan, schema)


def best_titles(titles: DataFrame, keywords: DataFrame, k: int = 10, least: int = 0) -> DataFrame:
    """keyword, id, title, score, rank (from 1): the k titles (id, title) nearest to each keyword, from a ratio of `least` on.

    Best first, then by id and title. Case doesn't count. Equal rows count once, and so do equal keywords; a null keyword, id
    or title takes no part. Ids are strings or whole numbers. Keywords beyond a block are dealt to several by their hash, one
    after another, and each block reads the titles again.
    """
    spark = titles.sparkSession
    # a file of titles is small for the work that it makes, and would be one task or few
    titles = titles.select("id", "title").filter("id IS NOT NULL AND title IS NOT NULL").repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    words = staged(keywords.select("keyword").filter("keyword IS NOT NULL").distinct())
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        shared = spark.sparkContext.broadcast([r.keyword for r in words.filter(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b).toLocalIterator()])
        parts.append(_block(titles, shared, k, least))
        if blocks > 1:
            parts[-1] = staged(parts[-1])
            shared.destroy()
    found = reduce(DataFrame.unionByName, parts).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    for by in (("keyword", "salt"), ("keyword",)):
        w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "title")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.drop("salt")
