"""MinHash near-dedup with SetSketch registers.

A register holds the least of a set's exponentially distributed hashes on an exponential scale, truncated, so sketches of
parts merge by the larger register and equal registers are as likely as the sets are similar. Documents meet when a band of
registers is equal; pairs that meet are kept if the joint likelihood of all registers, given both cardinalities, puts the
similarity high enough; what is left is verified on full sets.

Where many documents hang together loosely, a closer sketch parts them first: it has more registers and longer bands, so
documents that are similar without being linked fall away after their text was read twice.

No step lists the pairs of a group. Documents with equal sets are one class from the start. Where documents meet, a
breadth-first search takes each out of the pool when it is first reached, and only those spanning edges go on. The
components of those edges hold every possible link, so each document's set goes once to its component (or, where a component
is large, to cells that cover all pairs of its parts), and a second search over exact similarities finds the real edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_RANKS, find_words, flat, free_name, hash_spans, id_text, lower_ascii, mix, ranked, session, shared_folder, slices, window_hashes, written
from .components import connected_components

SHINGLE = 5
#: Links: 100 * intersection >= percent * union. The contract of op8 has this percent; callers may pass another.
LINK_PERCENT = 85
#: A sketch's bands are of so many registers, and so many are for the likelihood: in all texts, and in large loose components.
#: `tuning` derives the other settings from the percent.
Level = tuple[int, int]
ROWS, REGISTERS = BROAD = (3, 64)
CLOSE = (6, 512)
#: A pair just similar enough misses all bands, or is given up by the likelihood, with at most this probability each.
MISS, GIVE_UP = 6e-9, 1e-8
#: Bases of the scale for bands (16 bits) and for the likelihood (8 bits), and the rate of the exponential hashes.
FINE, COARSE, RATE = 1.001, 1.08, 20.0
#: Documents of a band key, and of a component, that meet in one group; more are dealt to cells of pairs of parts.
KEY_DOCS, CELL_DOCS = 20_000, 192

#: Ranks that are broadcast at most, 8 bytes each.
BROADCAST_RANKS = 1_000_000
#: Keys that are broadcast at most, 16 bytes each; each stands for more rows than KEY_DOCS or CELL_DOCS.
BROADCAST_KEYS = 500_000


@lru_cache
def tuning(percent: int, level: Level = BROAD) -> tuple[int, float]:
    """Bands, and the estimate below which a pair is given up, for links of `percent`: the fewest and the highest that keep to MISS and GIVE_UP."""
    rows, registers = level
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
    least = next((x / 100 for x in range(percent, 0, -1) if given_up(percent, x / 100, registers) <= GIVE_UP), 0.0)
    return bands, least


def given_up(percent: int, least: float, n: int = REGISTERS) -> float:
    """The exact chance that the likelihood over n registers puts a pair with a similarity of `percent` below `least`; the worst over the sizes that it can have."""
    s = percent / 100
    more, less = (x.ravel() for x in np.indices((n + 1, n + 1)))
    more, less = more[more + less <= n], less[more + less <= n]
    same = n - more - less
    fact = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    ways = fact[n] - fact[more] - fact[less] - fact[same]
    worst = 0.0
    for ratio in np.linspace(s, 1, 16):
        u = ratio / (1 + ratio)
        p, q = _odds(u - (1 - u) * s), _odds(1 - u - u * s)
        chance = np.exp(ways) * p**more * q**less * (1 - p - q) ** same
        worst = max(worst, float(chance[slope(u, more, less, same, least) < 0].sum()))
    return worst


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s, mix(s ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of lower-cased words."""
    low = lower_ascii(data)
    a, b, r = find_words(low, offs)
    h = hash_spans(low, a, b)
    first = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(offs) - 1))])
    w = window_hashes(h, SHINGLE)
    out = []
    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if y - x >= SHINGLE:
            out.append(np.unique(w[x : y - SHINGLE + 1]))
        else:
            out.append(window_hashes(h[x:y], y - x) if y > x else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """`count` exponential minima, one row for each set; infinite for an empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out = np.full((len(sets), count), np.inf)
    seed, factor = seeds(count)
    if not len(full):
        return out
    x = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    with np.errstate(over="ignore"):
        for k in range(count):
            low = np.minimum.reduceat((x ^ seed[k]) * factor[k], starts)
            out[full, k] = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return out


def on_scale(minima: np.ndarray, base: float, top: int) -> np.ndarray:
    """floor(1 - log_base(minimum)), truncated to 0..top."""
    return np.clip(np.floor(1 - np.log(minima) / np.log(base)), 0, top)


def _odds(x):
    """The chance that a register is larger on one side, of the share x of the union's weight that only this side has."""
    return -np.log(1 - (COARSE - 1) / COARSE * np.maximum(x, 1e-9)) / np.log(COARSE)


def slope(u: float, more: np.ndarray, less: np.ndarray, same: np.ndarray, least: float) -> np.ndarray:
    """Slope at `least` of the log-likelihood of the counts of larger, smaller and equal registers."""
    v = 1 - u
    c, log = (COARSE - 1) / COARSE, np.log(COARSE)
    x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    p, q = _odds(x), _odds(y)
    dp, dq = c / (log * (1 - c * x)), c / (log * (1 - c * y))
    return -more * v * dp / p - less * u * dq / q + same * (v * dp + u * dq) / (1 - p - q)


def likely(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray, percent: int = LINK_PERCENT, level: Level = BROAD) -> np.ndarray:
    """Whether the maximum-likelihood similarity of a with each row of b is high enough for `percent`, and the sizes allow a link.

    The log-likelihood is concave in the similarity, so its maximum is at a similarity or above if its slope there isn't negative.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    up = slope(n_a / (n_a + n_b), more, less, b.shape[1] - more - less, tuning(percent, level)[1])
    return (up >= 0) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def search(n: int, near, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the graph in which near(i, pool) tells which of the pool's members i is linked with.

    With `part`, only pairs of different parts count; members that were reached still have to be compared with the rest.
    """
    pool, edges = np.arange(n), []
    while len(pool):
        queue, pool = [int(pool[0])], pool[1:]
        while queue and len(pool):
            i = queue.pop()
            hit = near(i, pool)
            if part is not None:
                hit &= part[pool] != part[i]
            if hit.any():
                reached = pool[hit].tolist()
                edges.extend((i, j) for j in reached)
                queue.extend(reached)
                pool = pool[~hit]
    return edges


def sketch(docs: DataFrame, percent: int = LINK_PERCENT, level: Level = BROAD) -> DataFrame:
    """doc_id, rank, n_shingles, digest (of the set), fine (bands), coarse (likelihood) of (doc_id, rank, text) rows."""
    count, (rows, n) = tuning(percent, level)[0], level
    width = count * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flat(batch.column(2))
            for a, b in slices(offs):
                o = offs[a : b + 1]
                sets = shingle_sets(data[o[0] : o[-1]], o - o[0])
                minima = registers(sets, max(n, width))
                fine = on_scale(minima[:, :width], FINE, 65535).astype("<u2")
                coarse = on_scale(minima[:, :n], COARSE, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in fine], pa.binary()),
                        pa.array([x.tobytes() for x in coarse], pa.binary()),
                    ],
                    names=["doc_id", "rank", "n_shingles", "digest", "fine", "coarse"],
                )

    session(docs)
    return docs.mapInArrow(run, "doc_id long, rank long, n_shingles long, digest binary, fine binary, coarse binary")


def in_cells(df: DataFrame, key: str, big: DataFrame, limit: int) -> DataFrame:
    """Adds cell and part: a key with more than `limit` rows has its rows dealt to parts, and each row goes to every cell of its part with another or itself.

    big: key and size of the keys with more, a written table. It is broadcast up to BROADCAST_KEYS, so that no task gets all rows of one.
    """
    big = big.select(key, F.ceil(F.col("size") / limit).cast("int").alias("parts"))
    out = df.join(F.broadcast(big) if big.count() <= BROADCAST_KEYS else big.hint("merge"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64("rank", F.lit(7)), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.transform(other, lambda j: F.least(F.col("part"), j) * F.col("parts") + F.greatest(F.col("part"), j))
    return out.withColumn("cell", F.explode(cells)).drop("parts")


_EDGES = "u long, v long"


def _edge_table(ranks: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table([pa.array(ranks[e[:, 0]]), pa.array(ranks[e[:, 1]])], names=["u", "v"])


def meet(classes: DataFrame, folder: str, percent: int = LINK_PERCENT, level: Level = BROAD) -> DataFrame:
    """Edges that span, over all bands, what the likelihood lets through."""
    count, (wide, registers) = tuning(percent, level)[0], level

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fine = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(n, count, wide).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(count, dtype=np.uint64), (n, count)).copy()
                for r in range(wide):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + fine[:, :, r] + np.uint64(1))
            row = np.repeat(np.arange(n), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(3).take(pa.array(row))], names=["key", "rank", "n_shingles", "coarse"]
            )

    rows = classes.select("rank", "n_shingles", "fine", "coarse").mapInArrow(bands, "key long, rank long, n_shingles long, coarse binary")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    big = written(sizes.filter(F.col("size") > KEY_DOCS), folder, f"hot-keys-{wide}")
    rows = in_cells(rows, "key", big, KEY_DOCS) if not big.isEmpty() else rows.withColumn("cell", F.lit(0)).withColumn("part", F.lit(0))
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def group(key: list[np.ndarray]) -> pa.RecordBatch:
        rank, n, part, coarse = (np.concatenate([x[i] for x in key]) for i in range(4))
        pairwise = part if part.min() != part.max() else None
        edges = search(len(rank), lambda i, pool: likely(coarse[i], int(n[i]), coarse[pool], n[pool], percent, level), pairwise)
        return _edge_table(rank, edges).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            rank, n, part = (batch.column(i).to_numpy() for i in (1, 2, 5))
            coarse = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, registers)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (key[a], cell[a]) != at:
                    if sum(len(x[0]) for x in held) > 1:
                        yield from group(held)
                    held, at = [], (key[a], cell[a])
                held.append((rank[a:b], n[a:b], part[a:b], coarse[a:b]))
        if sum(len(x[0]) for x in held) > 1:
            yield from group(held)

    return rows.mapInArrow(run, _EDGES).distinct()


def tightened(rows: DataFrame, loose: DataFrame, folder: str, percent: int) -> DataFrame:
    """loose (rank, component) with the components of more than CELL_DOCS taken apart by a closer sketch of their members' texts.

    What isn't linked with anything by that sketch is left out. rows: doc_id, rank, text.
    """
    big = loose.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > CELL_DOCS)
    large = written(loose.join(big.select("component"), "component", "left_semi").select("rank"), folder, "large")
    size = large.count()
    if not size:
        return loose
    # texts move only where there are too many ranks to broadcast
    ranks = F.broadcast(large) if size <= BROADCAST_RANKS else large.hint("merge")
    texts = rows.join(ranks, "rank", "left_semi").select("doc_id", "rank", "text")
    closer = written(sketch(texts, percent, CLOSE).filter("n_shingles > 0"), folder, "closer")
    tight = connected_components(meet(closer, folder, percent, CLOSE), folder, "tight").withColumnRenamed("node", "rank")
    return loose.join(large, "rank", "left_anti").select("rank", "component").unionByName(tight)


def exact_edges(sets: list[np.ndarray], part: np.ndarray, percent: int = LINK_PERCENT) -> list[tuple[int, int]]:
    """Spanning edges of the exact links among the sets; with several parts, of those between different ones."""
    size = np.array([len(s) for s in sets], np.int64)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(number, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    start = np.searchsorted(number[order], np.arange(len(values) + 1))

    def near(i: int, pool: np.ndarray) -> np.ndarray:
        own = number[begin[i] : begin[i + 1]]
        lens = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        common = np.bincount(holder[at], minlength=len(sets))[pool]
        return 100 * common >= percent * (size[i] + size[pool] - common)

    return search(len(sets), near, part if part.min() != part.max() else None)


def verify(docs: DataFrame, members: DataFrame, folder: str, percent: int = LINK_PERCENT) -> DataFrame:
    """Edges that span the exact links. members: rank, component."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    big = written(sizes.filter(F.col("size") > CELL_DOCS), folder, "large-components")
    placed = in_cells(members, "component", big, CELL_DOCS)
    # members grow with the documents, so they aren't broadcast at any size
    rows = docs.join(placed.hint("merge"), "rank").select("component", "cell", "part", "rank", "text")

    def run(table: pa.Table) -> pa.Table:
        data, offs = flat(table.column("text"))
        sets = []
        for a, b in slices(offs):
            o = offs[a : b + 1]
            sets.extend(shingle_sets(data[o[0] : o[-1]], o - o[0]))
        full = [i for i, s in enumerate(sets) if len(s)]
        rank, part = table.column("rank").to_numpy()[full], table.column("part").to_numpy()[full]
        return _edge_table(rank, exact_edges([sets[i] for i in full], part, percent) if full else [])

    return rows.groupBy("component", "cell").applyInArrow(run, _EDGES).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. Links: see LINK_PERCENT.

    Documents of the same doc_id are one, linked with what either text is linked with. A row with a null text, or one without
    words, is linked with nothing. Each row with a null doc_id is a document of its own, and comes after all that have one: its
    component_id is null unless it is linked with one that has; of a group of such rows alone, one is kept. An id may be any
    long. An empty table gives no rows. Other columns are not read.
    """
    folder = shared_folder(session(docs))
    rows = id_text(docs, id_col, text_col)
    own, order = ranked(rows, folder)
    out = _groups(own, folder, percent).withColumn("kept", F.col("low") == F.col("rank"))
    if order is not None:
        return out.join(order, out["low"] == order["number"], "left").select("doc_id", "n_shingles", F.col("id").alias("component_id"), "kept")
    # without null ids, every rank is an id
    real = F.lit(True) if rows.filter("doc_id IS NULL").isEmpty() else F.col("low") < NULL_RANKS
    return out.select("doc_id", "n_shingles", F.when(real, F.col("low")).alias("component_id"), "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of docs, all columns, of the documents that near_duplicates keeps. All rows of a kept doc_id stay."""
    folder = shared_folder(session(docs))
    name = free_name(docs, "__rank")
    rows, _ = ranked(docs, folder, id_col, name)
    gone = _groups(id_text(rows, id_col, text_col, name).withColumnRenamed(name, "rank"), folder, percent).filter("low <> rank")
    return rows.join(gone.select(F.col("rank").alias(name)).distinct(), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _groups(rows: DataFrame, folder: str, percent: int) -> DataFrame:
    """doc_id, rank, n_shingles, low (the least rank reachable) of (doc_id, text, rank) rows."""
    rows = rows.select("doc_id", "rank", "text")
    sketches = written(sketch(rows, percent), folder, "sketches")
    full = sketches.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("rank").alias("rank"), F.min_by("n_shingles", "rank").alias("n_shingles"), F.min_by("fine", "rank").alias("fine"), F.min_by("coarse", "rank").alias("coarse"))
    classes = written(classes, folder, "classes")
    loose = connected_components(meet(classes, folder, percent), folder, "loose").withColumnRenamed("node", "rank")
    loose = tightened(rows, loose, folder, percent)
    # one text of each class; where rows share a doc_id, each of its texts
    exact = verify(rows.select("rank", "text"), loose, folder, percent)
    found = connected_components(exact.unionByName(_same_id(full, classes, folder)), folder, "links").withColumnRenamed("node", "rank")
    # copies get their class's component by its digest, so a class of very many copies is no hub of edges
    labels = classes.select("digest", "rank").join(found, "rank", "left").select("digest", F.coalesce("component", "rank").alias("low"))
    out = sketches.select("doc_id", "rank", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(labels, "digest", "left")
    return out.select("doc_id", "rank", "n_shingles", F.coalesce("low", "rank").alias("low"))


def _same_id(full: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Edges between the classes of texts that share a doc_id."""
    several = full.groupBy("rank").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("rank", "low")
    several = written(several, folder, "several")
    if several.isEmpty():
        return full.sparkSession.createDataFrame([], _EDGES)
    pairs = full.select("rank", "digest").join(several, "rank").filter("digest <> low").select("low", "digest").distinct()
    name = lambda column, node: classes.select(F.col("digest").alias(column), F.col("rank").alias(node))
    return pairs.join(name("low", "u"), "low").join(name("digest", "v"), "digest").select("u", "v")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=LINK_PERCENT)


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT r, doc_id, coalesce(CAST(doc_id AS HUGEINT), {1 << 64} + r) AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
links AS (SELECT da.k AS a, db.k AS b FROM pairs JOIN n na ON ra = na.r JOIN n nb ON rb = nb.r JOIN d da ON ra = da.r JOIN d db ON rb = db.r WHERE 100 * c >= {LINK_PERCENT} * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(k, c) AS (SELECT DISTINCT k, k FROM d UNION SELECT b, c FROM reach JOIN both_ways ON k = a),
comp AS (SELECT k, min(c) AS c FROM reach GROUP BY k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN c < {1 << 63} THEN CAST(c AS BIGINT) END AS component_id, c = k AS kept
FROM d LEFT JOIN n USING (r) JOIN comp USING (k)
"""
