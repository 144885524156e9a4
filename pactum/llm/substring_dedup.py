"""Substring dedup over a log-structured fingerprint index.

The index is a list of runs. A run is immutable, written once, and holds for each bucket the sorted hashes of the windows of
GRAM words that were selected from one batch of documents (each window of WINDOW words owns exactly one, chosen by its
content, see spans.py), each with the one document that has it, or a mark that several have. Beside a run lie the passages
around its shared hashes, sorted alike. A new batch's hashes are merge-joined with all runs. For a hash that several
documents have, the index holds the passages already; for one that a single earlier document has, that document's text is
read, once in the life of the index, as the hash is shared from then on. Passages are compared word by word. Then the batch
becomes a run, and runs are compacted into one when there are FANOUT of them.

The manifest, written last, names the runs; another session opens the index by it, and what a job that died had written
beside it doesn't count.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, NO_ID, exists, id_text, names, placed, read_file, remove, session, shared_folder, write_file, written
from .spans import BLOCK_BYTES, BUCKET_BYTES, STRIPS, Block, Plan, answer_rows, binary_array, by_bucket, covered, gathered, in_blocks, pack, packed_strips, per_document, rows_with, send_strips, strip_rows, table_of, unpacked, unpacked_strips

WINDOW, GRAM = 13, 4
#: Runs that are compacted into one.
FANOUT = 4
#: Batches of the query, and its fanout: the last one meets a compacted run.
BATCHES, QUERY_FANOUT = 3, 2
#: A batch's blocks and the index's buckets (a power of two), at least.
LEAST_BLOCKS = LEAST_BUCKETS = 32
#: Bytes of ids and hashes of earlier documents to read, up to which they are broadcast.
WANTED_BYTES = 32 << 20

#: Marks a hash that several documents have; less than every rank.
SHARED = LEAST
#: Kinds of rows: what a block has to send or mark, documents to read, passages that the index has, a run's hashes, its passages.
MARKS, SEND, READ, KNOWN, HASHES, PASSAGES = 1, 2, 3, 4, 5, 6
OWNED = "bucket int, blk long, hashes binary, multi binary, owners binary"
ROW = "blk long, bucket int, body binary, docs binary, lens binary, keys binary, kind int"
RESULT = "doc_id long, n_words long, n_removed long, kept binary"


def row(kind: int, blk: int | None = None, bucket: int | None = None, body: bytes | None = None, docs: bytes | None = None, lens: bytes | None = None, keys: bytes | None = None) -> tuple:
    return blk, bucket, body, docs, lens, keys, kind


def shared_parts(strips: list[bytes], least: np.ndarray, times: np.ndarray, anchor: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """The verification, on words: (offset, length, least document that has it) of the windows that other strips or rows have too.

    Equal windows have equal anchors, and the anchor's place in a window follows from its content, so a strip has no window
    twice. One that is alone at its anchor shares all windows, if several rows have it, or none.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in strips]
    order = np.argsort(anchor, kind="stable")
    doc, often = least.tolist(), times.tolist()
    for _, a, b in by_bucket(anchor[order]):
        group = order[a:b].tolist()
        if len(group) == 1:
            k = group[0]
            if often[k] > 1:
                out[k].append((0, strips[k].count(b" ") + 1, doc[k]))
        else:
            for k, parts in zip(group, _compared([strips[k] for k in group], [doc[k] for k in group], [often[k] for k in group], window), strict=True):
                out[k] = parts
    return out


def _compared(strips: list[bytes], least: list[int], times: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """shared_parts of the strips of one anchor, window by window."""
    lowest: dict[bytes, int] = {}
    often: set[bytes] = set()
    windows = []
    for s, d, n in zip(strips, least, times, strict=True):
        at = [0]
        for w in s.split(b" "):
            at.append(at[-1] + len(w) + 1)
        own = [s[at[i] : at[i + window] - 1] for i in range(len(at) - window)]
        windows.append(own)
        for x in own:
            if (m := lowest.get(x)) is None:
                lowest[x] = d
                if n > 1:
                    often.add(x)
            else:
                often.add(x)
                if d < m:
                    lowest[x] = d
    out = []
    for own in windows:
        parts: list[tuple[int, int, int]] = []
        for i, x in enumerate(own):
            if x in often:
                m = lowest[x]
                if parts and parts[-1][2] == m and parts[-1][0] + parts[-1][1] - window == i - 1:
                    parts[-1] = (parts[-1][0], parts[-1][1] + 1, m)
                else:
                    parts.append((i, window, m))
        out.append(parts)
    return out


def send_owned(blocks: DataFrame, p: Plan) -> DataFrame:
    """Distinct hashes of each block's windows, with the least document that has each and whether another one has it too."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, p)
        h, multi, bucket, least = b.anchors()
        return table_of(OWNED, [(k, b.blk, h[x:y].tobytes(), np.packbits(multi[x:y]).tobytes(), pack(least[x:y].tobytes())) for k, x, y in by_bucket(bucket)])

    return blocks.groupBy("blk").applyInArrow(run, OWNED)


def first_of(values: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array is the first of its kind."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


def merged_run(bodies: list[bytes], owners: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their owners; SHARED where any run or two owners say so."""
    h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in bodies)])
    o = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unpacked(x), np.int64) for x in owners)])
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    head = np.flatnonzero(first_of(h))
    if not len(h):
        return h, o
    low, high = np.minimum.reduceat(o, head), np.maximum.reduceat(o, head)
    return h[head], np.where(low == high, low, SHARED)


def merged_passages(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Keys, distinct passages and least documents, by key, of rows (docs, lens, body, keys)."""
    least: dict[bytes, tuple[int, int]] = {}
    for docs, lens, body, keys in rows:
        for (x, d), k in zip(unpacked_strips(docs, lens, body), np.frombuffer(unpacked(keys), np.uint64).tolist(), strict=True):
            if x not in least or d < least[x][1]:
                least[x] = k, d
    ordered = sorted(least.items(), key=lambda x: (x[1][0], x[0]))
    return np.array([k for _, (k, _) in ordered], np.uint64), [x for x, _ in ordered], np.array([d for _, (_, d) in ordered], np.int64)


def passages_row(kind: int, bucket: int, keys: np.ndarray, strips: list[bytes], least: np.ndarray) -> tuple:
    docs, lens, body = packed_strips(strips, least)
    return row(kind, -1, bucket, body, docs, lens, pack(keys.tobytes()))


def rebucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """HASHES and PASSAGES rows dealt to `buckets` buckets, a power of two and a multiple of what they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == HASHES:
                    h, o = merged_run([r["body"]], [r["docs"]])
                    for k, at in _dealt(h, buckets):
                        out.append(row(HASHES, None, k, h[at].tobytes(), pack(o[at].tobytes())))
                else:
                    keys, strips, least = merged_passages([(r["docs"], r["lens"], r["body"], r["keys"])])
                    for k, at in _dealt(keys, buckets):
                        out.append(passages_row(PASSAGES, k, keys[at], [strips[i] for i in at.tolist()], least[at]))
            yield from table_of(ROW, out).combine_chunks().to_batches()

    return rows.mapInArrow(run, ROW)


def _dealt(h: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places in h) as Block.buckets has it."""
    bucket = ((h >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [(k, order[a:b]) for k, a, b in by_bucket(bucket[order])]


class FingerprintIndex:
    """An index in a shared folder; what is there already is opened. `read` counts the earlier documents that were read."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout, self.read = spark, folder, fanout, 0
        self.state = {"version": 0, "batches": 0, "bytes": 0, "buckets": LEAST_BUCKETS, "runs": [], "passages": []}
        if versions := [int(x) for x in names(spark, f"{folder}/manifest") if x.isdigit()]:
            self.state = json.loads(read_file(spark, f"{folder}/manifest/{max(versions)}"))

    def _commit(self, **changes) -> None:
        """Names what belongs to the index from now on."""
        self.state = {**self.state, **changes, "version": self.state["version"] + 1}
        v = self.state["version"]
        write_file(self.spark, f"{self.folder}/manifest/{v}", json.dumps(self.state))
        remove(self.spark, f"{self.folder}/manifest/{v - 1}")

    def _rows(self, what: str, kind: int, buckets: int) -> DataFrame:
        """The HASHES or PASSAGES rows of all runs, in `buckets` buckets."""
        schema = ROW.removesuffix(", kind int")
        parts = []
        for path, own in self.state[what]:
            rows = self.spark.read.schema(schema).parquet(path).withColumn("kind", F.lit(kind))
            parts.append(rows if own == buckets else rebucketed(rows, buckets))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ROW)

    def _written(self, rows: DataFrame, name: str) -> Callable[[int], DataFrame]:
        """Writes rows in a folder for each kind; returns a reader of one kind."""
        path = f"{self.folder}/{name}"
        rows.write.mode("overwrite").partitionBy("kind").parquet(path)
        return lambda kind: self.spark.read.schema(ROW).parquet(path).filter(F.col("kind") == kind)

    def _there(self, name: str, kind: int, buckets: int) -> list[tuple[str, int]]:
        path = f"{self.folder}/{name}/kind={kind}"
        return [(path, buckets)] if exists(self.spark, path) else []

    def ingest(self, batch: DataFrame, history: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The batch's documents without what was seen before: doc_id, n_words, n_removed, kept (binary), passed through `shape`.

        batch and history have doc_id, text and rank (see common.placed), by which documents are ordered and told apart, the same in
        all calls; history holds what earlier calls ingested. It is scanned by
        Spark's reader, but only documents that alone had a hash of the batch are moved and cut to words. The rows come from a
        table that this writes, because the index changes afterwards.
        """
        k = self.state["batches"]
        size = batch.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        total = self.state["bytes"] + size
        buckets = self.state["buckets"]
        while buckets * BUCKET_BYTES < total:
            buckets *= 2
        p = Plan(True, WINDOW, GRAM, max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)), buckets)
        new = in_blocks(batch, p)
        earlier = self._rows("runs", HASHES, buckets).unionByName(self._rows("passages", PASSAGES, buckets))
        found = self._written(send_owned(new, p).groupBy("bucket").cogroup(earlier.groupBy("bucket")).applyInArrow(merge_join, ROW), f"found{k}")

        to_blocks = found(SEND).select("blk", "kind", "bucket", "body")
        strips = send_strips(new, to_blocks, p, keyed=True)
        known = found(KNOWN).select("bucket", F.lit(-2).cast("long").alias("blk"), "docs", "lens", F.col("body").alias("blob"), "keys")
        wanted = found(READ).groupBy(F.col("blk").alias("rank")).agg(F.collect_list("body").alias("bodies"))
        size_of = found(READ).agg(F.count_distinct("blk").alias("n"), F.sum(F.octet_length("body")).alias("size")).first()
        if size_of.n:
            self.read += size_of.n
            strips = strips.unionByName(_strips_of(history, F.broadcast(wanted) if size_of.size + 8 * size_of.n <= WANTED_BYTES else wanted, p))
        parts = self._written(strips.unionByName(known).groupBy("bucket").applyInArrow(verify, ROW), f"parts{k}")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            b = Block(left, p)
            cov = covered(b, right)
            n, removed, _ = per_document(b, cov)
            kept = []
            raw = b.data.tobytes()
            for i, (s, e) in enumerate(zip(b.byte_offs[:-1].tolist(), b.byte_offs[1:].tolist(), strict=True)):
                words = raw[s:e].split()
                if removed[i]:
                    words = [w for w, c in zip(words, cov[b.offs[i] : b.offs[i + 1]].tolist(), strict=True) if not c]
                kept.append(b" ".join(words))
            return pa.table([b.ids, pa.array(n), pa.array(removed), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

        answers = to_blocks.unionByName(parts(MARKS).select("blk", "kind", "bucket", "body"))
        out = written(shape(new.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, RESULT)), self.folder, f"batch{k}")
        self._commit(
            batches=k + 1,
            bytes=total,
            buckets=buckets,
            runs=[*self.state["runs"], *self._there(f"found{k}", HASHES, buckets)],
            passages=[*self.state["passages"], *self._there(f"parts{k}", PASSAGES, buckets)],
        )
        for kind in (SEND, READ, KNOWN):
            remove(self.spark, f"{self.folder}/found{k}/kind={kind}")
        remove(self.spark, f"{self.folder}/parts{k}/kind={MARKS}")
        if len(self.state["runs"]) >= self.fanout:
            self.compact()
        return out

    def compact(self) -> None:
        """Merges all runs into one, and their passages: each hash and passage once."""
        old, buckets, v = self.state, self.state["buckets"], self.state["version"]

        def merge(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            rows = table.to_pylist()
            hashes, strips = [r for r in rows if r["kind"] == HASHES], [r for r in rows if r["kind"] == PASSAGES]
            h, o = merged_run([r["body"] for r in hashes], [r["docs"] for r in hashes])
            out = [row(HASHES, None, bucket, h.tobytes(), pack(o.tobytes()))]
            if strips:
                out.append(passages_row(PASSAGES, bucket, *merged_passages([(r["docs"], r["lens"], r["body"], r["keys"]) for r in strips])))
            return table_of(ROW, out)

        rows = self._rows("runs", HASHES, buckets).unionByName(self._rows("passages", PASSAGES, buckets))
        self._written(rows.groupBy("bucket").applyInArrow(merge, ROW), f"run{v}")
        self._commit(runs=self._there(f"run{v}", HASHES, buckets), passages=self._there(f"run{v}", PASSAGES, buckets))
        for path, _ in [*old["runs"], *old["passages"]]:
            remove(self.spark, path)


def merge_join(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket of the batch's hashes against the same bucket of all runs: what to send, to read and to compare with, and the new run."""
    if not left.num_rows:
        return table_of(ROW, [])
    bucket = left.column("bucket")[0].as_py()
    hashes = [np.frombuffer(x, np.uint64) for x in left.column("hashes").to_pylist()]
    size = [len(x) for x in hashes]
    own = np.concatenate(hashes)
    blk = np.repeat(left.column("blk").to_numpy(), size)
    multi = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(left.column("multi").to_pylist(), size, strict=True)])
    owner = np.concatenate([np.frombuffer(unpacked(x), np.int64) for x in left.column("owners").to_pylist()])
    rows = right.to_pylist()
    h, o = merged_run([r["body"] for r in rows if r["kind"] == HASHES], [r["docs"] for r in rows if r["kind"] == HASHES])

    order = np.argsort(own, kind="stable")
    head = np.flatnonzero(first_of(own[order]))
    values = own[order][head]
    low, high = np.minimum.reduceat(owner[order], head), np.maximum.reduceat(owner[order], head)
    several = (low != high) | np.maximum.reduceat(multi[order], head)
    at = np.minimum(np.searchsorted(h, values), max(len(h) - 1, 0))  # both sides are sorted
    met = h[at] == values if len(h) else np.zeros(len(values), bool)
    before = np.where(met, o[at], NO_ID) if len(h) else np.full(len(values), NO_ID)
    one = met & (before != SHARED)
    shared = several | (met & (before == SHARED)) | (one & (before != low))

    out = []
    # documents that alone had a hash; null ids come after all others, so nobody loses anything to them
    ask = one & shared & (before != NO_ID)
    by = np.argsort(before[ask], kind="stable")
    asked = values[ask][by]
    for rank, a, b in by_bucket(before[ask][by]):
        out.append(row(READ, rank, bucket, asked[a:b].tobytes()))
    send = np.zeros(len(own), bool)
    send[order] = np.repeat(shared, np.diff(np.append(head, len(own))))
    sent = own[send]
    for b, i, j in by_bucket(blk[send]):  # rows come block by block
        out.append(row(SEND, b, bucket, sent[i:j].tobytes()))
    keys = values[shared]
    for r in rows:
        if r["kind"] == PASSAGES:
            theirs = np.frombuffer(unpacked(r["keys"]), np.uint64)
            hit = np.flatnonzero(np.isin(theirs, keys))
            if len(hit):
                strips = unpacked_strips(r["docs"], r["lens"], r["body"])
                out.append(passages_row(KNOWN, bucket, theirs[hit], [strips[i][0] for i in hit.tolist()], np.array([strips[i][1] for i in hit.tolist()], np.int64)))
    fresh = ~met | (one & shared)
    if fresh.any():
        out.append(row(HASHES, None, bucket, values[fresh].tobytes(), pack(np.where(shared, SHARED, low)[fresh].tobytes())))
    return table_of(ROW, out)


def _strips_of(history: DataFrame, wanted: DataFrame, p: Plan) -> DataFrame:
    """The strips, around the wanted hashes (rank, bodies), of earlier documents."""
    schema = STRIPS + ", keys binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                hashes = [np.frombuffer(x, np.uint64) for bodies in table.column("bodies").to_pylist() for x in bodies]
                yield from table_of(schema, strip_rows(Block(table, p), np.unique(np.concatenate(hashes)))).combine_chunks().to_batches()

    docs = history.select(F.lit(-1).cast("long").alias("blk"), "rank", "doc_id", "text")
    return docs.join(wanted, "rank").select("blk", "rank", "doc_id", "text", "bodies").mapInArrow(run, schema)


def verify(table: pa.Table) -> pa.Table:
    """Compares a bucket's passages word by word: marks for the batch's blocks (blk from 0 on), and passages that the index hasn't yet (others than those of blk -2)."""
    number, least, members = gathered(table)
    anchor = np.zeros(len(number), np.uint64)
    for own, keys in zip(members, table.column("keys").to_pylist(), strict=True):
        anchor[own] = np.frombuffer(unpacked(keys), np.uint64)
    parts = shared_parts(list(number), np.array(least, np.int64), rows_with(members, len(number)), anchor)
    rows = [row(MARKS, b, k, body) for b, _, k, body in answer_rows(table, members, parts)]
    stored = {}
    for b, own, docs in zip(table.column("blk").to_pylist(), members, table.column("docs").to_pylist(), strict=True):
        if b == -2:
            for k, d in zip(own, np.frombuffer(unpacked(docs), np.int64).tolist(), strict=True):
                stored[k] = min(d, stored.get(k, NO_ID))
    strips = list(number)
    new = sorted((a, k) for k, a in enumerate(anchor.tolist()) if k not in stored or least[k] < stored[k])
    if new:
        at = [k for _, k in new]
        rows.append(passages_row(PASSAGES, table.column("bucket")[0].as_py(), np.array([a for a, _ in new], np.uint64), [strips[k] for k in at], np.array([least[k] for k in at], np.int64)))
    return table_of(ROW, rows)


def remove_seen(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", shape: Callable[[DataFrame], DataFrame] = lambda df: df, fanout: int = QUERY_FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary; kept words joined by a blank): one row for each row of docs.

    Documents are ingested in batches of rising doc_id. A word is removed if a window of WINDOW words that covers it also
    starts in a document of smaller doc_id. A null text, or one of fewer words than a window, loses nothing. Rows of equal
    doc_id are one document: they are in one batch and take nothing from each other. Null doc_ids come last and take nothing
    from each other. Other columns are not read.
    """
    spark = session(docs)
    folder = shared_folder(spark)
    rows = placed(id_text(docs, id_col, text_col), folder)
    cuts = [k / batches for k in range(1, batches)]
    edges = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts or [0.5], 1000)).first()[0] or []))[: batches - 1] if batches > 1 else []
    index = FingerprintIndex(spark, f"{folder}/index", fanout)
    out, low = [], None
    for high in [*edges, None]:
        new = rows if low is None else rows.filter((F.col("doc_id") >= low) | F.col("doc_id").isNull())
        new = new if high is None else new.filter(F.col("doc_id") < high)
        out.append(index.ingest(new, rows.filter(F.col("doc_id") < low) if low is not None else rows.limit(0), shape))
        low = high
    return reduce(DataFrame.unionByName, out)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    digests = lambda df: df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return remove_seen(spark.read.parquet(f"{sf_dir}/documents.parquet"), shape=digests)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS HUGEINT), {1 << 64}) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM (SELECT r, k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
low AS (SELECT s, min(k) AS m FROM win GROUP BY s HAVING min(k) < max(k)),
cov AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN low USING (s) WHERE m < k),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM cov GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""
