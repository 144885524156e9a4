"""Benchmark decontamination by one Aho-Corasick automaton over normalised questions and answers.

Items are normalised to words. The automaton's patterns are probes: the first words of every stretch of an item, so placed
that each window of an item holds one whole. A document is normalised once and scanned once; where a probe occurs, the
windows of the document around it are looked up among the hashes of all items' windows and compared with the items' words.
Words carry their offsets in the original text. So nodes follow a part of the items' bytes (3 of 11 words), and not every
window's; windows cost some 30 bytes each. What is broadcast is the items' text; a worker builds its index once. Benchmark
texts beyond SHARD_BYTES are dealt to several indexes, used one after another, so that memory has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, free_name, hash_spans, id_text, mix, session, shared_folder, window_hashes, written

WINDOW = 13
#: Words of a probe.
PROBE = 3
#: Benchmark text of one index.
SHARD_BYTES = 32 << 20
#: Windows of an index whose items are remembered.
SEEN = 4096
#: A document with any hit is contaminated if CONTAMINATED * hit words >= words.
CONTAMINATED = 20

_keep = [b for b in range(256) if 48 <= b < 58 or 97 <= b < 123 or b >= 128]
_TABLE = bytes(b if b in _keep else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and bytes of non-ASCII characters."""
    return raw.translate(_TABLE).split()


def word_starts(text: np.ndarray) -> np.ndarray:
    """Where the words begin in words joined, preceded and followed by single blanks, and where one more would."""
    return np.flatnonzero(text == 32) + 1


def word_hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at at[:-1], a stretch at a time."""
    parts = [hash_spans(text[b[0] : b[-1]], b[:-1] - b[0], b[1:] - 1 - b[0]) for i in range(0, len(at) - 1, 1 << 16) if len(b := at[i : i + (1 << 16) + 1])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Windows:
    """All windows of the items, by size and hash: representative words for the comparison, and the items that have each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, first: np.ndarray, size: int):
        """text: words of all items, joined; at: where words begin; first: each item's first word, and the end."""
        self._text, self._at = text, at.astype(np.uint32)
        h, n = word_hashes(text, at), np.diff(first)
        # windows of `size` words, and the items of fewer words as windows of their own
        whole = np.repeat(np.maximum(first[1:] - size + 1, first[:-1]), n) if len(n) else np.zeros(0, np.int64)
        start = np.flatnonzero(np.arange(len(h)) < whole)
        short = np.flatnonzero((n > 0) & (n < size))
        self.sizes = sorted({int(x) for x in n[short]} | ({size} if len(start) else set()))
        long = window_hashes(h, size)[start] if len(start) else np.zeros(0, np.uint64)
        rest = np.array([window_hashes(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short.tolist()], np.uint64)
        start, words = np.concatenate([start, first[short]]), np.concatenate([np.full(len(start), size), n[short]])
        key = self.key(np.concatenate([long, rest]), words)
        del h, long, rest, whole
        item = (np.searchsorted(first, start, "right") - 1).astype(np.int32)
        order = np.argsort(key)
        self._key, self._start, self._words, self._item = key[order], start[order].astype(np.int32), words[order].astype(np.int32), item[order].astype(np.int32)

    @staticmethod
    def key(h: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h + np.asarray(words).astype(np.uint64))

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are some window's."""
        return self._key[np.minimum(np.searchsorted(self._key, keys), len(self._key) - 1)] == keys

    def items(self, key: np.uint64, raw: bytes, words: int) -> list[int]:
        """Numbers of the items with this window; raw: its words, joined by blanks."""
        out = set()
        for i in range(np.searchsorted(self._key, key, "left"), np.searchsorted(self._key, key, "right")):
            s = self._start[i]
            if self._words[i] == words and self._text[self._at[s] : self._at[s + words] - 1].tobytes() == raw:
                out.add(int(self._item[i]))
        return sorted(out)


class Scanner:
    """An index of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        self._size = size
        self._names = [name for name, _ in items]
        self._automaton, self._probe = ahocorasick.Automaton(), min(PROBE, size)
        joined, count = [b" "], [0]
        for _, raw in items:
            w = words_of(raw)
            count.append(len(w))
            if w:
                joined.append(b" ".join(w) + b" ")
            n = min(self._probe, len(w))
            # a window of an item has every word from its start to its start + size - 1, so one of these positions begins a probe inside
            for i in range(0, len(w) - n + 1 if w else 0, size - self._probe + 1):
                self._automaton.add_word((b" " + b" ".join(w[i : i + n]) + b" ").decode("latin-1"), n)
        text = np.frombuffer(b"".join(joined), np.uint8)
        del joined
        self._windows = Windows(text, word_starts(text), np.cumsum(count), size)
        if len(self._automaton):
            self._automaton.make_automaton()
        self._seen: dict[bytes, tuple[str, ...]] = {}

    def nodes(self) -> int:
        return self._automaton.get_stats()["nodes_count"]

    def _items(self, key: np.uint64, raw: bytes, words: int) -> tuple[str, ...]:
        if (x := self._seen.get(raw)) is None:
            if len(self._seen) > SEEN:
                self._seen.clear()
            x = self._seen[raw] = tuple(self._names[k] for k in self._windows.items(key, raw, words))
        return x

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
        """The number of words, and (first word, end word, item ids) of each occurrence of a window."""
        w = words_of(raw)
        if not len(self._automaton) or not w:
            return len(w), []
        text = b" " + b" ".join(w) + b" "
        hits = list(self._automaton.iter(text.decode("latin-1")))
        if not hits:
            return len(w), []
        flat_text = np.frombuffer(text, np.uint8)
        at = word_starts(flat_text)
        end = np.searchsorted(at - 1, np.array([e for e, _ in hits]))
        n = np.array([n for _, n in hits])
        begin = end - n
        h, found = word_hashes(flat_text, at), []
        for size in self._windows.sizes:
            # a probe lies anywhere in a full window, and at the beginning of a shorter item
            start = np.unique((begin[n == self._probe][:, None] - np.arange(size - self._probe + 1)).ravel() if size == self._size else begin)
            start = start[(start >= 0) & (start <= len(w) - size)]
            if not len(start):
                continue
            keys = Windows.key(window_hashes(h, size)[start], size)
            for k in np.flatnonzero(self._windows.known(keys)).tolist():
                i = int(start[k])
                if items := self._items(keys[k], text[at[i] : at[i + size] - 1], size):
                    found.append((i, i + size, items))
        return len(w), found


_scanners: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[str, bytes]], size: int) -> Scanner:
    """One index in each worker, built once."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(items, size)
    return _scanners[key]


def word_offsets(raw: bytes) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of its words."""
    low = np.frombuffer(raw.translate(_TABLE), np.uint8)
    solid = np.concatenate([[False], low != 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return list(zip(chars[edges[::2]].tolist(), chars[edges[1::2]].tolist(), strict=True))


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark in parts of about SHARD_BYTES at most; (item_id string, text binary)."""
    b = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SHARD_BYTES) or 1
    return [b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [b]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "array<struct<item_id:string,first:int,end:int>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans, contaminated: one row for each row of docs.

    spans has item_id, start and end (characters of the original text) for the maximal hit runs of each item. A null text
    has no words and no hits; a null item_id is the empty string; equal item_ids are one item. Null and repeated doc_ids keep
    their rows; an empty benchmark hits nothing. Other columns are not read. Nothing is shuffled.
    """
    spark = session(docs)
    parts = shards(benchmark)
    rows = id_text(docs, id_col, text_col).withColumn("hits", F.array().cast(_HITS))
    schema = pa.list_(pa.struct([("item_id", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    folder = shared_folder(spark) if len(parts) > 1 else ""
    for k, part in enumerate(parts):
        items, key = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in part.toLocalIterator()]), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items=items, key=key, last=k == len(parts) - 1) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, items.value, size)
            for batch in batches:
                data, offs = flat(batch.column(1))
                raw = data.tobytes() if batch.num_rows else b""
                out = []
                for i, before in enumerate(batch.column(2).to_pylist()):
                    text = raw[offs[i] : offs[i + 1]]
                    n, found = scanner.scan(text)
                    by: dict[str, list[tuple[int, int]]] = {}
                    for h in before:
                        by.setdefault(h["item_id"], []).append((h["first"], h["end"]))
                    for a, b, ids in found:
                        for item in ids:
                            by.setdefault(item, []).append((a, b))
                    out.append((n, text, {item: _merged(x) for item, x in sorted(by.items())}))
                if not last:
                    hits = [[{"item_id": i, "first": a, "end": b} for i, x in by.items() for a, b in x] for _, _, by in out]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, schema)], names=["doc_id", "text", "hits"])
                    continue
                spans, n_hit = [], []
                for n, text, by in out:
                    n_hit.append(sum(b - a for a, b in _merged([s for x in by.values() for s in x])))
                    at = word_offsets(text) if by else []
                    spans.append([{"item_id": i, "start": at[a][0], "end": at[b - 1][1]} for i, x in by.items() for a, b in x])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([n for n, _, _ in out], pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([list(by) for _, _, by in out], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([h > 0 and CONTAMINATED * h >= n for h, (n, _, _) in zip(n_hit, out, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
                )

        if k < len(parts) - 1:
            rows = written(rows.mapInArrow(run, f"doc_id long, text string, hits {_HITS}"), folder, f"shard{k}")
        else:
            rows = rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<item_id:string,start:int,end:int>>, contaminated boolean")
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated; judged row by row, so repeated ids don't matter.

    Hit words count together over all items, as in find_hits. With several shards, each row carries its text's hits on
    through find_hits under a number of its own.
    """
    spark = session(docs)
    parts = shards(benchmark)
    if len(parts) > 1:
        row = free_name(docs, "__row")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), shared_folder(spark), "numbered")
        good = find_hits(numbered, benchmark, row, text_col).filter(~F.col("contaminated")).select(F.col("doc_id").alias(row))
        return numbered.join(good, row, "left_semi").drop(row)
    items, key = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in parts[0].toLocalIterator()]), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, items.value, WINDOW)
        for batch in batches:
            ok = []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                n, found = scanner.scan((t.as_py() or "").encode())
                hit = sum(b - a for a, b in _merged([x[:2] for x in found]))
                ok.append(not (hit > 0 and CONTAMINATED * hit >= n))
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS s FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {CONTAMINATED} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
