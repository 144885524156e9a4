"""Finding passages that documents share, without moving more than a trace of the text.

Both substring operators look for windows of a fixed number of tokens (bytes, or words) that occur in several documents.
Each window is owned by one anchor: the k-gram of least hash inside it, which depends on the window's content alone. Windows
that follow each other and have the same anchor form a strip. Equal windows have equal anchors, so:

1. documents are dealt once to blocks of bounded size (all later steps reuse that one exchange of the text);
2. a block sends the distinct hashes of its anchors to buckets, pre-aggregated: a hash goes out once however many copies the
   block holds, so what a hot group sends is bounded by the number of blocks;
3. a bucket answers, by a bit for each hash, which ones have turned up in two documents;
4. a block sends the distinct strips of those anchors, with the least doc_id of each;
5. a bucket compares real content, not hashes, and answers with (strip, offset, length, least doc_id) for what is shared;
6. a block marks the tokens of each occurrence in a later document.

Steps 2 to 6 keep at most one block or one bucket in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST, NO_ID, SPACE, _byte_values, find_words, flat, hash_spans, slices, window_hashes

BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
LEAST_BLOCKS, LEAST_BUCKETS = 96, 128
_CHUNK, _POSITION = 1 << 19, (1 << 20) - 1

ANCHORS = "bucket int, blk long, hashes binary, multi binary"
ANSWER = "blk long, kind int, bucket int, body binary"
STRIPS = "bucket int, blk long, docs binary, lens binary, blob binary"
MARK = np.dtype([("entry", "<u4"), ("offset", "<u4"), ("length", "<u4"), ("doc", "<i8")])


@dataclass(frozen=True)
class Plan:
    words: bool  # tokens are words, otherwise bytes
    window: int
    gram: int
    blocks: int
    buckets: int


def plan_for(docs: DataFrame, words: bool, window: int, gram: int) -> Plan:
    """Blocks and buckets in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()[0] or 0
    return Plan(words, window, gram, max(LEAST_BLOCKS, -(-total // BLOCK_BYTES)), max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)))


def in_blocks(docs: DataFrame, p: Plan, more: list[str] | None = None) -> DataFrame:
    """blk, rank (see common.placed, which docs have been through), doc_id, text, and `more` columns that go along.

    The block follows from the text too, so rows that share an id, or have none, spread over blocks.
    """
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text", F.lit(p.window)), F.lit(p.blocks)).alias("blk"),
        "rank",
        "doc_id",
        "text",
        *(more or []),
    )


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def strips_of(tokens: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each strip. tokens: hashes, or bytes; offs: where each document's begin, and the end."""
    n = len(tokens) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.clip(offs[1:-1] - window + 1, 0, n), 1)
    np.add.at(crossing, np.clip(offs[1:-1], 0, n), -1)
    whole = np.cumsum(crossing[:-1], dtype=np.int32) == 0
    hashes, firsts, lasts = [], [], []
    for s in range(0, n, _CHUNK):
        e = min(s + _CHUNK, n)
        some = tokens[s : e + window - 1]
        g = window_hashes(_byte_values[some] if some.dtype == np.uint8 else some, gram)
        key = (g & np.uint64(~_POSITION & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(key, window - gram + 1) & np.uint64(_POSITION)).astype(np.int64)
        i = np.flatnonzero(whole[s:e])
        if not len(i):
            continue
        own = at[i]
        head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (i[1:] != i[:-1] + 1)]))
        hashes.append(g[own[head]])
        firsts.append(i[head] + s)
        lasts.append(i[np.append(head[1:], len(i)) - 1] + s)
    return (np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)) if hashes else (np.zeros(0, np.uint64), none, none)


class Block:
    """The documents of one block: tokens, strips, and where they are."""

    def __init__(self, table: pa.Table, p: Plan):
        # shuffled rows come in any order, and strips are numbered in the documents' order: each step has to see the same one
        table = table.sort_by([("rank", "ascending"), ("text", "ascending")]).combine_chunks()
        self.plan, self.table = p, table
        self.ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.blk = table.column("blk")[0].as_py() if table.num_rows else None
        self.rank = table.column("rank").to_numpy().astype(np.int64)
        data, offs = flat(table.column("text"))
        self.data, self.byte_offs = data[offs[0] : offs[-1]], offs - offs[0]
        if p.words:
            parts, base = [], 0
            for a, b in slices(self.byte_offs):
                o = self.byte_offs[a : b + 1]
                chunk = self.data[o[0] : o[-1]]
                s, e, r = find_words(chunk, o - o[0])
                parts.append((hash_spans(chunk, s, e), s + o[0], e + o[0], r + a))
            cat = lambda k, kind: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, kind)
            tokens, self.start, self.end, rows = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64), cat(3, np.int64)
            self.offs = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=table.num_rows))]).astype(np.int64)
        else:
            tokens, self.offs = self.data, self.byte_offs
        self.anchor, self.first, self.last = strips_of(tokens, self.offs, p.window, p.gram)
        self.n_tokens = len(tokens)
        self.row = np.searchsorted(self.offs, self.first, "right") - 1  # documents without tokens come before one that has some

    def doc_of(self) -> np.ndarray:
        return self.rank[self.row]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, by bucket and then value; whether each is in two documents; buckets; the least document."""
        order = np.argsort(self.anchor, kind="stable")
        h, d = self.anchor[order], self.doc_of()[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        multi = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head) if len(h) else np.zeros(0, bool)
        least = np.minimum.reduceat(d, head) if len(h) else d
        h = h[head]
        bucket = self.buckets(h)
        by = np.argsort(bucket, kind="stable")
        return h[by], multi[by], bucket[by], least[by]

    def buckets(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(11)) % np.uint64(self.plan.buckets)).astype(np.int64)

    @cached_property
    def gaps(self) -> np.ndarray:
        """Before each word: how many words were not separated from the next one by a single blank."""
        return np.concatenate([[0], np.cumsum((self.start[1:] != self.end[:-1] + 1) | (self.data[self.end[:-1]] != ord(" ")))])

    def content(self, chosen: np.ndarray) -> list[bytes]:
        """The text of each of these strips; words are separated by one blank."""
        raw = memoryview(self.data)
        first, last = self.first[chosen], self.last[chosen] + self.plan.window - 1
        if not self.plan.words:
            return [bytes(raw[a:b]) for a, b in zip(first.tolist(), (last + 1).tolist(), strict=True)]
        plain = self.gaps[last] == self.gaps[first]
        spans = zip(self.start[first].tolist(), self.end[last].tolist(), plain.tolist(), strict=True)
        return [bytes(raw[a:b]) if one else b" ".join(bytes(raw[a:b]).split()) for a, b, one in spans]

    def entries(self, shared: np.ndarray) -> dict[int, tuple[dict[bytes, int], list[int], list[int]]]:
        """For each bucket: the distinct strips whose anchor is in `shared` (sorted), numbered; the strips, and the number of each."""
        out: dict[int, tuple[dict[bytes, int], list[int], list[int]]] = {}
        if not len(shared):
            return out
        at = np.minimum(np.searchsorted(shared, self.anchor), len(shared) - 1)
        chosen = np.flatnonzero(shared[at] == self.anchor)
        bucket = self.buckets(self.anchor[chosen])
        by = np.argsort(bucket, kind="stable")
        for k, x, y in by_bucket(bucket[by]):
            own = chosen[by[x:y]]
            number: dict[bytes, int] = {}
            out[k] = number, own.tolist(), [number.setdefault(c, len(number)) for c in self.content(own)]
        return out


def table_of(schema: str, rows: Iterable[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def by_bucket(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of a sorted array."""
    if not len(buckets):
        return []
    cut = np.flatnonzero(np.diff(buckets)) + 1
    a = np.concatenate([[0], cut])
    return list(zip(buckets[a].tolist(), a.tolist(), [*cut.tolist(), len(buckets)], strict=True))


def send_anchors(blocks: DataFrame, p: Plan) -> DataFrame:
    """Step 2."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, p)
        h, multi, bucket, _ = b.anchors()
        return table_of(ANCHORS, [(k, b.blk, h[x:y].tobytes(), np.packbits(multi[x:y]).tobytes()) for k, x, y in by_bucket(bucket)])

    return blocks.groupBy("blk").applyInArrow(run, ANCHORS)


def unpack(table: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    blks = table.column("blk").to_pylist()
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    multi = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("multi"), hashes, strict=True)]
    return blks, hashes, multi


def answer_anchors(anchors: DataFrame) -> DataFrame:
    """Step 3: kind 0, a bit for each hash in the order sent."""

    def run(table: pa.Table) -> pa.Table:
        blks, hashes, multi = unpack(table)
        every = np.concatenate(hashes)
        order = np.argsort(every)
        s = every[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        many = np.concatenate(multi)
        # a hash in two documents of one block is shared in all blocks
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        spread = np.repeat(np.maximum.reduceat(many[order], head), np.diff(np.append(head, len(s))))
        shared = np.zeros(len(s), bool)
        shared[order] = twice | spread
        bucket = table.column("bucket")[0].as_py()
        ends = np.cumsum([len(h) for h in hashes])
        return table_of(ANSWER, [(blk, 0, bucket, np.packbits(x).tobytes()) for blk, x in zip(blks, np.split(shared, ends[:-1]), strict=True) if x.any()])

    return anchors.groupBy("bucket").applyInArrow(run, ANSWER)


def shared_anchors(b: Block, answers: pa.Table) -> np.ndarray:
    """The hashes, sorted, that step 3 found shared."""
    h, _, bucket, _ = b.anchors()
    where = {k: (x, y) for k, x, y in by_bucket(bucket)}
    kinds, buckets, bodies = (answers.column(c).to_pylist() for c in ("kind", "bucket", "body"))
    found = [np.zeros(0, np.uint64)]
    for kind, k, body in zip(kinds, buckets, bodies, strict=True):
        if kind == 0:
            x, y = where[k]
            found.append(h[x:y][np.unpackbits(np.frombuffer(body, np.uint8), count=y - x).astype(bool)])
        elif kind == 2:
            found.append(np.frombuffer(body, np.uint64))
    return np.unique(np.concatenate(found))


def strip_rows(b: Block, shared: np.ndarray, twice: bool = False) -> list[tuple]:
    """STRIPS rows of the distinct strips whose anchor is in `shared`, and their anchors.

    twice: a strip that several documents of the block have goes again, after all others, so that its bucket sees two occurrences.
    """
    doc, rows = b.doc_of(), []
    for k, (content, at, number) in b.entries(shared).items():
        strips = list(content)
        least, most = np.full(len(strips), NO_ID, np.int64), np.full(len(strips), LEAST, np.int64)
        np.minimum.at(least, number, doc[at])
        keys = np.zeros(len(strips), np.uint64)
        keys[number] = b.anchor[at]
        if twice:
            np.maximum.at(most, number, doc[at])
            again = np.flatnonzero(most > least)
            strips += [strips[i] for i in again.tolist()]
            least, keys = np.append(least, most[again]), np.append(keys, keys[again])
        rows.append((k, b.blk, *packed_strips(strips, least), pack(keys.tobytes())))
    return rows


def packed_strips(content: list[bytes], least: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return pack(least.tobytes()), pack(np.array([len(x) for x in content], np.uint32).tobytes()), pack(b"".join(content))


def send_strips(blocks: DataFrame, answers: DataFrame, p: Plan, keyed: bool = False, twice: bool = False) -> DataFrame:
    """Step 4. keyed: with each strip's anchor in a last column. twice: see strip_rows."""
    schema = STRIPS + ", keys binary" * keyed

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of(schema, [])
        b = Block(left, p)
        rows = strip_rows(b, shared_anchors(b, right), twice)
        return table_of(schema, rows if keyed else [r[:-1] for r in rows])

    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, schema)


def unpacked_strips(docs: bytes, lens: bytes, blob: bytes) -> list[tuple[bytes, int]]:
    """Strips and their least documents."""
    ends = np.cumsum([0, *np.frombuffer(unpacked(lens), np.uint32)]).tolist()
    raw = unpacked(blob)
    return list(zip([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.frombuffer(unpacked(docs), np.int64).tolist(), strict=True))


def gathered(table: pa.Table) -> tuple[dict[bytes, int], list[int], list[list[int]]]:
    """The distinct strips of STRIPS rows, numbered; the least document of each; and for each row, the numbers of its strips."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    members = []
    for docs, lens, blob in zip(*(table.column(c).to_pylist() for c in ("docs", "lens", "blob")), strict=True):
        own = []
        for x, d in unpacked_strips(docs, lens, blob):
            k = number.setdefault(x, len(number))
            if k == len(least):
                least.append(d)
            elif d < least[k]:
                least[k] = d
            own.append(k)
        members.append(own)
    return number, least, members


Parts = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int, int]]]]


def answer_rows(table: pa.Table, members: list[list[int]], parts: list[list[tuple[int, int, int]]]) -> list[tuple]:
    """ANSWER rows of kind 1 for STRIPS rows with these members, given the parts of each strip."""
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for blk, own in zip(table.column("blk").to_pylist(), members, strict=True):
        marks = [(i, *m) for i, k in enumerate(dict.fromkeys(own)) for m in parts[k]] if blk >= 0 else []
        if marks:
            rows.append((blk, 1, bucket, pack(np.array(marks, MARK).tobytes())))
    return rows


def rows_with(members: list[list[int]], strips: int) -> np.ndarray:
    """How often each strip is among the members."""
    return np.bincount([k for own in members for k in own], minlength=strips)


def answer_strips(strips: DataFrame, shared_parts: Parts) -> DataFrame:
    """Step 5: kind 1. shared_parts(distinct strips, least doc of each, rows that have it) -> for each strip, (offset, length, least doc) in tokens."""

    def run(table: pa.Table) -> pa.Table:
        number, least, members = gathered(table)
        parts = shared_parts(list(number), np.array(least, np.int64), rows_with(members, len(number)))
        return table_of(ANSWER, answer_rows(table, members, parts))

    return strips.groupBy("bucket").applyInArrow(run, ANSWER)


def occurrences(b: Block, entries: dict, answers: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What buckets answered, for each occurrence in the block: strips, first tokens, lengths in tokens, least documents."""
    kinds, buckets, bodies = (answers.column(c).to_pylist() for c in ("kind", "bucket", "body"))
    for kind, k, body in zip(kinds, buckets, bodies, strict=True):
        if kind != 1:
            continue
        marks = np.frombuffer(unpacked(body), MARK)
        content, at, number = entries[k]
        order = np.argsort(number, kind="stable")
        at = np.array(at)[order]
        begin = np.searchsorted(np.array(number)[order], np.arange(len(content) + 1))
        n = begin[marks["entry"] + 1] - begin[marks["entry"]]
        m = np.repeat(np.arange(len(marks)), n)
        strip = at[np.repeat(begin[marks["entry"]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        yield strip, b.first[strip] + marks["offset"][m], marks["length"][m].astype(np.int64), marks["doc"][m]


def covered(b: Block, answers: pa.Table, whole: bool = True) -> np.ndarray:
    """Step 6: which tokens of the block are covered. whole: strips that several documents of this block have count without an answer."""
    edge = np.zeros(b.n_tokens + 1, np.int32)
    doc = b.doc_of()
    entries = b.entries(shared_anchors(b, answers))
    for _, at, number in entries.values() if whole else ():
        at, number = np.array(at), np.array(number)
        least = np.full(number.max() + 1, NO_ID, np.int64)
        np.minimum.at(least, number, doc[at])
        at = at[doc[at] > least[number]]
        np.add.at(edge, b.first[at], 1)
        np.add.at(edge, b.last[at] + b.plan.window, -1)
    for strip, first, length, low in occurrences(b, entries, answers):
        later = low < doc[strip]
        np.add.at(edge, first[later], 1)
        np.add.at(edge, first[later] + length[later], -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def per_document(b: Block, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, covered tokens and covered runs of each document."""
    head = cov.copy()
    inner = np.zeros(len(cov) + 1, bool)
    inner[b.offs] = True
    head[1:] &= ~cov[:-1] | inner[1:-1]
    of = lambda x: np.array([np.count_nonzero(x[i:j]) for i, j in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True)], np.int64)
    return np.diff(b.offs), of(cov), of(head)


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
