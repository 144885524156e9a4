"""Suffix-array dedup: a common-prefix interval tree over an enhanced suffix array.

Suffixes of the strips that meet in a bucket (see spans.py) are sorted, common-prefix lengths of neighbours computed, and
the intervals of the common-prefix tree are found by a stack scan. An interval whose suffixes have different bytes to their
left is a maximal repeat; it comes with all of its occurrences. An interval without that diversity is the tail of a longer
repeat, and so is everything below it. Each occurrence in a later document than the earliest is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import _byte_values, id_text, placed, session, shared_folder, window_hashes
from .spans import Block, answer_anchors, answer_strips, binary_array, covered, in_blocks, occurrences, per_document, plan_for, send_anchors, send_strips, shared_anchors, table_of

WINDOW, GRAM = 50, 16
PLACES = "repeat binary, length long, doc_id long, offset long"


def enhanced_suffix_array(strings: list[bytes], least: int, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String numbers, offsets, common-prefix lengths with the suffix before (0 for the first), and bytes to the left.

    It holds the suffixes whose first `least` bytes occur more than once; no other can share as much. The byte to the left is
    256 at the beginning of a string, where what stands before isn't known. A string that occurs several times as a whole is a
    suffix twice: its other suffixes have the same byte to their left in all of its occurrences.
    """
    size = np.array([len(x) for x in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    longest = int(size.max(initial=0))
    flat = np.frombuffer(b"".join(strings) + b"\0" * longest, np.uint8)
    count = np.maximum(size - least + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + offset
    if len(at):
        prefix = window_hashes(_byte_values[flat], least)[at]
        order = np.argsort(prefix)
        same = prefix[order[1:]] == prefix[order[:-1]]
        more = np.zeros(len(at), bool)
        more[order[1:]] |= same
        more[order[:-1]] |= same
        twin = np.zeros(len(at), bool) if several is None else several[owner] & (offset == 0)
        copies = np.where(twin, 2, more)
        owner, offset, at = np.repeat(owner, copies), np.repeat(offset, copies), np.repeat(at, copies)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    left_over = size[owner] - offset
    by_size = np.argsort(left_over, kind="stable")  # a suffix that ends goes before one that goes on
    owner, offset, at, left_over = owner[by_size], offset[by_size], at[by_size], left_over[by_size]
    rows = np.lib.stride_tricks.sliding_window_view(flat, longest)[at]
    rows[np.arange(longest) >= left_over[:, None]] = 0
    order = np.argsort(rows.view(f"S{longest}").ravel(), kind="stable")
    rows, owner, offset, at, left_over = rows[order], owner[order], offset[order], at[order], left_over[order]
    common = np.zeros(len(at), np.int64)
    differ = rows[1:] != rows[:-1]
    common[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), longest), np.minimum(left_over[1:], left_over[:-1]))
    return owner, offset, common, np.where(offset > 0, flat[at - 1].astype(np.int64), 256)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every node of the common-prefix interval tree over common[1:], by a stack scan; children first."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        length = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, first, i - 1
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(strings: list[bytes], least: int = WINDOW, several: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences as (string number, offset)) of the maximal repeats of at least `least` bytes.

    Empty strings and strings shorter than `least` have none. The beginning of a string counts as a byte of its own, so equal
    strings are a repeat, and so is one that `several` says occurs more than once; its number comes twice.
    """
    owner, offset, common, left = enhanced_suffix_array(strings, least, several)
    if not len(owner):
        return
    head = np.flatnonzero(common < least)
    diverse = (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)) | (np.maximum.reduceat(left, head) == 256)
    tail = np.append(head[1:], len(common))
    for a, b in zip(head[diverse & (tail - head > 1)].tolist(), tail[diverse & (tail - head > 1)].tolist(), strict=True):
        lefts, own, off = left[a:b].tolist(), owner[a:b].tolist(), offset[a:b].tolist()
        for length, i, j in intervals([0, *common[a + 1 : b].tolist()]):
            x = lefts[i]
            if x == 256 or any(y != x for y in lefts[i : j + 1]):
                yield length, list(zip(own[i : j + 1], off[i : j + 1], strict=True))


def shared_parts(strips: list[bytes], least: np.ndarray, times: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The repeats that occur in each strip: (offset, length, least document that has it)."""
    doc = least.tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in strips]
    for length, where in maximal_repeats(strips, several=times > 1):
        first = min([doc[k] for k, _ in where])
        for k, offset in dict.fromkeys(where):
            out[k].append((offset, length, first))
    return out


def _by_block(rows: DataFrame, window: int, make, schema: str | StructType) -> DataFrame:
    """make(block, answers) -> table, over blocks of (doc_id, text, more columns) and the repeats found in them."""
    p = plan_for(rows, False, window, GRAM)
    more = [c for c in rows.columns if c not in ("doc_id", "text")]
    blocks = in_blocks(placed(rows, shared_folder(rows.sparkSession)), p, more)
    found = answer_anchors(send_anchors(blocks, p))
    parts = answer_strips(send_strips(blocks, found, p, twice=True), shared_parts)
    return blocks.groupBy("blk").cogroup(found.unionByName(parts).groupBy("blk")).applyInArrow(lambda left, right: make(Block(left, p), right), schema)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """repeat (digest of its bytes), length, doc_id, offset: every occurrence of every repeat, in bytes.

    A group is a string of `window` bytes or more with all places where it is, in the same document too. It can't be made longer
    without losing one of them, unless that crosses the end of a strip (see spans.py): a passage longer than a strip is a chain
    of groups, which overlap by `window` - 1 bytes. Each string of `window` bytes that several documents have is in a group;
    what recurs in one document alone may be. Null and empty texts have none, and an empty table gives no rows. Rows of equal doc_id are one
    document, and so are those without one; each row's places count from its own beginning. Repeated rows repeat their places.
    Other columns are not read.
    """
    session(docs)

    def make(b: Block, answers: pa.Table) -> pa.Table:
        places: list[tuple] = []
        raw = b.data.tobytes()
        for strip, first, length, _ in occurrences(b, b.entries(shared_anchors(b, answers)), answers):
            row = b.row[strip]
            for r, x, n in zip(row.tolist(), first.tolist(), length.tolist(), strict=True):
                places.append((hashlib.blake2b(raw[x : x + n], digest_size=16).digest(), n, b.ids[r].as_py(), x - int(b.byte_offs[r])))
        return table_of(PLACES, places)

    return _by_block(id_text(docs, id_col, text_col), window, make, PLACES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row for each row of docs.

    A byte is removed if a string of `window` bytes that covers it also starts in a document of smaller doc_id. A null or
    empty text, or one shorter than the window, loses nothing. Rows of equal doc_id are one document: they take nothing from
    each other. Null doc_ids come after all others and take nothing from each other either. Other columns are not read.
    """
    session(docs)

    def make(b: Block, answers: pa.Table) -> pa.Table:
        cov = covered(b, answers, whole=False)
        n, removed, runs = per_document(b, cov)
        return pa.table([b.ids, pa.array(n), pa.array(removed), pa.array(runs), binary_array(b.data[~cov], n - removed)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _by_block(id_text(docs, id_col, text_col), window, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with its text cleaned, other columns as they are. Bytes of a character that lost others of its bytes go too; a null text becomes empty."""
    session(docs)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("int")
    rows = id_text(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), packed.alias("__rest")), id_col, text_col, "__rest")

    def make(b: Block, answers: pa.Table) -> pa.Table:
        cov = covered(b, answers, whole=False)
        n, removed, _ = per_document(b, cov)
        raw, ends = b.data[~cov].tobytes(), np.concatenate([[0], np.cumsum(n - removed)]).tolist()
        text = [raw[i:j].decode(errors="ignore") for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([b.ids, pa.array(text, pa.string()), b.table.column("__rest")], names=["doc_id", "text", "__rest"])

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), rows.schema["__rest"]])
    out = _by_block(rows, window, make, schema)
    columns = {id_col: F.col("doc_id").alias(id_col), text_col: F.col("text").alias(text_col)} | {c: F.col(f"__rest.`{c}`").alias(c) for c in rest}
    return out.select(*[columns[c] for c in docs.columns])


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS HUGEINT), {1 << 64}) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, k, i, substr(h, 2 * i - 1, {2 * WINDOW}) AS s FROM (SELECT r, k, h, unnest(range(1, length(h) // 2 - {WINDOW - 2})) AS i FROM d WHERE length(h) >= {2 * WINDOW})),
low AS (SELECT s, min(k) AS m FROM win GROUP BY s HAVING min(k) < max(k)),
cov AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN low USING (s) WHERE m < k),
n AS (SELECT r, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM cov) GROUP BY r),
part AS (SELECT r, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS t FROM (SELECT r, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM d SEMI JOIN n USING (r)) ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN part USING (r)
"""
