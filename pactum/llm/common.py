"""Shared plumbing of the training-data operators: Arrow batches as flat numpy buffers, word hashing, work folders."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Longest span whose hash is a polynomial.
PLAIN_BYTES = 256
#: Rank of a null doc_id in operators that order documents: after every real one. Marks take the least long; `placed` keeps both free.
NO_ID, LEAST = (1 << 63) - 1, -(1 << 63)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD6E8FEB86659FD93
#: Ranks of rows with a null id begin here, where such rows are documents of their own; `ranked` keeps real ones below.
NULL_RANKS = 1 << 62

#: Settings that operators need while their results are computed. They are left in the session, as results are lazy, and are
#: only set where the session has none of its own: Arrow batches bounded in rows and bytes, and shuffle files that go when a
#: job ends and not when the driver happens to collect garbage.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_work: ContextVar[str | None] = ContextVar("work", default=None)


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with SETTINGS where it has none of its own."""
    spark = df.sparkSession
    own = spark.conf.getAll
    for k, v in SETTINGS.items():
        if k not in own:
            spark.conf.set(k, v)
    return spark


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A folder that holds all intermediate tables of the operators called inside, and goes at the end; write results elsewhere before."""
    path = shared_folder(spark)
    token = _work.set(path)
    try:
        yield path
    finally:
        _work.reset(token)
        remove(spark, path)


def _on_store(spark: SparkSession, path: str):
    """The file system of a path, as Spark has it, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    store, p = _on_store(spark, path)
    store.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _on_store(spark, path)
    return store.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    store, p = _on_store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(p)] if store.exists(p) else []


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, there as a whole or not at all."""
    store, p = _on_store(spark, path)
    _, new = _on_store(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    store.rename(new, p)


def read_file(spark: SparkSession, path: str) -> str:
    store, p = _on_store(spark, path)
    with_lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(store.open(p), "UTF-8"))
    lines = []
    while (line := with_lines.readLine()) is not None:
        lines.append(line)
    with_lines.close()
    return "\n".join(lines)


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the current work_folder, or else below spark.checkpoint.dir; where that is unset (tests), below a local one that is set as the checkpoint folder."""
    root = _work.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="pactum-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/pactum-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator reads, so others can't clash: doc_id long, text string (null: empty), and `more`."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_order(ids: DataFrame, folder: str) -> DataFrame:
    """id, number: numbers in the order of the ids, for any ids; they begin at 0 and stay below 2**62."""
    ids = ids.select("id").filter("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return written(ids.withColumn("number", F.monotonically_increasing_id()), folder, "in-order")


def placed(docs: DataFrame, folder: str) -> DataFrame:
    """Adds rank to doc_id and text: a long in the order of doc_id, null last of all as NO_ID. No real one is NO_ID or LEAST.

    That is the id itself, unless an id is one of the two; then ids are numbered in their order.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low != LEAST and high != NO_ID:
        return docs.withColumn("rank", F.coalesce("doc_id", F.lit(NO_ID)))
    order = in_order(docs.select(F.col("doc_id").alias("id")), folder)
    return docs.join(order, F.col("doc_id") == F.col("id"), "left").withColumn("rank", F.coalesce("number", F.lit(NO_ID))).drop("id", "number")


def ranked(docs: DataFrame, folder: str, id_col: str = "doc_id", name: str = "rank") -> tuple[DataFrame, DataFrame | None]:
    """Adds `name`: the id, or for a null id a number of its own from NULL_RANKS on.

    Where there are null ids and ids that large, ids are numbered in their order instead; the second result is then the table of id
    and number. Rows with a null id are written first, so that every later use sees the same numbers.
    """
    key = docs[id_col].cast("long")
    nulls = docs.filter(key.isNull())
    if nulls.isEmpty():
        return docs.withColumn(name, key), None
    rest, order = docs.filter(key.isNotNull()), None
    if (rest.agg(F.max(key)).first()[0] or 0) < NULL_RANKS:
        rest = rest.withColumn(name, key)
    else:
        order = in_order(rest.select(key.alias("id")), folder)
        columns = [rest[f"`{c}`"] for c in docs.columns]
        rest = rest.join(order, key == order["id"]).select(*columns, order["number"].alias(name))
    return rest.unionByName(written(nulls.withColumn(name, F.lit(NULL_RANKS) + F.monotonically_increasing_id()), folder, "null-ids")), order


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and offsets (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def map_text(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Maps (doc_id, text) to rows. fn(ids: pa.Array, data: uint8, offsets: int64) -> pa.RecordBatch, called on slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flat(batch.column(1))
            for a, b in slices(offs):
                o = offs[a : b + 1]
                yield fn(batch.column(0).slice(a, b - a), data[o[0] : o[-1]], o - o[0])

    session(df)
    return df.mapInArrow(run, schema)


def hex_sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# --- words as 64-bit hashes -------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64, B odd."""
    size = max(SLICE_BYTES + 1, 1 << (n - 1).bit_length() if n > SLICE_BYTES else 0)
    if size not in _powers:
        if len(_powers) > 2:
            _powers.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Fixed: the white space that separates words in the contracts, \x20 and \x09-\x0D.
SPACE = byte_set(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes outside `gap`; words never cross rows."""
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(stop) + 1, np.searchsorted(offsets, a, "right") - 1


def hash_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[a:b].

    Polynomials modulo 2**64 have known collisions among strings of 1,024 bytes and more, so long spans are hashed by a digest.
    """
    if not len(a):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values[data] * up[: len(data)], out=c[1:])
        out = mix((c[b] - c[a]) * down[a] + (b - a).astype(np.uint64))
    for i in np.flatnonzero(b - a > PLAIN_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(h: np.ndarray, n: int, step: int = _WORD_STEP) -> np.ndarray:
    """Hashes of all windows of n neighbours; as many as there are full windows."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, have = np.zeros(m, np.uint64), 0, h, 1
        rest = n
        while rest:
            if rest & 1:
                out += power[done : done + m] * np.uint64(pow(step, done, 1 << 64))
                done += have
            rest >>= 1
            if rest:
                power = power[: len(power) - have] + power[have:] * np.uint64(pow(step, have, 1 << 64))
                have *= 2
        return mix(out)
