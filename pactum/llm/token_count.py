"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the token counts of the most frequent pre-tokens, broadcast to every worker. Frequencies come
from a bounded sample of whole rows, drawn from all rows alike; they decide how fast a pre-token is looked up, never what is
counted. Tier two is a bounded cache in each worker, filled by encoding the pre-tokens that miss. Special strings in a text
are single tokens, as the library has it by default.
"""

from __future__ import annotations

import json
from collections import Counter as Tally
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_chars, pretokens
from .common import id_text, session

#: Rows that frequencies are counted in, about, and the pre-tokens of a row that take part, its most frequent ones.
SAMPLE_DOCS, SAMPLE_WORDS = 4_000, 256
#: Entries of the frequent tier.
FREQUENT = 50_000
#: Entries of a worker's cache of misses; it starts afresh when full.
CACHE = 600_000
CACHED_CHARS = 64
#: Fixed value: the pre-token pattern of the tokenizer file's ByteLevel pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_specials(path: str) -> list[str]:
    """Added tokens that are split from the text first. Options that strip or widen them aren't supported, and are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or spec["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} has unsupported options")
    return [t["content"] for t in spec["added_tokens"]]


class Lengths(dict):
    """Token counts of pre-tokens: the frequent ones given, and what was asked for since and is short enough to keep."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        # a pre-token goes straight to the library's model, as its byte characters: nothing splits it again, and no thread starts
        self._model = Tokenizer.from_file(path).model
        self._map = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})

    def __missing__(self, word: str) -> int:
        n = len(self._model.tokenize(word.encode().decode("latin-1").translate(self._map)))
        if len(word) <= CACHED_CHARS:
            self[word] = n
        return n


class Counter:
    def __init__(self, path: str, frequent: dict[str, int]):
        import regex

        self._pattern = regex.compile(BYTE_LEVEL_PATTERN)
        specials = read_specials(path)
        self._specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._frequent, self._known = frequent, Lengths(path, frequent)

    def pretokens(self, text: str) -> tuple[int, Iterator[list[str]]]:
        """How many special strings the text holds, and the pre-tokens of the rest, in groups."""
        n, parts = 0, [text]
        if self._specials and (hits := self._specials.findall(text)):
            n, parts = len(hits), self._specials.split(text)
        return n, chain.from_iterable(pretokens(self._pattern, part) for part in parts)

    def count(self, text: str) -> int:
        n, groups = self.pretokens(text)
        for words in groups:
            if len(self._known) > len(self._frequent) + CACHE:
                self._known.clear()
                self._known.update(self._frequent)
            n += sum(map(self._known.__getitem__, words))
        return n

    def lengths(self, words: list[str]) -> list[int]:
        return [self._known[w] for w in words]


_counters: dict[str, Counter] = {}


def _counter(key: str, path: str, table: tuple[bytes, bytes, bytes]) -> Counter:
    """One counter in each worker, kept from task to task."""
    if key not in _counters:
        _counters.clear()
        blob, sizes, counts = table
        cut = np.cumsum([0, *np.frombuffer(sizes, np.uint16)]).tolist()
        words = [blob[a:b].decode() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        _counters[key] = Counter(path, dict(zip(words, np.frombuffer(counts, np.uint16).tolist(), strict=True)))
    return _counters[key]


def frequent_lengths(rows: DataFrame, path: str, sample: int = SAMPLE_DOCS) -> dict[str, int]:
    """Token counts of the FREQUENT most frequent pre-tokens of a sample of about `sample` rows of (doc_id, text).

    At most SAMPLE_WORDS pre-tokens of a row come to the driver. Pre-tokens too long to cache take no part.
    """
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, {})
        for batch in batches:
            words, counts = [], []
            for t in batch.column(1):
                tally = Tally(w for group in counter.pretokens(t.as_py())[1] for w in group if len(w) <= CACHED_CHARS)
                for w, k in tally.most_common(SAMPLE_WORDS):
                    words.append(w)
                    counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    some = rows if n <= sample else rows.sample(sample / n, seed=10)
    found, tally = some.mapInArrow(run, "word string, n long").toArrow(), Tally()
    for w, k in zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True):
        tally[w] += k
    words = [w for w, _ in tally.most_common(FREQUENT)]
    return dict(zip(words, Counter(path, {}).lengths(words), strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row for each row of docs.

    A null text is empty: no bytes, no tokens. Null and repeated doc_ids keep their rows. Other columns are not read. The
    tokenizer file has to be at tokenizer_path on every machine.
    """
    spark = session(docs)
    rows = id_text(docs, id_col, text_col)
    frequent = frequent_lengths(rows, tokenizer_path)
    raw = [w.encode() for w in frequent]  # of at most CACHED_CHARS characters, so 16 bits hold sizes and counts
    packed = b"".join(raw), np.array([len(w) for w in raw], np.uint16).tobytes(), np.array([*frequent.values()], np.uint16).tobytes()
    table, key = spark.sparkContext.broadcast(packed), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, tokenizer_path, table.value)
        for batch in batches:
            sizes, counts = [], []
            for t in batch.column(1):
                t = t.as_py()
                sizes.append(len(t.encode()))
                counts.append(counter.count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", out.n_tokens > 1024)
