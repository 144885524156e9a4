"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

No training: every vocabulary entry becomes a piece, its bytes mapped one to one to characters, scored by its negative
rank. The normaliser is the identity, so sentencepiece's greedy best-score merging is lowest-rank merging. Text is cut into
pre-tokens first, and each is encoded on its own; ids map back to bytes by the inverse table.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, hex_sha256, id_text, session

#: Entries of the cache of pre-token ids in each worker; it starts afresh when full.
CACHE = 400_000
#: Longer pre-tokens are not cached.
CACHED_CHARS = 64
#: Characters from which a text is split in groups.
LONG = 1 << 20


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, otherwise the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto. Piece k + 1 is the entry of k-th lowest rank; piece 0 is the unknown piece."""
    chars = byte_chars()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, "".join(map(chars.__getitem__, token)).encode()) + _field(2, float(-rank)) + _field(3, 1)))
    # trainer: BPE (3 = 2), vocabulary size (4), ids of bos, eos, pad off (41-43); -1 is a ten-byte varint
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    # normaliser: identity; no dummy prefix (3), blanks kept (4) and not escaped (5)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def pretokens(pattern, text: str) -> Iterator[list[str]]:
    """The pattern's matches: at once, or in groups where the text is long."""
    if len(text) <= LONG:
        yield pattern.findall(text)
        return
    for group in batched((m.group() for m in pattern.finditer(text)), LONG // 8):
        yield list(group)


class Codec:
    """encode(text) -> ids, decode(ids) -> bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self._ranks = ranks
        self._pattern = regex.compile(pattern)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self._id_of_piece = [-1, *sorted(ranks.values())]
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._map = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self._cache: dict[str, tuple[int, ...]] = {}

    def encode_pretoken(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if (whole := self._ranks.get(raw)) is not None:
            return (whole,)
        ids = self._model.encode(raw.decode("latin-1").translate(self._map), out_type=int)
        return tuple(map(self._id_of_piece.__getitem__, ids))

    def _ids(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        cache = self._cache
        for w in set(words).difference(cache):
            if len(w) <= CACHED_CHARS:
                cache[w] = self.encode_pretoken(w)
        return (cache[w] if w in cache else self.encode_pretoken(w) for w in words) if any(len(w) > CACHED_CHARS for w in words) else map(cache.__getitem__, words)

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers. A very long text is split in groups of pre-tokens, so it needs little beside its ids."""
        out = array("I")
        for words in pretokens(self._pattern, text):
            if len(self._cache) > CACHE:
                self._cache = {}
            out.extend(chain.from_iterable(self._ids(words)))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec in each worker for each vocabulary."""
    key = ranks_path, pattern
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(ranks_path), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary): one row for each row of docs.

    A null text is empty: no tokens. Null and repeated doc_ids keep their rows. Other columns are not read. Nothing is
    shuffled; the vocabulary file has to be at ranks_path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(1).to_pylist()
                ids = [c.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([np.frombuffer(x, np.uint32).astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([c.decode(x) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "decoded"],
                )

    session(docs)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
