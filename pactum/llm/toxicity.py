"""Toxicity by noisy-channel deobfuscation.

Tokens that look disguised (symbols for letters, stretched letters, letters set apart) become lattices: each observed
character may stand for itself, for the letters it imitates, or for nothing. A Viterbi search under a character trigram
model, counted over the whole corpus, restores the likeliest words. A lexicon of words and word beginnings, learned from
labelled documents, then scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, byte_set, find_words, flat, hash_spans, id_text, lower_ascii, session, shared_folder, slices, window_hashes, written

#: Labelled documents that the lexicon is learned from, at most.
TRAIN_DOCS = 12_000
#: Log10 of the chance, were a feature independent of the label, below which it enters the lexicon.
SIGNIFICANCE = -5.0
#: Beginnings of words, in bytes, that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Readings of a disguised token that are scored.
READINGS = 3
#: Characters used in place of letters.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiou"}
#: Letters of other alphabets that look like Latin ones, and characters that aren't seen.
LOOKALIKES = {"а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u"}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Log-probabilities of the channel.
SAME, IMITATED, REPEATED, DROPPED = 0.0, -1.5, -0.5, -0.7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_gap = ~_LETTER
_symbols = "".join(IMITATES)
_SPECIAL = byte_set("".join(c for c in _symbols if c.isascii()).encode())
_wide = [c.encode() for c in [*_symbols, *LOOKALIKES, *UNSEEN] if not c.isascii()]
_APART = byte_set(b".-_")
_edges = ".,;:?\"'#%&<>)[]{}"  # what imitates a letter is left to the lattice, which may drop it
_run = re.compile(r"(.)\1{3,}", re.DOTALL)
#: A run of one symbol around four letters or more is emphasis: as letters, it would be a stretched one at the word's edge.
_emphasis = re.compile(r"^([$!*|(+@])\1+(?=[^\W\d_]{4})|(?<=[^\W\d_]{4})[,.;:]*(?:!!+|\*\*\*+|\$\$\$+|\+\++|\|\|+|\(\(+)$")
_stretched = re.compile(r"([^\W\d_])\1\1")
_stands_in = rf"[{re.escape(_symbols + UNSEEN)}]"
_mixed = re.compile(rf"[^\W\d_].*{_stands_in}|{_stands_in}.*[^\W\d_]")
_two_scripts = re.compile(rf"[a-z].*[{''.join(LOOKALIKES)}]|[{''.join(LOOKALIKES)}].*[a-z]")
_dotted = re.compile(r"(?:[^\W_]|[@$!|+(])(?:[.\-_](?:[^\W_]|[@$!|+(])){3,}")


# --- character model --------------------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram (three bytes of lower-cased words, with blanks for their edges, as one number) and n, over all documents.

    There are at most 153**3 of them, whatever the corpus; each task sends a gram once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 24, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flat(batch.column(1))
            for a, b in slices(offs):
                low = lower_ascii(data[offs[a] : offs[b]])
                x = np.concatenate([[32], np.where(_LETTER[low], low, 32), [32]]).astype(np.int64)
                g = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
                values, n = np.unique(g[x[1:-1] != 32], return_counts=True)
                total[values] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return docs.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log-probabilities of the next byte after two, smoothed with shorter contexts. grams: sorted; n: their counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self._grams, self._n = grams, n
        two = np.bincount(grams & 0xFFFF, weights=n, minlength=1 << 16)
        self._two, self._two_context = two, np.bincount(grams >> 8, weights=n, minlength=1 << 16)
        self._one, self._one_context = two.reshape(256, 256).sum(0), two.reshape(256, 256).sum(1)
        self._all = float(n.sum())
        self._cache: dict[int, float] = {}

    def log(self, a: int, b: int, c: int) -> float:
        key = a << 16 | b << 8 | c
        if (x := self._cache.get(key)) is None:
            at = int(np.searchsorted(self._grams, key))
            three = float(self._n[at]) if at < len(self._grams) and self._grams[at] == key else 0.0
            p1 = (self._one[c] + 0.5) / (self._all + 128)
            p2 = (self._two[b << 8 | c] + 5 * p1) / (self._one_context[b] + 5)
            x = self._cache[key] = math.log((three + 5 * p2) / (self._two_context[a << 8 | b] + 5))
        return x


def readings(token: str, model: CharModel, n: int = READINGS) -> list[str]:
    """The likeliest words behind a disguised token, best first, by a Viterbi search over its lattice.

    A state is the last two bytes restored; each keeps its best `n` paths, so time and memory grow with the token's length. A
    blank stays or is dropped, and what stays ends a word. A path is its score, a hash of what it restored, and its last byte with
    the path before.
    """
    token = token.lower()
    solid = [i for i, x in enumerate(token) if x.isalnum()] or [len(token)]
    paths: dict[tuple[int, int], list[tuple]] = {(32, 32): [(0.0, 0, None)]}
    for i, x in enumerate(token):
        options: list[tuple[bytes, float]] = []
        if x.isalpha():
            options.append((x.encode(), SAME))
            if i and token[i - 1] == x:
                options.append((b"", REPEATED))
        for c in IMITATES.get(x) or LOOKALIKES.get(x, ""):
            options.append((c.encode(), IMITATED))
            if i and token[i - 1] == x:
                options.append((b"", REPEATED + IMITATED))
        if not x.isalpha():
            options.append((b"", DROPPED if x in " .-_'" or x in UNSEEN or not solid[0] <= i <= solid[-1] else 3 * DROPPED))
        if x == " ":
            options.append((b" ", DROPPED))
        after: dict[tuple[int, int], dict[int, tuple]] = {}
        for (a, b), best in paths.items():
            for c, channel in options:
                p, q, gain = a, b, channel
                if c == b" ":
                    if b == 32:  # no word to end
                        continue
                    gain += model.log(a, b, 32)
                    p = q = 32
                else:
                    for byte in c:
                        gain += model.log(p, q, byte)
                        p, q = q, byte
                into = after.setdefault((p, q), {})
                for s, key, node in best:
                    for byte in c:
                        key, node = (key * 1_000_003 + byte + 1) & 0xFFFFFFFFFFFFFFF, (byte, node)
                    if key not in into or s + gain > into[key][0]:
                        into[key] = (s + gain, key, node)
        paths = {k: sorted(v.values(), key=lambda x: x[:2], reverse=True)[:n] for k, v in after.items()}
    # a blank at the end has ended its word already
    ends = [(s + (model.log(a, b, 32) if b != 32 else 0.0), key, node) for (a, b), best in paths.items() for s, key, node in best if node]
    out: list[str] = []
    for _, _, node in sorted(ends, key=lambda x: x[:2], reverse=True):
        word = bytearray()
        while node:
            word.append(node[0])
            node = node[1]
        if (text := word[::-1].decode(errors="ignore").strip()) and text not in out:
            out.append(text)
    return out[:n]


def _within_rows(r: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Words i to j, cut where a row ends."""
    cut = [i, *(np.flatnonzero(np.diff(r[i:j])) + i + 1).tolist(), j]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _places(x: np.ndarray, c: bytes) -> np.ndarray:
    """Where the bytes of one character are."""
    at = np.flatnonzero(x[: len(x) - len(c) + 1] == c[0])
    for k in range(1, len(c)):
        at = at[x[at + k] == c[k]]
    return at


def disguised(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, str]]:
    """(row, token) of what may hide a word: tokens with imitating, stretched or separated characters, and three single characters or more in a row.

    Bytes are searched first, and only tokens found so are looked at one by one. Of a character stretched further, three stay:
    they can be read as one, two or three.
    """
    a, b, r = find_words(data, offs)
    if not len(a):
        return []
    x = data
    ascii_run = np.flatnonzero((x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & _LETTER[x[2:]] & (x[2:] < 128))
    pair_run = np.flatnonzero((x[:-5] == x[2:-3]) & (x[2:-3] == x[4:-1]) & (x[1:-4] == x[3:-2]) & (x[3:-2] == x[5:]) & (x[:-5] >= 0xC0))
    apart = np.flatnonzero(_APART[x[1:-1]] & ~SPACE[x[:-2]] & ~SPACE[x[2:]])
    wide = [_places(x, c) for c in _wide] if (x >= 0xC2).any() else []
    at = np.concatenate([np.flatnonzero(_SPECIAL[x]), ascii_run, pair_run, apart, *wide])
    raw, found = data.tobytes(), []
    for w in np.unique(np.searchsorted(a, at, "right") - 1).tolist():
        if w >= 0 and b[w] - a[w] >= 3:
            t = _emphasis.sub("", _run.sub(r"\1\1\1", raw[a[w] : b[w]].decode(errors="replace").strip(_edges)))
            if len(t) >= 3 and (_stretched.search(t) or _mixed.search(t) or _two_scripts.search(t) or _dotted.fullmatch(t)):
                found.append((int(r[w]), t))
    lead = x[a]
    single = b - a == np.where(lead < 128, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for k, e in _within_rows(r, i, j):
            if e - k >= 3:
                found.append((int(r[k]), " ".join(raw[a[w] : b[w]].decode(errors="replace") for w in range(k, e))))
    return found


# --- features and lexicon ---------------------------------------------------------------------------------------------


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of lower-cased texts, and the row of each."""
    a, b, r = find_words(data, offs, _gap)
    hashes, rows = [hash_spans(data, a, b) ^ np.uint64(1)], [r]
    for k in PREFIXES:
        long = b - a >= k
        hashes.append(hash_spans(data, a[long], a[long] + k))
        rows.append(r[long])
    return np.concatenate(hashes), np.concatenate(rows)


def restored(data: np.ndarray, offs: np.ndarray, model: CharModel, cache: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each followed by the readings of its disguised tokens, and their offsets."""
    low = lower_ascii(data)
    more: dict[int, list[bytes]] = {}
    for row, token in disguised(low, offs):
        if (x := cache.get(token)) is None:
            if len(cache) > 200_000:
                cache.clear()
            x = cache[token] = " ".join(readings(token, model)).encode()
        more.setdefault(row, []).append(x)
    if not more:
        return low, offs
    raw, texts, at = low.tobytes(), [], offs.tolist()
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        texts.append(b" ".join([raw[a:b], *more[i]]) if i in more else raw[a:b])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def learn(labelled: DataFrame, grams: tuple[np.ndarray, np.ndarray]) -> tuple[dict[int, float], float]:
    """Lexicon (feature hash -> weight), and log-odds of a document without any of it.

    Features that keep company with the label too often for chance are chosen first, then weighted by a regression.

    labelled: doc_id, text, label. Near copies count once: of the documents with the same least 5-word shingle and label, one is
    taken, so that what copies share by chance doesn't look like evidence.
    """
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = CharModel(*shared.value), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flat(batch.column(1))
            label = batch.column(2)
            for a, b in slices(offs):
                o = offs[a : b + 1]
                low, ends = restored(data[o[0] : o[-1]], o - o[0], model, cache)
                s, e, r = find_words(low, ends)
                h = hash_spans(low, s, e)
                first = np.searchsorted(r, np.arange(b - a + 1))
                group = [int(window_hashes(h[x:y], min(5, max(1, y - x))).min()) if y > x else 0 for x, y in zip(first[:-1], first[1:], strict=True)]
                f, row = features(low, ends)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(b - a + 1))
                own = [np.unique(f[order[x:y]]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(group, np.uint64).view(np.int64)), label.slice(a, b - a), pa.array(own, pa.binary())], names=["g", "label", "own"])

    docs = labelled.mapInArrow(run, "g long, label int, own binary").groupBy("g", "label").agg(F.min("own").alias("own"))
    docs = written(docs, shared_folder(spark), "learned-from")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = np.zeros(2, np.int64)
        for batch in batches:
            for own, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.stack([np.frombuffer(own, np.uint64), np.full(len(own) // 8, label, np.uint64)]))
                total[label] += 1
        if held:
            both = np.concatenate(held, axis=1)
            values, where = np.unique(both[0], return_inverse=True)
            bad = np.bincount(where, weights=both[1].astype(float), minlength=len(values)).astype(np.int64)
            n = np.bincount(where, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values, np.uint64(0)).view(np.int64)), pa.array(np.append(bad, total[1])), pa.array(np.append(n, total.sum()))], names=["f", "bad", "n"])

    counts = docs.mapInArrow(count, "f long, bad long, n long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = counts.filter("f = 0").first()
    if not total or not 0 < total.bad < total.n:
        return {}, math.log((total.bad + 0.5) / (total.n - total.bad + 0.5)) if total else 0.0
    bad_all, good_all = total.bad, total.n - total.bad
    rate = bad_all / total.n
    # chance of as many bad documents among n, at most exp(-n * relative entropy)
    share = F.col("bad") / F.col("n")
    entropy = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0)
    chosen = counts.filter((F.col("f") != 0) & (F.col("bad") >= 2) & (share > rate)).withColumn("log10", -F.col("n") * entropy / math.log(10)).filter(F.col("log10") <= SIGNIFICANCE)
    # a text's features are no more than its bytes, so those of `labelled` have the bound of its rows
    keys = np.sort(chosen.select("f").toArrow()["f"].to_numpy().view(np.uint64))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(keys, np.frombuffer(own, np.uint64))).astype("<i4").tobytes() for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "hits"])

    seen = docs.mapInArrow(hits, "label int, hits binary").collect()  # at most TRAIN_DOCS rows
    weights, intercept = logistic([np.frombuffer(r.hits, "<i4") for r in seen], np.array([r.label for r in seen], float), len(keys))
    return {int(k): float(w) for k, w in zip(keys, weights, strict=True) if w > 0}, intercept


def logistic(hits: list[np.ndarray], label: np.ndarray, size: int, penalty: float = 1e-5, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights, none negative, and intercept of a regression on which features a document has.

    Together, strong features leave nothing for those that only keep company with them. Both labels weigh the same in all, so
    that one strong feature is enough for the rarer.
    """
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.concatenate(hits) if hits else np.zeros(0, np.int32)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(hits))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        grad = np.append(np.bincount(col, weights=error[row], minlength=size) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, float(b)


def scores(data: np.ndarray, offs: np.ndarray, model: CharModel, cache: dict[str, bytes], keys: np.ndarray, weights: np.ndarray, prior: float) -> np.ndarray:
    """The regression over the features that each text has. keys: sorted hashes of the lexicon. No text's score depends on another's."""
    low, ends = restored(data, offs, model, cache)
    z = np.full(len(offs) - 1, prior)
    if len(keys):
        f, row = features(low, ends)
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(f & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, f[maybe]), len(keys) - 1)
        hit = keys[at] == f[maybe]
        pairs = np.unique(row[maybe[hit]] * len(keys) + at[hit])
        z += np.bincount(pairs // len(keys), weights=weights[pairs % len(keys)], minlength=len(z))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(docs: DataFrame, grams: tuple[np.ndarray, np.ndarray], lexicon: dict[int, float], prior: float) -> DataFrame:
    """doc_id and score of (doc_id, text) rows."""
    spark = docs.sparkSession
    keys = np.array(sorted(lexicon), np.uint64)
    weights = np.array([lexicon[int(k)] for k in keys])
    shared = spark.sparkContext.broadcast((grams, keys, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, keys, weights = shared.value
        model, cache = CharModel(*grams), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flat(batch.column(1))
            out = [scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], model, cache, keys, weights, prior) for a, b in slices(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = TRAIN_DOCS) -> DataFrame:
    """doc_id and score (0 to 1): one row for each row of docs.

    train_on: a condition on labels' doc_id column; of the labelled rows that meet it, `sample` at most are learned from.
    Null and empty texts are scored like any other; null labels, texts and ids aren't learned from. Without labelled rows of
    both kinds the score is the rate of label 1, or 0.5. Null and repeated doc_ids keep their rows. Other columns are not read.
    """
    session(docs)
    rows = id_text(docs, id_col, text_col)
    table = trigram_counts(rows).toArrow().sort_by("gram")  # at most 153**3 rows of two numbers
    grams = table["gram"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.float64)
    chosen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).filter(train_on(F.col("id")) & F.col("label").isin(0, 1))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    labelled = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).filter("text <> ''").select("doc_id", "text", "label")
    lexicon, prior = learn(labelled, grams)
    return score_texts(rows, grams, lexicon, prior)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    part = lambda c: F.crc32(c.cast("string")) % 3
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: part(c) != 1)
    return out.select("doc_id", (part(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
