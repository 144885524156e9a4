"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by how it is written (no vocabulary, so no language is favoured)
and encoded; a gated attention, learned from document labels alone, weighs the passages; the weighted passage is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_set, find_words, hash_spans, id_text, map_text, mix, session, window_hashes

#: Labelled documents that the model is fitted on, at most. Texts are whole, in training too.
TRAIN_DOCS = 6_000
#: Words of a passage.
PASSAGE = 64
#: Sizes of the passage encoding and of the attention.
HIDDEN, GATE = 16, 8
ROUNDS, RATE, PENALTY, SEED = 400, 0.02, 1e-4, 20
#: Words of the windows whose repetition is a feature.
REPEAT = 6

_kinds = np.full(256, 5, np.int64)
_kinds[97:123], _kinds[65:91], _kinds[48:58], _kinds[128:] = 0, 1, 2, 3
_kinds[byte_set(b".,;:'\"()-?")] = 4
_SHOUT = byte_set(b"!")
_BAR = byte_set(b"|<>{}[]\\/=_~^`")
FEATURES = 16


def describe(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the row of each. A text without words is one passage of zeros, marked as empty."""
    n = len(offs) - 1
    a, b, r = find_words(data, offs)
    words = np.bincount(r, minlength=n)
    per = np.maximum(-(-words // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(per)])
    first = np.concatenate([[0], np.cumsum(words)])
    rows = np.repeat(np.arange(n), per)
    out = np.zeros((base[-1], FEATURES))
    out[base[:-1][words == 0], FEATURES - 1] = 1
    if not len(a):
        return out, rows
    at = base[r] + (np.arange(len(a)) - first[r]) // PASSAGE  # passage of each word
    size = np.bincount(at, minlength=base[-1])
    some = np.maximum(size, 1)
    share = lambda x: np.bincount(at, weights=x, minlength=base[-1]) / some
    length = b - a
    inside = np.zeros(len(data) + 1, np.int64)
    inside[a] += 1
    inside[b] -= 1
    solid = np.cumsum(inside[:-1]) > 0
    owner = np.repeat(at, length)
    kinds = np.bincount(owner * 6 + _kinds[data[solid]], minlength=base[-1] * 6).reshape(-1, 6)
    total = np.maximum(kinds.sum(1), 1)
    out[:, :6] = kinds / total[:, None]
    out[:, 6] = np.bincount(owner, weights=_SHOUT[data[solid]], minlength=base[-1]) / total
    out[:, 7] = np.bincount(owner, weights=_BAR[data[solid]], minlength=base[-1]) / total
    mean = share(length)
    out[:, 8] = np.log1p(mean)
    out[:, 9] = np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0)) / np.maximum(mean, 1)
    out[:, 10] = share(_kinds[data[b - 1]] == 5)
    h = hash_spans(data, a, b)
    same = np.zeros(len(a), bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out[:, 11] = share(same)
    pairs = mix(h + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.unique(pairs, return_index=True)[1]
    out[:, 12] = np.bincount(at[distinct], minlength=base[-1]) / some
    w = window_hashes(h, REPEAT)
    if len(w):
        whole = np.flatnonzero(r[: len(w)] == r[REPEAT - 1 :])
        key = mix(w[whole] + r[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        key, whole = key[order], whole[order]
        twice = np.zeros(len(key), bool)
        twice[1:] |= key[1:] == key[:-1]
        twice[:-1] |= key[1:] == key[:-1]
        cover = np.zeros(len(a) + 1, np.int64)
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + REPEAT, -1)
        out[:, 13] = share(np.cumsum(cover[:-1]) > 0)
    out[:, 14] = np.log1p(size) / np.log1p(PASSAGE)
    return out, rows


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """starts: the first passage of each document; every document has a passage."""
        p = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        n = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        bag = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "bag": bag, "n": n, "score": 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, f: dict[str, np.ndarray], starts: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        spread = lambda x: np.repeat(x, f["n"], axis=0)
        bag = error[:, None] * p["c"]
        da = (spread(bag) * f["h"]).sum(1)
        de = f["a"] * (da - spread(np.add.reduceat(f["a"] * da, starts)))
        dh = f["a"][:, None] * spread(bag)
        gate = de[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh += dv @ p["V"].T + du @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dz, "b": dz.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["bag"].T @ error, "d": np.array(error.sum())}


def fit(x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> Model:
    """Adam over all passages at once; both labels weigh the same in all, so that the rarer isn't ignored."""
    rng = np.random.default_rng(SEED)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
    model = Model(x.mean(0), x.std(0) + 1e-3, {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()})
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    m = {k: np.zeros(s) for k, s in shapes.items()}
    v = {k: np.zeros(s) for k, s in shapes.items()}
    for t in range(1, ROUNDS + 1):
        f = model.forward(x, starts)
        for k, g in model.gradient(f, starts, (f["score"] - label) * share).items():
            g = g + PENALTY * model.weights[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            model.weights[k] = model.weights[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return model


def quality(docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = TRAIN_DOCS) -> DataFrame:
    """doc_id and score (0 to 1): one row for each row of docs.

    train_on: a condition on labels' doc_id column; of the labelled rows that meet it, `sample` at most are fitted on. A null
    or empty text is one empty passage. Null labels and ids aren't fitted on. Without rows of both labels the score is the
    rate of label 1, or 0.5. Null and repeated doc_ids keep their rows. Other columns are not read.
    """
    session(docs)
    rows = id_text(docs, id_col, text_col)
    chosen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).filter(train_on(F.col("id")) & F.col("label").isin(0, 1))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    labelled = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("label", "text")

    def passages(label: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        x, row = describe(data, offs)
        cut = np.searchsorted(row, np.arange(len(offs)))
        return pa.RecordBatch.from_arrays([label, pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["label", "x"])

    seen = sorted((r.label, bytes(r.x)) for r in map_text(labelled, passages, "label int, x binary").collect())  # bounded by `sample`
    label = np.array([y for y, _ in seen], float)
    model, rate = None, float(label.mean()) if len(label) else 0.5
    if len(label) and 0 < rate < 1:
        bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for _, x in seen]
        model = fit(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]), label)

    def score(ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        if model is None:
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), rate))], names=["doc_id", "score"])
        x, row = describe(data, offs)
        return pa.RecordBatch.from_arrays([ids, pa.array(model.forward(x, np.searchsorted(row, np.arange(len(ids))))["score"])], names=["doc_id", "score"])

    return map_text(rows, score, "doc_id long, score double")


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    part = lambda c: F.crc32(c.cast("string")) % 4
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: part(c) != 2)
    return out.select("doc_id", (part(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
