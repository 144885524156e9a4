"""The inverted index against scans of the texts."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pactum.functions.scalar import prefix_match
from pactum.plans.stage import store_of
from pactum.sources.manifest import Conflict, Manifest
from pactum.sources.text_index import TextIndex

DOCS = "doc_id long, text string, term string, places int"  # with names that the index uses inside


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Ver", "version", "inver", "ÉVER", "_ver", "a", "the", "of", "night", "x1", "漢字"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 30))), "t", 1) for i in range(n)]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def phrase_counts(rows, phrase):
    p = words(phrase)
    n = {i: sum(words(t)[k : k + len(p)] == p for k in range(len(words(t)))) for i, t, *_ in rows if t}
    return {i: k for i, k in n.items() if k}


def test_search(spark, tmp_path):
    rows = texts(1, 300)
    index = TextIndex(spark, f"{tmp_path}/ix", fanout=2, file_bytes=2000)
    df = spark.createDataFrame([*rows, (None, "ver", "t", 1), (1000, None, "t", 1)], DOCS)
    for k in range(3):
        index.add(df.filter(f"doc_id % 3 = {k} OR doc_id IS NULL"))
    assert [s["level"] for s in index.state["segments"]] == [1, 0]
    for p in ("ver", "V", "_", "漢", "zzz", "é"):
        assert ids(index.prefix(p)) == ids(df.filter("doc_id < 1000").filter(prefix_match(F.col("text"), p)).select("doc_id")), p
    for p in ("the of", "Version", "a a", "of the night", "漢字 ver", "no such"):
        assert {r.doc_id: r.n for r in index.phrase(p).collect()} == phrase_counts(rows, p), p
    assert ids(index.every(["the", "NIGHT"])) == [i for i, t, *_ in rows if {"the", "night"} <= set(words(t))]
    assert {r.term for r in index.frequencies("ver").collect()} == {"ver", "version"}
    assert index.phrase("...").count() == 0 and ids(index.phrase("of th", prefix=True)) == ids(index.phrase("of the"))
    again = TextIndex(spark, f"{tmp_path}/ix")
    assert ids(again.prefix("ver")) == ids(index.prefix("ver"))


def test_documents_that_change(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/ix", fanout=3)
    one = lambda *rows: index.add(spark.createDataFrame([(*r, "t", 1) for r in rows], DOCS))
    one((1, "old words"), (2, "old thing"))
    before = TextIndex(spark, f"{tmp_path}/ix")
    one((1, "new words"))
    assert ids(index.prefix("old")) == [2] and ids(index.prefix("words")) == [1]
    assert ids(before.prefix("old")) == [1, 2]  # a reader keeps its version
    one((2, ""), (3, "old one"))  # merges
    assert len(index.state["segments"]) == 1 and ids(index.prefix("old")) == [3] and ids(index.prefix("")) == [1, 3]
    one((4, "two"), (4, "texts"))
    assert ids(index.every(["two", "texts"])) == [4]
    index.vacuum()
    assert ids(index.prefix("old")) == [3] and len([x for x in os.listdir(f"{tmp_path}/ix") if x.startswith("segment")]) == 2


def test_what_is_read(spark, tmp_path):
    """A prefix opens less than a tenth of what a scan reads, and a refresh opens new files only."""
    rng = random.Random(3)
    made = ["".join(rng.choices("abcdefghijklmnopqrstuvw", k=6)) for _ in range(4000)]
    for k in range(3):
        rows = [(1000 * k + i, " ".join(rng.choices(made, k=60)), "t", 1) for i in range(400)]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/docs/{k}")
    paths = [f"{tmp_path}/docs/{k}" for k in range(3)]
    index = TextIndex(spark, f"{tmp_path}/ix", file_bytes=4000)
    assert index.refresh(paths[:2]) == paths[:2]
    first = index.state["segments"]
    for name in os.listdir(paths[0]):  # what has been read isn't needed any more
        os.remove(f"{paths[0]}/{name}")
    assert index.refresh(paths) == paths[2:] and index.state["segments"][: len(first)] == first and index.refresh(paths) == []
    opened = [f for _, names in index.files("hell", "hell\U0010ffff") for f in names]
    size = lambda names: sum(store_of(spark, f)[0].getFileStatus(store_of(spark, f)[1]).getLen() for f in names)
    scan = size([f"{p}/{f}" for p in paths[1:] for f in os.listdir(p) if f.endswith(".parquet")]) * 3 / 2
    assert 0 < size(opened) < scan / 10
    assert index.prefix("hell").count() == sum(any(w.startswith("hell") for w in t.split()) for t in [r.text for r in spark.read.schema(DOCS).parquet(*paths[1:]).collect()]) + ids_below(index, "hell", 400)


def ids_below(index, prefix, n):
    return index.prefix(prefix).filter(f"doc_id < {n}").count()


def test_two_writers(spark, tmp_path):
    a, b = TextIndex(spark, f"{tmp_path}/ix"), TextIndex(spark, f"{tmp_path}/ix")
    a.add(spark.createDataFrame([(1, "one", "t", 1)], DOCS))
    with pytest.raises(Conflict):
        b.add(spark.createDataFrame([(2, "two", "t", 1)], DOCS))
    assert TextIndex(spark, f"{tmp_path}/ix").prefix("").count() == 1 and Manifest(spark, f"{tmp_path}/ix").latest() == 1


def test_a_writer_that_died(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    m.commit(0, {"a": 1})
    open(tmp_path / "manifest" / ".2.taken", "w").close()
    with pytest.raises(Conflict):
        m.commit(1, {"a": 2})
    m.stale = -5
    assert m.commit(1, {"a": 2}) == 2 and m.read(2) == {"a": 2} and m.latest() == 2


def test_nothing(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/ix")
    assert index.prefix("a").count() == 0 and index.phrase("a b").count() == 0
    index.add(spark.createDataFrame([], DOCS))
    assert index.version == 1 and index.state["segments"] == []


def test_words_are_gathered_where_they_are_read(spark, tmp_path, monkeypatch):
    """What is ranged and moved is a row for each term of a text; texts over several batches, empty ones and repeated ids come out whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        moved, segment = [], TextIndex._segment
        monkeypatch.setattr(TextIndex, "_segment", lambda self, postings, *a: moved.append(postings.count()) or segment(self, postings, *a))
        index = TextIndex(spark, f"{tmp_path}/ix")
        texts = [(1, "a b a c a b a d e a"), (2, ""), (3, "b"), (4, "a a a"), (5, None), (6, "b a")]
        index.add(spark.createDataFrame([(i, t, "t", 1) for i, t in texts], DOCS).coalesce(1))
        assert moved == [9]
        index.add(spark.createDataFrame([(7, "x y x", "t", 1), (8, "y", "t", 1), (7, "x", "t", 1)], DOCS).coalesce(1))
        got = {(r.term, r.doc_id): list(r.places) for r in index.postings("", True).collect()}
        assert got == {("a", 1): [0, 2, 4, 6, 9], ("b", 1): [1, 5], ("c", 1): [3], ("d", 1): [7], ("e", 1): [8], ("b", 3): [0], ("a", 4): [0, 1, 2], ("b", 6): [0], ("a", 6): [1], ("x", 7): [0, 0, 2], ("y", 7): [1], ("y", 8): [0]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
