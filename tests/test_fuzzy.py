"""The best titles of many keywords against every pair compared."""

import random

import pandas as pd
import pytest

from pactum.functions.scalar import ratio
from pactum.operators import fuzzy
from pactum.operators.fuzzy import Best, best_titles


def brute(titles, words, k, least=0):
    out = {}
    for w in set(words) - {None}:
        rows = sorted({(-ratio(t.lower(), w.lower()), i, t) for i, t in titles if i is not None and t is not None})
        out[w] = [r for r in rows if -r[0] >= least][:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("keyword", "rank").collect():
        assert r.rank == len(out.setdefault(r.keyword, [])) + 1
        out[r.keyword].append((-r.score, r.id, r.title))
    return out


def some(n, seed=1, letters="abcde É€", longest=24):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("least", [0, 60])
def test_equals_every_pair(spark, least):
    words = [*some(60, 2, longest=12), "", "A", "a", "É" * 70, "ab" * 60]
    titles = [(f"u{i % 190}", t) for i, t in enumerate(some(400))] + [("z", ""), ("z", "É" * 64), ("y", "ab" * 3000)]
    found = best_titles(spark.createDataFrame(titles, "id string, title string").repartition(7), spark.createDataFrame([(w,) for w in words], "keyword string"), 6, least)
    assert got(found) == {w: r for w, r in brute(titles, words, 6, least).items() if r}


def test_nulls_repeats_numbers(spark):
    titles = [(1, "mit"), (1, "mit"), (None, "mit"), (2, None), (2, "MIT"), (3, "mot")] * 3
    found = best_titles(spark.createDataFrame(titles, "id long, title string").repartition(5), spark.createDataFrame([("mit",), ("mit",), (None,)], "keyword string"), 2)
    assert got(found) == {"mit": [(-100, 1, "mit"), (-100, 2, "MIT")]}


def test_nothing(spark):
    titles, words = spark.createDataFrame([], "id string, title string"), spark.createDataFrame([], "keyword string")
    assert best_titles(titles, words).count() == 0
    assert best_titles(titles, spark.createDataFrame([("a",)], "keyword string")).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 9)
    words, titles = some(40, 3, longest=9), [(f"u{i}", t) for i, t in enumerate(some(120, 4))]
    found = best_titles(spark.createDataFrame(titles, "id string, title string"), spark.createDataFrame([(w,) for w in words], "keyword string"), 3)
    assert got(found) == brute(titles, words, 3)


def test_bounds_leave_few_pairs():
    """Names of licences and keywords that look like some of them: most pairs are ruled out unseen."""
    titles = [f"{a} {b} licence {n}.0" for a in ("open", "creative", "public", "general", "academic", "artistic") for b in ("data", "software", "commons", "domain") for n in range(1, 60)]
    words = [f"{a} {b} licence 3.0" for a in ("open", "creative", "public") for b in ("data", "commons")]
    best = Best(words, 5, 0)
    for at in range(0, len(titles), 10):
        best.add(list(range(at, min(at + 10, len(titles)))), titles[at : at + 10])
    expected = brute(list(enumerate(titles)), words, 5)
    assert {w: k for w, k in zip(best.words, best.kept, strict=True)} == expected
    assert best.compared < 0.05 * len(titles) * len(words)


def test_slices(monkeypatch):
    monkeypatch.setattr(fuzzy, "CELLS", 50)
    words, titles = some(20, 5, longest=9), list(enumerate(some(80, 6)))
    best = Best(sorted(set(words)), 4, 0)
    frame = pd.DataFrame(titles, columns=["id", "title"])
    best.add(frame["id"].tolist(), frame["title"].tolist())
    assert dict(zip(best.words, best.kept, strict=True)) == brute(titles, words, 4)


def test_one_file_is_many_tasks(spark, monkeypatch):
    """Titles in one partition are compared by all cores."""
    seen, block = [], fuzzy._block
    monkeypatch.setattr(fuzzy, "_block", lambda titles, *a: seen.append(titles.rdd.getNumPartitions()) or block(titles, *a))
    words, titles = some(10, 7, longest=9), [(f"u{i}", t) for i, t in enumerate(some(60, 8))]
    found = best_titles(spark.createDataFrame(titles, "id string, title string").coalesce(1), spark.createDataFrame([(w,) for w in words], "keyword string"), 3)
    assert got(found) == brute(titles, words, 3) and seen == [fuzzy.TASKS_PER_CORE * spark.sparkContext.defaultParallelism]
