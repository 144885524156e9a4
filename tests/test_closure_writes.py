"""What a closure writes while it grows."""

import random

import pytest

from pactum.plans import closure
from pactum.plans.closure import EDGES, Closure


def rows(df):
    got = sorted((r.a, r.b) for r in df.collect())
    assert len(got) == len(set(got))
    return got


def closed(edges, least=1):
    """Pairs with a walk of `least` edges or more."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        front, seen = set(after[a]), set()
        if least == 2:
            front = {c for b in front for c in after.get(b, ())}
        while front:
            seen |= front
            front = {c for b in front for c in after.get(b, ())} - seen
        out |= {(a, b) for b in seen}
    return sorted(out)


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "r") for a, b in edges], EDGES)


def test_a_pair_is_written_once(spark, monkeypatch):
    written, staged = [], closure.staged
    monkeypatch.setattr(closure, "staged", lambda df, path=None: written.append((path, staged(df, path))) or written[-1][1])
    monkeypatch.setattr(closure, "dropped", lambda *a: None)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    assert rows(closure._paths_by_joins(frame(spark, chain))) == closed(chain, 2)
    assert sum(df.count() for _, df in written) < 1.5 * len(closed(chain))


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_and_changes_of_any_graph(spark, monkeypatch, seed):
    monkeypatch.setattr(closure, "REWRITE", 2)
    r = random.Random(seed)
    some = lambda n: list({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(n)})
    edges = some(14) + [("x", "x"), ("p", "q"), ("q", "p")]
    assert rows(closure._paths_by_joins(frame(spark, edges))) == closed(edges, 2)
    c, held = Closure(frame(spark, edges)), set(edges)
    new, gone = some(3), r.sample(sorted(held), 3)
    c.insert(frame(spark, new))
    c.delete(frame(spark, gone))
    held = (held | set(new)) - set(gone)
    assert rows(c.pairs) == closed(held) and rows(c.edges) == sorted(held)
