"""Conflicts counted by masks of actions."""

import random

import pytest

from pactum.operators import audit
from pactum.operators.compat import conflicts


@pytest.mark.parametrize("actions, unrolled", [(5, 8), (150, 8), (150, 1)])
def test_masks_count_as_rows_do(spark, monkeypatch, actions, unrolled):
    monkeypatch.setattr(audit, "_UNROLLED", unrolled)
    r = random.Random(actions)
    name = lambda: f"a{r.randrange(actions)}"
    stmts = spark.createDataFrame([(f"l{r.randrange(12)}", r.choice(["permission", "prohibition", "duty"]), name()) for _ in range(400)], "id string, kind string, action string")
    # a chain gives long closures, both labels and several relations for a pair
    edges = [(f"a{i}", "odrl:includedIn", f"a{i + 1}") for i in range(0, actions - 1, 2)] + [(name(), rel, name()) for rel in ("odrl:implies", "owl:sameAs") for _ in range(6)]
    deps = spark.createDataFrame(edges, "a string, rel string, b string")
    used = [(k, f"l{r.randrange(14)}") for k in range(8) for _ in range(5)] + [(9, None), (9, "l1"), (9, "l1")]
    resolved = spark.createDataFrame(used, "repo long, license_id string")
    got = audit.repository_conflict_counts(resolved, stmts, deps)
    assert "array_contains" not in got._jdf.queryExecution().toString()  # lists of names aren't compared for each pair
    pairs = {(k, x) for k, x in used if x}
    want = {}
    for row in conflicts(stmts, deps).collect():
        for k in range(10):
            if (k, row.id1) in pairs and (k, row.id2) in pairs:
                n, acts = want.setdefault((k, row.id1, row.id2), [0, set()])
                want[k, row.id1, row.id2][0] += 1
                acts.add(row.a1)
    assert {(r.repo, r.id1, r.id2): (r.n_conflicts, r.n_actions) for r in got.collect()} == {k: (n, len(a)) for k, (n, a) in want.items()}


def test_no_statements(spark):
    none = spark.createDataFrame([], "id string, kind string, action string")
    got = audit.repository_conflict_counts(spark.createDataFrame([(1, "l")], "repo long, license_id string"), none, spark.createDataFrame([], "a string, rel string, b string"))
    assert got.count() == 0
