"""Names of blank nodes."""

import pytest

from pactum.operators.compose import TRIPLE
from pactum.plans.blank import canonical


def graph(spark, rows):
    """Triples from (s, p, o); what begins with _: is a blank node, with a quote a literal, otherwise an IRI."""
    kind = lambda x: None if x is None else "bnode" if x.startswith("_:") else "literal" if x.startswith('"') else "iri"
    return spark.createDataFrame([("g", s, kind(s), p, o, kind(o), None, None) for s, p, o in rows], TRIPLE).repartition(3)


def licence(name, file, actions):
    """Each action with its duties."""
    out = []
    for i, (action, duties) in enumerate(actions):
        n = f"_:{file}p{i}"
        out += [(name, "permission", n), (n, "action", action)]
        for j, d in enumerate(duties):
            out += [(n, "duty", f"{n}d{j}"), (f"{n}d{j}", "action", d)]
    return out


def shape(df):
    """Edges without names, counted."""
    return sorted((r.s if r.s_kind != "bnode" else "_", r.p, r.o if r.o_kind != "bnode" else "_") for r in df.collect())


def test_two_files_one_licence(spark):
    said = [("modify", ["notice", "rename"]), ("modify", ["notice"]), ("derive", []), ("derive", [])]
    one = licence("l", "a", said)
    two = licence("l", "b", [(a, d[::-1]) for a, d in said[::-1]])
    once, both = canonical(graph(spark, one)), canonical(graph(spark, one + two))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, both.collect()))
    assert shape(once) == shape(graph(spark, licence("l", "x", said[:3])))


def test_owners_keep_apart(spark):
    got = canonical(graph(spark, licence("l", "a", [("modify", [])]) + licence("m", "b", [("modify", [])]))).collect()
    assert len({r.o for r in got if r.o_kind == "bnode"}) == 2


def test_predicates_and_kinds_keep_apart(spark):
    rows = [("l", "p", "_:1"), ("_:1", "action", "x"), ("l", "q", "_:2"), ("_:2", "action", "x"), ("l", "p", "_:3"), ("_:3", "action", '"x'), ("l", "p", "_:4")]
    got = canonical(graph(spark, rows)).collect()
    assert len({r.o for r in got if r.o_kind == "bnode"}) == 4


def test_circles_and_shared_nodes_end_and_stay(spark):
    circle = [("_:x", "next", "_:y"), ("_:y", "next", "_:z"), ("_:z", "next", "_:x"), ("_:self", "next", "_:self"), ("_:z", "has", "_:leaf"), ("_:leaf", "action", "a")]
    shared = [("l", "p", "_:s"), ("m", "p", "_:s"), ("_:s", "action", "a"), ("_:s", "duty", "_:d"), ("_:d", "action", "b")]
    got = canonical(graph(spark, circle + shared)).collect()
    names = {x for r in got for x, k in ((r.s, r.s_kind), (r.o, r.o_kind)) if k == "bnode"}
    assert {"_:x", "_:y", "_:z", "_:self", "_:s"} <= names and len(names) == 7 and not {"_:leaf", "_:d"} & names


def test_without_owner(spark):
    rows = [(f"_:{f}", p, o) for f in "ab" for p, o in (("type", "Set"), ("title", '"t'))] + [("_:c", "type", "Set")]
    assert shape(canonical(graph(spark, rows))) == [("_", "title", '"t'), ("_", "type", "Set"), ("_", "type", "Set")]


@pytest.mark.parametrize("depth", [1, 6])
def test_depth(spark, depth):
    chain = lambda f: [("l", "p", f"_:{f}0")] + [(f"_:{f}{i}", "p", f"_:{f}{i + 1}") for i in range(depth)]
    assert canonical(graph(spark, chain("a") + chain("b"))).count() == depth + 1


def test_nulls_and_nothing(spark):
    assert canonical(graph(spark, [])).count() == 0
    rows = [("l", "p", None), (None, "p", "_:1"), ("_:1", None, "x"), ("_:1", "p", None), ("l", "p", "x"), ("l", "p", "x")]
    assert canonical(graph(spark, rows)).count() == 5


def test_one_node_with_many_statements(spark):
    rows = [(f"_:{f}", "type", f"t{i}") for f in "ab" for i in range(3000)] + [("l", "target", "_:a"), ("l", "target", "_:b")]
    assert canonical(graph(spark, rows)).count() == 3001


def test_owners_and_lines_are_found_by_one_shuffle_each(spark, monkeypatch):
    """Owners of nodes by one aggregation, without a join; what isn't blank doesn't move to be renamed."""
    from pactum.plans import blank

    plans, staged = [], blank.staged
    monkeypatch.setattr(blank, "staged", lambda df, path=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, path))
    assert shape(canonical(graph(spark, licence("l", "a", [("modify", ["notice"])]) + licence("l", "b", [("modify", ["notice"])]))))
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[1].count("Exchange hashpartitioning") == 1


def test_trees_are_named_where_they_meet_as_in_rounds(spark):
    """Names of shallow and deep trees, circles, shared and ownerless nodes, nulls and odd characters, in two graphs, are those of rounds over nodes."""
    import random

    from pyspark.sql import functions as F

    from pactum.plans import blank

    r, rows = random.Random(7), []
    for tree in range(24):
        owner = r.choice(["l", 'm"\\\n', "_x", None]) if tree % 6 else None
        nodes = [f"_:{tree}n{i}" for i in range(r.randint(1, 9))]
        rows += [(owner, "p", nodes[0])] if tree % 6 else []
        for i, n in enumerate(nodes):
            rows += [(n, r.choice("pq"), r.choice(["x", '"y', None, '"\t"'])) for _ in range(r.randint(0, 3))]
            if i:  # mostly below a node before it; a chain in every fourth tree
                rows.append((nodes[i - 1 if tree % 4 == 0 else r.randrange(i)], r.choice("pq"), n))
        if tree % 5 == 0:
            rows.append((r.choice(nodes), "again", r.choice(nodes)))
    t = graph(spark, rows + rows[::3])
    t = t.unionByName(t.filter(F.col("s").startswith("_:1")).withColumn("g", F.lit("h"))).unionByName(t.filter("o_kind IS NULL").withColumn("o_lang", F.lit("en")))
    said = lambda df: sorted(map(str, df.collect()))
    got = said(blank.canonical(t))
    assert got == said(blank._in_rounds(t)) and len(set(got)) == len(got)


def test_two_levels_are_written_three_times(spark, monkeypatch):
    """What meets at the leaves, what meets at the roots, and the result, each after one shuffle."""
    from pactum.plans import blank

    plans, staged = [], blank.staged
    monkeypatch.setattr(blank, "staged", lambda df, path=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, path))
    canonical(graph(spark, licence("l", "a", [("modify", ["notice"]), ("derive", [])]) + licence("l", "b", [("modify", ["notice"])])))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1, 1]
