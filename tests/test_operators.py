"""Operators on hand-made inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.functions import scalar as S
from pactum.operators import audit, compat, facets, profile, search
from pactum.operators.compose import Form, compose
from pactum.operators.facet_index import FacetIndex, further
from pactum.plans import closure
from pactum.plans.classes import contracted, equivalence_classes
from pactum.plans.numbering import numbered
from pactum.plans.stage import small, staged
from pactum.terms import DEPENDENCIES, RELATIONS, Vocabulary


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_ratio(a, b):
    assert S.ratio(a, b) == (round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100)


def test_ratio_of_known_strings():
    assert S.ratio("the mit license", "mit") == 33


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_scalars(spark):
    assert one(spark, S.local_label(F.lit("http://x/ns#ODbLDerivativeWorks"))) == "ODbLDerivative Works"
    assert one(spark, S.date_valid(F.lit("2023-02-29"))) is False
    assert one(spark, S.date_valid(F.lit(None).cast("string"))) is False
    assert one(spark, S.repository(F.lit("https://h.example/o/n/x?y=1"))).asDict() == {"owner": "o", "name": "n"}
    assert one(spark, S.repository(F.lit("nothing"))) is None
    assert one(spark, S.quoted_concat(F.lit('"a"'), F.lit("b"))) == '"ab"'
    assert one(spark, S.curie_expand(F.lit("nope:x"), Vocabulary().prefixes)) is None
    assert one(spark, S.strip_quotes(F.lit('"a"'))) == "a"
    assert one(spark, S.strip_element(F.lit('"a(b)"))'))) == "a(b)" and one(spark, S.strip_element(F.lit("x"))) == "x"
    words = spark.createDataFrame([("one (Version two", True), ("inversion", False), ("_version", False), ("ÉVersion", False), ("-VERSIONS", True), (None, None)], "t string, want boolean")
    assert all(r.got == r.want for r in words.select("want", S.prefix_match(F.col("t"), "ver").alias("got")).collect())


def test_closures(spark):
    d = spark.createDataFrame(list(DEPENDENCIES), "a string, rel string, b string")
    counts = {(r.rel, r.r): r["count"] for r in closure.relations(d, RELATIONS).groupBy("rel", "r").count().collect()}
    assert counts == {("odrl:includedIn", "dependencygraph"): 23, ("odrl:includedIn", "derived"): 5, ("odrl:implies", "dependencygraph"): 7, ("owl:sameAs", "dependencygraph"): 12, ("owl:sameAs", "derived"): 25}
    assert closure.closed_graph(d, RELATIONS).count() == 49


def test_large_closure_is_the_same(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "y"), ("d", "e", "y"), ("p", "p", "x")], closure.EDGES)
    small = {tuple(r) for r in closure.paths(e).collect()}
    monkeypatch.setattr(closure, "SMALL", 0)
    assert {tuple(r) for r in closure.paths(e).collect()} == small
    assert len(small) == 9 + 1 + 1


@pytest.mark.parametrize("seed", range(2))
def test_closure_under_changes(spark, seed):
    """Random graphs with cycles: edges come and go in batches, and the pairs are always those of the edges there are."""
    rng = random.Random(seed)
    every = [(str(a), str(b), r) for a in range(9) for b in range(9) for r in "xy"]

    def closed(edges):
        pairs = set(edges)
        while more := {(a, d, r) for a, b, r in pairs for c, d, q in edges if b == c and r == q} - pairs:
            pairs |= more
        return pairs

    have = set(rng.sample(every, 14))
    frame = lambda e: spark.createDataFrame(sorted(e), closure.EDGES)
    c = closure.Closure(frame(have))
    for _ in range(2):
        new, gone = set(rng.sample(every, 4)), set(rng.sample(sorted(have), 5))
        before = closed(have)
        added = {tuple(r) for r in c.insert(frame(new)).collect()}
        have |= new
        assert added == closed(have) - before
        before = closed(have)
        removed = {tuple(r) for r in c.delete(frame(gone)).collect()}
        have -= gone
        assert removed == before - closed(have)
        assert {tuple(r) for r in c.pairs.collect()} == closed(have) and c.pairs.count() == len(closed(have)) and {tuple(r) for r in c.edges.collect()} == have


def test_equivalence_classes(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(70)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("x", "x"), ("x", None), (None, None)]
    least = {n: n for e in edges for n in e if n and None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a and b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    got = equivalence_classes(spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.representative for r in got.collect()} == least
    facts = spark.createDataFrame([("p001", "is", "p060"), ("p002", "is", "q"), ("p000", "is", "q")], "s string, p string, o string")
    assert {tuple(r) for r in contracted(facts, got, ["s", "o"]).collect()} == {("p000", "is", "p000"), ("p000", "is", "q")} and contracted(facts, got, ["s", "o"]).count() == 2


def test_a_class_of_many(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") * 7919 + 13) % n).alias("b")).unionByName(spark.range(n).select(F.lit(n - 1).cast("long").alias("a"), F.col("id").alias("b")))
    got = equivalence_classes(edges).agg(F.count("*"), F.min("representative"), F.max("representative")).first()
    assert tuple(got) == (n, 0, 0)


def test_many_paths_leave_the_driver(spark, monkeypatch):
    """A chain's paths grow with the square of its edges; past the limit they are joined, in rounds that double lengths."""
    monkeypatch.setattr(closure, "SMALL_PATHS", 500)
    rounds = []
    monkeypatch.setattr(closure, "staged", lambda df, path: rounds.append(path) or staged(df, path))
    n = 150
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}", "x") for i in range(n)], closure.EDGES)
    got = {(r.a, r.b) for r in closure.paths(e).collect()}
    assert got == {(f"{i:03}", f"{j:03}") for i in range(n) for j in range(i + 2, n + 1)}
    assert len(rounds) < 25


@pytest.fixture
def lib(spark):
    rules = [("l1", "n1", "permission", "odrl:modify"), ("l1", "n2", "permission", "odrl:modify"), ("l1", "n3", "prohibition", "cc:CommercialUse"), ("l2", "n4", "permission", "odrl:modify"), ("l2", "n5", "prohibition", "odrl:present"), ("l3", "n6", "permission", "odrl:display"), ("l3", "n7", "prohibition", "odrl:modify")]
    duties = [("l1", "n1", "cc:Notice"), ("l1", "n2", "cc:Attribution"), ("l2", "n4", "cc:Notice"), ("l2", "n4", "cc:Attribution")]
    return {
        "titles": spark.createDataFrame([("l1", "One Red"), ("l2", "Two"), ("l3", "Three")], "id string, title string"),
        "alternatives": spark.createDataFrame([("l1", "uno blue"), ("l1", "first"), ("l3", "tres")], "id string, alt string"),
        "targets": spark.createDataFrame([("l1", "a1", "dcmitype:Software"), ("l2", "a2", "dcmitype:Software"), ("l2", "a2", "lic:CreativeWork")], "id string, asset string, asset_type string"),
        "rules": spark.createDataFrame(rules, "id string, node string, kind string, action string"),
        "rule_duties": spark.createDataFrame(duties, "id string, node string, duty string"),
        "wide_duties": spark.createDataFrame([("l2", "cc:ShareAlike")], "id string, action string"),
        "deps": spark.createDataFrame(list(DEPENDENCIES), "a string, rel string, b string"),
    }


def find(lib, **given):
    return [r.id for r in facets.faceted_search(lib["titles"], lib["targets"], lib["rules"], lib["rule_duties"], lib["wide_duties"], facets.Facets(**given)).collect()]


def test_facets(lib):
    assert find(lib) == ["l1", "l2"]
    assert find(lib, targets={"creativework": "no"}) == ["l1"]
    assert find(lib, targets={k: "no" for k in ("creativework", "dataset", "software")}) == []
    both = {"modify_duty_notice": "required", "modify_duty_attribution": "required"}
    assert find(lib, actions={"modify": "permitted"}, duties=both) == ["l2"]  # on one permission
    assert find(lib, duties=both) == ["l1", "l2"]  # ignored without the action
    assert find(lib, actions={"commercial_use": "prohibited"}) == ["l1"]
    assert find(lib, share_alike="required") == ["l2"]
    with pytest.raises(ValueError):
        facets.Facets(actions={"fly": "permitted"})


def test_keywords(lib):
    ids = lambda k: {r.id for r in search.list_licenses(lib["titles"], lib["alternatives"], k).collect()}
    assert ids("") == {"l1", "l2", "l3"}
    assert ids("red uno") == {"l1"}
    assert ids("uno first") == set()  # two terms on two alternatives
    assert ids("TWO") == {"l2"}
    assert ids("zzz") == set()


def test_conflicts(spark, lib):
    stmts = lib["rules"].select("id", "kind", "action").distinct()
    got = {tuple(r) for r in compat.conflicts(stmts, lib["deps"]).collect()}
    assert got == {
        ("l1", "odrl:modify", "l3", "odrl:modify", None, None),
        ("l2", "odrl:modify", "l3", "odrl:modify", None, None),
        ("l3", "odrl:display", "l2", "odrl:present", "odrl:includedIn", "dependencygraph"),
    }
    only = spark.createDataFrame([("l1",), ("l2",)], "id string")
    assert compat.conflicts(stmts, lib["deps"], only).count() == 0
    nested = compat.nested_report(compat.conflict_report(compat.conflicts(stmts, lib["deps"]))).first()
    assert set(nested.direct) == {"0", "1"} and nested.derived["0"].statement_1 == ["l3", "odrl:permission", "odrl:display"]
    assert nested.derived["0"].reason.endswith("is given in the dependency graph.")
    counts = {tuple(r) for r in compat.conflict_counts(stmts, lib["deps"]).collect()}
    assert counts == {
        ("l1", "odrl:modify", None, "odrl:modify", None, 1, "l3"),
        ("l2", "odrl:modify", None, "odrl:modify", None, 1, "l3"),
        ("l3", "odrl:display", "odrl:includedIn", "odrl:present", "dependencygraph", 1, "l2"),
    }


def test_only_few_rows_are_broadcast(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(small(spark.range(5), 5)) and "strategy=broadcast" not in plan(small(spark.range(6), 5))
    assert small(spark.range(0)).count() == 0


def test_broadcasts_are_bounded_in_bytes(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().analyzed().toString()
    wide = spark.range(3).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert "strategy=broadcast" in plan(small(wide, 10, 5000)) and "strategy=broadcast" not in plan(small(wide, 10, 2000))


def test_a_large_vocabulary_is_joined(spark, lib, monkeypatch):
    stmts = lib["rules"].select("id", "kind", "action").distinct()
    want = {tuple(r) for r in compat.conflicts(stmts, lib["deps"]).collect()}
    monkeypatch.setattr(compat, "few", lambda df: None)
    assert {tuple(r) for r in compat.conflicts(stmts, lib["deps"]).collect()} == want


def test_numbers_of_many_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1000).alias("v")).repartition(5)
    got = numbered(df, ["k", "v"]).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.number)] == sorted((i % 7, i * 37 % 1000) for i in range(1000)) and sorted(r.number for r in got) == list(range(1000))
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_conflict_counts_of_repositories(spark, lib):
    stmts = lib["rules"].select("id", "kind", "action").distinct()
    resolved = spark.createDataFrame([("r", "l1"), ("r", "l3"), ("r", "l3"), ("s", "l2"), ("s", None), ("t", "l2"), ("t", "l3")], "repo string, license_id string")
    rows = audit.repository_conflicts(resolved, stmts, lib["deps"]).groupBy("repo", "id1", "id2").agg(F.count("*"), F.count_distinct("a1")).collect()
    assert sorted(tuple(r) for r in audit.repository_conflict_counts(resolved, stmts, lib["deps"]).collect()) == sorted(tuple(r) for r in rows) != []


def test_facet_index(spark, lib):
    """Every further choice, and what it leads to, as the joins have it."""
    parts = (lib["titles"], lib["targets"], lib["rules"], lib["rule_duties"], lib["wide_duties"])
    index = FacetIndex.build(*parts)
    for given in (facets.Facets(), facets.Facets(actions={"modify": "permitted"}, duties={"modify_duty_notice": "required"}), facets.Facets(targets=dict.fromkeys(("creativework", "dataset", "software"), "no"))):
        assert [tuple(r) for r in index.search(given).collect()] == [tuple(r) for r in facets.faceted_search(*parts, given).collect()]
        counts = {r.choice: r.n for r in index.counts(given).collect()}
        wanted = further(given) | {"": given}
        assert counts.keys() == wanted.keys()
        for name in ("", "creativework=no", "modify_duty_attribution", "commercial_use=prohibited", "share_alike"):
            if name in wanted:
                assert counts[name] == facets.faceted_search(*parts, wanted[name]).select("id").distinct().count(), name


def test_profile(spark, lib):
    allow = {(r.id, r.action): r.duties for r in profile.permissions(lib["rules"], lib["rule_duties"]).collect()}
    assert allow["l1", "odrl:modify"] == ["cc:Attribution", "cc:Notice"] and allow["l3", "odrl:display"] == []
    props = spark.createDataFrame([("l1", "dct:publisher", "P"), ("l1", "foaf:img", "i")], "id string, p string, o string")
    rows = profile.license_profile(lib["titles"], props, lib["rules"], lib["rule_duties"], lib["targets"], lib["wide_duties"]).orderBy("id").collect()
    assert rows[1].duties == ["Share Alike"] and rows[0].duties is None and rows[0].obligations is None
    row = rows[0]
    assert row.properties == {"Publisher": ["P"]} and row.prohibitions == ["Commercial Use"] and row.targets == ["Software"]


def test_audit(spark, lib):
    text = '{"full_name":"o/r","language":"x","dependencies":[{"name":"d1","normalized_licenses":["l1"]},{"name":"d2","normalized_licenses":[]},{"name":"d3","normalized_licenses":["l3","??"]},{"name":"d4"}]}'
    docs = audit.read_documents(spark.createDataFrame([(text,), ("not json",)], "value string"))
    resolved = audit.resolve(audit.dependency_licenses(docs), lib["titles"])
    assert [tuple(r) for r in audit.repositories(docs).collect()] == [("o/r", "x")]
    assert {(r.dependency, r.license_id) for r in resolved.collect()} == {("d1", "l1"), ("d3", "l3"), ("d3", None)}
    got = audit.repository_conflicts(resolved, lib["rules"].select("id", "kind", "action").distinct(), lib["deps"]).collect()
    assert [(r.repo, r.id1, r.id2) for r in got] == [("o/r", "l1", "l3")]


def test_compose_is_deterministic():
    form = Form(title="T", permissions=(("odrl:modify", ("cc:Notice",)),), validity="specifyDate", start="2024-01-01", end="never")
    a = compose(form, Vocabulary(), "g")
    assert a == compose(form, Vocabulary(), "g")
    assert sum(p.endswith("startDate") for _, _, _, p, *_ in a) == 1 and not any(p.endswith("endDate") for _, _, _, p, *_ in a)


def test_five_optional_patterns(spark):
    """Every pattern null without a match, several matches multiply, types decide, and duties go with a permission's action only."""
    t = [("l", "rdf:type", "odrl:Set"), ("l", "dct:title", "T"), ("x", "dct:title", "no licence")]
    t += [("l", "odrl:permission", "n"), ("n", "rdf:type", "odrl:Permission"), ("n", "odrl:action", "modify"), ("n", "odrl:duty", "d1"), ("n", "odrl:duty", "d2"), ("n", "odrl:duty", "d3")]
    t += [("d1", "rdf:type", "odrl:Duty"), ("d1", "odrl:action", "notice"), ("d2", "rdf:type", "odrl:Duty"), ("d2", "odrl:action", "rename"), ("d3", "odrl:action", "untyped")]
    t += [("l", "odrl:prohibition", "p"), ("p", "rdf:type", "odrl:Prohibition"), ("p", "odrl:action", "sell"), ("l", "odrl:duty", "w"), ("w", "rdf:type", "odrl:Duty"), ("w", "odrl:action", "share")]
    t += [("l", "odrl:target", "a"), ("a", "rdf:type", "odrl:AssetCollection"), ("a", "dct:type", "Software"), ("a", "dct:type", "Dataset"), ("l", "odrl:target", "b"), ("b", "dct:type", "Untyped")]
    got = {tuple(r)[1:] for r in profile.optional_chain(spark.createDataFrame(t, "s string, p string, o string")).collect()}
    none = (None,) * 5
    assert got == {
        ("rdf:type", "odrl:Set", *none),
        ("dct:title", "T", *none),
        ("odrl:permission", "n", "modify", "notice", None, None, None),
        ("odrl:permission", "n", "modify", "rename", None, None, None),
        ("odrl:prohibition", "p", None, None, "sell", None, None),
        ("odrl:duty", "w", None, None, None, "share", None),
        ("odrl:target", "a", None, None, None, None, "Software"),
        ("odrl:target", "a", None, None, None, None, "Dataset"),
        ("odrl:target", "b", *none),
    }
