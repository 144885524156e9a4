"""Turtle parsing, stores, serialisers and streams on hand-written files."""

import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from pactum.sources import turtle as T
from pactum.operators.compose import TRIPLE
from pactum.sources.store import GraphStore, bucket_of, views
from pactum.terms import Vocabulary

HEAD = "﻿# a comment\n@prefix odrl: <http://www.w3.org/ns/odrl/2/> .\n@prefix dct: <http://purl.org/dc/terms/> .\n@prefix cc: <http://creativecommons.org/ns#> .\n@prefix dcmitype: <http://purl.org/dc/dcmitype/> .\n@prefix l: <urn:pactum:licences/> .\n"
GOOD = HEAD + '''l:A a odrl:Set ; dct:title "A \\"quoted\\" title"@en ; dct:alternative "x", """long
"text" here""" ;
  odrl:permission [ a odrl:Permission ; odrl:action odrl:modify ; odrl:duty [ a odrl:Duty ; odrl:action cc:Notice ] ],
    [ a odrl:Permission ; odrl:action odrl:modify ] ;
  odrl:duty [ a odrl:Duty ; odrl:action cc:ShareAlike ] ;
  odrl:target [ a odrl:AssetCollection ; dct:type dcmitype:Software ] .
'''
EMPTY_TARGET = HEAD + 'l:B a odrl:Set ; dct:title "B" ; odrl:prohibition [ a odrl:Prohibition ; odrl:action odrl:modify ] ; odrl:target [ ] .\n'
BAD = HEAD + 'l:C a odrl:Set ; dct:alternative "x" ; "y" ; dct:title "C" .\n'


@pytest.fixture
def folder(tmp_path):
    for name, text in (("One", GOOD), ("B", EMPTY_TARGET), ("Bad", BAD)):
        (tmp_path / f"{name}.ttl").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_parse():
    t = T.parse_turtle(GOOD, "One")
    assert ("urn:pactum:licences/A", "iri", "http://purl.org/dc/terms/title", 'A "quoted" title', "literal", "en", None) in t
    assert any(x[3] == 'long\n"text" here' for x in t)
    assert len({x[0] for x in t if x[1] == "bnode"}) == 5
    with pytest.raises(T.TurtleError):
        T.parse_turtle(BAD)
    assert T.parse_turtle("") == []
    numbers = T.parse_turtle("@prefix e: <urn:e:> . e:a e:b 1, 2.5, 1e3, true, (e:c e:d), '''x'''^^e:t .")
    assert {x[6].rsplit("#", 1)[-1] for x in numbers if x[6]} == {"integer", "decimal", "double", "boolean", "urn:e:t"}


def test_read_and_views(spark, folder):
    good, bad = T.read_turtle(spark, folder, "g")
    assert [os.path.basename(r.file) for r in bad.collect()] == ["Bad.ttl"]
    v = views(good)
    assert {(r.id, r.kind, r.action) for r in v.stmts.collect()} == {("urn:pactum:licences/A", "permission", "odrl:modify"), ("urn:pactum:licences/A", "duty", "cc:ShareAlike"), ("urn:pactum:licences/B", "prohibition", "odrl:modify")}
    assert v.rules.filter("kind = 'permission'").count() == 2
    assert [r.duty for r in v.rule_duties.collect()] == ["cc:Notice"]
    assert [r.asset_type for r in v.targets.collect()] == ["dcmitype:Software"]
    with pytest.raises(Exception, match="predicate"):
        T.read_turtle(spark, folder, "g", "FAILFAST")[0].collect()


def test_round_trips(spark, folder):
    t = T.parse_turtle(GOOD, "One")
    again = T.parse_turtle(T.to_turtle(t), "x")
    assert len(again) == len(t) and {x[3] for x in again if x[4] == "literal"} == {x[3] for x in t if x[4] == "literal"}
    lines = "\n".join(r.value for r in T.to_ntriples(T.read_turtle(spark, folder, "g")[0].filter("s_kind = 'iri'")).collect())
    assert len(T.parse_turtle(lines, "y")) == lines.count("\n") + 1
    doc = T.flatten_ids(json.loads(T.to_jsonld(t)))
    assert any(n.get("@id") == "urn:pactum:licences/A" for n in doc)
    import xml.etree.ElementTree as E

    assert len(E.fromstring(T.to_rdfxml(t).encode())) == len({x[0] for x in t})


def test_store(spark, folder, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    good, _ = T.read_turtle(spark, folder, "one")
    store.append(good)
    store.append(good.withColumn("g", good.p))
    n = good.count()
    assert store.graph("one").count() == n and store.default().count() == n and store.quads().count() == 2 * n
    before = store.snapshot()
    store.clear()
    assert store.quads().count() == 0 and before.quads().count() == 2 * n


def quads(spark, *subjects):
    return spark.createDataFrame([("g", s, "iri", "p", f"o{i}", "literal", None, None) for i, s in enumerate(subjects)], TRIPLE)


def test_versions_and_two_writers(spark, tmp_path):
    a, b = GraphStore(spark, str(tmp_path / "store")), GraphStore(spark, str(tmp_path / "store"))
    assert a.append(quads(spark, "x", "y")) == 1
    commit, calls = a.manifest.commit, []

    def late(before, state):  # b comes in between, with a triple that a is about to write
        if not calls:
            calls.append(b.append(quads(spark, "x", "y", "z")))
        return commit(before, state)

    a.manifest.commit = late
    assert a.append(quads(spark, "x", "y", "z", "w")) == 3
    assert sorted(r.s for r in a.quads().collect()) == ["w", "x", "y", "z"] == sorted(r.s for r in b.quads().collect())
    assert sorted(r.s for r in a.snapshot(1).quads().collect()) == ["x", "y"]
    b.delete(quads(spark, "x"))
    assert sorted(r.s for r in b.quads().collect()) == ["w", "y", "z"]
    b.compact()
    b.vacuum()
    assert sorted(r.s for r in b.quads().collect()) == ["w", "y", "z"] and len([x for x in os.listdir(tmp_path / "store") if x.startswith("part")]) == 1


def test_files_that_are_opened(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    subjects = [f"urn:s:{i}" for i in range(500)]
    store.append(quads(spark, *subjects))
    found = store.about(["urn:s:7", "urn:s:8", "ü"])
    assert sorted(r.s for r in found.collect()) == ["urn:s:7", "urn:s:8"]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    of = {bucket_of(s) for s in ("urn:s:7", "urn:s:8")}
    assert {int(re.search(r"bucket=(\d+)", r.f).group(1)) for r in found.select(F.input_file_name().alias("f")).collect()} == of


def test_stream(spark, folder, tmp_path):
    from pactum.streaming.ingest import ingest_licences

    q = ingest_licences(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"), "g")
    q.awaitTermination(120)
    assert GraphStore(spark, str(tmp_path / "out")).quads().count() == len(T.parse_turtle(GOOD)) + len(T.parse_turtle(EMPTY_TARGET))
    bad = spark.read.parquet(str(tmp_path / "out-bad")).collect()
    assert [os.path.basename(r.file) for r in bad] == ["Bad.ttl"] and "predicate" in bad[0].error


LIBRARY = os.environ.get("PACTUM_LICENCE_LIBRARY", "")  # a folder of public licence files


@pytest.mark.skipif(not os.path.isdir(LIBRARY), reason="PACTUM_LICENCE_LIBRARY isn't set")
def test_library(spark):
    """Known answers over the public licence files."""
    from pactum.operators import compat, facets, search
    from pactum.terms import DEPENDENCIES

    head = open(glob.glob(f"{LIBRARY}/M*.ttl")[0], encoding="utf-8-sig").read(4000)
    spaces = re.findall(r"@prefix \w+: <(https://[^/>]+/[^>]*)> \.", head)
    vocabulary = Vocabulary(house=next(x for x in spaces if x.endswith("#")), library=next(x for x in spaces if x.endswith("/")))
    good, bad = T.read_turtle(spark, LIBRARY, "g")
    good = good.cache()
    assert bad.count() == 1
    v = views(good, vocabulary)
    assert v.titles.count() == 342
    assert search.list_licenses(v.titles, v.alternatives, "creative commons").count() == 293
    assert [r.score for r in search.list_licenses(v.titles, v.alternatives, "Apache").collect()] == [36, 36]
    n = lambda **k: facets.faceted_search(v.titles, v.targets, v.rules, v.rule_duties, v.wide_duties, facets.Facets(**k)).count()
    assert n() == 341 and n(share_alike="required") == 104 and n(actions={"commercial_use": "permitted"}) == 188
    assert n(targets={"creativework": "no", "dataset": "no"}, actions={"modify": "permitted"}, duties={"modify_duty_source_code": "required"}) == 9
    found = compat.conflicts(v.stmts, spark.createDataFrame(list(DEPENDENCIES), "a string, rel string, b string"))
    assert found.filter("rel IS NULL").count() == 63387 and found.filter("rel IS NOT NULL").count() == 2203
