"""The facade from end to end on hand-written files."""

import json

from pactum.api import Library
from pactum.operators.audit import read_documents
from pactum.operators.compose import Form
from pactum.operators.facets import Facets
from tests.test_sources import BAD, EMPTY_TARGET, GOOD


def test_library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("A", GOOD), ("B", EMPTY_TARGET), ("Bad", BAD)):
        (tmp_path / "in" / f"{name}.ttl").write_text(text, encoding="utf-8")
    lib = Library(spark, str(tmp_path / "graphs"))
    assert lib.load(str(tmp_path / "in")).count() == 1
    a, b = "urn:pactum:licences/A", "urn:pactum:licences/B"
    assert {r.id for r in lib.list().collect()} == {a, b}
    assert [r.id for r in lib.list("quoted").collect()] == [a] and lib.list(limit=1).count() == 1 and lib.list(skip=1).count() == 1
    assert [r.id for r in lib.search(Facets(actions={"modify": "permitted"}, duties={"modify_duty_notice": "required"})).collect()] == [a]
    report = lib.compatibility([a, b]).first()
    assert report.direct["0"].statement_1[0] == a and report.direct["0"].statement_2[0] == b and not report.derived
    assert lib.dependency_graph().count() == 41 and lib.dependency_graph(True).count() == 49
    assert lib.profile(a).first().permissions[0].duties == ["Notice"] and lib.profile(a).first().duties == ["Share Alike"]
    before = lib.store.quads().count()
    assert lib.load(str(tmp_path / "in")).count() == 1 and lib.store.quads().count() == before
    assert lib.full_text("quot").count() == 1
    assert json.loads(lib.fetch(a))
    for fmt in ("ttl", "rdf-xml"):
        assert "quoted" in lib.fetch(a, fmt)
    lib.download(a, str(tmp_path / "out"), "ttl")
    new = lib.compose(Form(title="Mine", prohibitions=("odrl:modify",), targets=("dcmitype:Software",))).first().s
    assert lib.list("Mine").count() == 0 and lib.profile(new).first().title == "Mine"
    assert len(lib.compatibility([a, new]).first().direct) == 1
    docs = read_documents(spark.createDataFrame([(json.dumps({"full_name": "o/r", "dependencies": [{"name": "x", "normalized_licenses": ["A"]}, {"name": "y", "normalized_licenses": ["B", "Z"]}]}),)], "value string"))
    repositories, found, conflicts = lib.check_repositories(docs)
    assert [tuple(r) for r in repositories.collect()] == [("o/r", None)]
    assert {(r.license, r.license_id) for r in found.collect()} == {("A", a), ("B", b), ("Z", None)} and conflicts.count() == 1


def test_whole_licences_however_deep(spark, tmp_path):
    (tmp_path / "in").mkdir()
    deep = "'end'"
    for i in range(10):
        deep = f"[ l:p{i} {deep} ]"
    numbers = " ".join(f"'item{i}'" for i in range(50))
    (tmp_path / "in" / "Deep.ttl").write_text(f"@prefix l: <urn:x:> . l:Deep l:nested {deep} ; l:list ( {numbers} ) . l:a l:b [ l:c l:Deep ] .")
    lib = Library(spark, str(tmp_path / "graphs"))
    lib.load(str(tmp_path / "in"))
    text = lib.fetch("urn:x:Deep", "ttl")
    assert "end" in text and all(f'"item{i}"' in text for i in range(50)) and "urn:x:a" not in text


def test_files_beside_name_the_graph(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("A", "B"):
        (tmp_path / "in" / f"{name}.ttl").write_text(f"@prefix l: <urn:x:> . l:{name} l:p 'v' .")
    (tmp_path / "in" / "A.ttl.graph").write_text("urn:graph:a \n")
    lib = Library(spark, str(tmp_path / "graphs"))
    assert lib.load(str(tmp_path / "in")).count() == 0
    assert {(r.g, r.s) for r in lib.store.quads().collect()} == {("urn:graph:a", "urn:x:A"), ("licences", "urn:x:B")}
