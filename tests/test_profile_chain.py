"""How often a profile's triples move."""

from pactum.operators.profile import optional_chain


def test_triples_are_shuffled_once_and_not_written(spark):
    rows = [("l", "rdf:type", "odrl:Set"), ("l", "odrl:permission", "n"), ("l", "odrl:permission", "n"), (None, "p", "o"), ("l", "p", None)]
    rows += [("n", "rdf:type", "odrl:Permission"), ("n", "odrl:action", "modify"), ("n", "odrl:duty", "d"), ("d", "rdf:type", "odrl:Duty"), ("d", "odrl:action", "notice"), ("d", "odrl:action", "rename")]
    out = optional_chain(spark.createDataFrame(rows, "s string, p string, o string"))
    assert sorted((r.property, r.value or "", r.permission, r.pnduty) for r in out.collect()) == [
        ("odrl:permission", "n", "modify", "notice"), ("odrl:permission", "n", "modify", "rename"), ("p", "", None, None), ("rdf:type", "odrl:Set", None, None),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "FileScan" not in plan and plan.count("ReusedExchange") >= 3


def test_odd_triples_against_sql(spark):
    """Repeated triples, null subjects and predicates, nodes of two kinds, duties of one action, and duties that are none or whose owner is no permission."""
    import random

    import duckdb

    from pactum.queries import ORACLE_SQL

    r = random.Random(5)
    nodes = [f"n{i}" for i in range(12)] + [None]
    rows = [(r.choice(nodes), "rdf:type", r.choice(["odrl:Set", "odrl:Permission", "odrl:Prohibition", "odrl:Duty", "odrl:AssetCollection", None])) for _ in range(24)]
    rows += [(r.choice(nodes), r.choice(["odrl:action", "odrl:action", "dct:type", "dct:title", None]), r.choice(["a", "b", "odrl:Duty"])) for _ in range(30)]
    rows += [(r.choice(nodes), r.choice(["odrl:duty", "odrl:duty", "odrl:permission"]), r.choice(nodes)) for _ in range(40)]
    rows += rows[::3]
    c = duckdb.connect()
    c.execute("CREATE TABLE twice (s VARCHAR, p VARCHAR, o VARCHAR)")
    c.executemany("INSERT INTO twice VALUES (?, ?, ?)", rows)
    c.execute("CREATE TABLE graph AS SELECT DISTINCT * FROM twice")
    sql = ORACLE_SQL["profile_optional_chain"]
    want = c.execute(sql[sql.index("SELECT v.s AS id") :]).fetchall()
    got = optional_chain(spark.createDataFrame(rows, "s string, p string, o string")).collect()
    assert want and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_only_values_are_made_distinct_and_triples_compile(spark):
    """Flags and actions of nodes come from triples as they are; the fixture's arrays of triples are exploded in compiled code."""
    import re

    from pactum.queries import Fixture, _graph

    plan = optional_chain(spark.createDataFrame([("l", "p", "o")], "s string, p string, o string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"keys=\[s#\d+, p#\d+, o#\d+\]", plan)) <= 2
    spark.range(3).selectExpr("id p_partkey", "'n' p_name", "'b' p_brand", "'t' p_type", "int(id) p_size").createOrReplaceTempView("part")
    spark.range(3).selectExpr("id l_partkey", "id l_orderkey", "id l_suppkey", "int(id) l_linenumber", "'R' l_returnflag").createOrReplaceTempView("lineitem")
    f = Fixture(spark, "")
    f.table = spark.table
    assert len(re.findall(r"\*\(\d+\) Generate explode", _graph(f)._jdf.queryExecution().executedPlan().toString())) >= 2
