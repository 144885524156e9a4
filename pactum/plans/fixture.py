"""Licence-shaped views over the driver's star schema, and the same views as SQL.

Parts are licences, line items are their statements, orders are repositories whose lines are dependencies. Every row of
`part` and `lineitem` takes part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.terms import DEPENDENCIES

#: Actions that line items are dealt to, and duties of permissions.
VOCABULARY = ("odrl:display", "odrl:distribute", "odrl:modify", "odrl:derive", "odrl:present", "odrl:reproduce", "cc:CommercialUse", "cc:DerivativeWorks", "lic:ModifiedWorks", "lic:chargeDistributionFee", "lic:ChangeLicense", "odrl:extract", "odrl:copy", "cc:ShareAlike")
DUTY_VOCABULARY = ("cc:Attribution", "cc:Notice", "cc:SourceCode", "lic:rename", "lic:modificationNotice", "lic:compliantLicense")
WITH_DUTIES = ("odrl:distribute", "odrl:modify", "odrl:derive", "lic:ChangeLicense")


def _id(key: str):
    return F.concat(F.lit("urn:lic:"), F.col(key).cast("string"))


@dataclass
class Fixture:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def dep_edges(self) -> DataFrame:
        return self.spark.createDataFrame(list(DEPENDENCIES), "a string, rel string, b string")

    @cached_property
    def parts(self) -> DataFrame:
        """id, title, asset, kinds (types of the asset), wide (whether it asks to share alike)."""
        s = F.col("p_size")
        kinds = F.array_compact(F.array(F.when(s % 2 == 0, F.lit("lic:CreativeWork")), F.when(s % 3 == 0, F.lit("dcmitype:Dataset")), F.when((s % 5).isin(0, 1), F.lit("dcmitype:Software"))))
        title = F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string"))
        return self.table("part").select(_id("p_partkey").alias("id"), title.alias("title"), F.concat(F.lit("_:"), F.col("p_partkey").cast("string")).alias("asset"), kinds.alias("kinds"), (s % 3 == 0).alias("wide"))

    @cached_property
    def titles(self) -> DataFrame:
        return self.parts.select("id", "title")

    @cached_property
    def alternatives(self) -> DataFrame:
        p = self.table("part")
        k = F.col("p_size") % 5
        names = F.array_compact(F.array(F.when(k != 0, F.col("p_type")), F.when(k.isin(1, 2), F.concat_ws(" ", "p_brand", "p_type"))))
        return p.select(_id("p_partkey").alias("id"), F.explode(names).alias("alt"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.parts.select("id", "asset", F.explode("kinds").alias("asset_type"))

    @cached_property
    def rules(self) -> DataFrame:
        """id, node, kind, action, ok (order key, from which duties follow)."""
        return self.rule_rows.distinct()

    @cached_property
    def rule_rows(self) -> DataFrame:
        """rules, with those that the table has twice; for what makes its results distinct itself."""
        action = F.get(F.array(*map(F.lit, VOCABULARY)), ((F.col("l_suppkey") + F.col("l_linenumber")) % len(VOCABULARY)).cast("int"))
        return self.table("lineitem").select(
            _id("l_partkey").alias("id"),
            F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")]).alias("node"),
            F.when(F.col("l_returnflag") == "R", "prohibition").otherwise("permission").alias("kind"),
            action.alias("action"),
            F.col("l_orderkey").alias("ok"),
        )

    @cached_property
    def rules_due(self) -> DataFrame:
        """rules with due, the duties of each."""
        return self.with_due(self.rules)

    @staticmethod
    def with_due(rules: DataFrame) -> DataFrame:
        due = F.array_compact(F.array(*[F.when(F.col("ok") % (i + 2) == 0, F.lit(d)) for i, d in enumerate(DUTY_VOCABULARY)]))
        has = (F.col("kind") == "permission") & F.col("action").isin(*WITH_DUTIES)
        return rules.withColumn("due", F.when(has, due).otherwise(F.array().cast("array<string>")))

    @cached_property
    def rule_duties(self) -> DataFrame:
        return self.rules_due.filter(F.size("due") > 0).select("id", "node", F.explode("due").alias("duty"))

    @cached_property
    def wide_duties(self) -> DataFrame:
        return self.parts.filter("wide").select("id", F.lit("cc:ShareAlike").alias("action"))

    @cached_property
    def stmts(self) -> DataFrame:
        return self.rules.select("id", "kind", "action").distinct()

    @cached_property
    def dependencies(self) -> DataFrame:
        """repo, dependency, license_id (null: not recognised)."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("repo"),
            F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("dependency"),
            F.when(F.col("l_linenumber") != 7, _id("l_partkey")).alias("license_id"),
        )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


SQL = f"""
WITH RECURSIVE voc(i, action) AS (SELECT * FROM (VALUES {_values(enumerate(VOCABULARY))}) v(a, b)),
dut(i, action) AS (SELECT * FROM (VALUES {_values(enumerate(DUTY_VOCABULARY))}) v(a, b)),
dep_edges(a, rel, b) AS (SELECT * FROM (VALUES {_values(DEPENDENCIES)}) v(a, b, c)),
titles AS (SELECT concat('urn:lic:', p_partkey) AS id, concat(p_name, ' ', p_brand, ' ', p_partkey) AS title FROM part),
alternatives AS (SELECT concat('urn:lic:', p_partkey) AS id, p_type AS alt FROM part WHERE p_size % 5 <> 0
  UNION ALL SELECT concat('urn:lic:', p_partkey), concat(p_brand, ' ', p_type) FROM part WHERE p_size % 5 IN (1, 2)),
targets AS (SELECT concat('urn:lic:', p_partkey) AS id, concat('_:', p_partkey) AS asset, t.ty AS asset_type FROM part JOIN
  (VALUES (0, 'lic:CreativeWork'), (1, 'dcmitype:Dataset'), (2, 'dcmitype:Software')) t(k, ty)
  ON (t.k = 0 AND p_size % 2 = 0) OR (t.k = 1 AND p_size % 3 = 0) OR (t.k = 2 AND p_size % 5 IN (0, 1))),
rules AS MATERIALIZED (SELECT DISTINCT concat('urn:lic:', l_partkey) AS id, concat(l_partkey, ':', l_orderkey, ':', l_linenumber, ':', l_suppkey) AS node,
  CASE WHEN l_returnflag = 'R' THEN 'prohibition' ELSE 'permission' END AS kind, v.action, l_orderkey AS ok
  FROM lineitem JOIN voc v ON v.i = (l_suppkey + l_linenumber) % {len(VOCABULARY)}),
rule_duties AS (SELECT r.id, r.node, d.action AS duty FROM rules r JOIN dut d ON r.ok % (d.i + 2) = 0
  WHERE r.kind = 'permission' AND r.action IN ({", ".join(f"'{x}'" for x in WITH_DUTIES)})),
wide_duties AS (SELECT concat('urn:lic:', p_partkey) AS id, 'cc:ShareAlike' AS action FROM part WHERE p_size % 3 = 0),
stmts AS MATERIALIZED (SELECT DISTINCT id, kind, action FROM rules),
deps AS (SELECT l_orderkey AS repo, concat(l_linenumber, ':', l_suppkey) AS dependency, CASE WHEN l_linenumber <> 7 THEN concat('urn:lic:', l_partkey) END AS license_id FROM lineitem),
base AS (SELECT a, b, rel FROM dep_edges WHERE rel IN ('odrl:includedIn', 'odrl:implies', 'owl:sameAs') UNION SELECT b, a, rel FROM dep_edges WHERE rel = 'owl:sameAs'),
clo(a, b, rel) AS (SELECT DISTINCT c.a, e.b, c.rel FROM base c JOIN base e ON c.b = e.a AND c.rel = e.rel
  UNION SELECT c.a, e.b, c.rel FROM clo c JOIN base e ON c.b = e.a AND c.rel = e.rel),
rels AS (SELECT a, b, rel, 'dependencygraph' AS r FROM base UNION SELECT a, b, rel, 'derived' FROM clo)
"""
