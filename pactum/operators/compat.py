"""Compatibility: permissions that meet prohibitions, directly or through relations between actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.plans.closure import relations
from pactum.plans.numbering import numbered
from pactum.plans.stage import few, small, staged
from pactum.terms import DERIVED, DERIVED_REASON, DIRECT_REASON, GIVEN, RELATIONS

COLUMNS = ["id1", "a1", "id2", "a2", "rel", "r"]


def _reaching(allow: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """allow with a2, rel, r: a row for its own action (rel and r null), and one for each related action."""
    meets = relations(dep_edges, RELATIONS).select(F.col("a").alias("a1"), F.col("b").alias("a2"), "rel", "r")
    none = F.lit(None).cast("string")
    if (local := few(meets)) is None:  # a closure grows with the square of its edges, so it may be large where they are not
        return allow.select(*allow.columns, F.col("a1").alias("a2"), none.alias("rel"), none.alias("r")).unionByName(allow.join(meets, "a1"))
    entry = F.struct("a2", "rel", "r")
    by_action = local.groupBy("a1").agg(F.collect_list(entry).alias("meets"))
    itself = F.struct(F.col("a1").alias("a2"), none.alias("rel"), none.alias("r"))
    out = allow.join(F.broadcast(by_action), "a1", "left").withColumn("m", F.explode(F.concat(F.array(itself), F.coalesce("meets", F.array().cast(by_action.schema["meets"].dataType)))))
    return out.select(*allow.columns, "m.a2", "m.rel", "m.r")


def conflicts(stmts: DataFrame, dep_edges: DataFrame, licences: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """id1, a1 (permission), id2, a2 (prohibition), rel, r (both null where direct), sorted by nothing.

    licences (id) restricts both sides to the input. `within` names a column of stmts: only statements of the same value meet,
    and it is returned too. A licence may conflict with itself. All pairs of a large input are quadratic; see conflict_counts.
    """
    if licences is not None:
        stmts = stmts.join(small(licences.select("id").distinct()), "id", "left_semi")
    keys = [within] if within else []
    side = lambda kind, i, a: stmts.filter(F.col("kind") == kind).select(*keys, F.col("id").alias(i), F.col("action").alias(a)).distinct()
    found = _reaching(side("permission", "id1", "a1"), dep_edges).join(side("prohibition", "id2", "a2"), [*keys, "a2"])
    return found.select(*keys, *COLUMNS)


def conflict_counts(stmts: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """For each permission statement and each action that it meets (rel and r null where it is its own): how many prohibitions of all licences, and the first licence.

    Prohibitions are aggregated by action before they meet permissions, so the result grows with the statements, not with
    their pairs. There is one row for each action then, which is broadcast if its size allows.
    """
    side = lambda kind, i, a: stmts.filter(F.col("kind") == kind).select(F.col("id").alias(i), F.col("action").alias(a)).distinct()
    deny = side("prohibition", "id2", "a2").groupBy("a2").agg(F.count("*").alias("n_conflicts"), F.min("id2").alias("first_id"))
    return _reaching(side("permission", "id1", "a1"), dep_edges).join(small(staged(deny)), "a2").select("id1", "a1", "rel", "a2", "r", "n_conflicts", "first_id")


def reason(r: Column) -> Column:
    return F.when(r.isNull(), DIRECT_REASON).otherwise(F.concat(F.lit(DERIVED_REASON), F.when(r == "derived", DERIVED).otherwise(GIVEN)))


def conflict_report(found: DataFrame) -> DataFrame:
    """kind, key ('0', '1', ... within a kind), statement_1, statement_2, reason. Numbered by ranges, so a report may be of any size."""
    rows = numbered(found.withColumn("kind", F.when(F.col("rel").isNull(), "direct").otherwise("derived")), ["kind", "id1", "a1", "id2", "a2", "rel", "r"])
    first = rows.groupBy("kind").agg(F.min("number").alias("first"))  # two rows
    return rows.join(F.broadcast(first), "kind").select(
        "kind",
        (F.col("number") - F.col("first")).cast("string").alias("key"),
        F.array("id1", F.lit("odrl:permission"), "a1").alias("statement_1"),
        F.array("id2", F.lit("odrl:prohibition"), "a2").alias("statement_2"),
        reason(F.col("r")).alias("reason"),
    )


def nested_report(report: DataFrame) -> DataFrame:
    """One row: direct and derived as maps from key to (statement_1, statement_2, reason)."""
    entry = F.struct("key", F.struct("statement_1", "statement_2", "reason").alias("value"))
    of = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry)))).alias(kind)
    return report.agg(of("direct"), of("derived"))
