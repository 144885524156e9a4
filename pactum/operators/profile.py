"""Licence profiles: properties with labels, permissions with their duties, prohibitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions.scalar import camel_split, local_label
from pactum.terms import LABELS


def optional_chain(triples: DataFrame) -> DataFrame:
    """id, property, value, permission, pnduty, prohibition, duty, asset_type: all values of each licence, and what each leads to.

    triples: s, p, o with compact names. Five optional patterns start at the value: its action as a permission, the duties of
    that permission, its action as a prohibition, its action as a duty, and its type as an asset. Each is null without a match
    and multiplies the row with several. The triples are shuffled once, by subject, for all that is asked of subjects; only values and
    duties move again, to the nodes that they name. Nothing is written.
    """
    # every use below has all columns and rows of this shuffle, so that Spark makes it once: inner joins, as semi-joins and filters
    # would go below it. Repeated triples are left in it, and sets and flags of a subject, or distinct values, are taken from it
    graph = triples.select("s", "p", "o").filter("s IS NOT NULL").repartition("s")
    is_a = lambda kind: F.coalesce(F.bool_or((F.col("p") == "rdf:type") & (F.col("o") == kind)), F.lit(False))
    all_of = lambda p: F.collect_set(F.when(F.col("p") == p, F.col("o")))
    kinds = ("Permission", "Prohibition", "Duty", "AssetCollection")
    bit = reduce(lambda w, ik: w.when(F.col("o") == f"odrl:{ik[1]}", 1 << ik[0]), enumerate(kinds), F)
    nodes = graph.groupBy("s").agg(F.bit_or(F.when(F.col("p") == "rdf:type", bit)).alias("is"), all_of("odrl:action").alias("actions"), all_of("dct:type").alias("types")).filter(F.col("is") != 0)
    nodes = nodes.select("s", *[(F.col("is").bitwiseAND(1 << i) != 0).alias(k) for i, k in enumerate(kinds)], "actions", "types")
    # what names a duty goes to that node, and its actions come back; whose the duty has to be is asked of the permission
    asks = triples.filter((F.col("p") == "odrl:duty") & F.col("s").isNotNull()).select(F.col("s").alias("value"), F.col("o").alias("d")).filter("d IS NOT NULL").repartition("d")
    told = graph.join(asks.hint("shuffle_hash"), F.col("s") == F.col("d")).groupBy("value", "d").agg(is_a("odrl:Duty").alias("Duty"), all_of("odrl:action").alias("pnduty")).filter("Duty AND size(pnduty) > 0")
    duties = told.select("value", "pnduty").repartition("value").groupBy("value").agg(F.flatten(F.collect_list("pnduty")).alias("pnduties"))
    leads = nodes.join(duties.withColumnRenamed("value", "s").hint("shuffle_hash"), "s", "left")
    when = lambda kind, column: F.when(F.col(kind), F.col(column)).alias(f"{kind}_{column}")
    leads = leads.select(F.col("s").alias("value"), when("Permission", "actions"), when("Permission", "pnduties"), when("Prohibition", "actions"), when("Duty", "actions"), when("AssetCollection", "types"))
    sets = graph.groupBy("s").agg(is_a("odrl:Set").alias("Set")).filter("Set").select("s")
    values = graph.join(sets.hint("shuffle_hash"), "s").distinct().select(F.col("s").alias("id"), F.col("p").alias("property"), F.col("o").alias("value"))
    out = values.join(leads, "value", "left")
    # each pattern's matches multiply the row, and none leaves it as it is
    for column, name in (("Permission_actions", "permission"), ("Permission_pnduties", "pnduty"), ("Prohibition_actions", "prohibition"), ("Duty_actions", "duty"), ("AssetCollection_types", "asset_type")):
        out = out.select("*", F.explode_outer(column).alias(name)).drop(column)
    # the second pattern has the first one's action in it
    pnduty = F.when(F.col("permission").isNotNull(), F.col("pnduty")).alias("pnduty")
    return out.select("id", "property", "value", "permission", pnduty, "prohibition", "duty", "asset_type")


def labelled(properties: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """id, label, value of the properties that a profile shows; (id, p, o) in, p compact."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return properties.select("id", F.try_element_at(table, F.col("p")).alias("label"), F.col("o").alias("value")).filter(F.col("label").isNotNull())


def grouped(properties: DataFrame) -> DataFrame:
    """id, label, values (sorted, always a list)."""
    return labelled(properties).groupBy("id", "label").agg(F.sort_array(F.collect_set("value")).alias("values"))


def permissions(rules: DataFrame, rule_duties: DataFrame) -> DataFrame:
    """id, action, duties: duties of all permissions of an action together, sorted."""
    allow = rules.filter(F.col("kind") == "permission").select("id", "node", "action")
    return allow.join(rule_duties.select("id", "node", "duty"), ["id", "node"], "left").groupBy("id", "action").agg(F.sort_array(F.collect_set("duty")).alias("duties"))


def prohibitions(rules: DataFrame) -> DataFrame:
    """id, actions: sorted, each once."""
    return _actions(rules, "prohibition")


def _actions(rules: DataFrame, kind: str) -> DataFrame:
    return rules.filter(F.col("kind") == kind).groupBy("id").agg(F.sort_array(F.collect_set("action")).alias("actions"))


def license_profile(titles: DataFrame, properties: DataFrame, rules: DataFrame, rule_duties: DataFrame, targets: DataFrame, wide_duties: DataFrame) -> DataFrame:
    """id, title, properties (label -> values), permissions (action, duties), prohibitions, obligations, duties (of the whole licence), targets; labels in words, sorted.

    Aggregated side by side and joined by id, so nothing multiplies. Without any, a part is null.
    """
    props = grouped(properties).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.transform("values", lambda v: camel_split(v)).alias("values"))))).alias("properties"))
    allow = permissions(rules, rule_duties).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(local_label(F.col("action")).alias("action"), F.transform("duties", local_label).alias("duties")))).alias("permissions"))
    words = lambda df, name: df.select("id", F.sort_array(F.transform("actions", local_label)).alias(name))
    wide = wide_duties.groupBy("id").agg(F.collect_set("action").alias("actions"))
    kinds = targets.groupBy("id").agg(F.collect_set("asset_type").alias("actions"))
    out = titles
    for part in (props, allow, words(prohibitions(rules), "prohibitions"), words(_actions(rules, "obligation"), "obligations"), words(wide, "duties"), words(kinds, "targets")):
        out = out.join(part, "id", "left")
    return out
