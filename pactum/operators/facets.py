"""Faceted search: targets, actions with their duties, and share-alike."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.terms import ACTIONS, DUTIES, DUTIES_OF, SHARE_ALIKE, TARGETS


@dataclass(frozen=True)
class Facets:
    """targets: key -> 'yes' or 'no' (default yes); actions: key -> 'permitted', 'prohibited' or 'na'; duties: '<action>_duty_<duty>' -> 'required' or 'na'."""

    targets: dict[str, str] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    duties: dict[str, str] = field(default_factory=dict)
    share_alike: str = "na"

    def __post_init__(self):
        allowed = {f"{a}_duty_{d}" for a, ds in DUTIES_OF.items() for d in ds}
        for given, keys, states in ((self.targets, set(TARGETS), {"yes", "no"}), (self.actions, set(ACTIONS), {"permitted", "prohibited", "na"}), (self.duties, allowed, {"required", "na"}), ({"share_alike": self.share_alike}, {"share_alike"}, {"required", "na"})):
            for k, v in given.items():
                if k not in keys or v not in states:
                    raise ValueError(f"{k}={v!r} isn't a facet")

    def duties_of(self, action: str) -> list[str]:
        return [DUTIES[d] for d in DUTIES_OF.get(action, ()) if self.duties.get(f"{action}_duty_{d}") == "required"]


def with_targets(targets: DataFrame, facets: Facets) -> DataFrame:
    """Licences with one asset that has a wanted type and no unwanted one."""
    yes = [t for k, t in TARGETS.items() if facets.targets.get(k, "yes") == "yes"]
    no = [t for k, t in TARGETS.items() if facets.targets.get(k, "yes") == "no"]
    found = targets.filter(F.col("asset_type").isin(*yes)) if yes else targets
    if no:
        found = found.join(targets.filter(F.col("asset_type").isin(*no)).select("id", "asset"), ["id", "asset"], "left_anti")
    return found.select("id").distinct()


def permitting(rules: DataFrame, rule_duties: DataFrame, action: str, duties: list[str]) -> DataFrame:
    """Licences with a permission of the action, all duties on that same permission."""
    nodes = rules.filter((F.col("kind") == "permission") & (F.col("action") == action)).select("id", "node")
    if duties:
        held = rule_duties.filter(F.col("duty").isin(*duties)).groupBy("id", "node").agg(F.count_distinct("duty").alias("n")).filter(F.col("n") == len(set(duties)))
        nodes = nodes.join(held, ["id", "node"], "left_semi")
    return nodes.select("id")


def prohibiting(rules: DataFrame, action: str) -> DataFrame:
    return rules.filter((F.col("kind") == "prohibition") & (F.col("action") == action)).select("id")


def faceted_search(titles: DataFrame, targets: DataFrame, rules: DataFrame, rule_duties: DataFrame, wide_duties: DataFrame, facets: Facets) -> DataFrame:
    """id (https), title, by title. Duties of actions that aren't 'permitted' don't matter."""
    found = titles.join(with_targets(targets, facets), "id", "left_semi")
    for key, state in facets.actions.items():
        if state == "permitted":
            found = found.join(permitting(rules, rule_duties, ACTIONS[key], facets.duties_of(key)), "id", "left_semi")
        elif state == "prohibited":
            found = found.join(prohibiting(rules, ACTIONS[key]), "id", "left_semi")
    if facets.share_alike == "required":
        found = found.join(wide_duties.filter(F.col("action") == SHARE_ALIKE), "id", "left_semi")
    return found.select(F.replace("id", F.lit("http:"), F.lit("https:")).alias("id"), "title").distinct().orderBy("title")
