"""What a user calls: a licence library over named graphs.

    lib = Library(spark, "/tables/graphs", Vocabulary(house=..., library=...))
    lib.load("/landing/licences")
    lib.list("creative commons"), lib.search(Facets(...)), lib.compatibility([...]), lib.profile(id), lib.fetch(id, "ttl")
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.scalar import prefix_match
from pactum.operators import audit, compat, facets, profile, search
from pactum.operators.compose import Form, compose_license
from pactum.operators.fuzzy import best_titles
from pactum.plans.blank import canonical
from pactum.plans.closure import closed_graph
from pactum.plans.stage import staged
from pactum.sources import turtle
from pactum.sources.store import GraphStore, Views, views
from pactum.terms import DEPENDENCIES, RELATIONS, Vocabulary

FORMATS = {"json-ld": lambda t, p: turtle.to_jsonld(t), "ttl": turtle.to_turtle, "rdf-xml": lambda t, p: turtle.to_rdfxml(t)}


class RepositoryCheck(NamedTuple):
    """repositories: name, language; dependencies: repo, dependency, license, license_id; conflicts: repo, id1, a1, id2, a2, rel, r."""

    repositories: DataFrame
    dependencies: DataFrame
    conflicts: DataFrame


class Library:
    """Graphs: `licences` (searched), `custom` (composed; fetched, profiled and checked, but not searched)."""

    LICENCES, CUSTOM = "licences", "custom"

    def __init__(self, spark: SparkSession, folder: str, vocabulary: Vocabulary = Vocabulary()):
        self.spark, self.store, self.vocabulary = spark, GraphStore(spark, folder), vocabulary

    def load(self, path: str, graph: str = LICENCES, mode: str = "PERMISSIVE") -> DataFrame:
        """Adds all Turtle files below path, to the graphs that files beside them name, or to `graph`; returns those that can't be parsed.

        Blank nodes get names by content, so a licence that is there already, from whatever file, adds nothing.
        """
        good, bad = turtle.read_turtle(self.spark, path, graph, mode)
        bad = staged(bad)
        self.store.append(canonical(good))
        self.__dict__.pop("searched", None)
        self.__dict__.pop("every", None)
        return bad

    @cached_property
    def searched(self) -> Views:
        return views(self.store.graph(self.LICENCES), self.vocabulary)

    @cached_property
    def every(self) -> Views:
        return views(self.store.default(), self.vocabulary)

    @cached_property
    def dependencies(self) -> DataFrame:
        return self.spark.createDataFrame(list(DEPENDENCIES), "a string, rel string, b string")

    def list(self, keyword: str = "", skip: int = 0, limit: int | None = None) -> DataFrame:
        return search.list_licenses(self.searched.titles, self.searched.alternatives, keyword, skip, limit)

    def best(self, keywords: DataFrame, k: int = 10, least: int = 0) -> DataFrame:
        """For each row of keywords (column keyword), its k best titles."""
        return best_titles(self.searched.titles, keywords, k, least)

    def search(self, wanted: facets.Facets) -> DataFrame:
        v = self.searched
        return facets.faceted_search(v.titles, v.targets, v.rules, v.rule_duties, v.wide_duties, wanted)

    def full_text(self, prefix: str, graph: str = LICENCES) -> DataFrame:
        """Triples with a literal in which a word begins with prefix."""
        g = self.store.graph(graph)
        return g.filter((F.col("o_kind") == "literal") & prefix_match(F.col("o"), prefix))

    def fetch(self, licence: str, fmt: str = "json-ld") -> str:
        """One licence, serialised: the triples of its IRI and of all blank nodes below it, however deep."""
        store = self.store.snapshot()
        rows, seen, front = set(), set(), {licence}
        while front:  # a level of one licence at a time; names go to the scan
            seen |= front
            found = {tuple(r) for r in store.about(sorted(front)).select("s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt").collect()}
            rows |= found
            front = {o for _, _, _, o, kind, _, _ in found if kind == "bnode"} - seen
        if not rows:
            raise KeyError(licence)
        return FORMATS[fmt](sorted(rows, key=str), self.vocabulary.prefixes)

    def download(self, licence: str, path: str, fmt: str = "json-ld") -> None:
        self.spark.createDataFrame([(self.fetch(licence, fmt),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def profile(self, licence: str | None = None) -> DataFrame:
        v = self.every
        out = profile.license_profile(v.titles, v.properties, v.rules, v.rule_duties, v.targets, v.wide_duties)
        return out if licence is None else out.filter(F.col("id") == licence)

    def compatibility(self, licences: list[str]) -> DataFrame:
        """One row: maps of direct and derived conflicts among the licences."""
        given = self.spark.createDataFrame([(x,) for x in licences], "id string")
        return compat.nested_report(compat.conflict_report(compat.conflicts(self.every.stmts, self.dependencies, given)))

    def dependency_graph(self, closed: bool = False) -> DataFrame:
        return closed_graph(self.dependencies, RELATIONS) if closed else self.dependencies

    def compose(self, form: Form) -> DataFrame:
        """Adds the new licence to the custom graph; its triples."""
        new = compose_license(self.spark, form, self.vocabulary, self.CUSTOM)
        self.store.append(new)
        self.__dict__.pop("every", None)
        return new

    def check_repositories(self, documents: DataFrame) -> RepositoryCheck:
        """Repositories, their dependencies with the licences they resolve to, and conflicts within each. Licences are named by IRI or last part."""
        named = self.every.titles.select(F.explode(F.array_distinct(F.array("id", F.substring_index("id", "/", -1)))).alias("license"), F.col("id").alias("license_id"))
        found = staged(audit.dependency_licenses(documents).join(named, "license", "left").select("repo", "dependency", "license", "license_id"))
        return RepositoryCheck(audit.repositories(documents), found, audit.repository_conflicts(found, self.every.stmts, self.dependencies))
