"""Named graphs as a partitioned table, and the logical views that operators take."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators.compose import TRIPLE
from pactum.plans.stage import dropped, stage_folder, staged
from pactum.sources.manifest import Conflict, Manifest
from pactum.terms import STATEMENT_KINDS, Vocabulary


_NAMES = [x.split()[0] for x in TRIPLE.split(", ")]
#: Subjects are dealt to so many buckets in each graph.
BUCKETS = 64
#: Graphs and buckets up to which an append picks partitions by name.
MANY = 4000
#: Parts that are made one, and attempts of an append that other writers come before.
FANOUT, ATTEMPTS = 16, 5


def bucket_of(subject: str) -> int:
    """The bucket of a subject, as `in_buckets` has it."""
    return zlib.crc32(subject.encode()) % BUCKETS


def in_buckets(triples: DataFrame) -> DataFrame:
    return triples.select(*_NAMES, (F.crc32("s") % BUCKETS).cast("int").alias("bucket"))


class GraphStore:
    """Triples below a folder, in parts that are partitioned by graph and by bucket of the subject; a manifest says which parts there are.

    Reading one graph, or some subjects, opens no other partitions. Readers stay at the version that they have opened; a writer
    that finds another version than it began with begins again, so two can write at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder, self.manifest = spark, folder.rstrip("/"), Manifest(spark, folder)
        self.fixed = version

    @property
    def version(self) -> int:
        return self.manifest.latest() if self.fixed is None else self.fixed

    def snapshot(self, version: int | None = None) -> GraphStore:
        """The store as it is now, or was at a version, whatever is written afterwards; until `vacuum`."""
        return GraphStore(self.spark, self.folder, self.version if version is None else version)

    def _parts(self, version: int | None = None) -> list[str]:
        return self.manifest.read(self.version if version is None else version).get("parts", [])

    def _read(self, parts: list[str]) -> DataFrame:
        schema = f"{TRIPLE}, bucket int"
        if not parts:
            return self.spark.createDataFrame([], schema)
        each = [self.spark.read.schema(schema).parquet(p) for p in parts]
        return reduce(DataFrame.unionByName, each).select(*_NAMES, "bucket")

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.folder}/part-{uuid.uuid4().hex}"
        # a graph's bucket is one file of a part, and a large graph is spread over its buckets
        rows.repartition("g", "bucket").write.partitionBy("g", "bucket").parquet(path)
        return path

    def append(self, triples: DataFrame) -> int:
        """Adds what the graphs don't have, as a new part, and returns the new version; only buckets that the triples are in are read."""
        scratch = stage_folder(self.spark)
        new = staged(in_buckets(triples).distinct(), scratch)
        touched = [tuple(r) for r in new.select("g", "bucket").distinct().limit(MANY + 1).collect()]
        try:
            for _ in range(ATTEMPTS):
                before = self.manifest.latest()
                parts = self._parts(before)
                old = self._read(parts)
                if len(touched) <= MANY:
                    old = old.filter(F.col("g").isin(sorted({g for g, _ in touched})) & F.col("bucket").isin(sorted({b for _, b in touched})))
                fresh = self._written(new.select(*_NAMES, "bucket").subtract(old) if parts else new)
                try:
                    version = self.manifest.commit(before, {"parts": [*parts, fresh]})
                except Conflict:
                    dropped(self.spark, fresh)  # the other writer may have added the same triples
                    continue
                if len(parts) + 1 >= FANOUT:
                    self.compact()
                return version
        finally:
            dropped(self.spark, scratch)
        raise Conflict(f"{ATTEMPTS} other writers came before")

    def delete(self, triples: DataFrame) -> int:
        """Takes triples out, by all their columns; parts that hold none of them stay as they are."""
        before = self.manifest.latest()
        gone = in_buckets(triples).distinct()
        parts = []
        for p in self._parts(before):
            rows = self._read([p])
            if rows.intersect(gone).isEmpty():
                parts.append(p)
            else:
                parts.append(self._written(rows.subtract(gone)))
        return self.manifest.commit(before, {"parts": parts})

    def clear(self) -> int:
        return self.manifest.commit(self.manifest.latest(), {"parts": []})

    def compact(self) -> None:
        """Makes one part of all, unless another writer comes before."""
        before = self.manifest.latest()
        parts = self._parts(before)
        if len(parts) > 1:
            one = self._written(self._read(parts))
            try:
                self.manifest.commit(before, {"parts": [one]})
            except Conflict:
                dropped(self.spark, one)

    def vacuum(self) -> None:
        """Removes parts of earlier versions that the latest doesn't have."""
        now = self.manifest.latest()
        held = set(self._parts(now))
        for p in {p for v in range(1, now) for p in self._parts(v)} - held:
            dropped(self.spark, p)

    def quads(self) -> DataFrame:
        return self._read(self._parts()).drop("bucket")

    def graph(self, g: str) -> DataFrame:
        """One graph; `append` has seen to it that each triple is there once."""
        return self.quads().filter(F.col("g") == g)

    def default(self) -> DataFrame:
        """All graphs together, each triple once."""
        return self.quads().drop("g").dropDuplicates()

    def about(self, subjects: list[str]) -> DataFrame:
        """The quads of some subjects; only their buckets are opened."""
        rows = self._read(self._parts())
        return rows.filter(F.col("bucket").isin(sorted(set(map(bucket_of, subjects)))) & F.col("s").isin(subjects)).drop("bucket")


@dataclass
class Views:
    """Operators' inputs from triples, with compact names."""

    titles: DataFrame
    alternatives: DataFrame
    targets: DataFrame
    rules: DataFrame
    rule_duties: DataFrame
    wide_duties: DataFrame
    stmts: DataFrame
    properties: DataFrame


def compact(value, v: Vocabulary):
    out = value
    for p, ns in sorted(v.prefixes.items(), key=lambda x: len(x[1])):
        if p != "liclib":
            out = F.when(F.startswith(value, F.lit(ns)), F.concat(F.lit(p + ":"), F.substr(value, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def views(triples: DataFrame, v: Vocabulary = Vocabulary()) -> Views:
    t = triples.select("s", compact(F.col("p"), v).alias("p"), "o", F.when(F.col("o_kind") == "iri", compact(F.col("o"), v)).otherwise(F.col("o")).alias("c"), "o_kind").distinct()
    of = lambda p, a, b: t.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
    sets = t.filter((F.col("p") == "rdf:type") & (F.col("c") == "odrl:Set")).select(F.col("s").alias("id"))
    actions = t.filter(F.col("p") == "odrl:action").select(F.col("s").alias("node"), F.col("c").alias("action"))
    kinds = F.create_map(*[F.lit(x) for kv in STATEMENT_KINDS.items() for x in kv])
    owned = t.filter(F.col("p").isin(*STATEMENT_KINDS)).select(F.col("s").alias("id"), F.element_at(kinds, F.col("p")).alias("kind"), F.col("o").alias("node"))
    every = owned.join(actions, "node")
    rules = every.join(sets, "id", "left_semi").select("id", "node", "kind", "action")
    nested = t.filter(F.col("p") == "odrl:duty").select(F.col("s").alias("node"), F.col("o").alias("d"))
    duties = rules.select("id", "node").join(nested, "node").join(actions.select(F.col("node").alias("d"), F.col("action").alias("duty")), "d").select("id", "node", "duty").distinct()
    types = t.filter(F.col("p") == "dct:type").select(F.col("s").alias("asset"), F.col("c").alias("asset_type"))
    return Views(
        titles=of("dct:title", "id", "title").join(sets, "id", "left_semi"),
        alternatives=of("dct:alternative", "id", "alt").join(sets, "id", "left_semi"),
        targets=of("odrl:target", "id", "asset").join(types, "asset").select("id", "asset", "asset_type").distinct(),
        rules=rules,
        rule_duties=duties,
        wide_duties=rules.filter(F.col("kind") == "duty").select("id", "action").distinct(),
        stmts=rules.select("id", "kind", "action").distinct(),
        properties=t.filter(F.col("o_kind") != "bnode").select(F.col("s").alias("id"), "p", "o").join(sets, "id", "left_semi"),
    )
