"""A bitmap index for faceted search.

Licences are numbered; each facet value has a bitmap of 32,768 licences a row, built by Spark's bitmap aggregates. What a search
asks is an AND of clauses, each an OR of values: an asset or a permission is indexed by everything it has together (which types,
which duties), so what has to hold on one of them is an OR of the combinations that do. A search reads some of these rows, and the
counts of all further choices come from one pass over them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators.facets import Facets
from pactum.plans.numbering import numbered
from pactum.plans.stage import stage_folder
from pactum.terms import ACTIONS, DUTIES, DUTIES_OF, SHARE_ALIKE, TARGETS

_TYPES, _SHARE_ALIKE, _ALL = list(TARGETS), "share_alike", "all"


def _bits(column: str, names: list[str]):
    """An integer with a bit for each of the names; 0 for any other value."""
    out = F.lit(0)
    for i, n in enumerate(names):
        out = F.when(F.col(column) == n, 1 << i).otherwise(out)
    return out


def _rows(titles: DataFrame, targets: DataFrame, rules: DataFrame, rule_duties: DataFrame, wide_duties: DataFrame) -> DataFrame:
    """id, facet."""
    assets = targets.groupBy("id", "asset").agg(F.bit_or(_bits("asset_type", list(TARGETS.values()))).alias("m"))
    out = assets.select("id", F.concat(F.lit("asset:"), F.col("m").cast("string")).alias("facet"))
    known = rules.filter(F.col("action").isin(*ACTIONS.values()))
    held = rule_duties.groupBy("id", "node").agg(F.collect_set("duty").alias("duties"))
    allowed = known.filter(F.col("kind") == "permission").select("id", "node", "action").join(held, ["id", "node"], "left")
    mask = F.lit(0)
    for key, action in ACTIONS.items():
        own = F.lit(0)
        for i, d in enumerate(DUTIES_OF.get(key, ())):
            own = own + F.when(F.array_contains("duties", DUTIES[d]), 1 << i).otherwise(0)
        mask = F.when(F.col("action") == action, own).otherwise(mask)
    out = out.unionByName(allowed.select("id", F.concat(F.lit("permitted:"), "action", F.lit(":"), mask.cast("string")).alias("facet")))
    out = out.unionByName(known.filter(F.col("kind") == "prohibition").select("id", F.concat(F.lit("prohibited:"), "action").alias("facet")))
    out = out.unionByName(wide_duties.filter(F.col("action") == SHARE_ALIKE).select("id", F.lit(_SHARE_ALIKE).alias("facet")))
    return out.unionByName(titles.select("id", F.lit(_ALL).alias("facet")))


def clauses(facets: Facets) -> list[list[str]]:
    """An AND of ORs of facet values."""
    yes = sum(1 << i for i, k in enumerate(_TYPES) if facets.targets.get(k, "yes") == "yes")
    no = ((1 << len(_TYPES)) - 1) & ~yes
    out = [[_ALL], [f"asset:{m}" for m in range(1 << len(_TYPES)) if (m & yes or not yes) and not m & no]]
    for key, state in facets.actions.items():
        if state == "prohibited":
            out.append([f"prohibited:{ACTIONS[key]}"])
        elif state == "permitted":
            own = DUTIES_OF.get(key, ())
            wanted = sum(1 << i for i, d in enumerate(own) if facets.duties.get(f"{key}_duty_{d}") == "required")
            out.append([f"permitted:{ACTIONS[key]}:{m}" for m in range(1 << len(own)) if m & wanted == wanted])
    if facets.share_alike == "required":
        out.append([_SHARE_ALIKE])
    return out


def further(facets: Facets) -> dict[str, Facets]:
    """What may be chosen next, by name, each with the facets as they would be then. Each is narrower than the present ones."""
    out = {}
    for t in TARGETS:
        if facets.targets.get(t, "yes") == "yes":
            out[f"{t}=no"] = replace(facets, targets=facets.targets | {t: "no"})
    for a in ACTIONS:
        state = facets.actions.get(a, "na")
        if state == "na":
            out[f"{a}=prohibited"] = replace(facets, actions=facets.actions | {a: "prohibited"})
        if state != "prohibited":
            allowed = facets.actions | {a: "permitted"}
            if state == "na":
                # duties of an action that isn't permitted don't count, so none is carried over
                out[f"{a}=permitted"] = replace(facets, actions=allowed, duties=_without(facets, a))
            for d in DUTIES_OF.get(a, ()):
                name = f"{a}_duty_{d}"
                if state == "na" or facets.duties.get(name) != "required":
                    kept = facets.duties if state == "permitted" else _without(facets, a)
                    out[name] = replace(facets, actions=allowed, duties=kept | {name: "required"})
    if facets.share_alike != "required":
        out[_SHARE_ALIKE] = replace(facets, share_alike="required")
    return out


def _without(facets: Facets, action: str) -> dict[str, str]:
    return {k: v for k, v in facets.duties.items() if not k.startswith(f"{action}_duty_")}


class FacetIndex:
    """The index below a folder: `licences` (id, title, number, bucket, place) and `bitmaps` (facet, bucket, bits)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, titles: DataFrame, targets: DataFrame, rules: DataFrame, rule_duties: DataFrame, wide_duties: DataFrame, folder: str | None = None) -> FacetIndex:
        """An id with several titles is one licence of several rows; what has no title isn't found, as in faceted_search."""
        spark = titles.sparkSession
        index = cls(spark, folder or stage_folder(spark))
        ids = numbered(titles.select("id").distinct(), ["id"]).withColumn("number", F.col("number") + 1)  # bitmaps count from 1
        ids = ids.withColumns({"bucket": F.bitmap_bucket_number("number"), "place": F.bitmap_bit_position("number")})
        titles.select("id", "title").distinct().join(ids, "id").write.mode("overwrite").parquet(f"{index.folder}/licences")
        own = index.licences.select("id", "bucket", "place").distinct()
        rows = _rows(titles, targets, rules, rule_duties, wide_duties).join(own, "id")
        bitmaps = rows.groupBy("facet", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
        bitmaps.repartitionByRange("bucket").sortWithinPartitions("bucket", "facet").write.mode("overwrite").parquet(f"{index.folder}/bitmaps")
        return index

    @property
    def licences(self) -> DataFrame:
        return self.spark.read.schema("id string, title string, number long, bucket long, place long").parquet(f"{self.folder}/licences")

    @property
    def bitmaps(self) -> DataFrame:
        return self.spark.read.schema("facet string, bucket long, bits binary").parquet(f"{self.folder}/bitmaps")

    def _meeting(self, choices: dict[str, list[list[str]]]) -> DataFrame:
        """choice, bucket, bits of the licences that meet all clauses of each choice, in one pass over the bitmaps they name."""
        table = F.lit(None).cast("array<struct<choice: string, clause: int>>")
        places: dict[str, list] = {}
        for name, parts in choices.items():
            for i, values in enumerate(parts):
                for v in values:
                    places.setdefault(v, []).append((name, i))
        for v, where in places.items():
            table = F.when(F.col("facet") == v, F.array(*[F.struct(F.lit(n).alias("choice"), F.lit(i).alias("clause")) for n, i in where])).otherwise(table)
        rows = self.bitmaps.filter(F.col("facet").isin(*places)).select(F.explode(table).alias("x"), "bucket", "bits")
        one = rows.groupBy("x.choice", "x.clause", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        need = F.lit(0)
        for name, parts in choices.items():
            need = F.when(F.col("choice") == name, len(parts)).otherwise(need)
        met = one.groupBy("choice", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        # a clause without a licence in the bucket has no row
        return met.filter(F.col("n") == need).select("choice", "bucket", "bits")

    def search(self, facets: Facets) -> DataFrame:
        """id (https), title, by title: as faceted_search has it."""
        found = self._meeting({"": clauses(facets)}).select("bucket", "bits")
        byte = F.conv(F.hex(F.substr("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = self.licences.join(found, "bucket").filter(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1)
        return rows.select(F.replace("id", F.lit("http:"), F.lit("https:")).alias("id"), "title").distinct().orderBy("title")

    def counts(self, facets: Facets) -> DataFrame:
        """choice, n: how many licences each further choice leaves, and '' for the present ones; exact.

        A choice is narrower than the present facets, so its own changed clauses are met with what is found already.
        """
        now = clauses(facets)
        choices = {"": now}
        for name, then in further(facets).items():
            choices[name] = [c for c in clauses(then) if c not in now] or now
        parts = self._meeting(choices)
        names = F.array(*[F.lit(n) for n in choices if n])
        found = parts.filter("choice = ''")
        both = parts.filter("choice <> ''").unionByName(found.select(F.explode(names).alias("choice"), "bucket", "bits"))
        both = both.groupBy("choice", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter("n = 2")
        every = self.spark.createDataFrame([(n,) for n in choices], "choice string")
        n = found.unionByName(both.select("choice", "bucket", "bits")).groupBy("choice").agg(F.sum(F.bitmap_count("bits")).alias("n"))
        return every.join(n, "choice", "left").select("choice", F.coalesce("n", F.lit(0)).alias("n"))
