"""Auditing a repository's dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.operators.compat import _reaching, conflicts
from pactum.plans.numbering import numbered
from pactum.plans.stage import small, staged

#: Words of a mask that are compared one by one in an expression; more are folded.
_UNROLLED = 8

DOCUMENT = "full_name string, language string, dependencies array<struct<name string, normalized_licenses array<string>>>"


def read_documents(json_text: DataFrame, column: str = "value") -> DataFrame:
    """Repository documents from JSON text; what can't be parsed becomes nulls."""
    return json_text.select(F.from_json(column, DOCUMENT).alias("d")).select("d.*")


def dependency_licenses(documents: DataFrame) -> DataFrame:
    """repo, dependency, license: a row for each licence of a dependency that has any."""
    each = documents.select(F.col("full_name").alias("repo"), F.explode("dependencies").alias("d"))
    each = each.filter(F.size(F.coalesce("d.normalized_licenses", F.array().cast("array<string>"))) > 0)
    return each.select("repo", F.col("d.name").alias("dependency"), F.explode("d.normalized_licenses").alias("license"))


def resolve(found: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds license_id; null where the library doesn't have the licence. found: repo, dependency, license (its id)."""
    known = titles.select(F.col("id").alias("license_id"))
    return found.join(known, found["license"] == known["license_id"], "left").select("repo", "dependency", "license", "license_id")


def repository_conflicts(resolved: DataFrame, stmts: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """Conflicts among each repository's licences, all repositories at once; unknown licences take no part.

    The repositories' statements are computed once, as both sides of the conflicts need them.
    """
    used = resolved.filter(F.col("license_id").isNotNull()).select("repo", F.col("license_id").alias("id")).distinct()
    return conflicts(staged(used.join(stmts, "id").select("repo", "id", "kind", "action")), dep_edges, within="repo")


def _licence_masks(stmts: DataFrame, dep_edges: DataFrame) -> tuple[DataFrame, int, int]:
    """id, allowed, met; words, layers. Actions are numbered, and a set of them is a mask of so many words of 64 bits.

    allowed: what the licence permits. met: for each layer j, the permitted actions that meet a number of its prohibitions with the
    binary digit j, as words; then those that meet any.
    """
    stmts = staged(stmts.select("id", "kind", "action").distinct())
    number = staged(numbered(stmts.select(F.col("action").alias("a1")).distinct(), ["a1"], "n"))
    meets = staged(_reaching(number, dep_edges).groupBy("a1", "n", "a2").agg(F.count("*").alias("times")))
    words = max(1, -(-number.count() // 64))
    layers = int(meets.groupBy("a1").agg(F.sum("times").alias("t")).agg(F.max("t")).first()[0] or 0).bit_length()
    bit, word = F.expr("shiftleft(1L, CAST(n % 64 AS INT))"), F.floor(F.col("n") / 64).cast("int").alias("w")

    def by_word(rows: DataFrame, masks: list, name: str) -> DataFrame:
        """id and its masks, one after the other, as an array."""
        none = F.array(*[F.lit(0).cast("long")] * len(masks))
        held = rows.groupBy("id", word).agg(F.array(*map(F.bit_or, masks)).alias("m")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("m", w), none))
        return held.select("id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), lambda j: F.transform(dense, lambda m: F.get(m, j)))).alias(name))

    of = lambda kind, a: stmts.filter(F.col("kind") == kind).select("id", F.col("action").alias(a)).repartition("id")
    allowed = by_word(of("permission", "a1").join(small(number), "a1"), [bit], "allowed")
    counted = of("prohibition", "a2").join(small(meets), "a2").groupBy("id", "n").agg(F.sum("times").alias("times"))
    digit = [F.when(F.col("times").bitwiseAND(F.lit(1 << j)) != 0, bit).otherwise(F.lit(0).cast("long")) for j in range(layers)]
    return allowed.join(by_word(counted, [*digit, bit], "met"), "id", "full"), words, layers


def repository_conflict_counts(resolved: DataFrame, stmts: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """repo, id1, id2, n_conflicts, n_actions: how many conflicts each pair of a repository's licences has, without a row for each.

    What meets a licence's prohibitions is worked out once for each licence, and not for each repository or pair, as masks of
    actions. A repository then has a row for each of its licences, and a pair is counted by the bits that two rows share.
    """
    used = resolved.filter(F.col("license_id").isNotNull()).select("repo", F.col("license_id").alias("id")).distinct()
    masks, words, layers = _licence_masks(stmts, dep_edges)
    used = used.join(masks, "id")
    one = used.filter("allowed IS NOT NULL").select("repo", F.col("id").alias("id1"), "allowed")
    two = used.filter("met IS NOT NULL").select("repo", F.col("id").alias("id2"), "met")

    def shared(j: int) -> Column:
        if words <= _UNROLLED:
            return sum((F.bit_count(F.get("allowed", F.lit(w)).bitwiseAND(F.get("met", F.lit(j * words + w)))).cast("long") for w in range(words)), F.lit(0).cast("long"))
        bits = F.zip_with("allowed", F.slice("met", j * words + 1, words), lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda n, x: n + x)

    total = sum((shared(j) * (1 << j) for j in range(layers)), F.lit(0).cast("long"))
    pairs = one.join(two, "repo").select("repo", "id1", "id2", total.alias("n_conflicts"), shared(layers).alias("n_actions"))
    return pairs.filter("n_actions > 0")


def repositories(documents: DataFrame) -> DataFrame:
    """name, language: a row for each document that could be read."""
    return documents.filter(F.col("full_name").isNotNull()).select(F.col("full_name").alias("name"), "language")
