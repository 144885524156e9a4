"""Keyword search over titles and alternative titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.scalar import fuzzy_ratio


def with_alternatives(titles: DataFrame, alternatives: DataFrame) -> DataFrame:
    """id, title, alt: a row for each alternative title, or one with a null."""
    return titles.join(alternatives, "id", "left")


def keyword_condition(title: Column, alt: Column, keyword: str) -> Column:
    """Every term matches the title or the alternative of the same row; terms are regular expressions, in any case, anywhere.

    A null alternative matches nothing by itself (the condition stays unknown, and a filter drops it).
    """
    terms = keyword.split()
    if not terms:
        return F.lit(True)
    return reduce(Column.__and__, [title.rlike(f"(?i){t}") | alt.rlike(f"(?i){t}") for t in terms])


def list_licenses(titles: DataFrame, alternatives: DataFrame, keyword: str = "", skip: int = 0, limit: int | None = None) -> DataFrame:
    """id, title, and with a keyword score (0 to 100), best first and then by id; without one, by id if skip or limit picks from them."""
    found = titles
    if keyword.split():
        found = with_alternatives(titles, alternatives).filter(keyword_condition(F.col("title"), F.col("alt"), keyword)).select("id", "title").distinct()
        found = found.withColumn("score", fuzzy_ratio("title", F.lit(keyword))).orderBy(F.col("score").desc(), "id")
    elif skip or limit is not None:
        found = found.orderBy("id")
    if skip:
        found = found.offset(skip)
    return found if limit is None else found.limit(limit)
