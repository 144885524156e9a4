"""Scalar functions, all as Spark expressions but for the fuzzy ratio."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pactum.terms import ACRONYMS


def curie_expand(curie: Column, prefixes: dict[str, str]) -> Column:
    """IRI of a compact name; null for an unknown prefix."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.concat(F.try_element_at(table, F.split_part(curie, F.lit(":"), F.lit(1))), F.split_part(curie, F.lit(":"), F.lit(2)))


def camel_split(value: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """A blank before each capital after a small letter, not inside an acronym."""
    for i, a in enumerate(acronyms):
        value = F.replace(value, F.lit(a), F.lit(f"\x01{i}\x01"))
    value = F.regexp_replace(value, "(?<=[a-z])([A-Z])", " $1")
    for i, a in enumerate(acronyms):
        value = F.replace(value, F.lit(f"\x01{i}\x01"), F.lit(a))
    return value


def local_label(iri: Column) -> Column:
    """What follows the last '#', '/' or ':', with camel case split."""
    return camel_split(F.regexp_extract(iri, r"([^#/:]*)$", 1))


def date_valid(value: Column) -> Column:
    """Whether it is an ISO date; null counts as no."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def repository(url: Column) -> Column:
    """struct(owner, name) of a repository address; null without an owner and a name."""
    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), r"^[a-z]+://[^/]+/", "")
    return F.when(path.contains("/"), F.struct(F.split_part(path, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(path, F.lit("/"), F.lit(2)).alias("name")))


def quoted_concat(*parts: Column) -> Column:
    """Parts joined inside one pair of quotes if any part is quoted, else plainly."""
    bare = F.concat(*[F.replace(p, F.lit('"'), F.lit("")) for p in parts])
    quoted = F.lit(False)
    for p in parts:
        quoted = quoted | p.contains('"')
    return F.when(quoted, F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(bare)


def strip_quotes(value: Column) -> Column:
    return F.regexp_replace(value, '^"+|"+$', "")


def strip_element(value: Column) -> Column:
    """An element of a written-out term, bare: closing parentheses after it go, then quotes around it."""
    return strip_quotes(F.regexp_replace(value, r"\)+$", ""))


def ratio(a: str, b: str) -> int:
    """100 * twice the longest common subsequence over both lengths, rounded half to even; 100 for two empty strings.

    The subsequence is found on bit vectors, one machine operation for a row of the table.
    """
    if not a and not b:
        return 100
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return round(200 * common / (len(a) + len(b)))


@F.pandas_udf(IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() of the lower-cased strings; null for a null."""
    return pd.Series([None if x is None or y is None else ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="Int32")


def prefix_match(text: Column, prefix: str) -> Column:
    """Whether a word of the text begins with the prefix, whatever the case; one pass, without a list of its words."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(prefix)}")
