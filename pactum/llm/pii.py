"""Personal data by weak supervision (native): Spark expressions only.

Spans come from two sets of patterns: the contract's, whose matches that pass are given, and looser ones, which also see data that
a longer failing match swallowed, or that is written in other ways. Every span gets votes (yes, no, or none) by labelers:

* shape: is it written as its kind usually is,
* check: does the arithmetic hold (Luhn, parts up to 255, number of digits, a last label of letters),
* gazetteer: is a value's known part in a list (top-level domains, country codes, issuers, reserved networks),
* cue: is a word beside it that goes with its kind, or one that goes with other numbers,
* bounds: does it stand by itself.

Expectation-maximisation estimates how often each labeler says yes to true and to false spans of a kind, with the contract's spans
known to be true. What it believes of each span then trains a logistic classifier on votes and writing, which decides about
spans that the contract doesn't have. Spans that look alike to both are counted together first, so both work on a table whose
size is bounded by the votes and features there are; the fits are folds over that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, session, shared_folder, written

#: In the contract's order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The contract's patterns, so written that no text takes more than linear time: runs are taken whole, and a match can only begin
# where a run or the last match's rest does.
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:@|[ ]?[(\[{][ ]?(?:@|at)[ ]?[)\]}][ ]?|[ ]at[ ])", r"(?:\.|[ ]?[(\[{][ ]?(?:\.|dot|punkt|punto|point)[ ]?[)\]}][ ]?|[ ]dot[ ])"
_OCTET = r"[0-9]{1,3}"
LOOSE_PATTERNS = (
    rf"(?i)(?<![{_LOCAL}@])[{_LOCAL}]{{1,64}}+{_AT}(?:[A-Za-z0-9-]{{1,63}}+{_DOT}){{1,4}}[A-Za-z]{{2,24}}(?![A-Za-z0-9@-])",
    rf"(?<![0-9A-Za-z.:])(?:{_OCTET}(?:(?:\.|\[\.\]|\(\.\)){_OCTET}){{3}}|(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}})(?![0-9A-Za-z:]|\.[0-9])",
    r"(?<![0-9A-Za-z])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.+(-])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
)

#: Characters of context before and behind a span that labelers see.
BEFORE, BEHIND = 40, 20

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io eu uk us ca de at ch fr be nl lu es pt it pl cz se no dk fi ie mx ar br cl co jp cn in au nz za".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421".split()
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[0-9]|6011|62|64[4-9]|65)"
RESERVED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\."
CUES = (
    "mail email e-mail contact write kontakt schreib courriel correo contacto",
    "ip address host server client adresse dirección hôte",
    "card credit visa mastercard karte kreditkarte carte tarjeta",
    "phone tel telephone call mobile cell fax telefon handy anruf téléphone portable teléfono móvil",
)
OTHER_CUES = "token hash sha md5 key version release isbn issn order invoice sku part id nr bestellung rechnung commande facture pedido factura"

LABELERS, VOTES = ("shape", "check", "gazetteer", "cue", "bounds"), 5
ROUNDS, STEPS = 40, 200
#: Before any span is seen, a labeler (in their order) says yes to so many of the true spans it votes on and of the false ones. The
#: arithmetic rarely fails a true one, and passes a tenth of the false; a shape or a gap beside a span is had by many false ones.
PRIOR_TRUE, PRIOR_FALSE = (0.8, 0.99, 0.8, 0.9, 0.95), (0.5, 0.1, 0.4, 0.1, 0.5)
#: Spans that the priors weigh as much as.
PRIOR_WEIGHT = 10.0
RIDGE = 1e-3
#: Spans that the contract doesn't have are given from this score on.
THRESHOLD = 0.9


def _hits(text: Column, pattern: str, possible: Column) -> Column:
    """value, gap (characters since the last match), size, left, right of each match, in order."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest"))
    each = lambda b: lambda x, i: F.struct(
        x.alias("value"),
        F.char_length(F.get(b.rest, i)).alias("gap"),
        F.char_length(x).alias("size"),
        F.right(F.get(b.rest, i), F.lit(BEFORE)).alias("left"),
        F.left(F.get(b.rest, i + 1), F.lit(BEHIND)).alias("right"),
    )
    return F.when(possible, _let(both, lambda b: F.transform(b.found, each(b))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: Column, value: Column) -> Column:
    """Whether a match of the contract's pattern counts."""
    octets = F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.char_length(_digits(value))
    return F.when(kind == EMAIL, True).when(kind == IP, octets).when(kind == CARD, n.between(16, 19) & F.call_function("luhn_check", F.when(n <= 19, _digits(value)))).otherwise(n.between(8, 15))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _any_word(text: Column, words: str) -> Column:
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words.split())})(?![\p{{L}}\p{{N}}_])")


def _voted(spans: DataFrame) -> DataFrame:
    """Adds votes (in the order of LABELERS) and features (0 or 1)."""
    kind, value, left, right = (F.col(c) for c in ("kind", "value", "left", "right"))
    by_kind = lambda *cases: reduce(lambda x, kc: x.when(kind == kc[0], kc[1]), enumerate(cases), F)
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), rf"(?i){_AT}", "@"), rf"(?i){_DOT}", ".")
    digits = _digits(value)
    n = F.char_length(digits)
    code = F.regexp_extract(value, r"^(?:\+|00)([0-9]{1,3})(?![0-9])", 1)
    octets = F.regexp_replace(value, r"[\[\]()]", "")
    v6 = value.contains(":")
    shape = by_kind(
        _vote(value.contains("@") & (F.char_length(value) <= 254), F.lit(False)),
        _vote(value.rlike(r"^[0-9.]+$"), F.lit(False)),
        _vote(value.rlike(r"^(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.lit(False)),
        _vote(value.rlike(r"^\+|\("), ~value.rlike(r"[ ().-]")),
    )
    check = by_kind(
        _vote(plain.rlike(r"^[^@]+@[^@]+\.[a-z]{2,24}$"), F.lit(True)),
        _vote(v6 | _passes(F.lit(IP), octets), F.lit(True)),
        _vote(_passes(F.lit(CARD), value), F.lit(True)),
        _vote(n.between(9, 13), F.lit(True)),
    )
    tail = F.substring_index(plain, ".", -1)
    gazetteer = by_kind(
        _vote(tail.isin(*DOMAINS), F.lit(True)),
        _vote(~v6 & ~octets.rlike(RESERVED), ~v6),
        _vote(digits.rlike(ISSUERS), F.lit(False)),
        _vote(code.isin(*COUNTRY_CODES), code != ""),
    )
    near = F.concat(left, F.lit(" "), right)
    cue = _vote(by_kind(*[_any_word(near, w) for w in CUES]), _any_word(left, OTHER_CUES))
    inside = left.rlike(r"[\p{L}\p{N}_=/]$") | right.rlike(r"^[\p{L}\p{N}_=/]")
    bounds = _vote(~inside, inside)
    space = lambda c, at: c.rlike(rf"^\s*$|{at}")
    votes = F.array(shape, check, gazetteer, cue, bounds)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    features = F.concat(
        F.array(F.lit(1)),
        F.flatten(F.transform(votes, lambda v: F.array((v == 1).cast("int"), (v == -1).cast("int")))),
        F.array(one(value.rlike(r"[ ().\[\]-]")), one(space(left, r"\s$")), one(space(right, r"^\s")), one(right.rlike(r"^[.,;:!?]?(?:\s|$)"))),
    )
    return spans.withColumns({"votes": votes, "features": features})


FEATURES = 1 + 2 * VOTES + 4


def _numbers(xs) -> Column:
    return F.array(*map(F.lit, xs))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda x, r: x + of(r))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def believed(table: Column) -> Column:
    """EM over table (array of known, votes, features, n): the same rows with `truth`, the chance that they are true spans."""
    labelers = F.sequence(F.lit(0), F.lit(VOTES - 1))

    def truth(m: Column, r: Column) -> Column:
        said = F.transform(r.votes, lambda v, j: F.when(v == 1, F.ln(F.get(m.t, j) / F.get(m.u, j))).when(v == -1, F.ln((1 - F.get(m.t, j)) / (1 - F.get(m.u, j)))).otherwise(0.0))
        return F.when(r.known, 1.0).otherwise(_sigmoid(F.ln(m.prior / (1 - m.prior)) + _sum(said, lambda x: x)))

    def step(m: Column, _) -> Column:
        weighed = F.transform(table, lambda r: _let(truth(m, r), lambda q: F.struct((r.n * q).alias("w1"), (r.n * (1 - q)).alias("w0"), r.votes.alias("votes"), F.when(r.known, 0.0).otherwise(r.n).alias("open"))))

        def rates(rows: Column, w: str, prior: tuple[float, ...]) -> Column:
            yes = lambda j: _sum(rows, lambda r: F.when(F.get(r.votes, j) == 1, r[w]).otherwise(0.0))
            any_ = lambda j: _sum(rows, lambda r: F.when(F.get(r.votes, j) != 0, r[w]).otherwise(0.0))
            return F.transform(labelers, lambda j: (yes(j) + PRIOR_WEIGHT * F.get(_numbers(prior), j)) / (any_(j) + PRIOR_WEIGHT))

        def model(rows: Column) -> Column:
            # known spans are chosen by the contract's rules, so they don't tell how many of the others are true
            true, every = _sum(rows, lambda r: F.when(r.open > 0, r.w1).otherwise(0.0)), _sum(rows, lambda r: r.open)
            return F.struct(((true + 1) / (every + 2)).alias("prior"), rates(rows, "w1", PRIOR_TRUE).alias("t"), rates(rows, "w0", PRIOR_FALSE).alias("u"))

        return _let(weighed, model)

    start = F.struct(F.lit(0.5).alias("prior"), _numbers(PRIOR_TRUE).alias("t"), _numbers(PRIOR_FALSE).alias("u"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(end, lambda m: F.transform(table, lambda r: F.struct(r.features.alias("features"), r.n.alias("n"), truth(m, r).alias("truth"))))


def _dot(w: Column, f: Column) -> Column:
    return _sum(F.zip_with(w, f, lambda a, b: a * b), lambda x: x)


def fitted(table: Column) -> Column:
    """Weights of a logistic classifier of `truth` (array of features, n, truth); each step lowers a bound of the loss."""
    total = _sum(table, lambda r: r.n)
    each = F.sequence(F.lit(0), F.lit(FEATURES - 1))
    seen = F.transform(each, lambda j: _sum(table, lambda r: r.n * F.get(r.features, j)))
    active = 1 + VOTES + 4  # features that a span has at once, at most

    def step(s: Column, _) -> Column:
        missed = F.transform(table, lambda r: F.struct(r.features.alias("f"), (r.n * (_sigmoid(_dot(s.w, r.features)) - r.truth)).alias("e")))
        grown = lambda rows: F.transform(each, lambda j: F.get(s.w, j) - (_sum(rows, lambda r: r.e * F.get(r.f, j)) + RIDGE * s.total * F.get(s.w, j)) / (active / 4 * F.get(s.seen, j) + RIDGE * s.total))
        return F.struct(_let(missed, grown).alias("w"), s.seen.alias("seen"), s.total.alias("total"))

    start = F.struct(F.transform(each, lambda _: F.lit(0.0)).alias("w"), seen.alias("seen"), total.alias("total"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s.w)


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id and for each pattern its matches; rows are numbered, as ids may be null or repeated."""
    text = F.col("text")
    some = {EMAIL: (text.contains("@"), text.rlike(r"@|(?i)[(\[{ ]at[)\]} ]")), IP: (text.contains("."), text.rlike("[0-9][.:\\[(]"))}
    number = text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    some |= {CARD: (number, text.rlike("[0-9]{4}")), PHONE: (text.contains("+"), text.rlike("[0-9]{3}"))}
    columns = [_hits(text, p, some[k][i]).alias(f"{name}{k}") for i, (name, patterns) in enumerate((("base", BASE_PATTERNS), ("loose", LOOSE_PATTERNS))) for k, p in enumerate(patterns)]
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns)


def _spans(found: DataFrame) -> DataFrame:
    """row, kind, known, start, end, value, left, right: the contract's spans, and loose ones that touch none of those."""
    parts = []
    for k in range(len(KINDS)):
        for name in ("base", "loose"):
            x = found.select("row", F.posexplode(f"{name}{k}").alias("i", "x"))
            parts.append(x.select("row", F.lit(k).alias("kind"), F.lit(name == "base").alias("known"), "i", "x.*"))
    rows = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("row", "kind", "known").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one text's
    end = (F.sum("gap").over(w) + F.sum("size").over(w)).cast("long")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("i", "gap", "size")
    rows = rows.filter(~F.col("known") | _passes(F.col("kind"), F.col("value")))
    # both run along one text: the furthest end of a given span that began before, and the nearest begin of one that comes
    reach = F.max(F.when(F.col("known"), F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    coming = F.min(F.when(F.col("known"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc()))
    rows = rows.withColumns({"reach": reach, "coming": coming})
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("coming").isNull() | (F.col("coming") >= F.col("end")))
    return rows.filter(F.col("known") | free).drop("reach", "coming")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans (array of kind, start, end, given, score; code points, end exclusive): one row for each row of docs.

    given: whether the span is one of the contract's. spans are ordered by kind, then start; added ones never touch given ones. A null
    or empty text has none. Null and repeated doc_ids keep their rows. Texts of any length are read whole. An empty table gives
    no rows; a kind without spans has no model. Other columns are not read.
    """
    spark = session(docs)
    folder = shared_folder(spark)
    found = written(_found(id_text(docs, id_col, text_col)), folder, "matches")
    spans = written(_voted(_spans(found)), folder, "spans").drop("value", "left", "right")
    # bounded by the votes and features that there are, whatever the number of spans
    alike = spans.groupBy("kind", "known", "votes", "features").agg(F.count("*").cast("double").alias("n"))
    tables = alike.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("known", "votes", "features", "n"))).alias("t"))
    tables = written(tables.select("kind", believed(F.col("t")).alias("t")), folder, "beliefs")
    weights = {r.kind: r.w for r in tables.select("kind", fitted(F.col("t")).alias("w")).collect()}  # a row for each kind
    score = F.lit(0.0)
    for k, w in sorted(weights.items()):
        score = F.when(F.col("kind") == k, _sigmoid(_dot(_numbers(w), F.col("features")))).otherwise(score)
    scored = spans.withColumn("score", score).filter(F.col("known") | (F.col("score") >= threshold))
    span = F.struct("kind", "start", "end", F.col("known").alias("given"), "score")
    per = scored.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    out = found.select("row", "doc_id").join(per, "row", "left")
    named = F.transform("spans", lambda s: F.struct(F.get(names, s.kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.given.alias("given"), s.score.alias("score")))
    none = F.array().cast("array<struct<kind: string, start: long, end: long, given: boolean, score: double>>")
    return out.select("doc_id", F.coalesce(named, none).alias("spans"))


def op12_pii(spark, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.given)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
