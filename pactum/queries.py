"""The engine's queries over the driver tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.functions import scalar as S
from pactum.operators import audit, compat, facets, profile, search
from pactum.operators.compose import Form, compose
from pactum.operators.facet_index import FacetIndex, further
from pactum.operators.fuzzy import best_titles
from pactum.plans.blank import canonical
from pactum.plans.classes import equivalence_classes
from pactum.plans.closure import Closure, closed_graph, relations
from pactum.plans.fixture import DUTY_VOCABULARY, SQL, Fixture
from pactum.plans.stage import stage_folder
from pactum.sources.text_index import TextIndex
from pactum.sources.turtle import to_ntriples
from pactum.terms import ACTIONS, DERIVED, DERIVED_REASON, DIRECT_REASON, GIVEN, LABELS, PREFIXES, RELATIONS, TARGETS, Vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, prelude: bool = True):
    """Registers a function of a Fixture; sql goes after the fixture's views."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = (SQL if prelude else "") + sql
        return fn

    return add


_join = lambda c: F.array_join(c, ",")
#: The licences of the report, as a request would name them.
REQUEST = ("urn:lic:1", "urn:lic:2", "urn:lic:3", "urn:lic:10", "urn:lic:11")
_REQUEST = ", ".join(f"'{x}'" for x in REQUEST)

# --- graph, statements ------------------------------------------------------------------------------------------------


@query("dep_graph_scan", "SELECT a AS s, rel AS p, b AS o FROM dep_edges")
def _(f):
    return f.dep_edges.select(F.col("a").alias("s"), F.col("rel").alias("p"), F.col("b").alias("o"))


@query("license_statements", "SELECT DISTINCT id, kind, action FROM (SELECT id, kind, action FROM rules UNION ALL SELECT id, 'duty', action FROM wide_duties) WHERE kind IN ('permission', 'prohibition', 'obligation', 'duty')")
def _(f):
    every = f.rules.select("id", "kind", "action").unionByName(f.wide_duties.select("id", F.lit("duty").alias("kind"), "action"))
    return every.filter(F.col("kind").isin("permission", "prohibition", "obligation", "duty")).distinct()


def _triples(f: Fixture) -> DataFrame:
    """s, p, o of the fixture: types, titles, alternatives, statements."""
    return (
        f.titles.select(F.col("id").alias("s"), F.lit("rdf:type").alias("p"), F.lit("odrl:Set").alias("o"))
        .unionByName(f.titles.select(F.col("id").alias("s"), F.lit("dct:title").alias("p"), F.col("title").alias("o")))
        .unionByName(f.alternatives.select(F.col("id").alias("s"), F.lit("dct:alternative").alias("p"), F.col("alt").alias("o")))
        .unionByName(f.targets.select(F.col("asset").alias("s"), F.lit("dct:type").alias("p"), F.col("asset_type").alias("o")))
        .unionByName(f.rules.select(F.col("id").alias("s"), F.concat(F.lit("odrl:"), "kind").alias("p"), F.col("node").alias("o")))
        .unionByName(f.rules.select(F.col("node").alias("s"), F.lit("odrl:action").alias("p"), F.col("action").alias("o")))
    )


_TRIPLES = """, triples(s, p, o) AS (SELECT id, 'rdf:type', 'odrl:Set' FROM titles UNION ALL SELECT id, 'dct:title', title FROM titles
  UNION ALL SELECT id, 'dct:alternative', alt FROM alternatives UNION ALL SELECT asset, 'dct:type', asset_type FROM targets
  UNION ALL SELECT id, concat('odrl:', kind), node FROM rules UNION ALL SELECT node, 'odrl:action', action FROM rules) """


@query("license_sets", _TRIPLES + "SELECT t.s AS id, t.o AS title FROM triples t WHERE t.p = 'dct:title' AND EXISTS (SELECT 1 FROM triples x WHERE x.s = t.s AND x.p = 'rdf:type' AND x.o = 'odrl:Set')")
def _(f):
    t = _triples(f)
    sets = t.filter((F.col("p") == "rdf:type") & (F.col("o") == "odrl:Set")).select("s")
    return t.filter(F.col("p") == "dct:title").join(sets, "s", "left_semi").select(F.col("s").alias("id"), F.col("o").alias("title"))


@query("rule_actions", _TRIPLES + "SELECT a.s AS id, a.p AS kind, b.o AS action, count(*) AS n_nodes FROM triples a JOIN triples b ON a.o = b.s WHERE a.p IN ('odrl:permission', 'odrl:prohibition') AND b.p = 'odrl:action' GROUP BY ALL")
def _(f):
    t = _triples(f)
    owned = t.filter(F.col("p").isin("odrl:permission", "odrl:prohibition")).select(F.col("s").alias("id"), F.col("p").alias("kind"), F.col("o").alias("node"))
    acts = t.filter(F.col("p") == "odrl:action").select(F.col("s").alias("node"), F.col("o").alias("action"))
    return owned.join(acts, "node").groupBy("id", "kind", "action").agg(F.count("*").alias("n_nodes"))


@query("graph_union", ", g(s, p, o) AS (SELECT a, rel, b FROM dep_edges UNION SELECT id, kind, action FROM stmts UNION SELECT id, kind, action FROM stmts WHERE kind = 'permission') SELECT s, p, o FROM g")
def _(f):
    quads = f.dep_edges.select(F.lit("deps").alias("g"), F.col("a").alias("s"), F.col("rel").alias("p"), F.col("b").alias("o"))
    lib = f.stmts.select(F.lit("library").alias("g"), F.col("id").alias("s"), F.col("kind").alias("p"), F.col("action").alias("o"))
    own = lib.filter("p = 'permission'").withColumn("g", F.lit("custom"))
    return quads.unionByName(lib).unionByName(own).drop("g").distinct()


@query("ntriples_format", """SELECT concat('<', id, '> <urn:p:', kind, '> "', replace(replace(action, '\\', '\\\\'), '"', '\\"'), '" .') AS value FROM stmts
  UNION ALL SELECT concat('<', id, '> <http://purl.org/dc/terms/title> "', replace(replace(title, '\\', '\\\\'), '"', '\\"'), '"@en .') FROM titles""")
def _(f):
    none = F.lit(None).cast("string")
    of = lambda df, s, p, o, lang: df.select(F.col(s).alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), F.col(o).alias("o"), F.lit("literal").alias("o_kind"), lang.alias("o_lang"), none.alias("o_dt"))
    return to_ntriples(of(f.stmts, "id", F.concat(F.lit("urn:p:"), "kind"), "action", none).unionByName(of(f.titles, "id", F.lit(PREFIXES["dct"] + "title"), "title", F.lit("en"))))


@query("license_describe", _TRIPLES + "SELECT s, p, string_agg(o, '|' ORDER BY o) AS objects FROM (SELECT DISTINCT s, p, o FROM triples) GROUP BY s, p")
def _(f):
    return _triples(f).groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_set("o")), "|").alias("objects"))


# --- closures and conflicts -------------------------------------------------------------------------------------------


def _closure(kind: str):
    return lambda f: relations(f.dep_edges, (kind,))


for _name, _kind in (("closure_includedin", "odrl:includedIn"), ("closure_implies", "odrl:implies"), ("closure_sameas", "owl:sameAs")):
    query(_name, f"SELECT a, rel, b, r FROM rels WHERE rel = '{_kind}'")(_closure(_kind))


@query("dep_graph_closed", "SELECT DISTINCT a, rel, b FROM (SELECT a, rel, b FROM rels WHERE a <> b UNION ALL SELECT a, rel, b FROM dep_edges WHERE rel = 'lic:contradicts')")
def _(f):
    return closed_graph(f.dep_edges, RELATIONS)


def _orders(f: Fixture) -> DataFrame:
    """Each order and the next one of the same customer, as edges; key is the next one's."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = f.table("orders").select(F.lag("o_orderkey").over(w).alias("a"), F.col("o_orderkey").alias("key")).filter("a IS NOT NULL")
    return e.select(F.col("a").cast("string").alias("a"), F.col("key").cast("string").alias("b"), F.lit("odrl:includedIn").alias("rel"), "key")


_ORDERS = "WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, sum(CASE WHEN {} THEN 1 ELSE 0 END) OVER w AS g, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT CAST(x.k AS VARCHAR) AS a, CAST(y.k AS VARCHAR) AS b, {} FROM o x JOIN o y ON x.c = y.c AND x.g = y.g AND x.k < y.k"


@query("closure_orders", _ORDERS.format("false", "'odrl:includedIn' AS rel, CASE WHEN y.i = x.i + 1 THEN 'dependencygraph' ELSE 'derived' END AS r"), prelude=False)
def _(f):
    return relations(_orders(f), ("odrl:includedIn",))


@query("closure_changes", _ORDERS.format("o_orderkey % 40 = 1", "'odrl:includedIn' AS rel"), prelude=False)
def _(f):
    e = _orders(f)
    closure = Closure(e.filter("key % 40 <> 0"))
    closure.insert(e.filter("key % 40 = 0"))
    closure.delete(e.filter("key % 40 = 1"))
    return closure.pairs


def _same_clients(f: Fixture) -> DataFrame:
    """Clients and what makes two of them one: a master, or an address. Names are padded, so their order is that of the numbers."""
    c, name = f.table("clients"), lambda x: F.concat(F.lit("c:"), F.lpad(F.col(x).cast("string"), 20, "0"))
    own = c.select(name("client_id").alias("a"), name("client_id").alias("b"))
    return own.unionByName(c.select(name("client_id").alias("a"), name("master_id").alias("b"))).unionByName(c.select(name("client_id").alias("a"), F.concat(F.lit("m:"), "email").alias("b")))


@query(
    "same_clients",
    """WITH RECURSIVE e AS (SELECT client_id AS a, master_id AS b FROM clients WHERE master_id IS NOT NULL UNION SELECT x.client_id, y.client_id FROM clients x JOIN clients y ON x.email = y.email),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, c) AS (SELECT client_id, client_id FROM clients WHERE client_id IS NOT NULL UNION SELECT b.b, r.c FROM r JOIN b ON r.a = b.a)
SELECT a AS client_id, min(c) AS representative FROM r GROUP BY a""",
    prelude=False,
)
def _(f):
    number = lambda x: F.substr(x, F.lit(3)).cast("long")
    return equivalence_classes(_same_clients(f)).filter(F.startswith("node", F.lit("c:"))).select(number("node").alias("client_id"), number("representative").alias("representative"))


_SIDES = ", allow AS (SELECT DISTINCT id AS id1, action AS a1 FROM stmts WHERE kind = 'permission'), deny AS (SELECT DISTINCT id AS id2, action AS a2 FROM stmts WHERE kind = 'prohibition') "


@query("conflict_direct", _SIDES + "SELECT id1, a1, count(*) AS n_conflicts, min(id2) AS first_id FROM allow JOIN deny ON a1 = a2 GROUP BY id1, a1")
def _(f):
    return compat.conflict_counts(f.stmts, f.dep_edges).filter("rel IS NULL").select("id1", "a1", "n_conflicts", "first_id")


@query("conflict_derived", _SIDES + ", n AS (SELECT a2, count(*) AS n_conflicts, min(id2) AS first_id FROM deny GROUP BY a2) SELECT id1, a1, rel, a2, r, n_conflicts, first_id FROM allow JOIN rels ON a1 = a JOIN n ON b = a2")
def _(f):
    return compat.conflict_counts(f.stmts, f.dep_edges).filter("rel IS NOT NULL")


@query(
    "conflict_report",
    _SIDES
    + f""", c AS (SELECT id1, a1, id2, a2, CAST(NULL AS VARCHAR) AS rel, CAST(NULL AS VARCHAR) AS r FROM allow JOIN deny ON a1 = a2 WHERE id1 IN ({_REQUEST}) AND id2 IN ({_REQUEST})
  UNION ALL SELECT id1, a1, id2, a2, rel, r FROM allow JOIN rels ON a1 = a JOIN deny ON b = a2 WHERE id1 IN ({_REQUEST}) AND id2 IN ({_REQUEST}))
SELECT CASE WHEN rel IS NULL THEN 'direct' ELSE 'derived' END AS kind, CAST(row_number() OVER (PARTITION BY rel IS NULL ORDER BY id1, a1, id2, a2, rel, r) - 1 AS VARCHAR) AS key,
  concat_ws(' ', id1, 'odrl:permission', a1) AS statement_1, concat_ws(' ', id2, 'odrl:prohibition', a2) AS statement_2,
  CASE WHEN rel IS NULL THEN '{DIRECT_REASON}' ELSE concat('{DERIVED_REASON}', CASE WHEN r = 'derived' THEN '{DERIVED}' ELSE '{GIVEN}' END) END AS reason FROM c""",
)
def _(f):
    request = f.spark.createDataFrame([(x,) for x in REQUEST], "id string")
    out = compat.conflict_report(compat.conflicts(f.stmts, f.dep_edges, request))
    return out.withColumns({c: F.array_join(c, " ") for c in ("statement_1", "statement_2")})


#: A request of many licences, whose conflicts are given one by one.
MANY = tuple(f"urn:lic:{i}" for i in range(1, 121))
_MANY = ", ".join(f"'{x}'" for x in MANY)


@query(
    "conflict_rows",
    _SIDES
    + f"""SELECT id1, a1, id2, a2, CAST(NULL AS VARCHAR) AS rel, CAST(NULL AS VARCHAR) AS r FROM allow JOIN deny ON a1 = a2 WHERE id1 IN ({_MANY}) AND id2 IN ({_MANY})
  UNION ALL SELECT id1, a1, id2, a2, rel, r FROM allow JOIN rels ON a1 = a JOIN deny ON b = a2 WHERE id1 IN ({_MANY}) AND id2 IN ({_MANY})""",
)
def _(f):
    return compat.conflicts(f.stmts, f.dep_edges, f.spark.createDataFrame([(x,) for x in MANY], "id string"))


# --- facets -----------------------------------------------------------------------------------------------------------


def _facet(f: Fixture, **given) -> DataFrame:
    return facets.faceted_search(f.titles, f.targets, f.rules, f.rule_duties, f.wide_duties, facets.Facets(**given))


_FACET = "SELECT DISTINCT replace(t.id, 'http:', 'https:') AS id, t.title FROM titles t WHERE "
_ANY = "EXISTS (SELECT 1 FROM targets x WHERE x.id = t.id AND x.asset_type IN ('lic:CreativeWork', 'dcmitype:Dataset', 'dcmitype:Software'))"
_NODE = "EXISTS (SELECT 1 FROM rules r WHERE r.id = t.id AND r.kind = '{}' AND r.action = '{}'{})"
_DUTY = " AND EXISTS (SELECT 1 FROM rule_duties d WHERE d.node = r.node AND d.duty = '{}')"
_WIDE = "EXISTS (SELECT 1 FROM wide_duties w WHERE w.id = t.id AND w.action = 'cc:ShareAlike')"


@query("facet_basic", _FACET + _ANY)
def _(f):
    return _facet(f)


@query("facet_targets", "SELECT DISTINCT id FROM targets WHERE asset_type IN ('dcmitype:Dataset', 'dcmitype:Software', 'lic:CreativeWork')")
def _(f):
    return facets.with_targets(f.targets, facets.Facets())


@query("facet_target_exclude", "SELECT DISTINCT x.id FROM targets x WHERE x.asset_type IN ('dcmitype:Dataset', 'dcmitype:Software') AND NOT EXISTS (SELECT 1 FROM targets y WHERE y.asset = x.asset AND y.asset_type = 'lic:CreativeWork')")
def _(f):
    return facets.with_targets(f.targets, facets.Facets(targets={"creativework": "no"}))


@query("facet_actions", _FACET + " AND ".join([_ANY, _NODE.format("permission", "odrl:modify", ""), _NODE.format("prohibition", "cc:CommercialUse", "")]))
def _(f):
    return _facet(f, actions={"modify": "permitted", "commercial_use": "prohibited"})


@query("facet_duties", _FACET + " AND ".join([_ANY, _NODE.format("permission", "odrl:derive", _DUTY.format("cc:Attribution") + _DUTY.format("cc:Notice"))]))
def _(f):
    return _facet(f, actions={"derive": "permitted"}, duties={"derive_duty_attribution": "required", "derive_duty_notice": "required", "modify_duty_rename": "required"})


@query("facet_share_alike", _FACET + " AND ".join([_ANY, _WIDE]))
def _(f):
    return _facet(f, share_alike="required")


@query(
    "facet_full",
    _FACET
    + " AND ".join(
        [
            "EXISTS (SELECT 1 FROM targets x WHERE x.id = t.id AND x.asset_type IN ('dcmitype:Dataset', 'dcmitype:Software') AND NOT EXISTS (SELECT 1 FROM targets y WHERE y.asset = x.asset AND y.asset_type = 'lic:CreativeWork'))",
            _NODE.format("permission", "odrl:modify", _DUTY.format("lic:rename")),
            _NODE.format("prohibition", "odrl:reproduce", ""),
            _WIDE,
        ]
    ),
)
def _(f):
    return _facet(f, targets={"creativework": "no"}, actions={"modify": "permitted", "reproduce": "prohibited"}, duties={"modify_duty_rename": "required"}, share_alike="required")


def _facet_index(f: Fixture) -> FacetIndex:
    return FacetIndex.build(f.titles, f.targets, f.rules, f.rule_duties, f.wide_duties)


_FULL = facets.Facets(targets={"creativework": "no"}, actions={"modify": "permitted", "reproduce": "prohibited"}, duties={"modify_duty_rename": "required"}, share_alike="required")
_CHOSEN = facets.Facets(targets={"software": "no"}, actions={"modify": "permitted"}, duties={"modify_duty_notice": "required"})


def _facet_sql(x: facets.Facets) -> str:
    """Conditions on a title t."""
    types = lambda state: ", ".join(f"'{v}'" for k, v in TARGETS.items() if x.targets.get(k, "yes") == state)
    yes = f" AND x.asset_type IN ({types('yes')})" if types("yes") else ""
    no = f" AND NOT EXISTS (SELECT 1 FROM targets y WHERE y.asset = x.asset AND y.asset_type IN ({types('no')}))" if types("no") else ""
    out = [f"EXISTS (SELECT 1 FROM targets x WHERE x.id = t.id{yes}{no})"]
    for a, state in x.actions.items():
        if state == "prohibited":
            out.append(_NODE.format("prohibition", ACTIONS[a], ""))
        elif state == "permitted":
            out.append(_NODE.format("permission", ACTIONS[a], "".join(_DUTY.format(d) for d in x.duties_of(a))))
    return " AND ".join(out + [_WIDE] * (x.share_alike == "required"))


ORACLE_SQL["facet_bitmap_search"] = ORACLE_SQL["facet_full"]
QUERIES["facet_bitmap_search"] = lambda spark, sf_dir: _facet_index(Fixture(spark, sf_dir)).search(_FULL)


@query("facet_bitmap_counts", " UNION ALL ".join(f"SELECT '{n}' AS choice, count(*) AS n FROM titles t WHERE {_facet_sql(x)}" for n, x in ({"": _CHOSEN} | further(_CHOSEN)).items()))
def _(f):
    return _facet_index(f).counts(_CHOSEN)


# --- keyword search ---------------------------------------------------------------------------------------------------


@query("license_list_all", "SELECT id, title FROM titles")
def _(f):
    return search.list_licenses(f.titles, f.alternatives)


@query("titles_alternatives", "SELECT id, title, alt FROM titles LEFT JOIN alternatives USING (id)")
def _(f):
    return search.with_alternatives(f.titles, f.alternatives)


_MATCH = "(regexp_matches(title, '{0}', 'i') OR regexp_matches(alt, '{0}', 'i'))"
_FOUND = "SELECT DISTINCT id, title FROM titles LEFT JOIN alternatives USING (id) WHERE "


@query("keyword_single", _FOUND + _MATCH.format("red"))
def _(f):
    return search.list_licenses(f.titles, f.alternatives, "red").select("id", "title")


@query("keyword_multi", _FOUND + _MATCH.format("red") + " AND " + _MATCH.format("promo"))
def _(f):
    return search.list_licenses(f.titles, f.alternatives, "red promo").select("id", "title")


_RANKED = "brand#2"


def _ratio_sql(column: str, word: str) -> str:
    """Twice the longest common subsequence over both lengths: the table's lines as a fold over letters, each line a fold over the word."""
    big = lambda xs: "[" + ", ".join(f"CAST({x} AS BIGINT)" for x in xs) + "]"
    places = "[" + ", ".join(big([j]) for j in range(len(word) + 1)) + "]"
    step = f"CASE WHEN x[1] = {big(map(ord, word))}[j[1]] THEN line[j[1]] + 1 ELSE greatest(line[j[1] + 1], acc[-1]) END"
    lines = f"list_prepend({big([0] * (len(word) + 1))}, list_transform(string_split(lower({column}), ''), lambda c: [CAST(unicode(c) AS BIGINT)]))"
    common = f"list_reduce({lines}, lambda line, x: list_reduce({places}, lambda acc, j: list_append(acc, {step})))[-1]"
    return f"CAST(round_even(200 * {common} / (length({column}) + {len(word)}), 0) AS INTEGER)"


@query("keyword_ranked", f"SELECT DISTINCT id, title, {_ratio_sql('title', _RANKED)} AS score FROM titles LEFT JOIN alternatives USING (id) WHERE " + _MATCH.format(_RANKED))
def _(f):
    return search.list_licenses(f.titles, f.alternatives, _RANKED).select("id", "title", "score")


@query("keyword_page", "SELECT id, title FROM titles ORDER BY id OFFSET 20 LIMIT 10")
def _(f):
    return search.list_licenses(f.titles, f.alternatives, skip=20, limit=10)


#: Keywords of a request: the most frequent words of all documents.
KEYWORDS = 1000


@query(
    "keyword_best",
    f""", words AS (SELECT w AS keyword FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT {KEYWORDS}),
masks AS (SELECT keyword, map_from_entries(list((c, m))) AS m FROM (SELECT keyword, c, CAST(sum(CAST(1 AS HUGEINT) << (i - 1)) AS HUGEINT) AS m FROM
  (SELECT keyword, unnest(string_split(keyword, '')) AS c, generate_subscripts(string_split(keyword, ''), 1) AS i FROM words) GROUP BY keyword, c) GROUP BY keyword),
letters AS (SELECT id, title, string_split(lower(title), '') AS cs FROM titles),
rows_ AS (SELECT keyword, id, title, (CAST(1 AS HUGEINT) << length(keyword)) - 1 AS top, list_reduce(list_prepend(top, list_transform(cs, lambda c: coalesce(m[c], CAST(0 AS HUGEINT)))),
  lambda a, x: ((a + (a & x)) | (a - (a & x))) & top) AS line FROM masks, letters),
scored AS (SELECT keyword, id, title, CAST(round_even(200 * (length(keyword) - bit_count(line)) / (length(title) + length(keyword)), 0) AS INTEGER) AS score FROM rows_)
SELECT keyword, id, title, score, CAST(row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id, title) AS INTEGER) AS rank FROM scored
QUALIFY rank <= 10""",
)
def _(f):
    words = f.table("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    common = words.groupBy(F.lower("w").alias("keyword")).count().orderBy(F.col("count").desc(), "keyword").limit(KEYWORDS)
    return best_titles(f.titles, common, 10)


def _text_index(f: Fixture) -> TextIndex:
    """An index of all documents that has grown by three batches and been merged on the way."""
    index, docs = TextIndex(f.spark, stage_folder(f.spark), fanout=2), f.table("documents")
    for k in range(3):
        index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k))
    return index


@query("text_index_prefix", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\pL\\pN_])(?i:ver)')", prelude=False)
def _(f):
    return _text_index(f).prefix("ver")


@query("text_index_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\pL\\pN_])(?i:of)[^\\pL\\pN_]+(?i:the)($|[^\\pL\\pN_])')", prelude=False)
def _(f):
    return _text_index(f).phrase("of the").select("doc_id")


@query("fulltext_prefix", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\pL\\pN_])(?i:ver)')", prelude=False)
def _(f):
    return f.table("documents").filter(S.prefix_match(F.col("text"), "ver")).select("doc_id")


# --- profile ----------------------------------------------------------------------------------------------------------


def _graph(f: Fixture) -> DataFrame:
    """s, p, o of the fixture with all nodes that a profile follows: statements, nested and licence-wide duties, targets. Triples aren't made distinct."""
    c, lit, cat = F.col, F.lit, F.concat
    t = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
    node, wide = c("node"), cat(c("id"), lit("/cc:ShareAlike"))
    # arrays without lambdas and with nulls for what isn't there: these compile
    due = [(F.array_contains("due", d), x) for d in DUTY_VOCABULARY for at in (cat(node, lit(f"/{d}")),) for x in (t(node, lit("odrl:duty"), at), t(at, lit("rdf:type"), lit("odrl:Duty")), t(at, lit("odrl:action"), lit(d)))]
    own = [t(c("id"), cat(lit("odrl:"), c("kind")), node), t(node, lit("rdf:type"), F.when(c("kind") == "permission", "odrl:Permission").otherwise("odrl:Prohibition")), t(node, lit("odrl:action"), c("action"))]
    shared = [(c("wide"), x) for x in (t(c("id"), lit("odrl:duty"), wide), t(wide, lit("rdf:type"), lit("odrl:Duty")), t(wide, lit("odrl:action"), lit("cc:ShareAlike")))]
    titles = [t(c("id"), lit("rdf:type"), lit("odrl:Set")), t(c("id"), lit("dct:title"), c("title"))]
    asset = c("asset")
    aimed = F.flatten(F.transform("kinds", lambda k: F.array(t(c("id"), lit("odrl:target"), asset), t(asset, lit("rdf:type"), lit("odrl:AssetCollection")), t(asset, lit("dct:type"), k))))
    each = lambda df, always, where: df.select(F.explode(F.array(*always, *[F.when(*x) for x in where])).alias("x")).filter("x IS NOT NULL").select("x.*")
    rules = each(f.with_due(f.rule_rows), own, due)
    return rules.unionByName(each(f.parts, titles, shared)).unionByName(f.parts.select(F.explode(aimed).alias("x")).select("x.*"))


_GRAPH = """, graph(s, p, o) AS MATERIALIZED (SELECT id, 'rdf:type', 'odrl:Set' FROM titles UNION SELECT id, 'dct:title', title FROM titles
  UNION SELECT id, concat('odrl:', kind), node FROM rules UNION SELECT node, 'rdf:type', CASE kind WHEN 'permission' THEN 'odrl:Permission' ELSE 'odrl:Prohibition' END FROM rules
  UNION SELECT node, 'odrl:action', action FROM rules UNION SELECT node, 'odrl:duty', concat(node, '/', duty) FROM rule_duties
  UNION SELECT concat(node, '/', duty), 'rdf:type', 'odrl:Duty' FROM rule_duties UNION SELECT concat(node, '/', duty), 'odrl:action', duty FROM rule_duties
  UNION SELECT id, 'odrl:duty', concat(id, '/', action) FROM wide_duties UNION SELECT concat(id, '/', action), 'rdf:type', 'odrl:Duty' FROM wide_duties
  UNION SELECT concat(id, '/', action), 'odrl:action', action FROM wide_duties UNION SELECT id, 'odrl:target', asset FROM targets
  UNION SELECT asset, 'rdf:type', 'odrl:AssetCollection' FROM targets UNION SELECT asset, 'dct:type', asset_type FROM targets) """


@query(
    "profile_optional_chain",
    _GRAPH
    + """SELECT v.s AS id, v.p AS property, v.o AS value, a.permission, b.pnduty, c.prohibition, d.duty, e.asset_type
FROM graph v SEMI JOIN (SELECT s FROM graph WHERE p = 'rdf:type' AND o = 'odrl:Set') x ON v.s = x.s
LEFT JOIN (SELECT t.s, n.o AS permission FROM graph t JOIN graph n ON n.s = t.s AND n.p = 'odrl:action' WHERE t.p = 'rdf:type' AND t.o = 'odrl:Permission') a ON a.s = v.o
LEFT JOIN (SELECT t.s, n.o AS permission, m.o AS pnduty FROM graph t JOIN graph n ON n.s = t.s AND n.p = 'odrl:action' JOIN graph d ON d.s = t.s AND d.p = 'odrl:duty'
  JOIN graph k ON k.s = d.o AND k.p = 'rdf:type' AND k.o = 'odrl:Duty' JOIN graph m ON m.s = d.o AND m.p = 'odrl:action' WHERE t.p = 'rdf:type' AND t.o = 'odrl:Permission') b ON b.s = v.o AND b.permission = a.permission
LEFT JOIN (SELECT t.s, n.o AS prohibition FROM graph t JOIN graph n ON n.s = t.s AND n.p = 'odrl:action' WHERE t.p = 'rdf:type' AND t.o = 'odrl:Prohibition') c ON c.s = v.o
LEFT JOIN (SELECT t.s, n.o AS duty FROM graph t JOIN graph n ON n.s = t.s AND n.p = 'odrl:action' WHERE t.p = 'rdf:type' AND t.o = 'odrl:Duty') d ON d.s = v.o
LEFT JOIN (SELECT t.s, n.o AS asset_type FROM graph t JOIN graph n ON n.s = t.s AND n.p = 'dct:type' WHERE t.p = 'rdf:type' AND t.o = 'odrl:AssetCollection') e ON e.s = v.o""",
)
def _(f):
    return profile.optional_chain(_graph(f))


def _two_files(f: Fixture) -> DataFrame:
    """The fixture's graph as two files have it, each with names of its own for blank nodes."""
    none = F.lit(None).cast("string")
    blank = lambda x: F.col(x).rlike("^[0-9]+:|^_:|/")
    o_blank = blank("o") & (F.col("p") != "dct:title")
    label = lambda x, file: F.concat(F.lit(f"_:{file}"), F.col(x))
    g = _graph(f)
    of = lambda file: g.select(
        F.lit("library").alias("g"), F.when(blank("s"), label("s", file)).otherwise(F.col("s")).alias("s"), F.when(blank("s"), "bnode").otherwise("iri").alias("s_kind"), "p",
        F.when(o_blank, label("o", file)).otherwise(F.col("o")).alias("o"), F.when(o_blank, "bnode").when(F.col("p") == "dct:title", "literal").otherwise("iri").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"),
    )
    return of("a").unionByName(of("b"))


@query(
    "blank_nodes_merged",
    """, said AS (SELECT r.id, concat('odrl:', r.kind) AS property, r.action AS says, coalesce(string_agg(DISTINCT d.duty, ',' ORDER BY d.duty), '') AS duties FROM rules r LEFT JOIN rule_duties d USING (node) GROUP BY r.id, r.node, r.kind, r.action
  UNION ALL SELECT id, 'odrl:duty', action, '' FROM wide_duties UNION ALL SELECT id, 'odrl:target', string_agg(DISTINCT asset_type, ',' ORDER BY asset_type), '' FROM targets GROUP BY id, asset)
SELECT DISTINCT id, property, says, duties, CAST(1 AS BIGINT) AS n_nodes FROM said""",
)
def _(f):
    t, c = canonical(_two_files(f)), F.col
    listed = lambda df, name: df.groupBy("node").agg(_join(F.sort_array(F.collect_set("o"))).alias(name))
    said = t.filter(c("p").isin("odrl:action", "dct:type")).select(c("s").alias("node"), "o")
    due = t.filter("p = 'odrl:duty' AND s_kind = 'bnode'").select("s", c("o").alias("node")).join(said, "node").select(c("s").alias("node"), "o")
    own = t.filter("s_kind <> 'bnode' AND o_kind = 'bnode'").select(c("s").alias("id"), c("p").alias("property"), c("o").alias("node"))
    every = own.join(listed(said, "says"), "node", "left").join(listed(due, "duties"), "node", "left").na.fill("", ["duties"])
    return every.groupBy("id", "property", "says", "duties").agg(F.count("*").alias("n_nodes"))


def _properties(f: Fixture) -> DataFrame:
    p = f.table("part")
    key = F.concat(F.lit("urn:lic:"), F.col("p_partkey").cast("string")).alias("id")
    pairs = F.array(*[F.struct(F.lit(k).alias("p"), F.col(c).cast("string").alias("o")) for k, c in (("dct:title", "p_name"), ("dct:publisher", "p_brand"), ("cc:legalcode", "p_type"), ("foaf:img", "p_size"))])
    return p.select(key, F.explode(pairs).alias("x")).select("id", "x.p", "x.o").unionByName(f.alternatives.select("id", F.lit("dct:alternative").alias("p"), F.col("alt").alias("o")))


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in LABELS.items())
_PROPERTIES = f""", props AS (SELECT concat('urn:lic:', p_partkey) AS id, 'dct:title' AS p, p_name AS o FROM part UNION ALL SELECT concat('urn:lic:', p_partkey), 'dct:publisher', p_brand FROM part
  UNION ALL SELECT concat('urn:lic:', p_partkey), 'cc:legalcode', p_type FROM part UNION ALL SELECT concat('urn:lic:', p_partkey), 'foaf:img', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT id, 'dct:alternative', alt FROM alternatives),
labels(p, label) AS (SELECT * FROM (VALUES {_LABELS}) v(a, b)) """


@query("profile_labels", _PROPERTIES + "SELECT id, label, o AS value FROM props JOIN labels USING (p)")
def _(f):
    return profile.labelled(_properties(f))


@query("profile_grouped", _PROPERTIES + "SELECT id, label, string_agg(DISTINCT o, ',' ORDER BY o) AS values FROM props JOIN labels USING (p) GROUP BY id, label")
def _(f):
    return profile.grouped(_properties(f)).withColumn("values", _join("values"))


@query("profile_permissions", "SELECT r.id, r.action, coalesce(string_agg(DISTINCT d.duty, ',' ORDER BY d.duty), '') AS duties FROM rules r LEFT JOIN rule_duties d USING (node) WHERE r.kind = 'permission' GROUP BY r.id, r.action")
def _(f):
    return profile.permissions(f.rules, f.rule_duties).withColumn("duties", _join("duties"))


@query("profile_prohibitions", "SELECT id, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM rules WHERE kind = 'prohibition' GROUP BY id")
def _(f):
    return profile.prohibitions(f.rules).withColumn("actions", _join("actions"))


def _label_sql(x: str) -> str:
    """The words of a name after its prefix; none of the fixture's names holds an acronym."""
    return f"regexp_replace(regexp_extract({x}, '([^#/:]*)$', 1), '([a-z])([A-Z])', '\\1 \\2', 'g')"


@query(
    "license_profile",
    _PROPERTIES
    + f""", shown AS (SELECT id, string_agg(concat(label, '=', v), ';' ORDER BY label) AS properties FROM (SELECT id, label, string_agg(regexp_replace(o, '([a-z])([A-Z])', '\\1 \\2', 'g'), ',' ORDER BY o) AS v FROM (SELECT DISTINCT id, label, o FROM props JOIN labels USING (p)) GROUP BY id, label) GROUP BY id),
allowed AS (SELECT id, string_agg(concat({_label_sql('action')}, '(', duties, ')'), ';' ORDER BY {_label_sql('action')}) AS permissions FROM
  (SELECT r.id, r.action, coalesce(string_agg(DISTINCT {_label_sql('d.duty')}, ',' ORDER BY {_label_sql('d.duty')}), '') AS duties FROM rules r LEFT JOIN rule_duties d USING (node) WHERE r.kind = 'permission' GROUP BY r.id, r.action) GROUP BY id),
words AS (SELECT id, what, string_agg(w, ',' ORDER BY w) AS w FROM (SELECT DISTINCT id, 'n' AS what, {_label_sql('action')} AS w FROM rules WHERE kind = 'prohibition' UNION SELECT id, 'o', {_label_sql('action')} FROM rules WHERE kind = 'obligation'
  UNION SELECT id, 'd', {_label_sql('action')} FROM wide_duties UNION SELECT id, 't', {_label_sql('asset_type')} FROM targets) GROUP BY id, what)
SELECT t.id, t.title, s.properties, a.permissions, n.w AS prohibitions, o.w AS obligations, d.w AS duties, x.w AS targets FROM titles t LEFT JOIN shown s USING (id) LEFT JOIN allowed a USING (id)
  LEFT JOIN (SELECT id, w FROM words WHERE what = 'n') n USING (id) LEFT JOIN (SELECT id, w FROM words WHERE what = 'o') o USING (id)
  LEFT JOIN (SELECT id, w FROM words WHERE what = 'd') d USING (id) LEFT JOIN (SELECT id, w FROM words WHERE what = 't') x USING (id)""",
)
def _(f):
    p = profile.license_profile(f.titles, _properties(f), f.rules, f.rule_duties, f.targets, f.wide_duties)
    shown = F.transform(F.map_entries("properties"), lambda x: F.concat(x["key"], F.lit("="), _join(x["value"])))
    allowed = F.transform("permissions", lambda x: F.concat(x["action"], F.lit("("), _join(F.array_sort(x["duties"])), F.lit(")")))
    p = p.withColumns({"properties": F.array_join(shown, ";"), "permissions": F.array_join(allowed, ";")})
    return p.withColumns({c: _join(c) for c in ("prohibitions", "obligations", "duties", "targets")})


_NAMES = ("ModifiedWorks", "chargeDistributionFee", "ODbL", "usesLaTeXHere", "plain", "")


@query("camel_split", "SELECT action, replace(replace(regexp_replace(replace(replace(action, 'ODbL', '#0#'), 'LaTeX', '#1#'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '#0#', 'ODbL'), '#1#', 'LaTeX') AS label FROM (SELECT DISTINCT action FROM rules UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _NAMES) + ") v(a))")
def _(f):
    names = f.rules.select("action").distinct().unionByName(f.spark.createDataFrame([(x,) for x in _NAMES], "action string"))
    return names.select("action", S.camel_split(F.col("action")).alias("label"))


# --- composing, parsing -----------------------------------------------------------------------------------------------

_FORM = Form(title='My "own" licence', creator="Someone", validity="specifyDate", start="2024-02-29", end="2023-02-29", region="worldwide", permissions=(("odrl:modify", ("cc:Attribution", "cc:Notice")), ("odrl:derive", ())), prohibitions=("cc:CommercialUse",), duties=("cc:ShareAlike",), targets=("lic:CreativeWork", "dcmitype:Software"))


@query("compose_triples", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (t[1], t[3], t[4])) + ")" for t in compose(_FORM, Vocabulary(), "g")) + ") v(s, p, o)", prelude=False)
def _(f):
    from pactum.operators.compose import compose_license

    return compose_license(f.spark, _FORM).select("s", "p", "o")


@query("curie_expand", "SELECT action, concat(CASE split_part(action, ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Vocabulary().prefixes.items()) + " END, split_part(action, ':', 2)) AS iri FROM (SELECT DISTINCT action FROM rules)")
def _(f):
    return f.rules.select("action").distinct().select("action", S.curie_expand(F.col("action"), Vocabulary().prefixes).alias("iri"))


_DATES = ("2024-02-29", "2023-02-29", "2024-13-01", "24-1-1", "", "2024-01-01x")


@query("date_valid", "SELECT d, regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(d AS DATE) IS NOT NULL AS valid FROM (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _DATES) + ") v(a))", prelude=False)
def _(f):
    dates = f.table("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct().unionByName(f.spark.createDataFrame([(x,) for x in _DATES], "d string"))
    return dates.select("d", S.date_valid(F.col("d")).alias("valid"))


@query("quoted_concat", "SELECT id, CASE WHEN title LIKE '%\"%' OR kind LIKE '%\"%' THEN concat('\"', replace(title, '\"', ''), replace(kind, '\"', ''), '\"') ELSE concat(title, kind) END AS joined FROM (SELECT id, title, CASE WHEN length(title) % 2 = 0 THEN '\"x\"' ELSE 'x' END AS kind FROM titles)")
def _(f):
    t = f.titles.withColumn("kind", F.when(F.length("title") % 2 == 0, '"x"').otherwise("x"))
    return t.select("id", S.quoted_concat(F.col("title"), F.col("kind")).alias("joined"))


@query("repo_url_parse", "SELECT page_id, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) END AS owner, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 2) END AS name FROM (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+/', '') AS path FROM pages)", prelude=False)
def _(f):
    return f.table("pages").select("page_id", S.repository(F.col("url")).alias("r")).select("page_id", "r.owner", "r.name")


# --- repository audit -------------------------------------------------------------------------------------------------


def _documents(f: Fixture) -> DataFrame:
    """Repository documents: a dependency without a recognised licence has an empty list."""
    names = F.when(F.col("license_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("license_id"))
    return f.dependencies.groupBy("repo").agg(F.collect_list(F.struct(F.col("dependency").alias("name"), names.alias("normalized_licenses"))).alias("dependencies")).select(F.col("repo").cast("string").alias("full_name"), F.lit("x").alias("language"), "dependencies")


@query("dep_licenses", "SELECT CAST(repo AS VARCHAR) AS repo, dependency, license_id AS license FROM deps WHERE license_id IS NOT NULL")
def _(f):
    return audit.dependency_licenses(_documents(f))


@query("dep_license_lookup", "SELECT d.repo, d.dependency, d.license_id AS license, t.id AS license_id FROM deps d LEFT JOIN titles t ON d.license_id = t.id")
def _(f):
    return audit.resolve(f.dependencies.withColumnRenamed("license_id", "license"), f.titles)


@query(
    "dep_conflicts",
    """, used AS (SELECT DISTINCT d.repo, s.id, s.kind, s.action FROM deps d JOIN stmts s ON d.license_id = s.id),
al AS (SELECT DISTINCT repo, id AS id1, action AS a1 FROM used WHERE kind = 'permission'), dn AS (SELECT DISTINCT repo, id AS id2, action AS a2 FROM used WHERE kind = 'prohibition')
SELECT repo, id1, id2, count(*) AS n_conflicts, count(DISTINCT a1) AS n_actions FROM (SELECT al.repo, id1, a1, id2 FROM al JOIN dn ON al.repo = dn.repo AND a1 = a2
  UNION ALL SELECT al.repo, id1, a1, id2 FROM al JOIN rels ON a1 = a JOIN dn ON al.repo = dn.repo AND b = a2) GROUP BY repo, id1, id2""",
)
def _(f):
    return audit.repository_conflict_counts(f.dependencies, f.stmts, f.dep_edges)


# --- catalogue statistics ---------------------------------------------------------------------------------------------


@query("stat_action_counts", "SELECT kind, action, count(*) AS n_nodes, count(DISTINCT id) AS n_licences FROM rules GROUP BY kind, action")
def _(f):
    return f.rules.groupBy("kind", "action").agg(F.count("*").alias("n_nodes"), F.count_distinct("id").alias("n_licences"))


@query("stat_target_cube", "SELECT coalesce(asset_type, '*') AS asset_type, coalesce(kind, '*') AS kind, count(*) AS n FROM targets JOIN stmts USING (id) GROUP BY CUBE (asset_type, kind)")
def _(f):
    return f.targets.join(f.stmts, "id").cube("asset_type", "kind").agg(F.count("*").alias("n")).select(F.coalesce("asset_type", F.lit("*")).alias("asset_type"), F.coalesce("kind", F.lit("*")).alias("kind"), "n")


@query("stat_top_conflicts", _SIDES + "SELECT action, n_pairs, rank() OVER (ORDER BY n_pairs DESC) AS rank FROM (SELECT a1 AS action, na * nd AS n_pairs FROM (SELECT a1, count(*) AS na FROM allow GROUP BY a1) JOIN (SELECT a2, count(*) AS nd FROM deny GROUP BY a2) ON a1 = a2)")
def _(f):
    per = f.stmts.groupBy("action").pivot("kind", ["permission", "prohibition"]).count().na.fill(0)
    per = per.select("action", (F.col("permission") * F.col("prohibition")).alias("n_pairs")).filter("n_pairs > 0")
    return per.withColumn("rank", F.rank().over(Window.orderBy(F.col("n_pairs").desc())).cast("long"))  # one row for each action


@query("event_windows", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL", prelude=False)
def _(f):
    from pactum.streaming.ingest import hourly

    return hourly(f.table("events"))
