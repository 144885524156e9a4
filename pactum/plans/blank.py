"""Names of blank nodes that follow from what they say, so that equal statements from any files are one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.plans.stage import dropped, stage_folder, staged

#: Levels of blank nodes below a named owner that are named where they meet; deeper ones are named in rounds over nodes.
LEVELS = 4
#: What a row of `_rows` says: a blank subject's statement, a blank object's owner, or neither.
_LINE, _EDGE, _PLAIN = 0, 1, 2
#: Hexadecimal digits of a sum's terms, and the sums of one content: 60 bits of a digest go to each.
DIGITS, SUMS = 15, 4
_ACC = [f"acc{i}" for i in range(SUMS)]


def _digest(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])), 256)


def _name(owner: Column, p: Column, content: Column) -> Column:
    return F.concat(F.lit("_:"), F.substring(_digest(owner, p, content), 1, 40))


def _slice(line: Column | str, i: int) -> Column:
    return F.conv(F.substring(line, 1 + i * DIGITS, DIGITS), 16, 10)


def _blank(end: str) -> Column:
    return F.coalesce((F.col(f"{end}_kind") == "bnode") & F.col(end).isNotNull(), F.lit(False))


def _summed(lines: DataFrame) -> DataFrame:
    """node, acc0, ...: sums of the digests of a node's distinct lines. Lines move once, by node, as numbers."""
    return lines.select("node", *[_slice("line", i).cast("long").alias(a) for i, a in enumerate(_ACC)]).repartition("node").distinct().groupBy("node").agg(*[F.sum(F.col(a).cast("decimal(20,0)")).cast("decimal(38,0)").alias(a) for a in _ACC])


def _rows(triples: DataFrame) -> DataFrame:
    """A row at each blank node of a triple, its subject and its object, and one of any other triple.

    at is the blank node; s and o are what else the triple has. A subject's row of a blank object only counts: the object's row stands for the triple.
    """
    c = F.col
    other = [x for x in triples.columns if x not in ("s", "o", "p")]  # what hardly varies comes first, as rows compress better so
    none = F.lit(None).cast("string")
    row = lambda role, s, o, at: F.struct(*other, F.lit(role).alias("role"), "p", s.alias("s"), o.alias("o"), at.alias("at"))
    spread = F.xxhash64("s", "p", "o").cast("string")
    each = F.array(
        F.when(_blank("s"), row(_LINE, none, c("o"), c("s"))),
        F.when(_blank("o"), row(_EDGE, c("s"), none, c("o"))),
        F.when(~_blank("s") & ~_blank("o"), row(_PLAIN, c("s"), c("o"), spread)),
    )
    below = "array<struct<p: string, content: binary>>"
    return triples.select(F.explode(each).alias("x")).filter("x IS NOT NULL").select("x.*", none.alias("node"), F.lit(None).cast(below).alias("path"))


def _met(rows: DataFrame, columns: list[str], first: bool) -> DataFrame:
    """rows, with names where a node below a named owner has all of its content; moved to its owner where a blank one has it.

    A node's rows meet, and with them those of the nodes below that have their content: node is then whose row it is, and path leads there
    by predicates and contents. New columns: done, up (moved now), name (of the row's node, as bytes) and above (of its blank owner).
    """
    c, lit = F.col, F.lit
    own, line, edge = c("path").isNull(), c("role") == _LINE, c("role") == _EDGE
    content = F.get("path", 0)["content"]
    kind = F.when(own & line & ~_blank("o"), 0).when(own & line, 1).when(edge & (F.size("path") == 1), 2).otherwise(3)
    rows = rows.repartition("at").withColumn("what", kind)
    # equal statements of a node count once; of nodes below, equal content counts once, and each node is an answer
    said = ["o", "o_kind", "o_lang", "o_dt"]
    nth = lambda *by: F.row_number().over(Window.partitionBy("at", "what", "p", *by).orderBy("role"))
    rows = rows.withColumn("n", nth(*said)) if first else rows.withColumn("has", content).withColumn("same", nth("has")).withColumn("n", nth("has", *said, "node"))
    says = F.when((c("what") == 0) & (c("n") == 1), _digest(c("p"), c("o"), c("o_kind"), c("o_lang"), c("o_dt")))
    if not first:
        says = F.coalesce(says, F.when((c("what") == 2) & (c("same") == 1), _digest(c("p"), F.lower(F.hex("has")))))
    rows, node = rows.withColumn("line", says), Window.partitionBy("at")
    by = F.when(own & edge, F.struct(c("s").alias("owner"), c("s_kind").alias("owner_kind"), "p"))
    zero = lit(0).cast("decimal(38,0)")
    total = lambda i: F.coalesce(F.sum(_slice("line", i).cast("decimal(20,0)")).over(node).cast("decimal(38,0)"), zero).alias(_ACC[i])
    count = lambda what: F.count(F.when((c("what") == what) & (c("n") == 1), 1)).over(node)
    rows = rows.select("*", F.min(by).over(node).alias("by"), F.max(by).over(node).alias("last"), count(1).alias("asked"), count(2).alias("answered"), *map(total, range(SUMS)))
    # a node that several own is left as it is, and so is what hangs on it
    whole = c("by").eqNullSafe(c("last")) & (c("asked") == c("answered"))
    owned = F.coalesce(c("by.owner_kind") == "bnode", lit(False)) & c("by.owner").isNotNull()
    named = ~owned & ~F.coalesce(c("by.owner").startswith("_:"), lit(False))
    plain = c("role") == _PLAIN
    rows = rows.withColumn("done", plain | (whole & named)).withColumn("up", ~plain & whole & owned)
    rows = rows.filter(~((c("done") | c("up")) & (c("what") == 1)))
    rows = rows.withColumn("content", F.when(~plain & whole, _digest(*map(c, _ACC)))).withColumn("top", F.when(c("done") & ~plain, _name(c("by.owner"), c("by.p"), c("content"))))
    bytes_ = lambda name: F.unhex(F.substring(name, 3, 40))
    name, above = c("top"), lit(None).cast("string")
    if not first:
        down = lambda owner, x: _name(owner, x["p"], F.lower(F.hex(x["content"])))
        deep = F.aggregate(F.slice("path", 1, F.size("path") - 1), c("top"), down)
        rows = rows.withColumn("parent", F.when(c("done") & ~own, F.when(F.size("path") == 1, c("top")).otherwise(deep)))
        name, above = F.when(own, c("top")).otherwise(down(c("parent"), F.element_at("path", -1))), F.when(edge & ~own, c("parent"))
    step = F.struct(c("by.p").alias("p"), F.unhex("content").alias("content"))
    path = F.when(c("up"), F.concat(F.array(step), F.coalesce("path", F.array().cast(rows.schema["path"].dataType)))).otherwise(c("path"))
    rest = lambda x: F.when(~c("done"), x)
    return rows.select(
        *[x for x in columns if x not in ("s", "o")], "role", F.when(~c("done") | own, c("s")).alias("s"), "o", F.when(~c("done") | plain, F.when(c("up"), c("by.owner")).otherwise(c("at"))).alias("at"),
        rest(F.when(c("up"), F.coalesce("node", "at")).otherwise(c("node"))).alias("node"), rest(path).alias("path"), "done", "up", F.when(c("done"), bytes_(name)).alias("name"), F.when(c("done"), bytes_(above)).alias("above"),
    )


def canonical(triples: DataFrame) -> DataFrame:
    """The distinct triples, with new names for blank nodes: equal content below the same owner and predicate is one node.

    A node's content is its predicates and objects, and the content of blank nodes among those; its name adds the name of its owner.
    So one licence from two files, or a statement that a licence makes twice, has one node; equal statements of two licences have
    one each. Nodes with several owners, or that own each other in a circle, keep their names and count as named. A null is a
    value of its own. Rows of a tree of blank nodes meet level by level, from its leaves to its root, and are named there: each moves once
    a level, and once more to become distinct. Trees of more levels, circles and what several own are named by `_in_rounds`.
    """
    spark, work, c = triples.sparkSession, stage_folder(triples.sparkSession), F.col
    rows, parts = _rows(triples), []
    for level in range(LEVELS):
        met = staged(_met(rows, triples.columns, level == 0), f"{work}/{level}")
        parts.append(met.filter("done"))
        rows = met.filter("NOT done").drop("done", "up", "name", "above")
        if met.filter("up").isEmpty():
            break
    plain = [x for x in triples.columns if x not in ("s", "o")]
    # equal triples have equal names of their blank node: they meet by it as bytes, and become text when they are read
    known = reduce(DataFrame.unionByName, parts).select(*[x for x in plain if x != "p"], "role", "p", "s", "o", "at", "above", "name")
    out = staged(known.repartition("name", "at").distinct())
    text = lambda b: F.concat(F.lit("_:"), F.lower(F.hex(b)))
    s = F.when(c("role") == _LINE, text("name")).otherwise(F.coalesce("s", text("above"))).alias("s")
    out = out.select(*[s if x == "s" else F.when(c("role") == _EDGE, text("name")).otherwise(c("o")).alias("o") if x == "o" else x for x in triples.columns])
    if not rows.isEmpty():
        label = F.coalesce("node", "at")
        kept = rows.filter(~((c("role") == _LINE) & _blank("o"))).select(*plain, F.when(c("role") == _LINE, label).otherwise(c("s")).alias("s"), F.when(c("role") == _EDGE, label).otherwise(c("o")).alias("o"))
        out = out.unionByName(_in_rounds(kept.select(*triples.columns)))
    dropped(spark, work)
    return out


def _in_rounds(triples: DataFrame) -> DataFrame:
    """`canonical` of any triples. Content goes up in a round for each level, and names come down likewise; a round carries only nodes that are left."""
    spark, work = triples.sparkSession, stage_folder(triples.sparkSession)
    steps = iter(range(1 << 30))
    put = lambda df: staged(df, f"{work}/{next(steps)}")
    c = F.col
    t = put(triples.repartition("s").distinct())  # a subject's triples stay together, so tasks add up what is asked of it

    # owners: a node with several is named
    by = F.struct(c("s").alias("owner"), c("s_kind").alias("owner_kind"), "p")
    owned = t.filter("o_kind = 'bnode' AND o IS NOT NULL").select(c("o").alias("node"), by.alias("by"))
    every = t.filter("s_kind = 'bnode' AND s IS NOT NULL").select(c("s").alias("node"), F.lit(None).cast(owned.schema["by"].dataType).alias("by")).unionByName(owned)
    own = every.groupBy("node").agg(F.min("by").alias("by"), F.max("by").alias("last")).filter("by <=> last").select("node", "by.owner", "by.owner_kind", "by.p")
    own = put(own)
    inner = own.filter("owner_kind = 'bnode'").join(own.select(c("node").alias("owner")), "owner", "left_semi")  # owner has content, too

    # content: first of lines without own nodes, then upwards
    said = t.filter("s_kind = 'bnode'").select(c("s").alias("node"), "p", "o", "o_kind", "o_lang", "o_dt")
    to_blank = F.coalesce(c("o_kind") == "bnode", F.lit(False))
    plain = said.filter(to_blank).join(inner.select(c("owner").alias("node"), c("node").alias("o"), F.lit("bnode").alias("o_kind")), ["node", "o", "o_kind"], "left_anti").unionByName(said.filter(~to_blank))
    base = _summed(plain.select("node", _digest(c("p"), c("o"), c("o_kind"), c("o_lang"), c("o_dt")).alias("line")))
    children = inner.groupBy(c("owner").alias("node")).agg(F.count("*").alias("pending"))
    zero = F.lit(0).cast("decimal(38,0)")
    left = own.join(base, "node", "left").join(children, "node", "left").select("node", "owner", "owner_kind", "p", *[F.coalesce(a, zero).alias(a) for a in _ACC], F.coalesce("pending", F.lit(0)).alias("pending"))
    left, done = put(left), []
    while True:
        ready = put(left.filter("pending = 0").select("node", "owner", "owner_kind", "p", _digest(*map(c, _ACC)).alias("content")))
        if ready.isEmpty():
            break
        done.append(ready)
        up = ready.filter("owner_kind = 'bnode'").select(c("owner").alias("node"), "p", "content")
        add = _summed(up.select("node", _digest(c("p"), c("content")).alias("line")))
        add = add.withColumnsRenamed({a: f"{a}_" for a in _ACC}).join(up.groupBy("node").agg(F.count("*").alias("labelled")), "node")
        rest = left.filter("pending > 0").join(add, "node", "left")
        more = [(c(a) + F.coalesce(f"{a}_", zero)).cast("decimal(38,0)").alias(a) for a in _ACC]
        left = put(rest.select("node", "owner", "owner_kind", "p", *more, (c("pending") - F.coalesce("labelled", F.lit(0))).alias("pending")))

    # names: from nodes whose owner is named, downwards
    names = spark.createDataFrame([], "node string, name string")
    if done:
        waiting = put(reduce(DataFrame.unionByName, done))
        name = lambda owner: _name(owner, c("p"), c("content"))
        below = waiting.select(c("node").alias("owner"))
        top = waiting.join(below, "owner", "left_anti").unionByName(waiting.filter("owner_kind <> 'bnode'").join(below, "owner", "left_semi"))
        fresh = put(top.select("node", name(c("owner")).alias("name")))
        waiting = put(waiting.join(fresh, "node", "left_anti"))
        named = [fresh]
        while not waiting.isEmpty():
            known = waiting.join(fresh.select(c("node").alias("owner"), c("name").alias("above")), "owner", "left")
            known = put(known)
            fresh = put(known.filter("above IS NOT NULL").select("node", name(c("above")).alias("name")))
            waiting = known.filter("above IS NULL").drop("above")
            named.append(fresh)
        names = reduce(DataFrame.unionByName, named)

    def renamed(df: DataFrame, end: str) -> DataFrame:
        """df with the names of blank nodes at this end; other rows don't move."""
        blank = F.coalesce(c(f"{end}_kind") == "bnode", F.lit(False))
        to = names.select(c("node").alias(end), c("name").alias("__name"))
        return df.filter(blank).join(to, end, "left").withColumn(end, F.coalesce("__name", end)).select(*triples.columns).unionByName(df.filter(~blank).select(*triples.columns))

    out = renamed(renamed(t, "s"), "o")
    out = staged(out.select(*triples.columns).distinct())
    dropped(spark, work)
    return out
