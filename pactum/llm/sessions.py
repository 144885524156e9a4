"""Gap sessionisation of clicks.

A session ends after a final click, before a pause, and where its first click would be too far back. Clicks are dealt by client
and stretch of time, so a client with a third of all rows is spread over as many groups as there are stretches:

1. within a stretch, Spark's session_window merges clicks into islands without a pause;
2. islands are split behind final clicks, by running sums of those;
3. a part that touches no edge of its stretch is a whole piece; its sessions are cut greedily, in one pass over its clicks;
4. parts at edges are joined to pieces by rows of a few numbers each. A piece over several stretches that is longer than a
   session may be has every click pointed at the first one too late for its session; sessions begin at what the piece's first
   click leads to, found by doubling the length of those jumps;
5. late clicks are merged with session starts inside a stretch, and the last start before it is carried in.

What meets in one task is a stretch of one client's clicks, or a few rows for each stretch of one client.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import remove, session, shared_folder, written

MINUTE = 60_000_000
#: Fixed by the contract, in microseconds: the pause before which a session ends, the longest distance from its first click, and how late a click may arrive.
GAP, LENGTH, LATE = 30 * MINUTE, 120 * MINUTE, 60 * MINUTE
#: Least value of a final click.
FINAL_VALUE, FINAL_KIND = 60, "purchase"

CLOSED, OPEN, LATE_ROWS = "closed", "open", "late"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC; a timestamp without a zone counts as UTC whatever the session's zone."""
    c = df[name]
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def _once(clicks: DataFrame, late: int) -> DataFrame:
    """client_id, click_id, us, final, cents, late: each click once."""
    value = clicks["value"].cast("double")
    cents = F.when(F.abs(value) < 1e16, F.floor(100 * value + 0.5)).otherwise(0).cast("long")
    us, arrived = micros(clicks, "ts"), micros(clicks, "arrived_at")
    rows = clicks.select(
        clicks["click_id"],
        us.alias("us"),
        arrived.alias("arrived"),
        clicks["client_id"],
        F.coalesce((clicks["kind"] == FINAL_KIND) & (value >= FINAL_VALUE), F.lit(False)).alias("final"),
        cents.alias("cents"),
    )
    rows = rows.filter("click_id IS NOT NULL AND client_id IS NOT NULL AND us IS NOT NULL")
    # what a click's rows share is settled where they meet; a third of the rows may be one client's, but not one click's
    one = rows.repartition("click_id").groupBy("click_id").agg(F.min(F.struct("arrived", "us", "client_id", "final", "cents")).alias("c"))
    return one.select("c.client_id", "click_id", "c.us", "c.final", "c.cents", F.coalesce(F.col("c.arrived") - F.col("c.us") > late, F.lit(False)).alias("late"))


def _parts(once: DataFrame, gap: int, stretch: int) -> DataFrame:
    """client_id, bucket, kind, lo, lo_id, hi, ends, left, right, n, clicks: islands of a stretch, split behind final clicks; and the late clicks.

    left, right: whether the part may go on before or after its stretch. n: late clicks at lo.
    """
    dealt = once.withColumn("bucket", F.floor(F.col("us") / stretch).cast("long")).repartition("client_id", "bucket")
    click = F.struct("us", "click_id", "cents", "final")
    # windows that touch are merged, so a pause of just `gap` has to leave one microsecond between them
    window = F.session_window(F.timestamp_micros("us"), f"{gap - 1} microseconds")
    islands = dealt.filter(~F.col("late")).groupBy("client_id", "bucket", window).agg(F.array_sort(F.collect_list(click)).alias("clicks"))
    # a part begins where the running sum of finals before a click grows
    heads = F.filter(F.sequence(F.lit(0), F.size("clicks") - 1), lambda i: (i == 0) | F.get("clicks", i - 1).final)
    rows = islands.select("client_id", "bucket", "clicks", heads.alias("heads"))
    rows = rows.select("client_id", "bucket", F.posexplode(F.transform("heads", lambda i, k: F.slice("clicks", i + 1, F.coalesce(F.get("heads", k + 1), F.size("clicks")) - i))).alias("k", "clicks"), F.size("heads").alias("parts"))
    first, last = F.get("clicks", F.lit(0)), F.element_at("clicks", F.lit(-1))
    rows = rows.select(
        "client_id",
        "bucket",
        first["us"].alias("lo"),
        first["click_id"].alias("lo_id"),
        last["us"].alias("hi"),
        last["final"].alias("ends"),
        ((F.col("k") == 0) & (first["us"] - F.col("bucket") * stretch < gap)).alias("left"),
        ((F.col("k") == F.col("parts") - 1) & ~last["final"] & ((F.col("bucket") + 1) * stretch - last["us"] < gap)).alias("right"),
        F.lit(0).cast("long").alias("n"),
        F.transform("clicks", lambda c: F.struct(c.us.alias("us"), c.click_id.alias("click_id"), c.cents.alias("cents"))).alias("clicks"),
    )
    rows = rows.withColumn("kind", F.when(F.col("left") | F.col("right"), OPEN).otherwise(CLOSED))
    late = dealt.filter("late").groupBy("client_id", "bucket", F.col("us").alias("lo")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(LATE_ROWS))
    return rows.unionByName(late, allowMissingColumns=True)


def _cut(part: DataFrame, starts: Column, follows: Column | None = None) -> DataFrame:
    """Adds start, clicks (of that session), more (whether the piece has a later session): a row for each start of a part.

    starts: sorted; the first may lie before the part. follows: whether the piece has a start behind this part.
    """
    rows = part.withColumn("starts", starts)
    after = F.get("starts", F.col("i") + 1)
    own = F.when(F.size("starts") == 1, F.col("clicks")).otherwise(F.filter("clicks", lambda c: (c.us >= F.col("start")) & (after.isNull() | (c.us < after))))
    rows = rows.select("*", F.posexplode("starts").alias("i", "start"))
    return rows.withColumns({"clicks": own, "more": after.isNotNull() | (F.lit(False) if follows is None else follows)})


def _greedy(length: int) -> Column:
    """Starts of the sessions of a whole piece, from its first click on."""
    state = F.struct(F.col("lo").alias("s"), F.array("lo").alias("all"))
    fold = F.aggregate(
        "clicks",
        state,
        lambda x, c: F.when(c.us - x.s > length, F.struct(c.us.alias("s"), F.concat(x["all"], F.array(c.us)).alias("all"))).otherwise(x),
        lambda x: x["all"],
    )
    return F.when(F.col("hi") - F.col("lo") > length, fold).otherwise(F.array("lo"))


def _jumped(nodes: DataFrame, keys: list[str], length: int, folder: str) -> DataFrame:
    """keys, us of all session starts. nodes: keys, bucket, us (distinct clicks of long pieces), head (whether the piece's first).

    Each click points at the first one too late for a session that it begins; that lies in its stretch or the next. A session's
    start after 2k jumps is found once starts after k jumps, and jumps of k, are known.
    """
    spark = nodes.sparkSession
    asks = nodes.select(*keys, F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("b"), "bucket", "us")
    found = asks.select(*keys, "b", F.col("us").alias("at"), F.lit(1).alias("what"), F.col("us").alias("found"), F.lit(None).cast("long").alias("us"))
    asked = nodes.select(*keys, F.col("bucket").alias("b"), (F.col("us") + length).alias("at"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("found"), "us")
    # backwards in time: a question comes before a click of the same time, which isn't too late for it
    w = Window.partitionBy(*keys, "b").orderBy(F.col("at").desc(), "what").rowsBetween(Window.unboundedPreceding, 0)
    jump = found.unionByName(asked).withColumn("to", F.last("found", ignorenulls=True).over(w)).filter("what = 0 AND to IS NOT NULL").select(*keys, "us", "to")
    jump = written(jump, folder, "jump-0")
    starts = written(nodes.filter("head").select(*keys, "us"), folder, "starts-0")
    for k in count(1):
        new = starts.join(jump, [*keys, "us"]).select(*keys, F.col("to").alias("us"))
        grown = written(starts.unionByName(new), folder, f"starts-{k}")
        if grown.count() == starts.count():
            return grown
        twice = jump.join(jump.select(*keys, F.col("us").alias("to"), F.col("to").alias("then")), [*keys, "to"]).select(*keys, "us", F.col("then").alias("to"))
        jump, starts = written(twice, folder, f"jump-{k}"), grown
        remove(spark, f"{folder}/jump-{k - 1}")
        remove(spark, f"{folder}/starts-{k - 1}")


def _joined(parts: DataFrame, gap: int, length: int, folder: str) -> DataFrame:
    """client_id, start, clicks, ends, more of pieces whose parts touch an edge."""
    thin = parts.select("client_id", "bucket", "lo", "lo_id", "hi", "left", "right")
    w = Window.partitionBy("client_id").orderBy("bucket", "lo", "lo_id")  # two rows for each stretch of a client at most
    before = lambda c: F.lag(c).over(w)
    on = F.col("left") & before("right") & (before("bucket") + 1 == F.col("bucket")) & (F.col("lo") - before("hi") < gap)
    thin = thin.withColumn("on", F.coalesce(on, F.lit(False)))
    thin = thin.withColumn("piece", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy("client_id", "piece")
    thin = thin.select("client_id", "bucket", "lo", "lo_id", "piece", F.min("lo").over(piece).alias("first"), F.max("hi").over(piece).alias("end"), F.count("*").over(piece).alias("pieces"))
    thin = written(thin, folder, "pieces")
    key, keys = ["client_id", "bucket", "lo", "lo_id"], ["client_id", "piece"]
    rows = written(parts.drop("kind", "n").join(thin, key), folder, "joined")
    alone = rows.filter("pieces = 1")
    out = _cut(alone, _greedy(length)).select("client_id", "start", "clicks", "ends", "more")
    several = rows.filter("pieces > 1")
    nodes = several.filter(F.col("end") - F.col("first") > length).select(*keys, "bucket", F.explode(F.array_distinct(F.transform("clicks", lambda c: c.us))).alias("us"), "first")
    starts = _jumped(nodes.select(*keys, "bucket", "us", (F.col("us") == F.col("first")).alias("head")), keys, length, folder)
    starts = starts.unionByName(several.filter(F.col("end") - F.col("first") <= length).select(*keys, F.col("first").alias("us")).distinct())
    # starts of a stretch, the one that is carried into it, and whether more follow: rows for each stretch of a piece
    spans = several.select(*keys, "bucket", "lo", "hi")
    own = spans.join(starts, keys).filter("us BETWEEN lo AND hi").groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list("us")).alias("own"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    marked = spans.join(own, [*keys, "bucket"], "left").select(
        *keys,
        "bucket",
        F.coalesce("own", F.array().cast("array<long>")).alias("own"),
        F.max(F.element_at("own", -1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        (F.max(F.get("own", F.lit(0))).over(w.rowsBetween(1, Window.unboundedFollowing))).isNotNull().alias("follows"),
    )
    rows = several.join(marked, [*keys, "bucket"])
    carried = F.when(F.col("carried").isNull() | (F.get("own", F.lit(0)) == F.col("lo")), F.array().cast("array<long>")).otherwise(F.array("carried"))
    rows = _cut(rows, F.concat(carried, F.col("own")), F.col("follows"))
    rows = rows.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("bucket", "clicks", "ends", "more"))).alias("x"))
    last = F.element_at("x", -1)
    # the piece's last part tells whether its last click is final
    return out.unionByName(rows.select("client_id", "start", F.flatten(F.transform("x", lambda p: p.clicks)).alias("clicks"), last["ends"].alias("ends"), last["more"].alias("more")))


def _late_counts(marks: DataFrame, per: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """client_id, session_id, n_late: late clicks merged with starts inside a stretch, behind the last start before it."""
    w = Window.partitionBy("client_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    none = F.lit(None).cast(per.schema["last"].dataType)
    each = per.unionByName(late.select("client_id", "bucket", none.alias("last"), F.lit(True).alias("asks")).distinct(), allowMissingColumns=True)
    each = each.groupBy("client_id", "bucket").agg(F.max("last").alias("last"), F.max("asks").alias("asks"))
    carried = each.withColumn("last", F.last("last", ignorenulls=True).over(w)).filter("asks AND last IS NOT NULL").select("client_id", "bucket", "last.start_us", "last.session_id")
    events = marks.unionByName(carried).select("client_id", "bucket", F.col("start_us").alias("at"), F.lit(0).alias("what"), "session_id", F.lit(0).cast("long").alias("n"))
    events = events.unionByName(late.select("client_id", "bucket", F.col("lo").alias("at"), F.lit(1).alias("what"), F.lit(None).cast(marks.schema["session_id"].dataType).alias("session_id"), "n"))
    w = Window.partitionBy("client_id", "bucket").orderBy("at", "what", "session_id").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("session_id", F.last("session_id", ignorenulls=True).over(w)).filter("what = 1 AND session_id IS NOT NULL")
    return found.groupBy(*keys).agg(F.sum("n").alias("n_late"))


def sessions(clicks: DataFrame, gap: int = GAP, length: int = LENGTH, late: int = LATE) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, click_ids (in order): a row for each session.

    clicks: click_id, ts, arrived_at, client_id, kind, value; other columns are not read. gap, length, late in microseconds.
    Rows without click_id, client_id or ts take no part. Of rows of one click_id that differ, the one that arrived first counts
    (without arrived_at before all others; then by ts, client_id). A click without arrived_at isn't late, one without kind or
    value isn't final, and a value that is null, not finite or 1e16 or more adds no cents. Clicks at one time are ordered by
    click_id. An empty table gives no rows. A session is one result row, so its clicks have to meet.
    """
    spark = session(clicks)
    folder = shared_folder(spark)
    stretch = -(-max(3 * length, 2 * gap + length) // MINUTE) * MINUTE  # so each stretch that a piece crosses has a start in it
    _parts(_once(clicks, late), gap, stretch).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/parts")
    parts = spark.read.schema(_schema(clicks)).parquet(f"{folder}/parts")
    of = lambda kind: parts.filter(F.col("kind") == kind)
    closed = _cut(of(CLOSED), _greedy(length)).select("client_id", "start", "clicks", "ends", "more")
    every = closed.unionByName(_joined(of(OPEN), gap, length, folder))
    every = every.select(
        "client_id",
        F.get("clicks", F.lit(0))["click_id"].alias("session_id"),
        F.col("start").alias("start_us"),
        F.element_at("clicks", F.lit(-1))["us"].alias("end_us"),
        F.aggregate("clicks", F.lit(0).cast("long"), lambda x, c: x + c.cents).alias("value_cents"),
        F.when(F.col("more"), "length").when(F.col("ends"), "end").alias("closed_by"),
        F.transform("clicks", lambda c: c.click_id).alias("click_ids"),
    )
    every = written(every, folder, "sessions")
    marks = every.select("client_id", F.floor(F.col("start_us") / stretch).cast("long").alias("bucket"), "start_us", "session_id")
    per = marks.groupBy("client_id", "bucket").agg(F.max(F.struct("start_us", "session_id")).alias("last"))
    keys = ["client_id", "session_id"]
    notes = _late_counts(marks, per, of(LATE_ROWS).select("client_id", "bucket", "lo", "n"), keys).withColumn("is_last", F.lit(False))
    notes = notes.unionByName(per.groupBy("client_id").agg(F.max("last").alias("last")).select("client_id", "last.session_id", F.lit(0).cast("long").alias("n_late"), F.lit(True).alias("is_last")))
    notes = notes.groupBy(*keys).agg(F.sum("n_late").alias("n_late"), F.max("is_last").alias("is_last"))
    return every.join(notes, keys, "left").select(
        "client_id",
        "session_id",
        "start_us",
        "end_us",
        F.size("click_ids").cast("long").alias("n_clicks"),
        F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"),
        "value_cents",
        F.coalesce("closed_by", F.when(F.col("is_last"), "none"), F.lit("gap")).alias("closed_by"),
        "click_ids",
    )


def _schema(clicks: DataFrame) -> str:
    client, click = (clicks.schema[c].dataType.simpleString() for c in ("client_id", "click_id"))
    return f"client_id {client}, bucket long, lo long, lo_id {click}, hi long, ends boolean, left boolean, right boolean, n long, clicks array<struct<us: long, click_id: {click}, cents: long>>, kind string"


def op11_sessions(spark, sf_dir: str) -> DataFrame:
    out = sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return out.select("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", F.sha2(F.array_join(F.transform("click_ids", lambda x: x.cast("string")), ","), 256).alias("path_sha256"))


ORACLE_SQL = f"""
WITH RECURSIVE c AS (
  SELECT click_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > {LATE}, false) AS late, client_id,
    coalesce(kind = '{FINAL_KIND}' AND value >= {FINAL_VALUE}, false) AS final, CASE WHEN abs(value) < 1e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
  FROM (SELECT * FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts, client_id, kind, value) = 1)),
t AS (SELECT *, lag(us) OVER w AS before, lag(final) OVER w AS broken, lead(us) OVER w AS next FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
p AS (SELECT *, sum(CASE WHEN before IS NULL OR broken OR us - before >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY us, click_id) AS piece FROM t),
s(client_id, piece, start_us) AS (
  SELECT client_id, piece, min(us) FROM p GROUP BY client_id, piece
  UNION ALL SELECT s.client_id, s.piece, min(p.us) FROM s JOIN p ON p.client_id = s.client_id AND p.piece = s.piece AND p.us - s.start_us > {LENGTH} GROUP BY s.client_id, s.piece),
m AS (SELECT p.*, s.start_us FROM p ASOF JOIN s ON p.client_id = s.client_id AND p.piece = s.piece AND p.us >= s.start_us),
g AS (
  SELECT client_id, piece, start_us, arg_min(click_id, (us, click_id)) AS session_id, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
    arg_max(final, (us, click_id)) AS ends, arg_max_null(next, (us, click_id)) AS next, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY us, click_id)) AS path_sha256
  FROM m GROUP BY client_id, piece, start_us),
n AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY start_us, session_id) AS until FROM g),
l AS (SELECT n.client_id, n.session_id, count(*) AS n_late FROM n JOIN c ON c.late AND c.client_id = n.client_id AND c.us >= n.start_us AND (n.until IS NULL OR c.us < n.until) GROUP BY ALL)
SELECT n.client_id, n.session_id, n.start_us, n.end_us, n.n_clicks, coalesce(l.n_late, 0) AS n_late, n.value_cents,
  CASE WHEN n.ends THEN 'end' WHEN n.next IS NULL THEN 'none' WHEN n.next - n.end_us >= {GAP} THEN 'gap' ELSE 'length' END AS closed_by, n.path_sha256
FROM n LEFT JOIN l ON l.client_id = n.client_id AND l.session_id = n.session_id
"""
