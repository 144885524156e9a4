"""Gap sessionisation against a loop over each client's clicks."""

import datetime as dt
import random
from hashlib import sha256

import pytest

from pactum.llm import sessions as S

M = S.MINUTE
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"
EPOCH = dt.datetime(2024, 1, 1)
BASE = int(EPOCH.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000


def at(us):
    return EPOCH + dt.timedelta(microseconds=us)


def brute(rows, gap=S.GAP, length=S.LENGTH, late=S.LATE):
    clicks = {}
    order = lambda r: (r[2] is not None, r[2] or EPOCH, r[1], r[3])
    for r in rows:
        if r[0] is not None and r[1] is not None and r[3] is not None and (r[0] not in clicks or order(r) < order(clicks[r[0]])):
            clicks[r[0]] = r
    by = {}
    for r in clicks.values():
        us = (r[1] - EPOCH) // dt.timedelta(microseconds=1)
        is_late = r[2] is not None and (r[2] - r[1]) // dt.timedelta(microseconds=1) > late
        by.setdefault(r[3], ([], []))[is_late].append((us, r[0], r[4] == "purchase" and r[5] is not None and r[5] >= 60, r[5]))
    out = {}
    for client, (timely, lates) in by.items():
        found = []
        for c in sorted(timely):
            why = None
            if found:
                own = found[-1]
                why = "end" if own[-1][2] else "gap" if c[0] - own[-1][0] >= gap else "length" if c[0] - own[0][0] > length else None
            if not found or why:
                if found:
                    out[client, found[-1][0][1]] = [found[-1], why]
                found.append([])
            found[-1].append(c)
        if found:
            out[client, found[-1][0][1]] = [found[-1], "end" if found[-1][-1][2] else "none"]
        for i, own in enumerate(found):
            until = found[i + 1][0][0] if i + 1 < len(found) else None
            n = sum(own[0][0] <= x[0] and (until is None or x[0] < until) for x in lates)
            cents = sum(int((100 * c[3] + 0.5) // 1) for c in own if c[3] is not None)
            clicks_, why = out[client, own[0][1]]
            out[client, own[0][1]] = (BASE + own[0][0], BASE + own[-1][0], len(own), n, cents, why, [c[1] for c in own])
    return out


def got(spark, rows, **how):
    out = S.sessions(spark.createDataFrame(rows, SCHEMA), **how).collect()
    assert len({(r.client_id, r.session_id) for r in out}) == len(out)
    return {(r.client_id, r.session_id): (r.start_us, r.end_us, r.n_clicks, r.n_late, r.value_cents, r.closed_by, r.click_ids) for r in out}


def walk(rng, n, clients, steps, final=0.05):
    """Clicks at exact and nearly exact distances, with ties, late ones and repeats."""
    rows, now, ident = [], dict.fromkeys(range(clients), 0), list(range(n))
    rng.shuffle(ident)
    for i in ident:
        c = rng.randrange(clients)
        now[c] += rng.choice(steps)
        arrived = now[c] + rng.choice([0, 0, 0, S.LATE, S.LATE + 1, 5 * S.LATE])
        kind, value = ("purchase", rng.choice([60.0, 59.99, 75.555, None])) if rng.random() < final else (rng.choice(["view", None]), rng.choice([1.005, -3.2, None]))
        rows += [(i, at(now[c]), at(arrived), c, kind, value)] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("steps", [[0, 0, M, S.GAP - 1, S.GAP, S.GAP + 1, S.LENGTH], [20 * M, 29 * M, 10 * M, S.GAP - 1, 0], [0, 1, 1000]])
def test_against_a_loop(spark, steps):
    rows = walk(random.Random(len(steps)), 600, 3, steps)
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 3


def test_a_client_without_a_pause(spark):
    """One piece over many stretches: only the length ends sessions, and each start depends on the one before."""
    rng = random.Random(5)
    rows = walk(rng, 900, 1, [7 * M, 11 * M, 13 * M + 1, 24 * M], final=0)
    rows = [(r[0], r[1], r[1], *r[3:]) for r in rows]  # none late
    want = brute(rows)
    assert got(spark, rows) == want and {x[5] for x in want.values()} == {"length", "none"} and len(want) > 60


def test_other_measures(spark):
    rows = walk(random.Random(9), 300, 2, [0, M, 2 * M, 5 * M])
    how = {"gap": 5 * M, "length": 7 * M, "late": 30 * M}
    assert got(spark, rows, **how) == brute(rows, **how)


def test_edges(spark):
    t = lambda m: at(m * M)
    rows = [
        (1, t(0), None, 7, None, None),  # no arrival, no kind, no value
        (2, t(5), t(5), 7, "purchase", float("nan")),  # more than any value: final, no cents
        (3, t(6), t(6), 7, "view", float("inf")),
        (None, t(6), t(6), 7, "view", 1.0),
        (4, None, t(6), 7, "view", 1.0),
        (5, t(6), t(6), None, "view", 1.0),
        (6, t(1), t(200), 8, "view", 1.0),  # late, before any session
        (7, t(300), t(300), 8, "view", 0.005),
        (8, t(60 * 24 * 30), t(60 * 24 * 40), 8, "view", 1.0),  # late, a month behind the start
        (9, t(9), t(9), 9, "view", 1.0),
        (9, t(3), t(4), 9, "view", 2.0),  # the same click, arrived before
        (10, t(1), t(100), 10, "view", 1.0),  # a client with late clicks only
    ]
    assert got(spark, rows) == {
        (7, 1): (BASE, BASE + 5 * M, 2, 0, 0, "end", [1, 2]),
        (7, 3): (BASE + 6 * M, BASE + 6 * M, 1, 0, 0, "none", [3]),
        (8, 7): (BASE + 300 * M, BASE + 300 * M, 1, 1, 1, "none", [7]),
        (9, 9): (BASE + 3 * M, BASE + 3 * M, 1, 0, 200, "none", [9]),
    }
    assert got(spark, []) == {}


def test_query(spark, tmp_path):
    """The wrapper's digests, clashing columns, times before 1970, and a session whose zone isn't UTC."""
    rows = [(i, at(i * M) - dt.timedelta(days=30000), at(i * M) - dt.timedelta(days=30000), 1, "view", 1.0) for i in range(5)]
    df = spark.createDataFrame([(*r, "{}", 1, 2) for r in rows], SCHEMA + ", props string, bucket int, clicks int")
    df.write.parquet(f"{tmp_path}/clicks.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = S.op11_sessions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in row] == [(1, 0, BASE - 30000 * 1440 * M, BASE - 30000 * 1440 * M + 4 * M, 5, 0, 500, "none", sha256(b"0,1,2,3,4").hexdigest())]
