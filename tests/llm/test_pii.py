"""Personal data: the contract's spans against Python's re, the fits against numpy, and what the method adds."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import pii as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def given(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 8 <= len(d) <= 15}
            if ok[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def got(spark, texts, more=()):
    df = spark.createDataFrame([(i, t, *more) for i, t in enumerate(texts)], "doc_id long, text string" + "".join(f", x{i} int" for i in range(len(more))))
    return {r.doc_id: r.spans for r in P.personal_data(df).collect()}


def test_given_spans(spark):
    rng = random.Random(1)
    bits = ["a", ".", "@", "@x.y", "b-c", "1", "23", "256", "0", "+", "+4", " ", "-", "(", ")", "ü", "😀", "\n", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (826) 555-4081", "_", "00255", "%"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(400)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.c_d@e.f.g@h.i", "a@@b.c x@y z@.a", "+1+2345678+1", "4111111111111111 4111111111111111", "😀 me@mail.example.org!"]
    out = got(spark, texts)
    assert {i: [(s.kind, s.start, s.end) for s in out[i] if s.given] for i in out} == {i: given(t) for i, t in enumerate(texts)}


def test_very_long_runs(spark):
    """Nothing takes more than linear time, or as much stack as there are repetitions."""
    n = 300_000
    card = "1 " * 9 + "1"
    texts = {
        "a" * n: [],
        "1" * n: [],
        "1." * n: [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)],
        "a@" + "b." * n + "c": [("email", 0, 2 * n + 3)],
        "+" + "1 " * n: [],
        "a@" * n: [],
        "me@mail.example.com " * 3000: [("email", 20 * i, 20 * i + 19) for i in range(3000)],
        "1:" * n: [],
        f"+{card}": [("phone", 0, len(card) + 1)],
    }
    out = got(spark, list(texts))
    assert {i: [(s.kind, s.start, s.end) for s in out[i] if s.given] for i in out} == dict(enumerate(texts.values()))


def believed(rows):
    """EM as in `believed`, over single spans."""
    known, votes, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows], float)
    prior, t, u = 0.5, np.array(P.PRIOR_TRUE), np.array(P.PRIOR_FALSE)
    chance = lambda: np.where(known, 1, 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + (votes == 1) @ np.log(t / u) + (votes == -1) @ np.log((1 - t) / (1 - u))))))
    for _ in range(P.ROUNDS):
        q = chance()
        prior = ((n * q)[~known].sum() + 1) / (n[~known].sum() + 2)
        w = P.PRIOR_WEIGHT
        t, u = (((n * x) @ (votes == 1) + w * np.array(b)) / ((n * x) @ (votes != 0) + w) for x, b in ((q, P.PRIOR_TRUE), (1 - q, P.PRIOR_FALSE)))
    return chance()


def test_fits(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        true = rng.random() < 0.5
        votes = [int(v) for v in np.where(rng.random(P.VOTES) < (0.85 if true else 0.25), 1, -1) * (rng.random(P.VOTES) < 0.8)]
        features = [1, *(int(x) for v in votes for x in (v == 1, v == -1)), *rng.integers(0, 2, 4).tolist()]
        rows.append((bool(true and rng.random() < 0.4), votes, features, float(rng.integers(1, 9))))
    df = spark.createDataFrame([(rows,)], "t array<struct<known: boolean, votes: array<int>, features: array<int>, n: double>>")
    row = df.select(P.believed(F.col("t")).alias("t")).select("t", P.fitted(F.col("t")).alias("w")).first()
    want = believed(rows)
    assert np.allclose([r.truth for r in row.t], want, atol=1e-9)
    f, n = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    seen, w = n @ f, np.zeros(P.FEATURES)
    losses = []
    for _ in range(P.STEPS):
        s = 1 / (1 + np.exp(-(f @ w)))
        losses.append(-(n * (want * np.log(s) + (1 - want) * np.log(1 - s))).sum() + P.RIDGE * n.sum() * (w @ w) / 2)
        w = w - ((n * (s - want)) @ f + P.RIDGE * n.sum() * w) / ((1 + P.VOTES + 4) / 4 * seen + P.RIDGE * n.sum())
    assert np.allclose(row.w, w, atol=1e-9) and all(a >= b - 1e-9 for a, b in zip(losses, losses[1:], strict=False))


CARDS = [d for d in ("4" + f"{i:015}" for i in range(700)) if luhn(d)]
DECOYS = [d for d in ("4" + f"{i:015}" for i in range(60)) if not luhn(d)]


def test_added_spans(spark):
    """What a failing match swallowed is found; numbers that fail their arithmetic, hashes and versions are left alone."""
    texts = [f"pay with {c} now" for c in CARDS] + [f"see {d} there" for d in DECOYS]
    texts += [f"call +1 ({200 + i}) 555-{1000 + i} now" for i in range(60)] + [f"mail joe{i}@mail.example.com now" for i in range(40)] + [f"host 81.2.{i}.7 up" for i in range(40)]
    first = len(texts)
    texts += [
        f"pay {CARDS[3]} {CARDS[4]} now",
        "call +1 (826) 555-4081 190.137.223.204 now",
        "contact ann (at) mail (dot) example (dot) com now",
        'token = "b7852d4e73166f43a80132626729b5fa5141a7a6" and v1.2.3',
        f"x{CARDS[3]}y",
        "it was 1999-2001, 12 345 and 3.14159",
    ]
    out = got(spark, texts)
    added = lambda i: [texts[i][s.start : s.end] for s in out[i] if not s.given]
    assert all(not added(i) for i in range(first))
    assert [added(i) for i in range(first, len(texts))] == [[CARDS[3], CARDS[4]], ["+1 (826) 555-4081"], ["ann (at) mail (dot) example (dot) com"], [], [], []]
    assert all(s.score >= P.THRESHOLD for i in out for s in out[i] if not s.given)


def test_edges(spark, tmp_path):
    assert got(spark, []) == {}
    assert got(spark, [None, "", "nothing"], (1,)) == {0: [], 1: [], 2: []}
    df = spark.createDataFrame([(None, "me@x.org", 1), (None, None, 2), (7, "me@x.org", 3), (7, "me@x.org", 3)], "doc_id long, text string, row int")
    rows = P.personal_data(df).collect()
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows) == [(0, []), (0, [("email", 0, 8)]), (7, [("email", 0, 8)]), (7, [("email", 0, 8)])]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    row = P.op12_pii(spark, str(tmp_path)).filter("doc_id = 7").first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 0, 0) and row.spans == "email:0:8" and row.base_sha256 == sha256(b"email:0:8").hexdigest()


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(7, "me@x.org")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = P.op12_pii(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("value, ok", [("0255.1.1.01", True), ("256.1.1.1", False), ("1.1.1.00000000000000000000099", True)])
def test_octets(spark, value, ok):
    assert spark.createDataFrame([(P.IP, value)], "k int, v string").select(P._passes(F.col("k"), F.col("v"))).first()[0] is ok
