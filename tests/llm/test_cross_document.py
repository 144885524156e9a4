"""Operators that compare documents: suffix-array dedup, substring dedup, near-dedup, components, the pipeline. Brute force decides."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactum.llm import common, components, near_dedup, quality_rules, spans, substring_dedup, suffix_dedup
from pactum.llm.common import flat, shared_folder

LAST = 1 << 63
DOCS = "doc_id long, text string, blk string, rank string, cell int, bucket int"  # with names that operators use inside


@pytest.fixture(autouse=True)
def few_blocks(monkeypatch):
    for module in (spans, substring_dedup):
        monkeypatch.setattr(module, "LEAST_BLOCKS", 5)
        monkeypatch.setattr(module, "LEAST_BUCKETS", 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "r", 1, 2) for i, t in rows], DOCS)


def corpus(seed, alphabet, lengths, n=60):
    """Texts that share passages, copies, repeated ids, nulls, empty and short texts; ids aren't in order."""
    rng = random.Random(seed)
    make = lambda k: " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(k))
    shared = [make(k) for k in (4, 9, 14, 20, 40)]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(*lengths))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), make(rng.randint(0, 12))]
        rows.append((i * 7 % 101, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[4][1]), (201, rows[4][1]), (None, rows[5][1]), (None, rows[5][1] + " tail"), (202, None), (203, ""), (204, "short"), (205, "ß" * 300), (206, "é" + "ß" * 299), (207, " ".join(["again"] * 60))]
    rng.shuffle(rows)
    return rows


def key(i):
    return LAST if i is None else i


def brute(rows, tokens, window, join):
    """For each row: tokens, covered tokens, runs, digest of what is kept."""
    first: dict = {}
    for i, t in rows:
        w = tokens(t or "")
        for p in range(len(w) - window + 1):
            s = join(w[p : p + window])
            first[s] = min(first.get(s, LAST), key(i))
    out = []
    for i, t in rows:
        w = tokens(t or "")
        cov = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[join(w[p : p + window])] < key(i):
                cov[p : p + window] = [True] * window
        runs = sum(c and (p == 0 or not cov[p - 1]) for p, c in enumerate(cov))
        out.append((i, len(w), sum(cov), runs, hashlib.sha256(join([x for x, c in zip(w, cov, strict=True) if not c])).hexdigest()))
    return sorted(out, key=str)


def test_maximal_repeats():
    rng = random.Random(5)
    for _ in range(150):
        strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        where = defaultdict(set)
        for k, s in enumerate(strings):
            for i in range(len(s)):
                for j in range(i + 3, len(s) + 1):
                    where[s[i:j]].add((k, i))
        want = set()
        for x, occurrences in where.items():
            left = {strings[k][i - 1] if i else (k, i) for k, i in occurrences}
            right = {strings[k][i + len(x)] if i + len(x) < len(strings[k]) else (k, i) for k, i in occurrences}
            if len(occurrences) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(x), frozenset(occurrences)))
        assert {(n, frozenset(o)) for n, o in suffix_dedup.maximal_repeats(strings, 3)} == want
        # listed once with a mark, or as often as they occur: the same groups
        distinct = list(dict.fromkeys(strings))
        several = np.array([strings.count(x) > 1 for x in distinct])
        merged = {(n, frozenset((distinct.index(strings[k]), i) for k, i in o)) for n, o in want}
        assert {(n, frozenset(o)) for n, o in suffix_dedup.maximal_repeats(distinct, 3, several)} == merged


def test_strips_own_every_window_once():
    rng = np.random.default_rng(1)
    for n in (0, 5, 49, 50, 51, 400):
        tokens = rng.integers(0, 4, n).astype(np.uint64)
        offs = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 3)])).astype(np.int64)
        h, first, last = spans.strips_of(tokens, offs, 50, 16)
        own = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
        assert own == [p for a, b in zip(offs[:-1], offs[1:], strict=True) for p in range(a, b - 49)]
    a = np.arange(200, dtype=np.uint64) % np.uint64(37) * np.uint64(977)
    strips = lambda x: {(int(h), x[f : l + 50].tobytes()) for h, f, l in zip(*spans.strips_of(x, np.array([0, len(x)]), 50, 16), strict=True)}  # noqa: E731,E741
    assert len(strips(a) & strips(np.concatenate([np.full(9, 5, np.uint64), a]))) >= len(strips(a)) - 2


def test_suffix_dedup(spark):
    rows = corpus(1, "abcé", (0, 20))
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    want = brute(rows, lambda t: [bytes([b]) for b in t.encode()], 50, b"".join)
    assert got == want and sum(r[2] for r in want) > 3000


def test_suffix_dedup_texts(spark):
    rows = corpus(1, "abcé", (0, 20))
    df = frame(spark, rows)
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect() if r.doc_id not in (None, 201)}
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id in kept} == {i: k.decode(errors="ignore") for i, k in kept.items()}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeat_groups(spark):
    """Every group has all places of its string, and every string of 50 bytes that several documents have is in a group."""
    rows = corpus(3, "abcé", (0, 20))
    ids = {i: n for n, (i, _) in enumerate(rows)}
    assert len(ids) < len(rows)  # some share an id, or have none
    groups = defaultdict(list)
    for r in suffix_dedup.repeat_groups(frame(spark, rows)).collect():
        groups[bytes(r.repeat), r.length].append((r.doc_id, r.offset))
    texts = [(i, (t or "").encode()) for i, t in rows]
    strings = {(hashlib.blake2b(t[a : a + n], digest_size=16).digest(), n): t[a : a + n] for i, t in texts for d, n in groups for j, a in groups[d, n][:1] if i == j and hashlib.blake2b(t[a : a + n], digest_size=16).digest() == d}
    assert strings.keys() == groups.keys() and len(groups) > 50
    for k, x in strings.items():
        places = [(i, a) for i, t in texts for a in range(len(t) - len(x) + 1) if t.startswith(x, a)]
        assert sorted(groups[k], key=str) == sorted(places, key=str) and len(places) > 1
    windows = defaultdict(set)
    for i, t in texts:
        for a in range(len(t) - 49):
            windows[t[a : a + 50]].add(i)
    inside = {x[a : a + 50] for x in strings.values() for a in range(len(x) - 49)}
    assert {w for w, docs in windows.items() if len(docs) > 1} <= inside
    assert suffix_dedup.repeat_groups(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 4), (3, 2)])
def test_substring_dedup(spark, batches, fanout):
    rows = corpus(2, "ab", (0, 25), 40)
    got = substring_dedup.remove_seen(frame(spark, rows), batches=batches, fanout=fanout).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    want = [(a, b, c, e) for a, b, c, _, e in brute(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()), 13, b" ".join)]
    assert got == sorted(want, key=str) and sum(r[2] for r in want) > 300


def test_index_reads_a_document_once_and_is_reopened(spark):
    """Eight batches of a fixed size, each through a newly opened index: what is read of earlier documents stays flat."""
    rng = random.Random(21)
    make = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    hot, pairs, rows, reads = make(30), [make(20) for _ in range(8)], [], []
    for i in range(160):
        k = i // 20
        shared = [pairs[k]] * (i % 20 == 3) + [pairs[k - 1]] * (i % 20 == 7 and k > 0)  # in one batch, and again in the next
        rows.append((i, " ".join([make(25), hot, make(5), *shared, make(5)])))
    folder, got = shared_folder(spark), []
    for k in range(8):
        index = substring_dedup.FingerprintIndex(spark, folder, fanout=3)
        df = spark.createDataFrame(rows[: 20 * (k + 1)], "doc_id long, text string").withColumn("rank", F.col("doc_id"))
        got += index.ingest(df.filter(f"doc_id >= {20 * k}"), df.filter(f"doc_id < {20 * k}")).collect()
        reads.append(index.read)
    assert index.state["batches"] == 8 and len(index.state["runs"]) < 3
    assert reads[0] == 0 and max(reads) <= 3  # of up to 140
    want = brute(rows, lambda t: t.encode().split(), 13, b" ".join)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == sorted([(a, b, c, e) for a, b, c, _, e in want], key=str)


def test_index_grows_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1500)
    rows = corpus(2, "ab", (0, 25), 40)
    got = substring_dedup.remove_seen(frame(spark, rows), batches=4, fanout=3).collect()
    want = [(a, b, c, e) for a, b, c, _, e in brute(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()), 13, b" ".join)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == sorted(want, key=str)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.remove_seen(frame(spark, []), batches=2).count() == 0


def near_corpus():
    """Families of edited copies around the threshold, with chains, equal sets, short texts, repeated and null ids."""
    rng = random.Random(6)
    rows, at = [], 0
    for f in range(12):
        base = [f"w{f}x{rng.randint(0, 400)}" for _ in range(rng.choice([60, 120, 200]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 50)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
            rows.append((at * 13 % 997, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
            at += 1
            if rng.random() < 0.3:
                base = w
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "one two three"), (2003, ""), (2004, None), (2005, " \n"), (2006, rows[0][1]), (2006, rows[-1][1]), (None, rows[1][1]), (None, "alone " * 9 + "in the world")]
    return rows


def brute_near(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    keys = [LAST + n if i is None else i for n, (i, _) in enumerate(rows)]  # a row without an id is a document of its own
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(keys[a]), root(keys[b])
                parent[max(x, y)] = min(x, y)
    low = [root(k) for k in keys]
    return sorted(((i, len(s), None if r >= LAST else r, r == k) for (i, _), k, s, r in zip(rows, keys, sets, low, strict=True)), key=str)


@pytest.mark.parametrize("limits", [(20_000, 192, 1000), (4, 3, 1000), (4, 3, 0)])
def test_near_duplicates(spark, monkeypatch, limits):
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", limits[2])
    monkeypatch.setattr(near_dedup, "KEY_DOCS", limits[0])
    monkeypatch.setattr(near_dedup, "CELL_DOCS", limits[1])
    rows = near_corpus()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = brute_near(rows)
    assert got == want and sum(not r[3] for r in want) > 30


def test_near_duplicates_of_another_percent(spark):
    rows = [(i, t) for i, t in near_corpus() if i is not None and i < 2000]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), percent=80).collect()}
    words = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    want = {i: i for i in sets}
    for _ in sets:
        before = dict(want)
        for i in sets:
            want[i] = min(want[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
        if want == before:
            break
    assert got == want
    assert len(set(want.values())) < sum(r.kept for r in near_dedup.near_duplicates(frame(spark, rows)).collect())


def test_pipeline_links_from_80_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [" ".join(f"w{i}" for i in range(100)), " ".join("x" if i in (30, 60) else f"w{i}" for i in range(100)), " ".join("x" if i in (20, 50, 80) else f"v{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # the first two share 86 of 106 shingles, the others 81 of 111
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_rows_without_ids_are_documents_of_their_own(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (9, b), (None, a), (None, b), (None, "some other words of no one else"), (None, "some other words of no one else")]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_near(rows) and [r[3] for r in got if r[0]] == [True, True]
    kept = near_dedup.without_near_duplicates(frame(spark, rows).withColumnRenamed("cell", "__rank"))
    assert kept.columns == ["doc_id", "text", "blk", "rank", "__rank", "bucket"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


LEAST, MOST = -(1 << 63), (1 << 63) - 1


@pytest.mark.parametrize("ids", [(LEAST, 5, MOST, None), (1, 1 << 62, MOST, None), (LEAST, 0, MOST, MOST)])
def test_any_long_is_an_id(spark, ids):
    """No id stands for anything else; null comes after all."""
    shared, more = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    texts = [f"{shared} one", f"two {shared} {more}", f"{more} {shared} three", f"four {more}"]
    rows = list(zip(ids, texts, strict=True))
    words = [(a, b, c, e) for a, b, c, _, e in brute(rows, lambda t: t.encode().split(), 13, b" ".join)]
    for batches in (1, 3):
        got = substring_dedup.remove_seen(frame(spark, rows), batches=batches).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == sorted(words, key=str)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = brute(rows, lambda t: [bytes([b]) for b in t.encode()], 50, b"".join)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == want


def test_near_duplicates_of_large_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    big = 1 << 62
    rows = [(big + 5, a), (big + 9, a), (big, b), (None, "x y z"), (None, a), (LEAST, "x y z"), (MOST, b)]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(big + 5, 36, big + 5, True), (big + 9, 36, big + 5, False), (None, 36, big + 5, False), (big, 36, big, True), (MOST, 36, big, False), (LEAST, 1, LEAST, True), (None, 1, LEAST, False)], key=str)
    kept = near_dedup.without_near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {big + 5, big, LEAST} and len(kept) == 3
    without = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, without)).collect()}
    assert got == {big + 5: big + 5, big + 9: big + 5, big: big, MOST: big, LEAST: LEAST}


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 2), (2, text + " b", "c", 3)], "doc_id long, text string, `source url` string, `a.b` int")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, text, "a", 2), (2, " b", "c", 3)]
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(df).collect()) == [1]


def test_null_ids_spread_over_blocks(spark):
    rows = frame(spark, [(None if i % 2 else i, f"text {i}") for i in range(4000)])
    p = spans.Plan(True, 13, 4, 16, 16)
    sizes = [r["count"] for r in spans.in_blocks(common.placed(rows.select("doc_id", "text"), ""), p).groupBy("blk").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]


def test_long_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement are equal under any polynomial modulo 2**64 from 1,024 letters on."""
    for k in (9, 10, 11, 12):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        other = word.translate(str.maketrans("ab", "ba"))
        rows = [(20, word), (21, other), (22, " ".join([word] * 8 + [other] * 8))]
        assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [20, 21, 22]
        eight = [word if i.bit_count() % 2 else other for i in range(16)]
        measured = quality_rules.measure(*flat(pa.array([" ".join(eight)])))
        assert measured[4][0] == 0


def test_similar_documents_without_links_fall_away(spark, monkeypatch):
    """Many documents of similarity 0.6 hang together loosely; the closer sketch parts them before their sets are compared."""
    monkeypatch.setattr(near_dedup, "CELL_DOCS", 16)
    sent, loose, verify, tightened = [], [], near_dedup.verify, near_dedup.tightened
    monkeypatch.setattr(near_dedup, "verify", lambda docs, members, *more: sent.append((members.count(), loose[0])) or verify(docs, members, *more))
    monkeypatch.setattr(near_dedup, "tightened", lambda rows, members, *more: loose.append(members.count()) or tightened(rows, members, *more))
    rng = random.Random(14)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(5, 95), 3):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in rows[:3]] + [(2000, " ".join(rows[4][1].split() + ["tail"]))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_near(rows)
    assert sent[0][1] > 100 and sent[0][0] < 40


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    r = near_dedup.registers([a, b, np.unique(np.concatenate([a, b])), np.zeros(0, np.uint64)])
    assert np.array_equal(np.minimum(r[0], r[1]), r[2]) and np.isinf(r[3]).all()
    scale = lambda x: near_dedup.on_scale(x[:, : near_dedup.REGISTERS], near_dedup.COARSE, 255).astype(np.uint8)
    assert (np.maximum(scale(r[:1]), scale(r[1:2])) == scale(r[2:3])).all()
    for share, expected in ((0.95, True), (0.87, True), (0.3, False)):
        n = 2000
        own = int(n * (1 - share) / (1 + share))
        x, y = pool[: n - own], np.concatenate([pool[: n - 2 * own], pool[n : n + own]])
        s = scale(near_dedup.registers([np.unique(x), np.unique(y)]))
        assert near_dedup.likely(s[0], len(x), s[1:], np.array([len(y)]))[0] == expected


def test_components_loop_until_nothing_changes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.component for r in components.connected_components(edges, shared_folder(spark), "c").collect()} == {0}


def test_filter_keeps_links():
    n = near_dedup.REGISTERS
    for percent in (80, 85):
        s, least = percent / 100, near_dedup.tuning(percent)[1]
        alike = 1 + 2 * math.log(1 - (near_dedup.COARSE - 1) / near_dedup.COARSE * (1 - s) / 2) / math.log(near_dedup.COARSE)
        lost = 0.0
        for same in range(n + 1):
            for more in range(n - same + 1):
                a, b = np.zeros(n, np.uint8), np.zeros((1, n), np.uint8)
                a[same : same + more], b[0, same + more :] = 1, 1
                if not near_dedup.likely(a, 1000, b, np.array([1000]), percent)[0]:
                    lost += math.comb(n, same) * math.comb(n - same, more) * alike**same * ((1 - alike) / 2) ** (n - same)
        assert lost <= 1e-8 and least < s


@pytest.mark.parametrize("hub", [3, 10_000])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "LEAST_HUB", hub)
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.connected_components(df, shared_folder(spark), "t").collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(df.limit(0), shared_folder(spark), "t").count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pactum.llm.decontaminate import find_hits
    from pactum.llm.quality_rules import quality_of

    rng = random.Random(9)
    vocabulary = [a + b for a in ("th", "st", "re", "on", "qu") for b in ("e", "is", "at", "or", "ing")]
    # names keep texts apart: no 8 words recur
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice("abcdefgh") * (rng.random() < 0.6) for _ in range(k)).capitalize() + "."
    item = prose(30)
    texts = [prose(rng.randint(60, 120)) for _ in range(20)]
    texts += [texts[0], texts[1] + " Extra", texts[2] + "\n" + item, prose(50) + " " + texts[3][:200], "$$$ %%% " * 90, "too short"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"stage{k}")))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in s.collect()} for s in seen]
    assert ids[1] == {r.doc_id for r in quality_of(docs).filter("kept").collect()} and {24, 25}.isdisjoint(ids[1]) and len(ids[1]) == 24
    assert ids[2] == {i for i, _, _, kept in brute_near([(r.doc_id, r.text) for r in seen[1].collect()]) if kept} and 20 not in ids[2]
    rows = [(r.doc_id, r.text) for r in seen[2].collect()]
    want = {r[0]: r[4] for r in brute(rows, lambda t: [bytes([b]) for b in t.encode()], 50, b"".join)}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in seen[3].collect()} == want
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    clean = find_hits(seen[3], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).filter("NOT contaminated")
    assert ids[4] == {r.doc_id for r in clean.collect()} and 22 not in ids[4]
    assert ids[5] == ids[4] and corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[5])
