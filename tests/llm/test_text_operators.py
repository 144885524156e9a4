"""Operators that work text by text: formatting, rules, tokens, decontamination, models. Brute force or the library itself decides."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactum.llm import bpe, chat_format, decontaminate, quality_model, quality_rules, token_count, toxicity
from pactum.llm.common import flat

tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, hits string, rank int"  # with names that operators use inside
TEXTS = ["", None, "one", "a b\tc\nd\n\nd\n  \nd", "word " * 3000, "Ünï cödé 漢字 🙂 x", "x" * 5000, "#$%&* <|endoftext|> a<|endoftext|>", "the cat sat on the mat " * 3, "\r\n \x0b\x0c"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "en", "h", 1) for i, t in enumerate([*TEXTS, TEXTS[4]])], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_text(docs, out, *columns):
    """Values next to the texts; ids are unique here."""
    got = {r.doc_id: tuple(r[c] for c in columns) for r in out.collect()}
    return [(r.text or "", got[r.doc_id]) for r in docs.collect()]


# --- chat -------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn int, role string, text string, blocks string"
TURNS = [
    (1, 1, "assistant", "second</s>", "x"),
    (1, 0, "user", "first <|end|>\n<|part|>", "x"),
    (1, 2, "assistant", None, "x"),
    (1, 3, "tool\nx", "back\\slash <\\| [INST] [/INST] <<SYS>><</SYS>> <s>", "x"),
    (2, None, None, "", "x"),
    (2, 0, "user", "same", "x"),
    (2, 0, "user", "same", "x"),
    (None, 0, "assistant", "no id", "x"),
]


def test_chat_round_trip(spark):
    out = chat_format.format_conversations(spark.createDataFrame(TURNS, CHAT))
    got = {r.conv_id: (r.formatted, r.read) for r in out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("read")).collect()}
    want = {
        1: [("user", ["first <|end|>\n<|part|>"]), ("assistant", ["second</s>", ""]), ("tool\nx", ["back\\slash <\\| [INST] [/INST] <<SYS>><</SYS>> <s>"])],
        2: [("", [""]), ("user", ["same", "same"])],
        None: [("assistant", ["no id"])],
    }
    assert {k: [(b.role, list(b.parts)) for b in read] for k, (_, read) in got.items()} == want
    assert got[1][0].count("<|end|>") == 3 and "</s>" not in got[1][0]
    assert chat_format.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_digests(spark, tmp_path):
    spark.createDataFrame([t[:4] for t in TURNS], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = chat_format.op1_chat_format(spark, str(tmp_path))
    got = {r.conv_id: r for r in df.collect()}
    said = chat_format.PROBE_TEXT
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(said) and got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].loss_sha256 == hashlib.sha256(b"second</s>").hexdigest()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- rules ------------------------------------------------------------------------------------------------------------


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_rules(docs, none):
    out = quality_rules.quality_of(docs)
    for text, got in by_text(docs, out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
        assert got == base_rules(text)
    assert quality_rules.quality_of(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()


def test_rules_on_random_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "\n", "é ", "|"], k=rng.randint(0, 90))) for _ in range(300)]
    fields = quality_rules.measure(*flat(pa.array(texts)))
    for i, t in enumerate(texts):
        assert tuple(int(x[i]) for x in fields[:5]) + (bool(fields[7][i]),) == base_rules(t)


def test_divergence():
    prose = "The quick brown fox is one of the animals that jump over a lazy dog, and it was seen in the wood by a man with a hat. "
    distinct = " ".join(prose.replace("fox", f"fox{chr(97 + i)}") for i in range(3))
    noisy = " ".join(f"{w}$$$%%" for w in re.findall(r"\w+", " ".join(f"w{i}{chr(97 + i % 26)}" for i in range(80))))
    short = "$$$ %%% ***"
    p = np.array([[1, 0], [0, 0], [1, 1]])
    assert np.allclose(quality_rules.distance(p, np.array([0.0, 1.0])), [1, 0, quality_rules.distance(np.array([[1, 1]]), np.array([0.0, 1.0]))[0]])
    char = quality_rules.measure(*flat(pa.array([distinct, noisy, short])))[5]
    assert char[0] < quality_rules.MAX_CHAR_DISTANCE < char[1]
    kept = quality_rules.measure(*flat(pa.array([distinct, noisy])))[8]
    assert not kept[1]


def test_texts_without_common_words(spark, tmp_path):
    rng = random.Random(5)
    made_up = lambda: "".join(rng.choices("bdfgklmnprstv", k=3)) + rng.choice("aeiou") + rng.choice(["", "r", "nt"])
    few = [made_up() for _ in range(30)]
    lacking = " ".join(" ".join(rng.choice(few) for _ in range(9)).capitalize() + "." for _ in range(12))
    foreign = [" ".join(" ".join(made_up() for _ in range(9)).capitalize() + "." for _ in range(n)) for n in (6, 12, 400)]
    prose = [" ".join(w or made_up() for w in rng.choices([*q, ""], [*q.values(), 1 - sum(q.values())], k=200)).capitalize() + "." for q in quality_rules.WORD_REFERENCE.values()]
    fields = quality_rules.measure(*flat(pa.array([lacking, *prose, *foreign])))
    assert fields[5][0] <= quality_rules.MAX_CHAR_DISTANCE and fields[6][0] < quality_rules.MAX_WORD_DISTANCE and not fields[7][0]
    assert fields[8].tolist() == [False, *[True] * 7]  # prose of a language without a reference stays, at any length
    docs = spark.createDataFrame(list(enumerate([lacking, *prose, *foreign])), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == list(range(1, 8))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.kept for r in quality_rules.op3_quality_rules(spark, str(tmp_path)).collect()} == {0: False} | dict.fromkeys(range(1, 8), True)


# --- tokens -----------------------------------------------------------------------------------------------------------


def hard_texts():
    rng = random.Random(2)
    chars = [chr(i) for i in range(0x250)] + list("漢字🙂 \n\t'")
    return [t or "" for t in TEXTS] + ["".join(rng.choices(chars + [" "] * 200, k=80)) for _ in range(300)] + ["   lead", "it's 'S 'll", "   x", "<|endoftext", "a\x1c\x85b"]


def test_bpe_is_the_librarys():
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    theirs = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.codec(path, tokenizers.PATTERN)
    for t in hard_texts():
        ids = ours.encode(t)
        assert list(ids) == theirs.encode_ordinary(t) and ours.decode(ids) == t.encode()


def test_bpe_documents(docs, none):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_documents(docs, path, tokenizers.PATTERN)
    for text, (ids, n, decoded) in by_text(docs, out, "ids", "n_tokens", "decoded"):
        assert bytes(decoded) == text.encode() and len(ids) == 4 * n
    assert bpe.encode_documents(none, path, tokenizers.PATTERN).count() == 0


def test_counts_are_the_librarys(docs, none):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    frequent = token_count.frequent_lengths(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    assert frequent[" word"] == 1 and all(frequent[w] == len(theirs.encode(w, add_special_tokens=False).ids) for w in frequent)
    ours = token_count.Counter(path, frequent)
    for t in hard_texts():
        assert ours.count(t) == len(theirs.encode(t, add_special_tokens=False).ids)
    for text, (size, n) in by_text(docs, token_count.count_tokens(docs, path), "n_bytes", "n_tokens"):
        assert (size, n) == (len(text.encode()), len(theirs.encode(text, add_special_tokens=False).ids))
    assert token_count.count_tokens(none, path).count() == 0


def test_long_texts_are_split_in_groups(monkeypatch):
    from tokenizers import Tokenizer

    text = " ".join(t for t in hard_texts())
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = list(bpe.codec(path, tokenizers.PATTERN).encode(text))
    monkeypatch.setattr(bpe, "LONG", 80)
    assert list(bpe.codec(path, tokenizers.PATTERN).encode(text)) == whole
    path = tokenizers.path("byte_bpe_50k.json")
    assert token_count.Counter(path, {}).count(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_small_caches_change_nothing(monkeypatch):
    path = tokenizers.path("byte_bpe_50k.json")
    want = [token_count.Counter(path, {}).count(t) for t in hard_texts()]
    monkeypatch.setattr(token_count, "CACHE", 3)
    small = token_count.Counter(path, {})
    assert [small.count(t) for t in hard_texts()] == want


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_hits(text, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, which = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    which.add(item)
    return len(w), len(hit), sorted(which), bool(hit) and 20 * len(hit) >= len(w)


def decontamination_case():
    rng = random.Random(3)
    vocabulary = ["a", "B", "c9", "é", "d"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([15, 14, 3, 20, 1, 0])] + [("", "b"), ("7", None)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", "! " + items[0][1].replace(" ", "  -\n")]) for _ in range(40)] + ["", None]
    return items, texts


@pytest.mark.parametrize("shard", [32 << 20, 40])
def test_decontamination(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    items, texts = decontamination_case()
    benchmark = spark.createDataFrame([(i or None, t) for i, t in items], "item_id string, text string")
    docs = spark.createDataFrame([(i, t, "x", "h", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in decontaminate.find_hits(docs, benchmark).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"]), got[i].contaminated) == brute_hits(t, items)
        for s in got[i].spans:
            assert not re.match(r"[\s!-]", t[s.start]) and not re.match(r"[\s!-]", t[s.end - 1])
    good = decontaminate.drop_contaminated(docs, benchmark)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i in got if not got[i].contaminated}
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.find_hits(docs, nothing).filter("n_hit > 0").count() == 0
    assert decontaminate.find_hits(docs.limit(0), benchmark).count() == 0


def test_decontamination_index_follows_the_text():
    """Nodes of the automaton and bytes of the windows stay below fixed multiples of the items' text."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60_000)]
    items = [(str(i), " ".join(rng.choices(words, k=rng.randint(5, 90))).encode()) for i in range(6_000)]
    size = sum(len(t) for _, t in items)
    s = decontaminate.Scanner(items)
    held = sum(x.nbytes for x in vars(s._windows).values() if isinstance(x, np.ndarray))
    assert s.nodes() < 0.4 * size and held < 6 * size
    long = next(t for _, t in items if len(t.split()) > 40)
    n, found = s.scan(b"x " * 50 + long + b" y" * 50)
    assert {w for a, b, _ in found for w in range(a, b)} == set(range(50, 50 + len(long.split()))) and n == 100 + len(long.split())


# --- models -----------------------------------------------------------------------------------------------------------


def test_gradient():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, quality_model.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    m = quality_model.Model(np.zeros(quality_model.FEATURES), np.ones(quality_model.FEATURES), {k: rng.normal(0, 0.5, s) for k, s in {"W": (quality_model.FEATURES, 16), "b": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "c": (16,), "d": ()}.items()})
    loss = lambda: -(y * np.log(m.forward(x, starts)["score"]) + (1 - y) * np.log(1 - m.forward(x, starts)["score"])).sum()
    f = m.forward(x, starts)
    for k, g in m.gradient(f, starts, f["score"] - y).items():
        at = tuple(0 for _ in g.shape)
        keep = m.weights[k].copy()
        m.weights[k] = keep.copy() if keep.shape else keep + 0.0
        step = np.zeros(g.shape)
        step[at] = 1e-5
        m.weights[k] = keep + step
        up = loss()
        m.weights[k] = keep - step
        down = loss()
        m.weights[k] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4, k


def labelled(spark, good, bad, n=160):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        rows.append((i, (bad if i % 4 == 0 else good)(rng)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(None, "text without id"), (n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (n, None)], "doc_id long, label int")


WORDS = ["the", "river", "stone", "house", "walks", "green", "and", "of", "window", "table"]
PROSE = lambda rng: " ".join(rng.choices(WORDS, k=rng.randint(80, 200)))


def accuracy(scores, n):
    return np.mean([(scores[i] >= 0.5) == (i % 4 == 0) for i in range(n) if i % 3 == 1])


def test_quality_held_out(spark):
    docs, labels = labelled(spark, PROSE, lambda rng: " ".join(w.upper() + "$$" for w in PROSE(rng).split()))
    out = quality_model.quality(docs, labels, lambda c: c % 3 != 1, label_col="label")
    scores = {r.doc_id: r.score for r in out.collect()}
    assert len(scores) == 163 and all(0 <= s <= 1 for s in scores.values()) and accuracy(scores, 160) > 0.95
    none = quality_model.quality(docs, labels.limit(0), lambda c: c % 3 != 1, label_col="label")
    assert {r.score for r in none.collect()} == {0.5}


def test_toxicity_held_out_and_disguised(spark):
    def bad(rng):
        w = PROSE(rng).split()
        w[rng.randrange(len(w))] = rng.choice(["nastyword", "nastywords", "vileterm"])
        return " ".join(w)

    docs, labels = labelled(spark, PROSE, bad, 400)
    hidden = [(1000, "the river n4styw0rd stone house"), (1001, "the river v i l e t e r m stone"), (1002, "the house vvviiileterm table"), (1003, "the r1ver 5tone h0use of gr33n"), (1004, "walks")]
    docs = docs.unionByName(spark.createDataFrame(hidden, "doc_id long, text string"))
    out = toxicity.toxicity(docs, labels, lambda c: c % 3 != 1, label_col="label")
    scores = {r.doc_id: r.score for r in out.collect()}
    assert len(scores) == 408 and accuracy(scores, 400) > 0.95
    assert min(scores[i] for i in (1000, 1001, 1002)) > 0.5 > max(scores[i] for i in (1003, 1004))
    assert toxicity.toxicity(docs, labels.limit(0), lambda c: c % 3 != 1, label_col="label").count() == 408
    assert toxicity.toxicity(docs.limit(0), labels, lambda c: c % 3 != 1, label_col="label").count() == 0


def char_model(words):
    text = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8).astype(np.int64)
    g = text[:-2] << 16 | text[1:-1] << 8 | text[2:]
    grams, n = np.unique(g[text[1:-1] != 32], return_counts=True)
    return toxicity.CharModel(grams, n.astype(float))


def words_read(text, model):
    found = toxicity.disguised(*flat(pa.array([text.lower()])))
    return {w for _, t in found for reading in toxicity.readings(t, model) for w in reading.split()}


def test_words_disguised_at_their_edges():
    model = char_model((WORDS + ["stupid", "idiot", "moron", "ass", "gas", "you", "are", "a"]) * 20)
    for hidden, word in [("$tupid", "stupid"), ("$tup1d", "stupid"), ("!diot", "idiot"), ("|diot", "idiot"), ("*diot", "idiot"), ("@ss", "ass"), ("a$$", "ass"), ("g@s", "gas"), ("m0ron", "moron")]:
        assert word in words_read(f"the river {hidden} stone", model), hidden
    for decorated in ("stup1d!", "(stup1d)", "*stup1d*", "$$stup1d!!", "|stup1d|"):
        assert "stupid" in words_read(f"the river {decorated} stone", model), decorated


def test_every_stand_in_is_read():
    """Each symbol and each look-alike at the first, a middle and the last place of a word, and characters that aren't seen."""
    letters = {v: f"{v}on{v}ur{v}" for v in set("".join(toxicity.IMITATES.values()) + "".join(toxicity.LOOKALIKES.values()))}
    for x, meant in (toxicity.IMITATES | toxicity.LOOKALIKES).items():
        for v in meant:
            word, model = letters[v], char_model((WORDS + [letters[v]]) * 20)
            for i in (0, 3, 6):
                hidden = word[:i] + x + word[i + 1 :]
                assert word in words_read(f"the river {hidden} stone", model), (hidden, word)
    model = char_model((WORDS + ["eoneure"]) * 20)
    for x in toxicity.UNSEEN:
        assert "eoneure" in words_read(f"the eon{x}eu{x}re stone", model)
    # words of one script aren't disguised
    assert not toxicity.disguised(*flat(pa.array(["слово и ещё слово", "ένα λόγος", "plain words"])))


def test_long_and_spaced_disguises():
    model = char_model((WORDS + ["stupid", "idiot", "you", "are", "a", "you", "are", "a"]) * 20)
    spaced = lambda text: " ".join(text.replace(" ", ""))
    for hidden, word in [
        ("stu" + "p" * 60 + "id", "stupid"),
        ("s" + "t" * 300 + "upid", "stupid"),
        ("you are a s t u p i d", "stupid"),
        ("y o u i d i o t", "idiot"),
        (spaced("the river and green stone house walks of the table ") + " " + spaced("you are a stupid"), "stupid"),
        ("x" + "-q7" * 60 + " 1d10t", "idiot"),
    ]:
        assert word in words_read(f"river {hidden} stone", model), hidden
    # runs of single characters end with their row
    assert {r for r, _ in toxicity.disguised(*flat(pa.array(["a b c", "d e f", "g h"])))} == {0, 1}
    # time grows with the length
    assert toxicity.readings("1d10t-" * 2000, model)


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(12)
    bad = ["stupid", "s t u p i d", "$tupid", "stuuuupid", "1d10t", "idiot", "i d i o t", "s.t.u.p.i.d", "a b c", "x"]
    texts = [" ".join(rng.choice(bad) if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["s", "s t u p", "i d", ""]
    model = char_model((WORDS + ["stupid", "idiot", "you", "are", "a"]) * 20)
    keys = np.unique(toxicity.features(*flat(pa.array(["stupid idiot"])))[0])
    weights = np.linspace(1, 2, len(keys))
    of = lambda some, cache: toxicity.scores(*flat(pa.array(some)), model, cache, keys, weights, -3.0).tolist()
    alone = [of([t], {})[0] for t in texts]
    assert of(texts, {}) == alone and len(set(alone)) > 4
    order = list(range(len(texts)))
    for _ in range(3):
        rng.shuffle(order)
        assert of([texts[i] for i in order], {}) == [alone[i] for i in order]


def every_reading(token, model):
    """Readings and their scores, by listing all paths through the lattice."""
    solid = [i for i, x in enumerate(token) if x.isalnum()] or [len(token)]
    found = {}

    def walk(i, text, score):
        if i == len(token):
            if text:
                end = 0.0 if text.endswith(" ") else model.log(*(" " + " " + text)[-2:].encode(), 32)
                found[text] = max(found.get(text, -1e9), score + end)
            return
        x, again = token[i], i > 0 and token[i - 1] == token[i]
        a, b = ("  " + text)[-2:].encode() if not text.endswith(" ") else (32, 32)
        stand_ins = toxicity.IMITATES.get(x, "")
        if x.isalpha():
            walk(i + 1, text + x, score + toxicity.SAME + model.log(a, b, ord(x)))
            if again:
                walk(i + 1, text, score + toxicity.REPEATED)
        for c in stand_ins:
            walk(i + 1, text + c, score + toxicity.IMITATED + model.log(a, b, ord(c)))
        if stand_ins and again:
            walk(i + 1, text, score + toxicity.REPEATED + toxicity.IMITATED)
        if not x.isalpha():
            inside = solid[0] <= i <= solid[-1]
            walk(i + 1, text, score + (toxicity.DROPPED if x in " .-_'" or not inside else 3 * toxicity.DROPPED))
        if x == " " and b != 32:
            walk(i + 1, text + " ", score + toxicity.DROPPED + model.log(a, b, 32))

    walk(0, "", 0.0)
    return found


def test_readings_are_the_likeliest():
    model = char_model((WORDS + ["stupid", "idiot", "you", "are", "a"]) * 3)
    for token in ("$tup1d", "1d10t", "a b c", "sss", "@$$", "y o u", "s-t-u", "r1v3r!", "5t0", "a*b", "!!x"):
        every = every_reading(token, model)
        best: dict[str, float] = {}
        for text, score in every.items():
            best[text.strip()] = max(best.get(text.strip(), -1e9), score)
        got = toxicity.readings(token, model)
        want = sorted((x for x in best if x), key=best.get, reverse=True)
        assert got[0] == want[0] and [best[x] for x in got[:2]] == pytest.approx([best[x] for x in want[:2]]), token


def test_emphasis_is_no_disguise():
    model = char_model((WORDS + ["stupid", "ass"]) * 20)
    assert words_read("STONE!! river*** table$$$ **house !!stone", model) == set()
    assert "stupid" in words_read("the stup1d!! stone", model) and "ass" in words_read("a$$ stone", model)
