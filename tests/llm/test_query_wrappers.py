"""The registered queries themselves, on small tables: columns, digests and flags that they derive from their operators."""

import hashlib
import struct
import zlib

import pytest

from pactum.llm.queries import ORACLE_SQL, QUERIES

sha = lambda x: hashlib.sha256(x).hexdigest()
SHARED = " ".join(f"shared{i}" for i in range(30))
ROWS = [
    (0, f"The river of stone and the house. {SHARED}"),
    (1, f"{SHARED} a stupid end, write to me@mail.example.com"),
    (2, f"{SHARED} a stupid end, write to me@mail.example.com"),
    (3, None),
    (4, ""),
    (5, "word " * 1500),
    (6, " ".join(f"w{i}" for i in range(25))),
    (7, "<|endoftext|> Ünï 漢字"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", " ".join(f"w{i}" for i in range(5, 20))), ("b2", "nothing of it")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), int(i in (1, 2))) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_decontaminate(spark, folder):
    rows = run(spark, folder, "op2_decontaminate")
    assert (rows[6].n_words, rows[6].n_hit, rows[6].n_items, rows[6].items_sha256, rows[6].contaminated) == (25, 15, 1, sha(b"b1"), True)
    assert (rows[0].n_hit, rows[0].items_sha256, rows[0].contaminated) == (0, sha(b""), False) and (rows[3].n_words, rows[3].contaminated) == (0, False)


def test_rules(spark, folder):
    rows = run(spark, folder, "op3_quality_rules")
    assert rows[5].n_repeat_words == 1500 and rows[5].base_failed and not rows[5].kept and rows[0].kept and rows[3].base_failed


def test_passages(spark, folder):
    rows = run(spark, folder, "op4_suffix_dedup")
    text = dict(ROWS)
    kept = text[1].encode()[len(SHARED) :]
    assert (rows[1].n_removed, rows[1].n_spans, rows[1].kept_sha256) == (len(SHARED), 1, sha(kept)) or rows[1].n_removed == len(SHARED) + 1  # the blank before
    assert (rows[2].n_removed, rows[2].kept_sha256) == (len(text[2]), sha(b"")) and (rows[3].n_bytes, rows[3].kept_sha256) == (0, sha(b""))
    rows = run(spark, folder, "op6_substring_dedup")
    assert (rows[1].n_words, rows[1].n_removed, rows[1].kept_sha256) == (36, 30, sha(b" ".join(text[1].encode().split()[30:])))
    assert (rows[2].n_removed, rows[2].kept_sha256) == (36, sha(b"")) and rows[0].n_removed == 0


def test_near(spark, folder):
    rows = run(spark, folder, "op8_near_dedup")
    assert (rows[1].component_id, rows[1].kept, rows[2].component_id, rows[2].kept) == (1, True, 1, False)
    assert (rows[3].n_shingles, rows[3].kept, rows[5].n_shingles) == (0, True, 1)


@pytest.mark.parametrize("name, parts, rest", [("op7_quality_model", 4, 2), ("op9_toxicity", 3, 1)])
def test_models(spark, folder, name, parts, rest):
    rows = run(spark, folder, name)
    assert len(rows) == 8
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_tokens(spark, folder):
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken
    import tokenizers as hf
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("x", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = run(spark, folder, "op5_bpe")
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode()))
    lib = hf.Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, folder, "op10_token_count")
    for i, t in ROWS:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert rows[5].over_limit


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
