"""A corpus pipeline over `documents`: rules, near-duplicates, repeated passages, benchmark leaks, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import bpe, decontaminate, near_dedup, quality_rules, suffix_dedup
from pactum.llm.common import remove, shared_folder, work_folder, written

#: Near-duplicates share this percent of their five-word shingles.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged row by row. A null or empty text has too few words to be kept."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id. Rows of a kept doc_id stay, all of them.

    Rows without a doc_id are documents of their own, after all others. Null and empty texts resemble nothing and stay.
    """
    return near_dedup.without_near_duplicates(docs.select(*COLUMNS), percent=NEAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has; characters cut in half at an edge go too.

    Rows of one doc_id, and rows without one, take nothing from each other. A null text becomes empty.
    """
    return suffix_dedup.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages, judged row by row; a null or empty text isn't."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and decoded text: one row for each row; a null text has no tokens."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeats),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: SQL can't express the sketches' exact counterpart on whole tables in reasonable time, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder, so that a lost executor costs one stage.

    A stage's intermediate tables go when it is done, and its rows when the next one's are written; the last stage's input stays
    for its result, which is computed when asked for.
    """
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with work_folder(spark):
            docs = written(stage(spark, docs, sf_dir), folder, f"stage{k}")
        if k:
            remove(spark, f"{folder}/stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
