"""A corpus pipeline of five stages: language ID, exact dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage is written to the shared folder and read back; it works on all that the one before has kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import best_fit_packing, exact_dedup, lang_cnn, ngram_join, substring_dedup
from ledgerloom.llm.common import stash, table

#: A document whose language is unknown, or less likely than this, is rejected.
LEAST_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; a null or letterless text goes."""
    judged = lang_cnn.judge_beside(docs, lang_cnn.train(docs))
    return judged.where((F.col("judged.lang") != "und") & (F.col("judged.score") >= LEAST_SCORE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents stay. A text without repeats is not touched."""
    return substring_dedup.drop_repeats(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network decides the first stage, which SQL cannot express; tests compare run() with a brute-force version.
ORACLE_SQL = None
