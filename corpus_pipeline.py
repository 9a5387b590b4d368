"""From raw documents to tokens: good texts, one of each group of near copies, no benchmark passages, no secrets.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor has kept. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import bpe, decontaminate, secrets, simhash, weak_labels
from snapfold.llm.queries import BPE_FILE, digest_tokens
from snapfold.llm.rows import table, written


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps. Null and wordless texts go."""
    return weak_labels.good_rows(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near copies."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked in the text; ``n_chars`` follows where there is such a column."""
    hidden = secrets.masked(docs)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the decoded text, and the ids."""
    coded = bpe.encoded(docs.select("doc_id", "text"), BPE_FILE)
    return digest_tokens(coded, "ids")


STAGES = [
    ("quality classifier", good_texts),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the models of secrets and the components cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
