"""A corpus pipeline of four stages, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and is the next
stage's `docs`. All but the last return the columns of documents. Null texts, empty tables, repeated rows and ties are
treated as the operators' modules say; SQL cannot express the language filters, the mix's permutations or BPE, so the
stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenekiln.llm.bpe import BpeOperator
from scenekiln.llm.langid import held_out, identify, learn
from scenekiln.llm.minhash import NearDuplicates
from scenekiln.llm.mixing import Mix
from scenekiln.session import materialize, table

#: A document is rejected if less than this share of its n-grams belongs to any learned language, beyond doubt: if even the
#: upper bound of the share at so many standard errors, as its n-grams tell it, is less. One rule for texts of any length.
LEAST_KNOWN, ERRORS = 0.2, 3.0


def _upper(share: Column, n: Column) -> Column:
    """Wilson's upper bound of a share seen in n cases."""
    z2 = ERRORS * ERRORS
    return (share + z2 / (2 * n) + ERRORS * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; a missing label is filled in. Text without letters or a known n-gram goes,
    and text with too few of them, as LEAST_KNOWN says."""
    judged = identify(docs, learn(docs.select("doc_id", "text", "lang"), ~held_out()), pred_col="__lang", score_col="__score", grams_col="__n")
    score, n = F.col("__score"), F.col("__n").cast("double")
    known = judged.filter((F.col("__lang") != "und") & (score > 0) & (_upper(score, n) >= LEAST_KNOWN))
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: the one of smallest id."""
    return NearDuplicates(docs, k=5, percent=80).kept(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; a document's second helping is a row of its own."""
    return Mix(docs).documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back."""
    op = BpeOperator(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = op.encode(docs.select("doc_id", "lang", "source", "text"), "text", "token_ids", "intact")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "intact")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL cannot express a stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
