"""A training-data pipeline of five stages over the documents table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.llm.byte_bpe import read_ranks, token_digests
from panelfx.llm.jaccard_join import JaccardOptions, keep_one
from panelfx.llm.mixing import MixOptions, mix
from panelfx.llm.secrets import redact
from panelfx.llm.texts import unused
from panelfx.llm.toxicity import toxicity_scores
from panelfx.session import freeze, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# As op4_toxicity predicts.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learnt from the labels table, is below TOXIC_FROM."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = unused("toxicity", docs.columns)
    return toxicity_scores(docs, labels, name=name).where(F.col(name) < TOXIC_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree in four fifths."""
    return keep_one(docs, JaccardOptions(num=80, den=100, width=5))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark; n_chars follows."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mixture of the sources has them."""
    return mix(docs, MixOptions())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, and the digest of what they decode to."""
    return token_digests(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# The stages learn a classifier, Markov models and a transducer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written to the shared folder and read by the next."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
