"""A corpus pipeline of five stages, each from one operator of ``sextant.llm``.

Every stage takes ``docs`` with ``doc_id, text, source`` and any other columns,
whatever their names, works on all rows it is given, and returns the same
columns (the last one: ids in place of the text). Null texts count as empty,
texts of any length are read whole, repeated rows are rows of their own unless
a stage says otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from sextant.llm.common import shared_root, temporary, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the labels of ``sf_dir`` teach the weights.

    Null and empty texts get the score of no match and stay; repeated rows
    stay or go together. Without usable labels the built-in words decide.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = unused("toxicity", docs.columns)
    return toxicity.score(docs, model, scored).where(F.col(scored) < 0.5).drop(scored)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest id.

    Null and empty texts are equal. Rows that repeat both id and text tie: they
    stay or go together. Of copies with and without id those with one stay.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 or more, directly or through
    others, that with the smallest id.

    Texts without words link with nothing and stay; texts of fewer words than
    five link with equal ones. Rows that repeat both id and text stay or go together.
    """
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix to target weights takes it, whole or in part.

    Texts without words are taken as often as their source is taken whole.
    Repeated rows are taken each by itself; null is a source of its own.
    """
    return mixing.repeat_mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids ``ids`` of each text, and their number ``n_tokens``, in place of the text.

    Null and empty texts have no ids. Columns called ``ids`` or ``n_tokens`` are replaced.
    """
    return bpe.encode(docs, bpe.tokenizer_path()).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Learned scores and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and
    what a stage has staged for it is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
