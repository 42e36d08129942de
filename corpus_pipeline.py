"""The corpus pipeline: documents in, encoded training documents out, by five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import durable, table
from glossaria.llm.ngram_join import NgramJaccardJoin
from glossaria.llm.quality_classifier import CoTraining
from glossaria.llm.quality_rules import RiskControlledRules
from glossaria.llm.queries import PIECES
from glossaria.llm.sentencepiece_codec import SentencePieceCodec
from glossaria.llm.source_mix import FairMix


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return CoTraining().filter(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    return RiskControlledRules().filter(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return NgramJaccardJoin().one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of their sources, each as many times as the mix takes it."""
    return FairMix().apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    out = SentencePieceCodec(PIECES).encode(docs, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("ngram_join", dedup),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: A trained classifier takes part, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, f"stage-{name}")
    return docs
