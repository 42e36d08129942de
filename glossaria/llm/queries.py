"""The registered queries of this package and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Default place of the public model file; a parameter of the query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import RiskControlledRules

    return RiskControlledRules().judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import CoTraining

    return CoTraining().score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over what the labels hold: `unfit` (quality 0), then `toxic`. Finer categories of annotators are further links (ToxicityChain's `chain`)."""
    from .toxicity import ToxicityChain

    return ToxicityChain().predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import LanguageId

    return LanguageId().predict(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import CosineGroups

    return CosineGroups().groups(table(spark, sf_dir, "embeddings"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import FairMix

    return FairMix().plan(table(spark, sf_dir, "documents")).drop("copies")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import MainText

    return MainText().extract(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import NgramJaccardJoin

    return NgramJaccardJoin().groups(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import ChatFormat

    return ChatFormat().format(table(spark, sf_dir, "conversations"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECES) -> DataFrame:
    """Ids of every document, their number, and the text's length after decoding them again."""
    from .sentencepiece_codec import SentencePieceCodec

    back = SentencePieceCodec(model_file).round_trip(table(spark, sf_dir, "documents"))
    return back.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), F.length("text").alias("decoded_chars"), F.xxhash64("text").alias("decoded_hash"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text as written for training, and of the text rebuilt from it."""
    from .fill_in_middle import FillInMiddle, restored

    rows = FillInMiddle().transform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import PrefixTrie

    return PrefixTrie().nodes(table(spark, sf_dir, "conversations"))


def op13_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page, which are written, read back and deleted."""
    from .zip_warc import ZipWarc, discard

    warc = ZipWarc()
    manifest = warc.write(table(spark, sf_dir, "pages"))
    out = warc.resolved(manifest).drop("url")
    discard(spark, manifest)
    return out


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_source_mix": op6_source_mix,
        "op7_html_extract": op7_html_extract,
        "op8_ngram_join": op8_ngram_join,
        "op9_chat_format": op9_chat_format,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_zip_warc": op13_zip_warc,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op5_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op8_ngram_join": oracles.NGRAM_JOIN,
        "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
        "op12_prefix_trie": oracles.PREFIX_TRIE,
        "op13_zip_warc": oracles.ZIP_WARC,
    }
