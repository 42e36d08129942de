"""Whole builds: a corpus from exam files, a vocabulary from a book, an index after uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import textops as t
from ..operators import index as ix
from ..operators import vocab as vb
from ..sources import readers as rd
from ..sources import writers as wr


def corpus_sections(files: DataFrame) -> DataFrame:
    """year, kind, source, ord, key, label, label_en, sentences of what a build leaves of files(phase, path, page, text).

    Files are worked through in order, and a year that comes again replaces the earlier one: of every year the last file or block
    with a section counts.
    """
    single, bundles = files.where("phase < 2"), files.where("phase = 2")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    kinds = single.groupBy(F.col("path").alias("doc")).agg(F.min("phase").alias("phase"), t.exam_type_of_pages(pages).alias("kind"))
    own = rd.split_documents(single).join(kinds, "doc").withColumn("year", t.year_of_name(rd.name_of(F.col("doc")))).withColumn("block", F.lit(0).cast("long"))
    many = rd.split_bundles(bundles).withColumn("phase", F.lit(2))
    rows = own.unionByName(many.select(*own.columns)).withColumn("at", F.struct("phase", "doc", "block"))
    last = rows.groupBy("year").agg(F.max("at").alias("at"))
    return rows.join(last, ["year", "at"], "left_semi").withColumn("source", rd.name_of(F.col("doc"))).drop("doc", "at", "phase", "block")


def build_papers(spark: SparkSession, root: str, out: str, year_folder: str = "single") -> int:
    """Writes the processed corpus of a folder of exam files; returns the number of files written."""
    return wr.write_sections(corpus_sections(rd.corpus_walk(spark, root, year_folder)), out)


def build_vocabulary(pages: DataFrame, total: int, out: str) -> DataFrame:
    """Writes a book's entries by part and merged; returns the report of entries and lemmas by part. pages(doc, page, line_no, line)."""
    rows = vb.book(pages, total)
    wr.write_vocabulary(rows, vb.merge(rows), out)
    return vb.report(rows)


def after_uploads(papers: DataFrame, pages: DataFrame, **build) -> tuple[DataFrame, DataFrame]:
    """Papers with the uploads appended, and the index built anew over them."""
    start = papers.agg(F.coalesce(F.max("paper_idx") + 1, F.lit(0)).alias("n")).scalar()
    both = rd.append_uploads(papers, rd.uploaded(pages, start))
    return both, ix.build(both, **build)


def settings_view(settings: Settings, groups: DataFrame) -> DataFrame:
    """The settings with the groups there are and their sizes, one row."""
    sizes = groups.groupBy("grp").agg(F.count_distinct("lemma").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "n")))).alias("group_sizes"))
    return sizes.select(
        F.lit(settings.high_threshold).alias("high_threshold"),
        F.lit(settings.medium_threshold).alias("medium_threshold"),
        F.array(*map(F.lit, settings.exclude_levels)).cast("array<string>").alias("exclude_levels"),
        F.array(*map(F.lit, settings.exclude_groups)).cast("array<string>").alias("exclude_groups"),
        F.lit(settings.use_vocab_examples).alias("use_vocab_examples"),
        F.map_keys("group_sizes").alias("available_groups"),
        "group_sizes",
    )
