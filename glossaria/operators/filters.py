"""Word lists, vocabulary groups and their set operations; all of them semi and anti joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("primary", "zhongkao", "gaokao", "cet4")


def level_words(lists: DataFrame, levels) -> DataFrame:
    """level, word: words of the requested levels. gaokao and cet4 leave out the words of every lower level.

    lists(level, word). A word's lowest level is one aggregation, so no set is compared with another.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(LEVELS) for x in (n, i)]), F.col("level"))
    ranked = lists.where(F.col("level").isin(*LEVELS, "custom")).select("word", "level", rank.alias("rank")).distinct()
    low = ranked.where("rank is not null").groupBy("word").agg(F.min("rank").alias("lowest"))
    own = ranked.join(low, "word", "left")
    raw = F.col("level").isin("primary", "zhongkao", "custom")
    return own.where(F.col("level").isin(*levels) & (raw | (F.col("rank") == F.col("lowest")))).select("level", "word") if levels else own.select("level", "word").limit(0)


def without_words(index: DataFrame, words: DataFrame) -> DataFrame:
    """Index rows whose lemma is not a word of the list; denominators are not touched."""
    return index.join(words.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_anti")


def without_groups(index: DataFrame, groups: DataFrame, names) -> DataFrame:
    return index.join(groups.where(F.col("grp").isin(*names)).select("lemma").distinct(), "lemma", "left_anti")


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.count_distinct("lemma").alias("n"))


def delete_year(papers: DataFrame, year: str) -> DataFrame:
    """Papers of other years; those without a year stay."""
    return papers.where(~F.col("year").eqNullSafe(year))
