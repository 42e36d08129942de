"""Search, order, paging, drill-down and export over an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import textops as t

LONGEST_SEARCH = 50


def search(index: DataFrame, text: str) -> DataFrame:
    """Rows whose lemma or a variant contains the text, lower-cased and taken literally; more than 50 characters are refused."""
    if len(text) > LONGEST_SEARCH:
        raise ValueError(f"a search holds at most {LONGEST_SEARCH} characters")
    needle = F.lit(text.lower())
    return index.where(F.contains("lemma", needle) | F.exists("variants", lambda v: F.contains(v, needle)))


def keys(sort: str, order: str) -> list[Column]:
    """Frequency ties keep first-seen order both ways; lemma order is inverted ("desc" is A to Z), as clients expect."""
    if sort == "frequency":
        return [F.desc("frequency") if order == "desc" else F.asc("frequency"), F.asc("first_seen")]
    return [F.asc("lemma") if order == "desc" else F.desc("lemma")]


def check_page(number: int, size: int) -> None:
    if number < 1 or not 10 <= size <= 500:
        raise ValueError("page starts at 1 and holds 10 to 500 rows")


def page(index: DataFrame, sort: str = "frequency", order: str = "desc", number: int = 1, size: int = 50) -> DataFrame:
    """A page in the order of keys(). stored.Ranked keeps an order for deep pages."""
    check_page(number, size)
    return index.orderBy(*keys(sort, order)).offset((number - 1) * size).limit(size)


def of_band(index: DataFrame, band: str, settings: Settings = Settings()) -> DataFrame:
    """Rows of a band, or of all; bands are worked out when the index is read."""
    if band not in ("high", "medium", "low", "all"):
        raise ValueError(f"no such band: {band}")
    rows = index.withColumn("band", t.band(F.col("frequency"), settings.high_threshold, settings.medium_threshold))
    return rows if band == "all" else rows.where(F.col("band") == band)


def words(
    index: DataFrame, band: str = "all", sort: str = "frequency", order: str = "desc", text: str = "", number: int = 1, size: int = 50,
    settings: Settings = Settings(),
) -> DataFrame:
    """A page of the list in one row: total (after band and search), page, page_size, the sizes of the bands of the whole index, words.

    Works for an empty index and for a page beyond the last: total and bands are there, words is empty.
    """
    hit = of_band(index, band, settings)
    hit = search(hit, text) if text else hit
    key = {"frequency": F.col("frequency"), "lemma": F.lit(0.0)}[sort]
    rows = page(hit, sort, order, number, size).withColumn("__key", key)
    rest = [c for c in index.columns if c not in ("lemma", "first_seen")]
    row = F.struct("__key", "lemma", *(["first_seen"] if "first_seen" in index.columns else []), *rest)
    # At most 500 rows: the page is put in order once more within its array.
    up = (sort == "frequency" and order == "asc") or (sort == "lemma" and order == "desc")
    first = "first_seen" if sort == "frequency" else "lemma"

    def after(x, y):
        tie = F.when(x[first] < y[first], -1).when(x[first] > y[first], 1).otherwise(0)
        if sort == "lemma":
            return tie if up else -tie
        return F.when(x["__key"] == y["__key"], tie).when((x["__key"] < y["__key"]) == F.lit(up), -1).otherwise(1)

    said = F.transform(F.array_sort(F.collect_list(row), after), lambda x: F.struct(x["lemma"].alias("lemma"), *[x[c].alias(c) for c in rest]))
    sizes = of_band(index, "all", settings).agg(*[F.count(F.when(F.col("band") == b, 1)).alias(b) for b in ("high", "medium", "low")])
    return rows.agg(said.alias("words")).select(
        hit.agg(F.count("*")).scalar().alias("total"),
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        *[sizes.select(b).scalar().alias(b) for b in ("high", "medium", "low")],
        "words",
    )


def shown(examples: DataFrame, part: int = 10) -> DataFrame:
    """What a list and a detail view show: ten sentences a part of speech, the word marked, and a short form of the sentence."""
    place = W.partitionBy("lemma", "pos").orderBy("paper_idx", "para_idx", "sent_idx", "text")
    rows = examples.withColumn("n", F.row_number().over(place)).where(F.col("n") <= part)
    return rows.select("lemma", "pos", "n", t.highlighted("text", "word").alias("marked"), t.truncated("text").alias("short"))


def listed(index: DataFrame) -> DataFrame:
    """lemma, its first four variants and four senses, and the colour class of its frequency, as a list shows them."""
    return index.select(
        "lemma",
        F.slice("variants", 1, 4).alias("variants"),
        F.slice("senses", 1, 4).alias("senses"),
        F.format_number("frequency", 3).alias("shown_frequency"),
        t.frequency_class(F.col("frequency")).alias("colour"),
    )


def pages(total: int, size: int) -> int:
    return -(-total // size)


def joined_senses(suffix: str) -> Column:
    """The first five senses as text: `pos. meaning (n` and the suffix, then `)`."""
    part = lambda s: F.concat(s["pos"], F.lit(". "), s["meaning"], F.lit(" ("), s["pos_count"].cast("string"), F.lit(suffix + ")"))
    return F.array_join(F.transform(F.slice("senses", 1, 5), part), "; ")


def with_senses(index: DataFrame, senses: DataFrame) -> DataFrame:
    per = senses.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "meaning", "pos_count"))).alias("senses"))
    return index.join(per, "lemma", "left").withColumn("senses", F.coalesce("senses", F.array().cast("array<struct<ord:int,pos:string,meaning:string,pos_count:bigint>>")))


def _export_order(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc("frequency"), F.asc("first_seen"))


def csv_export(index: DataFrame, band: str = "all", settings: Settings = Settings()) -> DataFrame:
    """单词, 变体, 词性 (always empty), 释义, 次数, 频率 of a band, most frequent first, ties as first seen."""
    return _export_order(of_band(index, band, settings)).select(
        F.col("lemma").alias("单词"),
        F.array_join("variants", ", ").alias("变体"),
        F.lit("").alias("词性"),
        joined_senses("次").alias("释义"),
        F.col("count_sum").alias("次数"),
        F.bround("frequency", 4).alias("频率"),
    )


def excel_export(index: DataFrame, examples: DataFrame, band: str = "all", settings: Settings = Settings()) -> DataFrame:
    """单词, 总次数, 频率, 释义（按词性）, 真题例句 in the order of csv_export: the first sentence of each of five parts of speech, cut to 80, all to 500."""
    label = F.coalesce("section_label", "section") if "section_label" in examples.columns else F.col("section")
    line = F.concat(F.lit("["), F.coalesce("year", F.lit("")), F.lit("·"), F.coalesce(label, F.lit("")), F.lit("] "), F.substring("text", 1, 80))
    first = F.min_by(line, F.struct("paper_idx", "para_idx", "sent_idx", "text"))
    per = examples.groupBy("lemma", "pos").agg(first.alias("line")).groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    told = F.substring(F.array_join(F.transform(F.slice("l", 1, 5), lambda x: x["line"]), "\n"), 1, 500)
    return _export_order(of_band(index, band, settings).join(per, "lemma", "left")).select(
        F.col("lemma").alias("单词"),
        F.col("count_sum").alias("总次数"),
        F.bround("frequency", 4).alias("频率"),
        joined_senses("").alias("释义（按词性）"),
        F.coalesce(told, F.lit("")).alias("真题例句"),
    )
