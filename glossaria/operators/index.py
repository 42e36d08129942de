"""The frequency index: how many (year, section) units hold a lemma, by part of speech, with variants.

Units are bitmaps (see units): every function takes rows of tokens.cells(), or plain token rows, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import textops as t
from . import filters, senses
from . import tokens as tk
from . import units as un

# Parts of speech that a token can have, in code-point order.
POS = ("adj", "adv", "aux", "conj", "det", "int", "n", "num", "other", "prep", "pron", "v")


units = un.units


def total_units(papers: DataFrame) -> DataFrame:
    """One row: units of the active papers, also of those without a token."""
    return units(papers).agg(F.count("*").alias("total_units"))


def occurrences(tokens: DataFrame) -> DataFrame:
    """Distinct (lemma, pos, year, section) of token rows: repeated uploads of a unit count once."""
    return tokens.select("lemma", "pos", "year", "section").distinct()


def _units_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, units: how many units hold a key."""
    if "bits" in rows.columns:
        return un.size(rows, *keys)
    return rows.select(*keys, "year", "section").distinct().groupBy(*keys).agg(F.count("*").alias("units"))


def _share(papers: DataFrame):
    """Units over all units; the total is a scalar subquery, so nothing runs before the query does."""
    total = total_units(papers).scalar()
    return F.when(total > 0, F.col("units") / total).otherwise(F.lit(0.0))


def frequency(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """lemma, units, frequency."""
    return _units_of(rows, "lemma").withColumn("frequency", _share(papers))


def pos_counts(rows: DataFrame) -> DataFrame:
    return _units_of(rows, "lemma", "pos").withColumnRenamed("units", "pos_count")


def count_sums(rows: DataFrame) -> DataFrame:
    """Sum of pos counts: a unit with a lemma in two parts of speech counts twice, as exports show it."""
    return pos_counts(rows).groupBy("lemma").agg(F.sum("pos_count").alias("count_sum"))


def variants(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lemma").agg(F.array_sort(F.collect_set(F.lower("word"))).alias("variants"))


def first_seen(rows: DataFrame) -> DataFrame:
    place = F.col("place") if "place" in rows.columns else tk.place()
    return rows.groupBy("lemma").agg(F.min(place).alias("place")).select("lemma", tk.unplaced("place").alias("first_seen"))


def assembled(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """One row a lemma: variants, pos_counts (map), units, frequency, count_sum, first_seen.

    One aggregation by (lemma, 64 units) and one by lemma give all of them; the longs of a unit set are never gathered in a row.
    Rows without places have no first_seen.
    """
    rows = rows if "bits" in rows.columns else tk.as_bits(rows, papers)
    rows = rows if "place" in rows.columns else rows.withColumn("place", F.lit(None).cast("decimal(38,0)"))
    told = [F.bit_or(F.when(F.col("pos") == p, F.col("bits"))).alias("of_" + p) for p in POS]
    part = rows.groupBy("lemma", "w").agg(
        *told, F.bit_or("bits").alias("bits"), F.array_sort(F.collect_set("word")).alias("words"), F.min("place").alias("place")
    )
    many = lambda p: F.coalesce(F.sum(F.bit_count("of_" + p)), F.lit(0)).cast("long")
    out = part.groupBy("lemma").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("variants"),
        F.array(*[F.struct(F.lit(p).alias("pos"), many(p).alias("n")) for p in POS]).alias("__n"),
        F.sum(F.bit_count("bits")).cast("long").alias("units"),
        F.min("place").alias("place"),
    )
    out = out.withColumn("first_seen", tk.unplaced("place")).withColumn("__n", F.filter("__n", lambda x: x["n"] > 0))
    out = out.withColumn("pos_counts", F.map_from_entries("__n")).withColumn("count_sum", F.aggregate("__n", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    return out.select("lemma", "variants", "pos_counts", "units", "count_sum", "first_seen").withColumn("frequency", _share(papers))


def without_units(bits: DataFrame, papers: DataFrame, kept: DataFrame) -> DataFrame:
    """lemma, units, frequency over the units of `kept` alone, from the word_bits() of all papers: an AND with a mask, no text is read again.

    Lemmas are those of the words that are left. The first places of words aren't told by a mask.
    """
    left = un.masked(bits, un.mask(un.numbered(papers), kept))
    return frequency(tk.with_lemmas(left), kept)


def build(papers: DataFrame, book: DataFrame | None = None, lists: DataFrame | None = None, groups: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """The index of the enabled papers, one assembled row a lemma with its senses, without the words that the settings exclude.

    book(lemma, pos, meaning, ord), lists(level, word), groups(grp, lemma). Denominators are those of all enabled papers; exclusions
    are anti joins on the lemma and never change them.
    """
    papers = tk.active(papers) if "enabled" in papers.columns else papers
    rows = excluded(tk.cells(papers, settings.stop_words), lists, groups, settings)
    rows = assembled(rows, papers)
    return senses.attached(rows, book) if book is not None else rows


def excluded(index: DataFrame, lists: DataFrame | None, groups: DataFrame | None, settings: Settings) -> DataFrame:
    """Index or token rows without lemmas of the excluded groups, then of the excluded levels."""
    if groups is not None and settings.exclude_groups:
        index = filters.without_groups(index, groups, settings.exclude_groups)
    if lists is not None and settings.exclude_levels:
        index = filters.without_words(index, filters.level_words(lists, settings.exclude_levels))
    return index


def bands(index: DataFrame, high: float = 0.5, medium: float = 0.2) -> DataFrame:
    return index.withColumn("band", t.band(F.col("frequency"), high, medium))


def band_counts(index: DataFrame, high: float = 0.5, medium: float = 0.2) -> DataFrame:
    """band, n; a band without a lemma has 0."""
    sums = [F.sum(F.when(F.col("band") == b, 1).otherwise(0)).alias(b) for b in ("high", "medium", "low")]
    one = bands(index, high, medium).agg(*sums)
    row = F.array(*[F.struct(F.lit(b).alias("band"), F.coalesce(F.col(b), F.lit(0)).cast("long").alias("n")) for b in ("high", "medium", "low")])
    return one.select(F.explode(row).alias("r")).select("r.*")


def paper_sections(papers: DataFrame) -> DataFrame:
    """year, paper_idx, section, section_label, sentence_count, enabled of every paper, in the order of years (null first), then of papers."""
    said = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) if "text" in papers.columns else F.size("sentences")
    cols = papers.columns
    label = F.col("section_label") if "section_label" in cols else F.lit(None).cast("string")
    enabled = F.coalesce("enabled", F.lit(True)) if "enabled" in cols else F.lit(True)
    count = F.greatest(F.coalesce(said, F.lit(0)), F.lit(0)).alias("sentence_count")
    return papers.select("year", "paper_idx", "section", label.alias("section_label"), count, enabled.alias("enabled")).orderBy("year", "paper_idx")


def papers_by_year(papers: DataFrame) -> DataFrame:
    """year, kind, section_count, sentence_count in the order of years. Their sections are rows of paper_sections(), not a list: a year may hold any number."""
    per = paper_sections(papers).groupBy("year").agg(F.count("*").alias("section_count"), F.sum("sentence_count").cast("long").alias("sentence_count"))
    return per.select("year", F.lit("英语一").alias("kind"), "section_count", "sentence_count").orderBy("year")
