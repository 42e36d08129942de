"""Sentence ends learned from the corpus itself: abbreviations are found by a log-likelihood ratio, without a list.

A word type that nearly always stands before a full stop is an abbreviation, after Kiss and Strunk (Unsupervised Multilingual Sentence
Boundary Detection, 2006): the likelihood ratio of "followed by a full stop as any word is" against "nearly always", weighed by the
type's length, its inner full stops, and its occurrences without one. Counts are one aggregation over distinct tokens of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

# Fixed values of the published method: the likelihood of a full stop after an abbreviation, and the score from which a type is one.
NEARLY = 0.99
LEAST = 0.3
_MARK = "\ue000"  # of the private use area


def _bare(token: Column) -> Column:
    """A token in lower case, without what is no letter or digit at its ends; a final full stop is told apart by the caller."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def counts(papers: DataFrame, clean: bool = True) -> DataFrame:
    """word, with_stop, without: how often a type of at least one letter, and no digit, stands before a full stop, and how often not."""
    each = tk.lines(papers, clean).select(F.explode(F.split("line", r"\s+")).alias("token"))
    each = each.groupBy("token").agg(F.count("*").alias("n")).select(_bare(F.col("token")).alias("word"), F.col("token").endswith(".").alias("stop"), "n")
    each = each.where(F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\p{N}"))
    return each.groupBy("word").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("with_stop"), F.sum(F.when(F.col("stop"), 0).otherwise(F.col("n"))).alias("without"))


def scores(counted: DataFrame) -> DataFrame:
    """word, with_stop, without, score of the types that stand before a full stop at all."""
    total = counted.agg((F.sum("with_stop") / F.sum(F.col("with_stop") + F.col("without"))).alias("p")).scalar()
    a, b = F.col("with_stop"), F.col("without")
    # log(0) is never asked for: p is above 0 where a type has a full stop, and 1 - p is weighed by b, which is 0 where p is 1.
    rest = F.when(b > 0, b * (F.log(F.lit(1 - NEARLY)) - F.log(1 - F.col("p")))).otherwise(0.0)
    ratio = 2 * (a * (F.log(F.lit(NEARLY)) - F.log("p")) + rest)
    long_ = F.length(F.regexp_replace("word", r"[.]", ""))
    inner = F.length("word") - long_ + 1
    score = F.col("ratio") * F.exp(-long_) * inner * F.pow(long_.cast("double"), -b)
    return counted.where("with_stop > 0").withColumn("p", total).withColumn("ratio", ratio).withColumn("score", score).select("word", "with_stop", "without", "score")


def abbreviations(scored: DataFrame, least: float = LEAST, most: int = 4096) -> DataFrame:
    """word of the types whose score is `least` or more; the model holds the `most` best ones."""
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most).select("word")


#: The column that holds the learned abbreviations where lines are split.
KNOWN = "known"


def split(line: Column) -> Column:
    """A splitter of lines beside a column KNOWN: as tokens.plain, but a full stop ends nothing within a token, after an initial, or after an
    abbreviation, unless the line ends there."""
    parts = F.split(line, " ")

    def mark(token: Column, i: Column) -> Column:
        """Full stops that end nothing are put out of sight."""
        inner = lambda x: F.regexp_replace(x, r"\.([\p{L}\p{N}])", _MARK + "$1")
        known = F.array_contains(KNOWN, _bare(token)) | token.rlike(r"^[^\p{L}\p{N}]*\p{Lu}\.$")
        quiet = (i < F.size(parts) - 1) & token.endswith(".") & ~token.endswith("..") & known
        return F.when(~F.contains(token, F.lit(".")), token).when(quiet, inner(F.regexp_replace(token, r"\.$", _MARK))).otherwise(inner(token))

    whole = F.array_join(F.transform(parts, mark), " ")
    return F.transform(tk.plain(whole), lambda s: F.replace(s, F.lit(_MARK), F.lit(".")))


def known(papers: DataFrame, clean: bool = True, least: float = LEAST) -> Column:
    """The papers' abbreviations as one value of the plan: no text moves, and nothing runs before the query does."""
    found = abbreviations(scores(counts(papers, clean)), least).agg(F.collect_list("word").alias("w")).scalar()
    return F.coalesce(found, F.array().cast("array<string>"))


def sentences(papers: DataFrame, clean: bool = True) -> DataFrame:
    """tokens.sentences() with ends learned from the papers. The same goes into examples.told(papers, split=split, known=known(papers))."""
    return tk.sentences(papers, clean, split, known(papers, clean))
