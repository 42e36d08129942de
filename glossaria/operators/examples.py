"""Example sentences of lemmas.

A token matches a sentence of its paper if it is one of the sentence's word runs. That makes the
match an equi-join on (paper, word) instead of a pattern test of every token against every sentence.

Choices are made on postings (word and place, no text); texts are fetched for the chosen places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import textops as t
from . import tokens as tk


def examples(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """lemma, pos, text, word, year, section and ordinals: of equal texts under a lemma and part of speech the first counts."""
    words = tokens.groupBy("paper_idx", F.lower("word").alias("word"), "lemma", "pos").agg(F.min(F.struct("line_no", "tok_idx")).alias("tok"))
    told = sentences.select(
        "paper_idx", "year", "section", F.col("line_no").alias("para_idx"), "sent_idx", "text", F.explode(F.array_distinct(t.runs(F.lower("text")))).alias("word")
    )
    place = F.struct("paper_idx", "para_idx", "sent_idx", "tok.line_no", "tok.tok_idx")
    keep = F.min_by(F.struct("word", "year", "section", "paper_idx", "para_idx", "sent_idx"), place).alias("first")
    return words.join(told, ["paper_idx", "word"]).groupBy("lemma", "pos", "text").agg(keep).select("lemma", "pos", "text", "first.*")


def told(papers: DataFrame, min_ratio: float = 0.3, clean: bool = True, split=tk.plain, known=None, rows: DataFrame | None = None) -> DataFrame:
    """paper_idx, year, section, para_idx, token (whether the line has enough English), sent_idx, text of every sentence.

    Lines are dealt out once, by paper: postings are made where they arrive, and what a paper holds is asked there. rows: the papers' dealt(),
    where other parts of a plan use it too.
    """
    rows = tk.dealt(papers, min_ratio, clean, known) if rows is None else rows
    rows = rows.select("paper_idx", "year", "section", F.col("line_no").alias("para_idx"), "token", F.posexplode(split(F.col("line"))).alias("sent_idx", "text"))
    return rows.withColumn("text", F.trim("text")).where("text <> ''")


def _named_texts(rows: DataFrame) -> DataFrame:
    """t1, t2: two 64-bit hashes that stand for a text until the places are chosen."""
    return rows.withColumns({"t1": F.xxhash64(F.lit(1), "text"), "t2": F.xxhash64(F.lit(2), "text")})


def _odd(text: str):
    # Two capital letters have small forms that are, or hold, plain letters: what stands in such a text is judged by the words as written.
    return F.col(text).rlike("[\u0130\u212a]")


def _each_word(rows: DataFrame, stop) -> DataFrame:
    """A row for every word of a sentence that can be a token: k, low in place of the text, unless it is kept as `said`."""
    rows = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(F.array_distinct(t.runs(F.lower("text")))).alias("k", "low"))
    return rows.where(t.is_token(F.col("low"))).where(f"NOT {t.within('low', stop)}")


def _counting(rows: DataFrame, stop, names: DataFrame | None = None) -> DataFrame:
    """_each_word() of the words that count, with tok: the first place in the paper where the word is a token."""
    as_written = F.transform(F.filter(t.runs("text"), t.is_token), F.lower)
    rows = _each_word(rows.withColumn("odd", F.when(_odd("text"), as_written)), stop)
    rows = rows if names is None else rows.join(F.broadcast(names), "low")
    is_one = F.col("token") & F.coalesce(F.array_contains("odd", F.col("low")), F.lit(True))
    at = F.struct("para_idx", "sent_idx", "k")
    tok = F.min(F.when(is_one, at)).over(W.partitionBy("paper_idx", "year", "section", "low"))
    return rows.withColumn("tok", tok).where("tok is not null")


def postings(sentences: DataFrame, stop_words=None) -> DataFrame:
    """low, paper_idx, year, section, para_idx, sent_idx, t1, t2, n_chars, tok: a row for every word of a sentence of told(), without its text.

    A word of a line with enough English is a token where it stands; one of any other line counts if the paper has it as a token elsewhere.
    tok is the first place in the paper where it is one.
    """
    stop = list(tk.STOP_WORDS if stop_words is None else stop_words)
    rows = _counting(_named_texts(sentences).withColumn("n_chars", F.length("text")), stop)
    return rows.select("low", "paper_idx", "year", "section", "para_idx", "sent_idx", "t1", "t2", "n_chars", "tok")


def of_lemma(sentences: DataFrame, words: DataFrame, lemma: str, pos: str, stop_words=None) -> DataFrame:
    """examples() of one lemma and part of speech. words(low): those of all papers, which decide its forms.

    A lemma has a few forms, at most one for each rule and irregular form: they are sent to the sentences, and nothing else is moved.
    """
    stop = list(tk.STOP_WORDS if stop_words is None else stop_words)
    names = tk.named(words, stop).where((F.col("lemma") == lemma) & (F.col("pos") == pos))
    rows = _counting(sentences.withColumn("said", F.col("text")), stop, names)
    # A paper without a number is left out late: as a condition on the lines this would part their shuffle from that of others.
    first = F.min(F.when(F.col("paper_idx").isNotNull(), F.struct(*_PLACE, "tok", F.col("low").alias("word"), "year", "section"))).alias("first")
    rows = rows.groupBy("lemma", "pos", F.col("said").alias("text")).agg(first).where("first is not null")
    return rows.select("lemma", "pos", "text", *[f"first.{c}" for c in ("word", "year", "section", *_PLACE)])


def first_of(sentences: DataFrame, words: DataFrame, shortest: bool = False, stop_words=None) -> DataFrame:
    """lemma, pos, text, year, section and ordinals: of every lemma and part of speech the first example, or the first of the shortest.

    words(low): those of all papers. The first is found word by word where the sentences are, so what is moved is a row for a task's word, not
    for its places. Equal texts need not be told apart for one example. Only papers with a line that has not enough English ask what they hold.
    """
    stop = list(tk.STOP_WORDS if stop_words is None else stop_words)
    rows = _named_texts(sentences).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("mixed", F.max(~F.col("token") | _odd("text")).over(W.partitionBy("paper_idx", "year", "section")))
    rank = [*["n_chars"] * shortest, *_PLACE, "t1", "t2"]
    cols = ["low", "n_chars", *_PLACE, "t1", "t2"]
    rows = _each_word(rows.where("NOT mixed"), stop).select(*cols).unionByName(_counting(rows.where("mixed"), stop).select(*cols))
    # A paper without a number is left out late: as a condition on the lines this would part their shuffle from that of others.
    rows = rows.groupBy("low").agg(F.min(F.when(F.col("paper_idx").isNotNull(), F.struct(*rank))).alias("first")).where("first is not null")
    rows = rows.join(tk.named(words, stop), "low").groupBy("lemma", "pos").agg(F.min("first").alias("first"))
    chosen = rows.select("lemma", "pos", *[f"first.{c}" for c in (*_PLACE, "t1", "t2")]).withColumn("n_chars", F.lit(None))
    return with_texts(chosen, sentences, ["year", "section"]).select("lemma", "pos", "text", "year", "section", *_PLACE)


def places(sentences: DataFrame, stop_words=None) -> DataFrame:
    """lemma, pos, t1, t2, n_chars, word, year, section and ordinals: where the examples stand. Of equal texts under a lemma and part of speech the first counts."""
    stop = list(tk.STOP_WORDS if stop_words is None else stop_words)
    rows = postings(sentences, stop)
    rows = rows.join(tk.named(rows, stop), "low")
    # Nothing stands in a paper without a number: it must not be the first of equal texts.
    first = F.min(F.when(F.col("paper_idx").isNotNull(), F.struct("paper_idx", "para_idx", "sent_idx", "tok", F.col("low").alias("word"), "year", "section", "n_chars"))).alias("first")
    rows = rows.groupBy("lemma", "pos", "t1", "t2").agg(first).where("first is not null")
    return rows.select("lemma", "pos", "t1", "t2", *[f"first.{c}" for c in ("n_chars", "word", "year", "section", "paper_idx", "para_idx", "sent_idx")])


_PLACE = ["paper_idx", "para_idx", "sent_idx"]


def with_texts(chosen: DataFrame, sentences: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Places with their texts, fetched from told() by place, and `more` of its columns. Rows of sentences that come twice count once."""
    one = _named_texts(sentences).groupBy(*_PLACE, "t1", "t2").agg(F.first("text").alias("text"), F.max(F.struct("year", "section", "token")).alias("any"))
    # The condition keeps all columns of the sentences, so that both uses of them share the shuffle of dealt().
    one = one.where("any is not null").select(*_PLACE, "t1", "t2", "text", *[f"any.{c}" for c in more or []])
    return chosen.join(one, [*_PLACE, "t1", "t2"]).drop("t1", "t2", "n_chars")


def first_places(rows: DataFrame, k: int) -> DataFrame:
    """The first k places of a lemma and part of speech."""
    order = W.partitionBy("lemma", "pos").orderBy(*_PLACE)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def found(papers: DataFrame, stop_words=None, min_ratio: float = 0.3, clean: bool = True) -> DataFrame:
    """examples() of the papers' own tokens and sentences: places first, texts last."""
    sentences = told(papers, min_ratio, clean)
    return with_texts(places(sentences, stop_words), sentences).select("lemma", "pos", "text", "word", "year", "section", *_PLACE)


#: Year and label that stand for the vocabulary's own examples.
VOCABULARY = ("墨墨", "墨墨原版例句")


def _best(senses: DataFrame) -> DataFrame:
    return senses.groupBy("lemma").agg(F.max_by("pos", F.struct("pos_count", (-F.col("ord")).alias("o"))).alias("pos"))


def top_example(examples_: DataFrame, senses: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """lemma, pos, text: of the sense with most units (the first of equals), the shortest sentence (the first of equals).

    book(lemma, examples): where it is given, a lemma's first example of the vocabulary comes before all others, and has no part of speech.
    """
    best = _best(senses)
    rank = F.struct(F.length("text").alias("n"), F.col("paper_idx"), F.col("para_idx"), F.col("sent_idx"))
    own = examples_.join(best, ["lemma", "pos"]).groupBy("lemma", "pos").agg(F.min_by("text", rank).alias("text"))
    if book is None:
        return own
    given = book.where(F.size("examples") > 0).join(best.select("lemma"), "lemma").select("lemma", F.lit(None).cast("string").alias("pos"), F.element_at("examples", 1).alias("text"))
    return given.unionByName(own.join(given.select("lemma"), "lemma", "left_anti"))


def numbered(examples_: DataFrame) -> DataFrame:
    """Examples of a lemma and part of speech in order, numbered from 1."""
    return examples_.withColumn("n", F.row_number().over(W.partitionBy("lemma", "pos").orderBy("paper_idx", "para_idx", "sent_idx", "text")))


def detail(lemma: str, pos: str, examples_: DataFrame, pos_counts: DataFrame) -> DataFrame:
    """lemma, pos, unit_count and a row for each sentence of one lemma and part of speech; where there is none, one row with 0 and nulls."""
    same = (F.col("lemma") == lemma) & (F.col("pos") == pos)
    count = pos_counts.where(same).agg(F.coalesce(F.max("pos_count"), F.lit(0)).alias("n")).scalar()
    head = examples_.sparkSession.range(1).select(F.lit(lemma).alias("lemma"), F.lit(pos).alias("pos"), count.alias("unit_count"))
    said = examples_.where(same).select("lemma", "pos", "text", "word", "year", "section", "paper_idx", "para_idx", "sent_idx")
    return head.join(said, ["lemma", "pos"], "left")


class Stored:
    """Places and sentences as tables below a path: places are parted by lemma, each sentence is kept once, parted by its place.

    A detail reads the part of its lemma, and of the sentences the parts that its places name.
    """

    def __init__(self, spark, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def write(self, sentences: DataFrame, stop_words=None) -> Stored:
        """From told(); a hot lemma's places are written by several tasks."""
        rows = places(sentences, stop_words).withColumn("part", self._part("lemma"))
        rows.repartition("part", F.pmod("t1", F.lit(8))).sortWithinPartitions("part", "lemma", "pos").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/places")
        texts = _named_texts(sentences).select(*_PLACE, "t1", "t2", "text", self._part(*_PLACE).alias("text_part"))
        texts.repartition("text_part").sortWithinPartitions("text_part", *_PLACE).write.partitionBy("text_part").mode("overwrite").parquet(f"{self.path}/texts")
        return self

    def of(self, lemma: str, pos: str) -> DataFrame:
        """examples() of one lemma and part of speech."""
        rows = self.spark.read.parquet(f"{self.path}/places").where((F.col("part") == self._part(F.lit(lemma))) & (F.col("lemma") == lemma) & (F.col("pos") == pos))
        rows = rows.drop("part").withColumn("text_part", self._part(*_PLACE))
        texts = self.spark.read.parquet(f"{self.path}/texts").dropDuplicates(["text_part", *_PLACE, "t1", "t2"])
        return rows.join(texts, ["text_part", *_PLACE, "t1", "t2"]).select("lemma", "pos", "text", "word", "year", "section", *_PLACE)
