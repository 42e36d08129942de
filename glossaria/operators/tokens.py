"""Papers to paragraphs, sentences, tokens and lemmas. Ordinals are columns, as rows have no order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textops as t
from ..functions.lexicon import SHORTEST, STOP_WORDS, SUFFIXES
from . import units as un


def active(papers: DataFrame) -> DataFrame:
    """Papers that are enabled; a null flag counts as enabled."""
    return papers.where(F.coalesce("enabled", F.lit(True)))


def toggle(papers: DataFrame, year: str, section: str | None, enabled: bool) -> DataFrame:
    hit = F.col("year") == year
    if section:
        hit &= F.col("section") == section
    return papers.withColumn("enabled", F.when(hit, F.lit(enabled)).otherwise(F.col("enabled")))


def lines(papers: DataFrame, clean: bool = False) -> DataFrame:
    """paper_idx, year, section, line_no, line of papers by their sentences, or else their text; `clean`: what one pass of the cleaner leaves."""
    found = [F.col("sentences")] * ("sentences" in papers.columns) + [F.split("text", "\n")] * ("text" in papers.columns)
    found = F.coalesce(*found)
    # Cleaned before the generator: a filter on its lines can't be pushed below it, so no line is cleaned twice.
    found = F.transform(found, t.clean_paragraph) if clean else found
    rows = papers.select("paper_idx", "year", "section", F.posexplode(found).alias("line_no", "line"))
    return rows.where("line is not null") if clean else rows


def dealt(papers: DataFrame, min_ratio: float = 0.3, clean: bool = True, known=None) -> DataFrame:
    """paper_idx, year, section, line_no, line, token (whether the line has enough English), known: lines(), dealt out by paper.

    What a plan makes of them shares this one shuffle, so no line is cleaned twice, and what is asked for paper by paper needs no other.
    For that, all of it must use every column, and no condition on a line may stand before a generator.
    """
    rows = lines(papers, clean).withColumn("token", t.en_ratio("line", clean) > min_ratio)
    rows = rows if known is None else rows.withColumn("known", known)
    return rows.repartition("paper_idx", "year", "section")


def _words(papers: DataFrame, stop, min_ratio: float | None, clean: bool, split) -> DataFrame:
    """paper_idx, year, section, line_no, tok_idx, word, low of words that count as tokens by their form; of papers, or of lines from dealt()."""
    found = split(F.col("line"))
    if "token" in papers.columns:
        rows, found = papers, F.when(F.col("token") & (F.col("line_no") >= 0), found)  # always so: no column of dealt() is left out
    else:
        rows = lines(papers, clean)
        if min_ratio is not None:
            rows = rows.where(t.en_ratio("line", clean) > min_ratio)
    rows = rows.select("paper_idx", "year", "section", "line_no", F.posexplode(found).alias("tok_idx", "word"))
    return rows.where(t.is_token(F.col("word"))).withColumn("low", F.lower("word")).where(f"NOT {t.within('low', stop)}")


def words(papers: DataFrame, stop_words=None, min_ratio: float | None = 0.3, clean: bool = True, split=t.runs) -> DataFrame:
    """What tokens() looks lemmas up for: the words that count as tokens by their form, stop words left out."""
    return _words(papers, list(STOP_WORDS if stop_words is None else stop_words), min_ratio, clean, split)


def named(words: DataFrame, stop, suffixes: bool = True) -> DataFrame:
    """low -> lemma, pos of every distinct word that is a token by its lemma too: lemmas and tags are worked out once a word."""
    rows = words.select("low").distinct()
    if suffixes:
        rows = lemmas(rows.select(F.col("low").alias("word"))).select(F.col("word").alias("low"), "lemma")
    else:
        rows = rows.withColumn("lemma", t.lemma_of("low"))
    return rows.where(f"NOT {t.within('lemma', stop)} AND length(lemma) >= 2").withColumn("pos", t.pos_of("low"))


def tokens(papers: DataFrame, stop_words=None, min_ratio: float | None = 0.3, suffixes: bool = True, clean: bool = False, split=t.runs) -> DataFrame:
    """paper_idx, year, section, line_no, tok_idx, word, lemma, pos of every vocabulary token.

    Lemmas are those of lemmas() over the tokens' words; without `suffixes`, by irregular forms only. `split` parts a line into words
    (t.runs, or t.treebank).
    """
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    rows = _words(papers, stop, min_ratio, clean, split)
    return rows.join(named(rows, stop, suffixes), "low").select("paper_idx", "year", "section", "line_no", "tok_idx", "word", "lemma", "pos")


def of_lemma(words: DataFrame, lemma: str, stop_words=None) -> DataFrame:
    """tokens() of one lemma, from words(): its few forms are sent to the words, and nothing else is moved."""
    names = named(words, list(STOP_WORDS if stop_words is None else stop_words)).where(F.col("lemma") == lemma)
    return words.join(F.broadcast(names), "low")


#: Line and word of a place take 31 bits each below the paper's number.
_STEP = "cast(4611686018427387904 as decimal(19,0))"


def place():
    """paper_idx, line_no, tok_idx as one number in their order. Numbers of fixed size are kept in hash tables where structs are sorted."""
    below = "cast(shiftleft(cast(line_no as bigint), 31) + tok_idx as decimal(20,0))"
    return F.expr(f"cast(cast(paper_idx as decimal(19,0)) * {_STEP} + {below} as decimal(38,0))")


def unplaced(column: str):
    """The struct (paper_idx, line_no, tok_idx) of a place()."""
    below = f"cast(pmod({column}, {_STEP}) as bigint)"
    paper = f"cast(({column} - pmod({column}, {_STEP})) div {_STEP} as bigint)"
    return F.expr(f"struct({paper} as paper_idx, cast(shiftright({below}, 31) as int) as line_no, cast({below} & 2147483647 as int) as tok_idx)")


def counted(papers: DataFrame, stop_words=None, min_ratio: float | None = 0.3, clean: bool = True, split=t.runs, places: bool = True) -> DataFrame:
    """low, year, section, n_tokens: the words of every unit with their number; with `places` also place, the first one.

    Words are counted on the map side, so what is shuffled grows with the vocabulary of a unit, not with its text. The conditions at the end
    hold for every row: they keep all columns in any plan on these rows, so that plans which use them twice share one shuffle
    and read the texts once.
    """
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    rows = _words(papers, stop, min_ratio, clean, split).where("low is not null")
    count, always = [F.count("*").alias("n_tokens")], F.col("n_tokens") > 0
    if places:
        count, always = [*count, F.min(place()).alias("place")], always & (F.col("place").isNull() | (F.col("place") > F.lit("-" + "9" * 38).cast("decimal(38,0)")))
    return rows.groupBy("low", "year", "section").agg(*count).where(always)


def or_bits(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with a unit's bit to rows of 64 units."""
    first = [F.min("place").alias("place")] * ("place" in rows.columns)
    return rows.groupBy(*keys, "w").agg(F.bit_or("bit").alias("bits"), F.sum("n_tokens").alias("n_tokens"), *first)


def word_bits(papers: DataFrame, stop_words=None, min_ratio: float | None = 0.3, clean: bool = True, split=t.runs, places: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """low, w, bits, n_tokens, place: of every word the bitmap of its units (units.numbered of the papers), 64 units a row. rows: the papers' dealt()."""
    return or_bits(un.marked(counted(papers if rows is None else rows, stop_words, min_ratio, clean, split, places), un.numbered(papers)), "low")


def with_lemmas(bits: DataFrame, words: DataFrame | None = None, stop_words=None, suffixes: bool = True) -> DataFrame:
    """Rows of word_bits() as word, lemma, pos, w, bits, n_tokens, place; words without a lemma that counts go.

    Lemmas and tags are worked out once a word, for the words of these rows, or for others that the caller knows to be the same ones.
    """
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    names = named(bits if words is None else words, stop, suffixes)
    return bits.join(names, "low").withColumnRenamed("low", "word")


def cells(papers: DataFrame, stop_words=None, min_ratio: float | None = 0.3, suffixes: bool = True, clean: bool = True, split=t.runs, places: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """word, lemma, pos, w, bits, n_tokens, place: tokens() as bitmaps of units. All of an index follows from it; counts alone need no places.

    rows: the papers' dealt(), where other parts of a plan use it too.
    """
    args = (stop_words, min_ratio, clean, split, places)
    return with_lemmas(word_bits(papers, *args, rows), counted(papers if rows is None else rows, *args), stop_words, suffixes)


def as_bits(tokens: DataFrame, papers: DataFrame) -> DataFrame:
    """The rows of cells(), from token rows."""
    rows = tokens.groupBy(F.lower("word").alias("word"), "lemma", "pos", "year", "section").agg(F.min(place()).alias("place"), F.count("*").alias("n_tokens"))
    return or_bits(un.marked(rows, un.numbered(papers)), "word", "lemma", "pos")


#: Abbreviations whose full stop does not end a sentence; a parameter of `careful`.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "fig", "no", "vol", "inc", "ltd", "co", "e.g", "i.e", "a.m", "p.m", "u.s")


def plain(line):
    """Runs up to closing punctuation."""
    return F.regexp_extract_all(line, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))


def careful(line, abbreviations=ABBREVIATIONS):
    """As plain, but full stops of abbreviations, initials and numbers, and those before a small letter, end nothing."""
    stop = "\ue000"  # of the private use area
    known = "|".join(a.replace(".", "[.]") for a in abbreviations)
    x = F.regexp_replace(line, rf"(?i)(^|[^\p{{L}}.])({known})[.]", f"$1$2{stop}")
    x = F.regexp_replace(x, r"(^|[^\p{L}])(\p{Lu})[.]", f"$1$2{stop}")
    x = F.regexp_replace(x, r"[.]([\p{L}\p{N}]|\s+\p{Ll})", f"{stop}$1")
    return F.transform(plain(x), lambda s: F.replace(s, F.lit(stop), F.lit(".")))


def sentences(papers: DataFrame, clean: bool = False, split=plain, known=None) -> DataFrame:
    """paper_idx, year, section, line_no, sent_idx, text: what `split` makes of each line, trimmed; `known`: a value it needs beside the line."""
    rows = lines(papers, clean)
    rows = rows if known is None else rows.withColumn("known", known)
    rows = rows.select("paper_idx", "year", "section", "line_no", F.posexplode(split(F.col("line"))).alias("sent_idx", "text"))
    return rows.withColumn("text", F.trim("text")).where("text <> ''")


def build(papers: DataFrame, stop_words=None) -> tuple[DataFrame, DataFrame]:
    """tokens() and sentences() of an index build, which cleans every line once more; papers hold text, or sentences as readers leave them."""
    return tokens(papers, stop_words, clean=True), sentences(papers, clean=True)


#: Stands for the word itself, after all rules.
_SELF = len(SUFFIXES)


def _lemmatized(words: DataFrame) -> DataFrame:
    """Distinct words with their lemma; the lexicon is the words themselves and the stop words.

    Every word is sent to itself and to all that the suffix rules make of it; where a word or stop word lives, those sent there have found a
    base. A word's group holds few: at most one for each rule. No table is joined with itself.
    """
    itself = F.array(F.struct(F.lit(_SELF).alias("rule"), F.col("word").alias("base")))
    sent = words.select("word", F.explode(F.concat(itself, _bases())).alias("t")).select("word", "t.*")
    home = sent.groupBy("base").agg(F.collect_list(F.struct("word", "rule")).alias("tries"))
    lives = f"exists(tries, x -> x.rule = {_SELF}) OR {t.within('base', STOP_WORDS)}"
    found = home.where(lives).select("base", F.explode("tries").alias("t")).select("base", "t.*")
    out = found.groupBy("word").agg(F.min_by("base", "rule").alias("base"))
    return out.select("word", F.coalesce(t.irregular("word"), "base").alias("lemma"))


def _bases():
    """What the suffix rules make of a word, as (rule, base)."""
    cases = ", ".join(
        f"CASE WHEN endswith(word, '{end}') AND length(word) >= {SHORTEST + len(end) - len(to)} "
        f"THEN named_struct('rule', {i}, 'base', concat(substring(word, 1, length(word) - {len(end)}), '{to}')) END"
        for i, (_, end, to) in enumerate(SUFFIXES)
    )
    return F.expr(f"array_compact(array({cases}))")


def lemmas(words: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """word -> lemma: by table of irregular forms, else by the first suffix rule whose result is in the lexicon, else the word itself.

    The lexicon is the words themselves and the stop words, unless given. Works on distinct words, so each is looked up once
    whatever the corpus size.
    """
    words = words.select("word").distinct()
    if lexicon is None:
        return _lemmatized(words)
    lexicon = lexicon.select(F.col("word").alias("base")).distinct()
    tries = words.select("word", F.explode(_bases()).alias("t")).select("word", "t.rule", "t.base")
    found = tries.join(lexicon, "base").groupBy("word").agg(F.min_by("base", "rule").alias("base"))
    return words.join(found, "word", "left").select("word", F.coalesce(t.irregular("word"), "base", "word").alias("lemma"))
