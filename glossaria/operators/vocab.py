"""Vocabulary books: page lines to entries with senses and examples, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import textops as t

# Parts of speech, longest first; line patterns; lines that say nothing.
POS = "|".join(["phrv", "prep", "conj", "pron", "adj", "adv", "num", "art", "int", "aux", "n", "v"])
ENTRY = rf"^(\d{{1,4}})\s+(\w[\w\-]*\w|\w)\s*({POS})?\.?\s*(.*)$"
SENSE = rf"^({POS})\.\s*(.*)$"
TITLE = r"^(\d{3})\s+(\w[\w\-]*)\s*——\s*(.+)$"
SKIP = r"^(|墨墨背单词 2027墨墨考研深度记忆宝典 全部单词|单词 释义 例句|Page\s+\d+)$"
#: Page ranges of the book's parts, 1-based and inclusive.
PARTS = (("main", 1, 142), ("basic", 143, 238), ("low_syllabus", 239, 283), ("zero_syllabus", 284, 379), ("low_extra", 380, 402))


def parts_of(pages: DataFrame, total: int) -> DataFrame:
    """Adds the part of the book that each page belongs to."""
    part = F.lit(None).cast("string")
    for name, lo, hi in PARTS:
        part = F.when(F.col("page").between(lo, min(hi, total)), F.lit(name)).otherwise(part)
    return pages.withColumn("grp", part).where("grp is not null")


def entries(rows: DataFrame, main: bool) -> DataFrame:
    """doc, lemma, at, group_idx, group_title, senses, examples of (doc, page, line_no, line); `at` is the place of the entry's line.

    main: lines group by page, titles close a word, and a page's last word is lost unless it is on the book's last page with text;
    otherwise state runs on from page to page. Books are independent of one another.
    """
    s = t.strip(F.col("line"))
    rows = rows if "doc" in rows.columns else rows.withColumn("doc", F.lit(""))
    r = rows.where("line is not null").withColumn("last_page", F.max("page").over(W.partitionBy("doc")))
    r = r.withColumn("line", s).where(~s.rlike(SKIP) & ~(F.lit(not main) & s.startswith("附录")))
    title = F.col("line").rlike(TITLE) if main else F.lit(False)
    kind = (
        F.when(title, F.lit("title"))
        .when(F.col("line").rlike(ENTRY), F.lit("entry"))
        .when(F.col("line").rlike(SENSE), F.lit("sense"))
        .when(t.en_ratio("line") > 0.5, F.lit("example"))
    )
    r = r.withColumn("kind", kind).where("kind is not null").withColumn("at", F.struct("page", "line_no"))
    book = W.partitionBy("doc").orderBy("page", "line_no")
    w = W.partitionBy("doc", "page").orderBy("page", "line_no") if main else book
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    entry_at = F.when(F.col("kind") == "entry", F.col("at"))
    r = r.withColumn("open", F.last(F.when(F.col("kind").isin("entry", "title"), F.struct("kind", "at")), ignorenulls=True).over(back))
    r = r.withColumn("next", F.first(entry_at, ignorenulls=True).over(ahead))
    r = r.withColumn("owner", F.when(F.col("open.kind") == "entry", F.col("open.at")).otherwise(F.col("next")))
    r = r.withColumn("closed", F.count(F.when(F.col("kind").isin("entry", "title"), 1)).over(ahead) > 0)
    r = r.withColumn("kept", F.col("closed") | (F.col("page") == F.col("last_page")) if main else F.lit(True))
    if main:
        name = F.when(F.col("kind") == "title", F.regexp_replace("line", r"\s*——\s*", " —— "))
        r = r.withColumn("group_title", F.last(name, ignorenulls=True).over(book.rowsBetween(W.unboundedPreceding, 0)))
    else:
        r = r.withColumn("group_title", F.lit(None).cast("string"))
    head = r.where("kind = 'entry' and kept").select(
        "doc", F.col("at").alias("owner"), F.lower(F.regexp_extract("line", ENTRY, 2)).alias("lemma"), F.coalesce("group_title", F.lit("")).alias("group_title")
    )
    pos = F.when(F.col("kind") == "entry", F.regexp_extract("line", ENTRY, 3)).otherwise(F.regexp_extract("line", SENSE, 1))
    raw = F.when(F.col("kind") == "entry", F.regexp_extract("line", ENTRY, 4)).otherwise(F.regexp_extract("line", SENSE, 2))
    said = r.where("kind in ('entry', 'sense')").select("doc", "owner", "at", "kind", pos.alias("pos"), raw.alias("raw"), t.clean_meaning(raw).alias("meaning"))
    # An entry's own sense needs a rest of the line, a sense line a meaning.
    said = said.where("pos <> '' and if(kind = 'entry', raw <> '', meaning <> '')")
    order = F.array_sort(F.collect_list(F.struct("at", "pos", "meaning")))
    said = said.groupBy("doc", "owner").agg(F.array_distinct(F.transform(order, lambda x: F.struct(x["pos"].alias("pos"), x["meaning"].alias("meaning")))).alias("senses"))
    shown = r.where("kind = 'example'").groupBy("doc", "owner").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), 1, 5).alias("examples"))
    out = head.join(said, ["doc", "owner"], "left").join(shown, ["doc", "owner"], "left")
    none = "array<struct<pos:string,meaning:string>>"
    return out.select(
        "doc",
        "lemma",
        F.col("owner").alias("at"),
        F.coalesce(F.expr("try_cast(substring(group_title, 1, 3) as int)"), F.lit(0)).alias("group_idx"),
        "group_title",
        F.coalesce("senses", F.array().cast(none)).alias("senses"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


def book(pages: DataFrame, total: int) -> DataFrame:
    """Entries of all parts of the books, with grp and ord: the order of parts, then of lines. pages(doc, page, line_no, line)."""
    rows = parts_of(pages, total)
    names = [n for n, _, _ in PARTS]
    found = []
    for name in names:
        found.append(entries(rows.where(F.col("grp") == name).drop("grp"), main=name == "main").withColumn("grp", F.lit(name)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    part = F.array_position(F.array(*map(F.lit, names)), F.col("grp"))
    return out.withColumn("ord", F.struct(part.alias("part"), F.col("doc"), F.col("at")))


def merge(rows: DataFrame) -> DataFrame:
    """One row a lemma of (lemma, grp, ord, senses, examples): the first keeps its group and examples, senses unite in order."""
    own = [c for c in ("grp", "group_idx", "group_title", "examples") if c in rows.columns]
    first = rows.groupBy("lemma").agg(F.min_by(F.struct(*own), "ord").alias("f"))
    each = rows.select("lemma", "ord", F.posexplode("senses").alias("k", "s"))
    seen = each.groupBy("lemma", "s").agg(F.min(F.struct("ord", "k")).alias("at"))
    senses = seen.groupBy("lemma").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("senses"))
    none = F.array().cast("array<struct<pos:string,meaning:string>>")
    return first.join(senses, "lemma", "left").select("lemma", *[f"f.{c}" for c in own], F.coalesce("senses", none).alias("senses"))


def report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.count("*").alias("entries"), F.count_distinct("lemma").alias("lemmas"))
