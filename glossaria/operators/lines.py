"""Line-oriented parsing as ordered windows within a document: fill forward, running counts, islands.

Every state machine is per document, so windows partition by `doc` and order by `line_no`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import HEADED, SECTIONS
from ..functions import textops as t


def so_far(back: int = 0):
    """The document's lines up to this one, or up to `back` lines before it."""
    return W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, -back)


# Header words by section, in order of priority; the text is lower-cased and without white space.
HEADERS = (
    ("use_of_english", ("useofenglish", "usenglish", "clozetest", "closetest")),
    ("reading_a", ("readingcomprehension", "iireading", "ⅱreading")),
    ("reading_c", ("translation", "english-chinese", "englishchinese")),
    ("writing_a", ("writing",)),
)


def _any(flag):
    return F.sum(flag.cast("int")).over(so_far())


def _joined(rows: DataFrame, keys: list[str], sep: str = " ") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["line"]), sep).alias("text"))


def year_blocks(rows: DataFrame) -> DataFrame:
    """doc, block, year, text: a boundary line starts a block and belongs to it; lines before the first are dropped."""
    bound = F.col("line").rlike(t.YEAR_LINE)
    cut = rows.withColumn("block", _any(bound)).where("block > 0")
    head = cut.where(bound).select("doc", "block", F.regexp_extract("line", r"((?:19|20)\d{2})年", 1).alias("year"))
    return _joined(cut, ["doc", "block"], "\n").join(head, ["doc", "block"]).select("doc", "block", "year", "text")


def _labels(column: int):
    """Label of a section's key."""
    return F.element_at(F.create_map(*[F.lit(x) for row in SECTIONS for x in (row[0], row[column])]), F.col("key"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Content lines with the key of their section, seg (its number in the document) and whether a header named it."""
    low = F.lower(F.regexp_replace(t.strip(F.col("line")), f"{t.S}+", ""))
    head = F.lit(None).cast("string")
    for key, words in reversed(HEADERS):
        head = F.when(F.lower(low).rlike("|".join(words)), F.lit(key)).otherwise(head)
    head = F.when(low.contains("section") | low.contains("part"), head)
    part = F.nullif(F.upper(F.regexp_extract(t.strip(F.col("line")), r"^Part\s*([ABCabc])\b", 1)), F.lit(""))
    r = rows.withColumn("head", head).withColumn("part", F.when(F.col("head").isNull(), part))
    # Parts A and B keep to reading or writing; only headers and part C change it: one fill forward.
    side = F.when(F.col("head").isNotNull(), F.col("head").startswith("writing")).when(F.col("part") == "C", F.lit(False))
    r = r.withColumn("writing", F.coalesce(F.last(side, ignorenulls=True).over(so_far()), F.lit(False)))
    kind = F.when(F.col("writing"), F.lit("writing_")).otherwise(F.lit("reading_"))
    event = F.coalesce("head", F.when(F.col("part") == "C", F.lit("reading_c")).when(F.col("part").isNotNull(), F.concat(kind, F.lower("part"))))
    r = r.withColumn("event", event).withColumn("key", F.last("event", ignorenulls=True).over(so_far()))
    r = r.withColumn("seg", _any(F.col("event").isNotNull()))
    r = r.withColumn("headed", F.last(F.when(F.col("event").isNotNull(), F.col("head").isNotNull()), ignorenulls=True).over(so_far()))
    return r.where("event is null and key is not null")


def section_keys(rows: DataFrame) -> DataFrame:
    """doc, line_no, line, key: the section that holds each content line; headers and lines before the first are dropped."""
    return _keyed(rows).select("doc", "line_no", "line", "key")


def sections(rows: DataFrame) -> DataFrame:
    """doc, ord, key, label, label_en, sentences: every section of the documents, in order; a key may come again, a section without content is left out.

    Words parted at a line's end are joined within a section before its numbered translation lines are marked and its paragraphs made.
    """
    text = _joined(_keyed(rows), ["doc", "seg", "key", "headed"], "\n")
    name = F.when(F.col("headed"), F.element_at(F.create_map(*[F.lit(x) for kv in HEADED.items() for x in kv]), F.col("key")))
    unit = F.to_json(F.struct("doc", "seg"))
    text = text.withColumn("unit", unit)
    split = text.select(F.col("unit").alias("doc"), F.posexplode(F.split(t.rejoin_hyphenated("text"), "\n")).alias("line_no", "line"))
    said = paragraphs(translation_marks(split)).groupBy(F.col("doc").alias("unit"))
    said = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]).alias("sentences"))
    return text.join(said, "unit").select(
        "doc", F.col("seg").cast("int").alias("ord"), "key", _labels(1).alias("label"), F.coalesce(name, _labels(2)).alias("label_en"), "sentences"
    )


def translation_marks(rows: DataFrame) -> DataFrame:
    """doc, line_no, line: numbered translation lines with what follows them are one line in double brackets."""
    s = t.strip(F.col("line"))
    event = (
        F.when(F.col("line").rlike(t.TRANSLATION_MARK), F.lit("open"))
        .when(s == "", F.lit("close"))
        .when((t.en_ratio(s) < 0.1) & (t.zh_ratio(s) > 0.3), F.lit("close"))
    )
    r = rows.withColumn("event", event).withColumn("seg", _any(F.coalesce(F.col("event") == "open", F.lit(False))))
    r = r.withColumn("prev", F.last("event", ignorenulls=True).over(so_far(1)))
    inside = F.coalesce(F.col("event") == "open", F.lit(False)) | (F.col("event").isNull() & F.coalesce(F.col("prev") == "open", F.lit(False)))
    r = r.withColumn("inside", inside)
    held = r.where("inside").withColumn("line", s)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    held = held.groupBy("doc", "seg").agg(F.min("line_no").alias("line_no"), F.concat(F.lit("[["), F.array_join(F.transform(parts, lambda x: x["line"]), " "), F.lit("]]")).alias("line"))
    plain = r.where("not inside").select("doc", "line_no", F.when(s == "", F.lit("")).otherwise(F.col("line")).alias("line"))
    return held.select("doc", "line_no", "line").unionByName(plain)


def paragraphs(rows: DataFrame) -> DataFrame:
    """doc, para, text: lines joined up to a blank, choice, header or low-ratio line; a marked line stands alone; then cleaned once."""
    s = t.strip(F.col("line"))
    mark = s.startswith("[[") | F.col("line").rlike(t.TRANSLATION_MARK)
    drop = (s == "") | s.rlike(t.CHOICE_LINE) | s.rlike("(?i)" + t.HEADER_LINE) | (~mark & (t.en_ratio(s) < 0.05))
    r = rows.withColumn("drop", drop).withColumn("mark", mark & ~drop)
    after = F.coalesce(F.lag("mark").over(W.partitionBy("doc").orderBy("line_no")), F.lit(False))
    r = r.withColumn("para", _any(F.col("drop") | F.col("mark") | after)).where("not drop").withColumn("line", s)
    return _joined(r, ["doc", "para"]).withColumn("text", t.clean_paragraph("text")).where("text is not null")


def loose_sentences(rows: DataFrame) -> DataFrame:
    """doc, grp, text of unsplit documents: blank lines part, a numbered line opens a group; English ones are kept."""
    s = t.strip(F.col("line"))
    opens = s.rlike(r"^[\d一二三四五六七八九十]+[.、\s]")
    r = rows.withColumn("grp", _any((s == "") | opens)).where(s != "").withColumn("line", s)
    return _joined(r, ["doc", "grp"]).where(t.en_ratio("text") > 0.3)
