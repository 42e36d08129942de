"""Readers of the corpus' inputs. Everything is read by Spark, so any store that Spark reads will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import WHOLE
from ..functions import textops as t
from ..operators import lines as ln

SENSES = "array<struct<pos:string,meaning:string>>"
VOCAB = f"lemma string, `group` string, group_idx int, group_title string, senses {SENSES}, examples_en array<string>"
META = "year string, type string, source string, sections array<struct<key:string,label:string,label_en:string,file:string,sentence_count:int>>"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the cluster has cores, dealt out anew; a scan with more stays as it is.

    Work on texts costs far more than moving them once, and one large row group is one task. Inputs worth a cluster have more partitions
    than cores, so nothing is shuffled there.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def documents_as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers(paper_idx, year, section, section_label, filename, text, enabled) bound to the documents table."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return d.select(F.col("doc_id").alias("paper_idx"), F.col("source").alias("year"), F.col("lang").alias("section"), "text", F.lit(True).alias("enabled"))


def _there(spark: SparkSession, pattern: str) -> bool:
    """Does anything match a path pattern, in whatever store it names?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def word_list(spark: SparkSession, path: str, level: str) -> DataFrame:
    """level, word of a list, lower-cased and distinct; an absent list has no words."""
    if not _there(spark, path):
        return _empty(spark, "level string, word string")
    words = spark.read.text(path).select(F.lower(t.strip(F.col("value"))).alias("word"))
    return words.where("word <> ''").distinct().select(F.lit(level).alias("level"), "word")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a vocabulary file, their meanings cleaned and their senses made distinct; none if it is absent."""
    if not _there(spark, path):
        return _empty(spark, VOCAB)
    v = spark.read.schema(VOCAB).json(path, multiLine=True).where("lemma is not null")
    sense = F.transform("senses", lambda s: F.struct(s["pos"].alias("pos"), t.clean_loaded_meaning(s["meaning"]).alias("meaning")))
    return v.withColumn("senses", F.array_distinct(F.coalesce(sense, F.array().cast(SENSES))))


def vocabulary_senses(entries: DataFrame) -> DataFrame:
    """lemma, pos, meaning, ord of vocabulary entries: of a lemma that comes again, senses unite in order. entries(lemma, senses)."""
    each = entries.select("lemma", F.monotonically_increasing_id().alias("row"), F.posexplode("senses").alias("k", "s")).select("lemma", "row", "k", "s.pos", "s.meaning")
    first = each.groupBy("lemma", "pos", "meaning").agg(F.min(F.struct("row", "k")).alias("at"))
    return first.select("lemma", "pos", "meaning", (F.row_number().over(W.partitionBy("lemma").orderBy("at")) - 1).alias("ord"))


def vocabulary_groups(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """grp, lemma of the appendix files; group by file. Absent files have no words."""
    out = _empty(spark, "grp string, lemma string")
    for g, p in sorted(paths.items()):
        if _there(spark, p):
            out = out.unionByName(spark.read.schema(VOCAB).json(p, multiLine=True).select(F.lit(g).alias("grp"), F.lower("lemma").alias("lemma")))
    return out.where("lemma is not null").distinct()


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """lemma, pos, meaning, ord of a dictionary cache {word: [{pos, meaning}]}; nothing of an absent or broken one."""
    if not _there(spark, path):
        return _empty(spark, "lemma string, pos string, meaning string, ord int")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{SENSES}>").alias("m"))
    each = raw.select(F.explode("m").alias("lemma", "senses")).select(F.lower("lemma").alias("lemma"), F.posexplode("senses").alias("ord", "s"))
    return each.select("lemma", "s.pos", "s.meaning", "ord")


PAPERS = "paper_idx int, year string, section string, section_label string, filename string, nth int, sentences array<string>, enabled boolean"


def _name(path, parts: int):
    """The last parts of a file's address, as they were before the address was encoded."""
    return F.url_decode(F.replace(F.substring_index(path, "/", -parts), F.lit("+"), F.lit("%2B")))


def processed_sections(spark: SparkSession, root: str) -> DataFrame:
    """papers of a processed corpus: <root>/<year>/meta.json names the section files; files that are missing are skipped.

    paper_idx is the order of year folders, then of sections in meta.json. A corpus without any year is empty.
    """
    if not _there(spark, f"{root}/*/meta.json") or not _there(spark, f"{root}/*/*.txt"):
        return _empty(spark, PAPERS)
    meta = spark.read.schema(META).json(f"{root}/*/meta.json", multiLine=True).withColumn("dir", F.substring_index(_name(F.input_file_name(), 2), "/", 1))
    each = meta.select("year", "source", "dir", F.posexplode("sections").alias("nth", "s"))
    each = each.withColumn("paper_idx", F.row_number().over(W.orderBy("dir", "nth")) - 1)  # a few rows a year, without texts
    files = spark.read.text(f"{root}/*/*.txt", wholetext=True).select(_name(F.input_file_name(), 2).alias("path"), "value")
    rows = each.withColumn("path", F.concat("dir", F.lit("/"), "s.file")).join(files, "path")
    paras = F.filter(F.split(t.strip(F.col("value")), "\n\n"), lambda p: t.strip(p) != "")
    rows = rows.withColumn("sentences", F.array_compact(F.transform(paras, t.clean_paragraph)))
    return rows.select("paper_idx", "year", F.col("s.key").alias("section"), F.col("s.label").alias("section_label"), F.col("source").alias("filename"), "nth", "sentences", F.lit(True).alias("enabled"))


_PARA = re.compile(r"<w:p[ >].*?</w:p>", re.S)
_RUN = re.compile(r"<w:t(?: [^>]*)?>(.*?)</w:t>", re.S)


def docx_text(raw: bytes, tables: bool = False) -> str:
    """Non-blank paragraphs of a DOCX, joined by newlines; with `tables`, table rows follow, cells joined by a space."""
    from html import unescape

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    found = re.findall(r"<w:tbl>.*?</w:tbl>", xml, re.S)
    body = re.sub(r"<w:tbl>.*?</w:tbl>", "", xml, flags=re.S)
    said = lambda x: unescape("".join(_RUN.findall(x))).strip()
    out = [p for p in map(said, _PARA.findall(body)) if p]
    if tables:
        for tbl in found:
            for row in re.findall(r"<w:tr[ >].*?</w:tr>", tbl, re.S):
                cells = [c for c in map(said, re.findall(r"<w:tc>.*?</w:tc>", row, re.S)) if c]
                out += [" ".join(cells)] if cells else []
    return "\n".join(out)


def pdf_pages(raw: bytes) -> list[str]:
    """Text of each page; needs an optional PDF library."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pdfplumber") from e
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def _extracted(batches: Iterator[pd.DataFrame], tables: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, raw in zip(b["path"], b["content"], strict=True):
            kind = path.rsplit(".", 1)[-1].lower()
            if kind not in ("docx", "pdf"):
                raise ValueError(f"unsupported file type: {path}")
            pages = [docx_text(raw, tables)] if kind == "docx" else pdf_pages(raw)
            rows += [(path, i + 1, p) for i, p in enumerate(pages) if p]
        yield pd.DataFrame(rows, columns=["path", "page", "text"])


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx}", tables: bool = False, recursive: bool = True) -> DataFrame:
    """path, page, text of the PDF and DOCX files of a folder; `tables`: with the rows of a DOCX's tables after its paragraphs."""
    if not _there(spark, path):
        return _empty(spark, "path string, page int, text string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content").mapInPandas(lambda it: _extracted(it, tables), "path string, page int, text string")


def corpus_walk(spark: SparkSession, root: str, year_folder: str) -> DataFrame:
    """phase, path, page, text in the order in which a corpus is built: PDFs of the folder of single years, PDFs of the root, then DOCX bundles."""
    found = [
        binary_documents(spark, f"{root}/{year_folder}", "*.pdf", recursive=False),
        binary_documents(spark, root, "*.pdf", recursive=False),
        binary_documents(spark, root, "*.docx", tables=True, recursive=False),
    ]
    out = [x.select(F.lit(i).alias("phase"), "*") for i, x in enumerate(found)]
    return out[0].unionByName(out[1]).unionByName(out[2]).orderBy("phase", "path", "page")


def lines_of(pages: DataFrame) -> DataFrame:
    """doc, page, line_no, line in reading order, for the line operators; doc is the file's whole path, as names may come twice."""
    rows = pages.select(F.col("path").alias("doc"), "page", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc", "page", (F.shiftleft(F.col("page").cast("long"), 32) + F.col("n")).alias("line_no"), "line")


def name_of(path) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def split_documents(pages: DataFrame) -> DataFrame:
    """Sections (doc, ord, key, label, label_en, sentences) of single documents. pages(path, page, text)."""
    return ln.sections(lines_of(pages))


def split_bundles(pages: DataFrame) -> DataFrame:
    """Sections of documents that hold several years: doc, block, year, kind, ord, key, label, label_en, sentences."""
    blocks = ln.year_blocks(lines_of(pages)).withColumn("unit", F.to_json(F.struct("doc", "block")))
    rows = blocks.select(F.col("unit").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    named = blocks.select("unit", "doc", "block", "year", t.exam_type("text").alias("kind"))
    return ln.sections(rows).withColumnRenamed("doc", "unit").join(named, "unit").drop("unit")


def uploaded(pages: DataFrame, after: int | Column = 0) -> DataFrame:
    """papers of uploaded documents: their sections, or the whole document as one unit where no section is found.

    paper_idx goes on after `after`, in the order of names and sections. Paragraphs of sections have been cleaned once and are cleaned again; those of
    whole documents once.
    """
    rows = lines_of(pages)
    once_more = F.array_compact(F.transform("sentences", t.clean_paragraph))
    name = name_of(F.col("doc"))
    year = t.year_of_name(name)
    split = ln.sections(rows).select(
        "doc", "ord", year.alias("year"), F.col("key").alias("section"), F.col("label").alias("section_label"),
        F.concat_ws("_", year, "key").alias("filename"), F.lit(None).cast("string").alias("text"), once_more.alias("sentences"),
    )
    other = rows.join(split.select("doc").distinct(), "doc", "left_anti")
    text = other.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    said = ln.loose_sentences(other).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "text"))), lambda x: x["text"]).alias("sentences"))
    said = text.join(said, "doc", "left").withColumn("sentences", F.coalesce("sentences", F.array().cast("array<string>")))
    whole = said.select(
        "doc", F.lit(0).alias("ord"), year.alias("year"), F.lit(WHOLE[0]).alias("section"), F.lit(WHOLE[1]).alias("section_label"),
        name.alias("filename"), "text", once_more.alias("sentences"),
    )
    both = split.unionByName(whole)
    # Keys alone are numbered: within ranges of their order, after the sizes of the ranges before. Texts stay where they are until the join.
    keys = both.select("doc", "ord").repartitionByRange("doc", "ord").withColumn("range", F.spark_partition_id())
    keys = keys.withColumn("nth", F.row_number().over(W.partitionBy("range").orderBy("doc", "ord")) - 1)
    sizes = keys.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = (F.col("nth") + F.col("before") + after).cast("long").alias("paper_idx")
    numbers = keys.join(before, "range").select("doc", "ord", place)
    return both.join(numbers, ["doc", "ord"]).withColumn("enabled", F.lit(True)).drop("doc", "ord")


def append_uploads(papers: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads are appended; a unit that comes twice is kept twice and counts once."""
    return papers.unionByName(uploads, allowMissingColumns=True)
