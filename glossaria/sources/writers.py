"""Writers of the corpus' outputs."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SECTION_FILES, SECTION_ORDER
from .sections_sink import SectionFiles, written


def first_sections(sections: DataFrame) -> DataFrame:
    """The first of each (year, key) in the fixed order of sections. sections(year, key, label, label_en, source, ord, sentences)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SECTION_ORDER]), F.col("key"))
    rows = sections.where(rank > 0).withColumn("rank", rank.cast("int"))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("year", "key").orderBy("ord"))).where("n = 1").drop("n")


def _file():
    """Name of a section's file: its place in the fixed order, and its short name."""
    short = F.create_map(*[F.lit(x) for kv in SECTION_FILES.items() for x in kv])
    return F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("_"), F.element_at(short, F.col("key")), F.lit(".txt"))


def meta(sections: DataFrame, kind: str = "英语一") -> DataFrame:
    """year, meta: one JSON text a year that names the section files and their sentence counts. sections may have a kind of their own."""
    row = F.struct("rank", "key", "label", "label_en", _file().alias("file"), F.size("sentences").alias("sentence_count"))
    told = F.min("kind") if "kind" in sections.columns else F.lit(kind)
    per = first_sections(sections).groupBy("year").agg(F.array_sort(F.collect_list(row)).alias("s"), F.min("source").alias("source"), told.alias("type"))
    parts = F.transform("s", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), x["label_en"].alias("label_en"), x["file"].alias("file"), x["sentence_count"].alias("sentence_count")))
    return per.select("year", F.to_json(F.struct("year", "type", "source", parts.alias("sections"))).alias("meta"))


def section_files(sections: DataFrame, kind: str = "英语一") -> DataFrame:
    """year, file, value: the section texts, paragraphs parted by an empty line, and meta.json of every year."""
    text = first_sections(sections).select("year", _file().alias("file"), F.array_join("sentences", "\n\n").alias("value"))
    return text.unionByName(meta(sections, kind).select("year", F.lit("meta.json").alias("file"), F.col("meta").alias("value")))


def write_sections(sections: DataFrame, path: str, kind: str = "英语一") -> int:
    """One folder a year with the files that its meta.json names, as readers.processed_sections reads them; files that come again are written anew.

    Tasks write the files, whatever their number and size (see sections_sink). Returns the number of files.
    """
    sections.sparkSession.dataSource.register(SectionFiles)
    section_files(sections, kind).write.format("section_files").option("path", path).mode("append").save()
    return written(path)


def write_vocabulary(rows: DataFrame, merged: DataFrame, path: str) -> None:
    """Entries by part of the book, and merged in the order of (group, lemma), in the columns that readers.vocabulary reads."""
    columns = ["lemma", F.col("grp").alias("group"), "group_idx", "group_title", "senses", F.col("examples").alias("examples_en")]
    rows.select("grp", "ord", *columns).sortWithinPartitions("grp", "ord").drop("ord").write.partitionBy("grp").mode("overwrite").json(f"{path}/parts")
    merged.select(*columns).orderBy("group", "lemma").write.mode("overwrite").json(f"{path}/merged")


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).mode("overwrite").csv(path)


def write_dictionary(rows: DataFrame, path: str) -> None:
    """New look-ups are appended; readers take the union."""
    rows.write.mode("append").parquet(path)


_CELL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _row(n: int, values) -> str:
    cells = []
    for i, v in enumerate(values):
        ref = f"{chr(65 + i)}{n}"
        if isinstance(v, int | float):
            cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
        else:
            cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_CELL.sub("", str(v or "")))}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


def write_excel(table: DataFrame, path: str, title: str) -> int:
    """A workbook of one sheet with a header row; returns the number of rows. Rows stream through the driver: a sheet holds 1,048,575 at most."""
    name, main = "http://schemas.openxmlformats.org", "spreadsheetml/2006/main"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    office = f"{name}/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{name}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{name}/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{name}/package/2006/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{name}/{main}" xmlns:r="{office}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'{head}<worksheet xmlns="{name}/{main}"><sheetData>{_row(1, table.columns)}'.encode())
            for r in table.toLocalIterator():
                n += 1
                if n > 1 << 20:
                    raise ValueError("a sheet holds 1,048,575 rows; write a band, or CSV")
                f.write(_row(n, r).encode())
            f.write(b"</sheetData></worksheet>")
    return n - 1
