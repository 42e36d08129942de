"""Whole builds and composed queries on small inputs derived by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaria.config import SECTION_ORDER, Settings
from glossaria.functions import lexicon
from glossaria.functions import textops as t
from glossaria.operators import examples, filters, index, lines, senses, serving, tokens, vocab
from glossaria.plans import batch
from glossaria.plans import fixtures as fx
from glossaria.sources import readers, writers

PAPERS = "paper_idx int, year string, section string, text string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAPERS)


def one(df, column):
    return df.first()[column]


def test_word_tables_are_whole():
    assert len(lexicon.STOP_WORDS) == len(set(lexicon.STOP_WORDS)) == 218 and len(lexicon.IRREGULAR) == 184 and len(set(lexicon.IRREGULAR.values())) == 55


def test_studies_and_studied_are_one_row(spark):
    p = papers(spark, ("2010", "a", "Studies matter."), ("2010", "b", "They studied and stopped planning."), ("2011", "a", "The study, the plan."), (None, "a", "studying"), (None, None, "study plans"))
    rows = {r["lemma"]: r for r in index.build(p).collect()}
    assert rows["study"]["variants"] == ["studied", "studies", "study", "studying"] and rows["study"]["units"] == 5 and rows["study"]["frequency"] == 1.0
    assert rows["plan"]["variants"] == ["plan", "planning", "plans"] and "stop" not in rows and "stopped" not in rows
    assert rows["study"]["count_sum"] == sum(rows["study"]["pos_counts"].values())
    assert one(index.total_units(p), "total_units") == 5  # a null is a unit's value of its own


def test_one_pass_equals_tokens(spark):
    p = papers(spark, ("2010", "a", "The cats chased busy dogs. Dogs slept\nA hurried fox, the foxes."), ("2010", "a", "Dogs barked happily"), ("2011", "b", "中文中文中文中文 fox cats"), (None, None, None))
    tok, cell = tokens.tokens(p, clean=True), tokens.cells(p)
    key = lambda df: sorted(map(str, df.collect()))
    for f in (index.variants, index.pos_counts, index.count_sums, index.first_seen):
        assert key(f(tok)) == key(f(cell))
    assert key(index.frequency(tok, p)) == key(index.frequency(cell, p))
    assert one(cell.agg(F.sum("n_tokens").alias("n")), "n") == tok.count()
    low = tok.withColumn("word", F.lower("word"))
    assert key(examples.found(p)) == key(examples.examples(low, tokens.sentences(p, clean=True)))


def test_senses_within_rows_equal_joins(spark):
    p = papers(spark, ("2010", "a", "Dogs bark loudly. Cats sleep."), ("2011", "a", "The dog barked"))
    book = spark.createDataFrame([("dog", "n", "狗", 0), ("dog", "v", "跟", 1), ("cat", "v", "x", 0), ("zebra", "n", "y", 0)], "lemma string, pos string, meaning string, ord int")
    cell = tokens.cells(p)
    rows = senses.sense_rows(senses.attached(index.assembled(cell, p), book))
    assert sorted(map(str, rows.collect())) == sorted(map(str, senses.with_fallback(index.pos_counts(cell), book).collect()))


def test_settings():
    s, anew = Settings().updated({"high_threshold": 0.7, "exclude_levels": ["cet4"], "unknown": 1})
    assert (s.high_threshold, s.exclude_levels, anew) == (0.7, ("cet4",), True)
    assert Settings().updated({"use_vocab_examples": True}) == (Settings(use_vocab_examples=True), False)


def test_words_page(spark):
    rows = spark.createDataFrame(
        [("b", ["b"], 0.5, 1, 1), ("a", ["a", "xb"], 0.5, 2, 1), ("c", ["c"], 0.7, 3, 1), ("d", ["d"], 0.1, 4, 1)], "lemma string, variants array<string>, frequency double, first_seen int, units int"
    )
    get = lambda *a, **k: serving.words(rows, *a, size=10, **k).first()
    r = get()
    assert (r["total"], r["high"], r["medium"], r["low"]) == (4, 3, 0, 1) and [x["lemma"] for x in r["words"]] == ["c", "b", "a", "d"]
    assert [x["lemma"] for x in get("all", "frequency", "asc")["words"]] == ["d", "b", "a", "c"]
    assert [x["lemma"] for x in get("all", "lemma", "asc")["words"]] == ["d", "c", "b", "a"]
    assert [x["lemma"] for x in get("high", "lemma", "desc", "B")["words"]] == ["a", "b"]
    far = get(number=9)
    assert far["words"] == [] and far["total"] == 4
    none = serving.words(rows.limit(0)).first()
    assert (none["total"], none["high"], none["words"]) == (0, 0, [])
    with pytest.raises(ValueError):
        get(text="x" * 51)
    with pytest.raises(ValueError):
        get("other")


def test_null_years(spark):
    p = papers(spark, ("2010", "a", "x"), ("2011", "a", "x"), (None, "a", "x"))
    assert sorted(str(r["year"]) for r in filters.delete_year(p, "2010").collect()) == ["2011", "None"]
    assert [(r["year"], r["section_count"], r["sentence_count"]) for r in index.papers_by_year(p).collect()] == [(None, 1, 1), ("2010", 1, 1), ("2011", 1, 1)]
    assert [(r["year"], r["paper_idx"], r["section"]) for r in index.paper_sections(p).collect()] == [(None, 2, "a"), ("2010", 0, "a"), ("2011", 1, "a")]


def test_detail_of_a_missing_word(spark):
    p = papers(spark, ("2010", "a", "Dogs bark."))
    detail = lambda w: [(r["unit_count"], r["text"]) for r in examples.detail(w, "n", examples.found(p), index.pos_counts(tokens.cells(p))).collect()]
    assert detail("zebra") == [(0, None)] and detail("bark") == [(1, "Dogs bark.")]


def test_vocabulary_example_comes_first(spark):
    p = papers(spark, ("2010", "a", "The dog at night. Dogs bark at night. Dogs bark."))
    told, rows = examples.found(p), senses.sense_rows(senses.attached(index.assembled(tokens.cells(p), p), spark.createDataFrame([], "lemma string, pos string, meaning string, ord int")))
    book = spark.createDataFrame([("dog", ["A dog."]), ("bark", []), ("zebra", ["Z."])], "lemma string, examples array<string>")
    plain = {r["lemma"]: r["text"] for r in examples.top_example(told, rows).collect()}
    given = {r["lemma"]: r["text"] for r in examples.top_example(told, rows, book).collect()}
    assert plain == {"dog": "Dogs bark.", "bark": "Dogs bark.", "night": "The dog at night."} and given == plain | {"dog": "A dog."}


def test_sections(spark):
    said = ["x", "Section I Use of English", "The eco-", "nomy grew.", "", "Section II Reading Comprehension", "Part A", "Prices rose.", "Part B", "Part C", "(46) Markets moved", "on and on.", "", "Part A", "Wages fell."]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(said)] + [("e", 0, "no section")], "doc string, line_no int, line string")
    got = [(r["doc"], r["key"], r["label_en"], r["sentences"]) for r in lines.sections(rows).orderBy("ord").collect()]
    assert got == [
        ("d", "use_of_english", "Use of English", ["The economy grew."]),
        ("d", "reading_a", "Reading Comprehension Part A", ["Prices rose."]),
        ("d", "reading_c", "Reading Comprehension Part C", ["(46) Markets moved on and on."]),
        ("d", "reading_a", "Reading Comprehension Part A", ["Wages fell."]),
    ]


def docx(*paragraphs, table=()):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        body += "<w:tbl>" + "".join(f"<w:tr><w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc></w:tr>" for c in table) + "</w:tbl>" if table else ""
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
    return raw.getvalue()


def test_corpus_build_round_trip(spark, tmp_path):
    (tmp_path / "raw" / "single").mkdir(parents=True)
    first = docx("1995年全国硕士研究生入学统一考试英语（二）试题", "Section I Use of English", "The trade grew fast.", "Section II Reading Comprehension", "Prices rose.", "1996年全国硕士研究生入学统一考试英语试题", "Section III Writing", "Write well.", table=["Part B", "Late text of a table."])
    (tmp_path / "raw" / "a.docx").write_bytes(first)
    (tmp_path / "raw" / "b.docx").write_bytes(docx("1995年硕士研究生英语试题", "Section I Use of English", "It fell later."))
    n = batch.build_papers(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert n == 5  # 1995 is replaced by the later bundle: one section and its meta; 1996: two sections and meta
    meta = json.loads((tmp_path / "out" / "1995" / "meta.json").read_text())
    assert [s["file"] for s in meta["sections"]] == ["01_完形填空.txt"] and meta["source"] == "b.docx" and meta["type"] == "未知"
    got = [(r["paper_idx"], r["year"], r["section"], r["section_label"], r["sentences"]) for r in readers.processed_sections(spark, str(tmp_path / "out")).orderBy("paper_idx").collect()]
    assert got == [
        (0, "1995", "use_of_english", "完形填空", ["It fell later."]),
        (1, "1996", "writing_a", "写作A（应用文）", ["Write well."]),
        (2, "1996", "writing_b", "写作B（大作文）", ["Late text of a table."]),
    ]
    assert set(SECTION_ORDER) >= {r[2] for r in got}
    # The index built from it, with an upload that has no section
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "2020.docx").write_bytes(docx("1. Exports dropped", "sharply that winter.", "中文"))
    read = readers.processed_sections(spark, str(tmp_path / "out"))
    both, rows = batch.after_uploads(read, readers.binary_documents(spark, str(tmp_path / "up")))
    new = both.where("year = '2020'").first()
    assert (new["paper_idx"], new["section"], new["section_label"], new["filename"], new["sentences"]) == (3, "full", "全文", "2020.docx", ["1. Exports dropped sharply that winter. 中文"])
    found = {r["lemma"]: r["frequency"] for r in rows.collect()}
    assert found["export"] if "export" in found else found["exports"] == 0.25


def test_absent_inputs_are_empty(spark, tmp_path):
    no = str(tmp_path / "none")
    assert readers.word_list(spark, no, "cet4").count() == readers.vocabulary(spark, no).count() == readers.dictionary(spark, no).count() == 0
    assert readers.vocabulary_groups(spark, {"basic": no}).count() == readers.processed_sections(spark, no).count() == readers.binary_documents(spark, no).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.dictionary(spark, str(tmp_path / "bad.json")).count() == 0


def test_books_are_apart(spark, tmp_path):
    rows = [("a", 1, 0, "001 core —— 核心"), ("a", 1, 1, "1 abandon v. 放弃"), ("a", 1, 2, "2 ability n. 能力"), ("a", 2, 0, "墨墨背单词 2027墨墨考研深度记忆宝典 全部单词"), ("b", 1, 0, "1 able adj. 能"), ("b", 1, 1, "2 about prep. 关于"), ("b", 143, 0, "1 basis n. 基础"), ("b", 144, 0, "v. 支撑")]
    pages = spark.createDataFrame(rows, "doc string, page int, line_no int, line string")
    got = {(r["doc"], r["lemma"], r["grp"], r["group_idx"]): [tuple(s) for s in r["senses"]] for r in vocab.book(pages, 402).collect()}
    # The last word of a page is lost unless the page is the book's last; a page of skipped lines is one, too.
    assert got == {("a", "abandon", "main", 1): [("v", "放弃")], ("b", "able", "main", 0): [("adj", "能")], ("b", "about", "main", 0): [("prep", "关于")], ("b", "basis", "basic", 0): [("n", "基础"), ("v", "支撑")]}
    report = {r["grp"]: (r["entries"], r["lemmas"]) for r in batch.build_vocabulary(pages, 402, str(tmp_path / "book")).collect()}
    assert report == {"main": (3, 3), "basic": (1, 1)}
    back = readers.vocabulary(spark, str(tmp_path / "book" / "merged"))
    assert back.count() == 0 or {r["lemma"] for r in back.collect()} <= {"abandon", "able", "about", "basis"}


def test_exports(spark, tmp_path):
    p = papers(spark, ("2010", "a", "Dogs bark. Cats sleep."), ("2011", "a", "The dog barked <loud> & \x01"))
    rows = senses.attached(index.assembled(tokens.cells(p), p), spark.createDataFrame([("dog", "n", "狗", 0)], "lemma string, pos string, meaning string, ord int"))
    csv = [tuple(r) for r in serving.csv_export(rows).collect()]
    assert [r[0] for r in csv][:2] == ["dog", "bark"] and csv[0] == ("dog", "dog, dogs", "", "n. 狗 (2次)", 2, 1.0)
    assert [r[0] for r in serving.csv_export(rows, "medium", Settings(high_threshold=0.9)).collect()] == ["cats", "sleep", "loud"]
    sheet = serving.excel_export(rows, examples.found(p))
    assert sheet.columns == ["单词", "总次数", "频率", "释义（按词性）", "真题例句"] and sheet.first()["释义（按词性）"] == "n. 狗 (2)" and sheet.first()["真题例句"] == "[2010·a] Dogs bark."
    assert writers.write_excel(sheet, str(tmp_path / "x.xlsx"), "all频词汇") == len(csv)
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        import xml.etree.ElementTree as ET

        cells = ET.fromstring(z.read("xl/worksheets/sheet1.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")
        assert len(list(cells)) == len(csv) + 1


def test_dictionary_source():
    asked = []

    def source(word):
        asked.append(word)
        if word == "down":
            raise OSError
        return {"run": [("verb", ["go", "move", "flow"]), ("noun", ["race"])]}.get(word)

    d = senses.Dictionary(source, {"old": [{"pos": "n", "meaning": "x"}]})
    want = [{"pos": "verb", "meaning": "go"}, {"pos": "verb", "meaning": "move"}, {"pos": "noun", "meaning": "race"}]
    assert d.lookup("Run") == d.lookup("run") == want and asked == ["run"]
    assert d.lookup("none") == d.lookup("down") == [] and d.lookup("down") == [] and asked == ["run", "none", "down", "down"]
    assert d.lookup("OLD") == [{"pos": "n", "meaning": "x"}]


def test_display(spark):
    df = spark.createDataFrame([("The Cat sat", "cat"), ("none", "cat"), ("x" * 75, ""), (None, "a")], "text string, word string")
    got = [tuple(r) for r in df.select(t.highlighted("text", "word"), t.truncated("text")).collect()]
    assert got == [("The <mark>Cat</mark> sat", "The Cat sat"), ("none", "none"), ("x" * 75, "x" * 70 + "…"), (None, None)]
    assert serving.pages(101, 50) == 3


def test_tokenizers_and_sentences(spark):
    df = spark.createDataFrame([("Don't stop John's well-known dogs, they're e.g. cannot do (fine).",)], "text string")
    assert one(df.select(t.treebank("text").alias("w")), "w") == ["Do", "n't", "stop", "John", "'s", "well-known", "dogs", "they", "'re", "e.g", "can", "not", "do", "fine"]
    df = spark.createDataFrame([("Dr. Smith paid 3.5 dollars, e.g. for J. Doe. He left! Why?",)], "text string")
    assert one(df.select(F.transform(tokens.careful(F.col("text")), lambda x: F.trim(x)).alias("s")), "s") == ["Dr. Smith paid 3.5 dollars, e.g. for J. Doe.", "He left!", "Why?"]
    pages = spark.createDataFrame([(["x", "英语（二）", "英语（一）"],), (["a", "b", "英语一"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in pages.select(t.exam_type_of_pages("p")).collect()] == ["英语二", "未知", "未知", "未知"]


def test_meta_names_the_files(spark):
    got = {r["year"]: json.loads(r["meta"]) for r in writers.meta(fx.frame(spark, fx.SPLIT)).collect()}
    assert [s["file"] for s in got["2010"]["sections"]] == ["01_完形填空.txt", "02_阅读A.txt"] and [s["sentence_count"] for s in got["2010"]["sections"]] == [1, 2]


def test_stored_examples_are_read_by_part(spark, tmp_path):
    p = papers(spark, ("2010", "a", "The dog at night. Dogs bark at night. Dogs bark."), ("2011", "b", "Dogs bark.\nA night of dogs"), ("2011", "b", None))
    told = examples.told(p)
    kept = examples.Stored(spark, str(tmp_path / "s"), parts=8).write(told)
    every = examples.found(p)
    for lemma, pos in ((r["lemma"], r["pos"]) for r in every.select("lemma", "pos").distinct().collect()):
        want = every.where((F.col("lemma") == lemma) & (F.col("pos") == pos))
        assert sorted(map(str, kept.of(lemma, pos).collect())) == sorted(map(str, want.collect()))
    rows = kept.of("dog", "n")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert kept.of("zebra", "n").collect() == []


def test_white_space_is_that_of_unicode(spark):
    every = [chr(c) for c in [*range(1, 0x3001), 0xFEFF] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{c}{c} b") for c in every], "c string, x string")
    got = df.select("c", F.regexp_replace("c", f"^{t.S}$", "") == "", F.regexp_replace("c", r"(?U)^\s$", "") == "", t.spaced(F.col("x")), F.regexp_replace("x", r"(?U) \s+|[\s&&[^ ]]\s*", " ")).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got) and sum(r[1] for r in got) == 25
    words = df.select(t.runs("x").alias("a"), F.regexp_extract_all("x", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("b"))
    assert words.where("a <> b").count() == 0


def test_one_example_and_one_lemma_equal_a_choice_among_all(spark):
    """also where a paper has lines without enough English, odd letters, no number, or comes twice. Only forms of one lemma are broadcast."""
    texts = ["The idiot met idiots. A dog ran!\nidiots 12345 67890 12345 67890 24680", "Idiots 1234567890 1234567890.\nDogs are \u0130diot like. The dog barked."]
    rows = [(1, "y", "a", texts[0]), (2, "y", "b", texts[1]), (2, "y", "b", texts[1]), (3, None, "a", texts[0]), (None, "y", "a", "Dog. " + texts[0]), (4, "z", None, None)]
    p = spark.createDataFrame(rows, "paper_idx long, year string, section string, text string")
    lines = tokens.dealt(p)
    told, words = examples.told(p, rows=lines), tokens.words(lines)
    every = examples.found(p).collect()
    place = lambda r: (r["paper_idx"], r["para_idx"], r["sent_idx"])
    for shortest in (False, True):
        got = {(r["lemma"], r["pos"]): (r["text"], r["year"], r["section"], place(r)) for r in examples.first_of(told, words, shortest).collect()}
        want = {}
        for r in sorted(every, key=lambda r: (len(r["text"]) if shortest else 0, place(r))):
            want.setdefault((r["lemma"], r["pos"]), (r["text"], r["year"], r["section"], place(r)))
        assert got == want and len(got) == 3
    for lemma in ("idiot", "dog", "absent"):
        got = [tuple(r[c] for c in ("text", "word", "year", "section")) + place(r) for r in examples.of_lemma(told, words, lemma, "n").collect()]
        assert sorted(map(str, got)) == sorted(str(tuple(r[c] for c in ("text", "word", "year", "section")) + place(r)) for r in every if (r["lemma"], r["pos"]) == (lemma, "n"))
        count = {r["pos"]: r["pos_count"] for r in index.pos_counts(tokens.of_lemma(words, lemma)).collect()}
        assert count == {r["pos"]: r["pos_count"] for r in index.pos_counts(tokens.cells(p)).where(F.col("lemma") == lemma).collect()}
