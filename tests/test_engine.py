"""Hand-derived cases of the operators, and what must hold of any index."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaria.functions import textops as t
from glossaria.operators import examples, filters, index, lines, senses, serving, tokens
from glossaria.plans import fixtures as fx
from glossaria.sources import readers, writers

TAGGED = "paper_idx int, year string, section string, line_no int, tok_idx int, word string, lemma string, pos string"


def texts(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_cleaner_gates(spark):
    got = dict(texts(fx.frame(spark, fx.PARAGRAPHS).select("id", t.clean_paragraph("text").alias("x")), "id", "x"))
    want = {1: "The economy grew.", 3: "The economy grew fast.", 7: "The economy of most countries grew quickly last year.", 10: "The rate fell sharply.",
            13: "He is a good man.", 18: "经济增长率中文很多文字 abc", 19: "Participants in the long study slept well."}
    assert {k: v for k, v in got.items() if v is not None} == want


def test_cleaner_is_not_idempotent(spark):
    df = fx.frame(spark, fx.PARAGRAPHS).where("id = 19").select(t.clean_passes("text", 2).alias("x"))
    assert df.first()["x"] is None


def test_hyphens(spark):
    got = dict(texts(fx.frame(spark, fx.HYPHENS).select("id", t.rejoin_hyphenated("text").alias("x")), "id", "x"))
    assert got == {1: "airports", 2: "airports", 3: "theword\nnext", 4: "The\nWord\nnext"}


def test_section_keys(spark):
    got = {r["line"]: r["key"] for r in lines.section_keys(fx.frame(spark, fx.SECTIONS)).collect()}
    assert got == {"c1": "use_of_english", "w1": "writing_a", "w2": "writing_b", "t1": "reading_c", "r1": "reading_b", "PART A": "reading_b", "r2": "reading_b", "x1": "writing_a"}


def tagged(spark):
    rows = [(0, "2010", "a", 0, 0, "Studies", "study", "n"), (0, "2010", "a", 0, 1, "studied", "study", "v"), (1, "2010", "b", 0, 0, "study", "study", "n"), (1, "2010", "b", 0, 1, "study", "study", "n"), (2, "2011", "a", 0, 0, "policy", "policy", "n")]
    papers = spark.createDataFrame([(0, "2010", "a"), (1, "2010", "b"), (2, "2011", "a"), (3, "2011", "b")], "paper_idx int, year string, section string")
    return spark.createDataFrame(rows, TAGGED), papers


def test_frequency(spark):
    tok, papers = tagged(spark)
    again = tok.unionByName(tok.where("paper_idx = 1"))
    for rows in (tok, again):
        got = {r["lemma"]: (r["units"], r["frequency"]) for r in index.frequency(rows, papers).collect()}
        assert got == {"study": (2, 0.5), "policy": (1, 0.25)}
        assert dict(texts(index.count_sums(rows), "lemma", "count_sum")) == {"study": 3, "policy": 1}
    assert dict(texts(index.variants(tok), "lemma", "variants"))["study"] == ["studied", "studies", "study"]
    less = papers.where("not (year = '2011' and section = 'b')")
    assert {r["lemma"]: r["frequency"] for r in index.frequency(tok, less).collect()} == {"study": 2 / 3, "policy": 1 / 3}


def test_level_differences(spark):
    lists = spark.createDataFrame([(n, w) for n, ws in (("primary", "a"), ("zhongkao", "ab"), ("gaokao", "abc"), ("cet4", "bcd")) for w in ws], "level string, word string")
    get = lambda *levels: {r["word"] for r in filters.level_words(lists, levels).collect()}
    assert (get("primary"), get("zhongkao"), get("gaokao"), get("cet4"), get("primary", "cet4"), get()) == ({"a"}, {"a", "b"}, {"c"}, {"d"}, {"a", "d"}, set())


def test_orders(spark):
    rows = spark.createDataFrame([("B", 0.5, 1), ("A", 0.5, 2), ("C", 0.7, 3)], "lemma string, frequency double, first_seen int")
    get = lambda *a: [r["lemma"] for r in serving.page(rows, *a, size=10).collect()]
    assert (get("frequency", "desc"), get("frequency", "asc"), get("lemma", "desc"), get("lemma", "asc")) == (["C", "B", "A"], ["B", "A", "C"], ["A", "B", "C"], ["C", "B", "A"])
    with pytest.raises(ValueError):
        serving.page(rows, size=5)


def test_senses(spark):
    counts = spark.createDataFrame([("x", "n", 2), ("x", "v", 1), ("x", "det", 1)], "lemma string, pos string, pos_count long")
    book = lambda rows: spark.createDataFrame(rows, "lemma string, pos string, meaning string, ord int")
    got = texts(senses.with_fallback(counts, book([("x", "n", "研究", 0), ("x", "v", "学习", 1), ("x", "art", "x", 2)])).orderBy("ord"), "pos", "meaning", "pos_count")
    assert got == [("n", "研究", 2), ("v", "学习", 1)]
    got = texts(senses.with_fallback(counts, book([("x", "art", "x", 0)])).orderBy("ord"), "pos", "meaning", "pos_count")
    assert got == [("det", "", 1), ("n", "", 2), ("v", "", 1)]


def test_examples_match_whole_words(spark):
    tok = spark.createDataFrame([(0, "y", "s", 0, 0, "art", "art", "n"), (0, "y", "s", 0, 1, "state", "state", "n")], TAGGED)
    papers = spark.createDataFrame([(0, "y", "s", "Part of it is art. State-of-the-art tools."), (1, "y2", "s", "Part of it is art.")], "paper_idx int, year string, section string, text string")
    got = set(texts(examples.examples(tok, tokens.sentences(papers)), "lemma", "text"))
    assert got == {("art", "Part of it is art."), ("art", "State-of-the-art tools."), ("state", "State-of-the-art tools.")}


def test_index_invariants(spark):
    papers = spark.createDataFrame([(i, f"y{i % 3}", f"s{i % 2}", f"the cats ran quickly over lazy dogs {i} happy\nword{i} cats") for i in range(7)], "paper_idx int, year string, section string, text string")
    tok = tokens.tokens(papers)
    rows = index.bands(index.frequency(tok, papers)).collect()
    assert all(0 <= r["frequency"] <= 1 for r in rows)
    counts = dict(texts(index.band_counts(index.frequency(tok, papers)), "band", "n"))
    assert sum(counts.values()) == len(rows)
    top = {r["lemma"]: r["m"] for r in index.pos_counts(tok).groupBy("lemma").agg(F.max("pos_count").alias("m")).collect()}
    sums = dict(texts(index.count_sums(tok), "lemma", "count_sum"))
    assert all(top[r["lemma"]] <= r["units"] <= sums[r["lemma"]] for r in rows)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Apple \n\napple\nPear\n")
    assert {r["word"] for r in readers.word_list(spark, str(tmp_path / "list.txt"), "cet4").collect()} == {"apple", "pear"}
    (tmp_path / "cache.json").write_text(json.dumps({"Run": [{"pos": "verb", "meaning": "go fast"}]}))
    assert texts(readers.dictionary(spark, str(tmp_path / "cache.json")), "lemma", "pos", "meaning", "ord") == [("run", "verb", "go fast", 0)]
    (tmp_path / "vocab.json").write_text(json.dumps([{"lemma": "run", "group": "main", "group_idx": 1, "group_title": "t", "senses": [{"pos": "v", "meaning": "跑 He ran"}, {"pos": "v", "meaning": "跑"}], "examples_en": []}]))
    assert [len(r["senses"]) for r in readers.vocabulary(spark, str(tmp_path / "vocab.json")).collect()] == [1]
    writers.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>")
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "2010.docx").write_bytes(raw.getvalue())
    assert readers.docx_text(raw.getvalue()) == "One & two"
    assert texts(readers.lines_of(readers.binary_documents(spark, str(tmp_path / "doc"))), "line") == [("One & two",)]
    assert texts(readers.lines_of(readers.binary_documents(spark, str(tmp_path / "doc"), tables=True)), "line") == [("One & two",), ("cell",)]
    year = tmp_path / "done" / "2010"
    year.mkdir(parents=True)
    (year / "meta.json").write_text(json.dumps({"year": "2010", "type": "x", "source": "a.pdf", "sections": [{"key": "reading_a", "label": "A", "label_en": "A", "file": "02.txt", "sentence_count": 1}, {"key": "gone", "label": "", "label_en": "", "file": "no.txt", "sentence_count": 0}]}))
    (year / "02.txt").write_text("The trade grew fast.\n\nPart B\n\nIt fell.")
    assert texts(readers.processed_sections(spark, str(tmp_path / "done")), "year", "section", "sentences") == [("2010", "reading_a", ["The trade grew fast.", "It fell."])]


def test_streamed_uploads(spark, tmp_path):
    from glossaria.streaming import uploads

    schema = "paper_idx int, year string, section string, text string, enabled boolean"
    spark.createDataFrame([(1, "2010", "a", "The trade grew", True)], schema).write.parquet(str(tmp_path / "in"))
    uploads.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["lemma"]: r["frequency"] for r in uploads.indexed(spark, str(tmp_path / "out")).collect()} == {"trade": 1.0}  # "grew" is a stop word by its lemma
