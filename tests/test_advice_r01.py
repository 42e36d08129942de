
import json

from glossaria.operators import index, tokens
from glossaria.plans import catalog
from glossaria.sources import readers


def test_every_document_is_in_a_vocabulary_group(spark, tmp_path):
    rows = [(i, f"word{'abcdefghij'[i % 10]} shared" + (" extra" if i >= 50 else "")) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["grp"]: r["n"] for r in catalog.QUERIES["q42_group_sizes"](spark, str(tmp_path)).collect()}
    assert got == {f"g{g}": 3 for g in range(50)}


def test_tokens_have_suffix_lemmas(spark):
    said = ["They jumped far. Jumping helps.", "I jump; policies altered.", "Policy. He flew.", "Alter unmatched boxing"]
    papers = spark.createDataFrame([(i, f"y{i}", "s", x) for i, x in enumerate(said)], "paper_idx int, year string, section string, text string")
    tok = tokens.tokens(papers)
    lemma = {r["word"].lower(): r["lemma"] for r in tok.collect()}
    assert {k: lemma[k] for k in ("jumped", "jumping", "jump", "policies", "policy", "altered", "flew", "unmatched", "boxing")} == {
        "jumped": "jump", "jumping": "jump", "jump": "jump", "policies": "policy", "policy": "policy", "altered": "alter", "flew": "fly", "unmatched": "unmatched", "boxing": "boxing"
    }
    assert {r["lemma"]: r["units"] for r in index.frequency(tok, papers).collect()}["jump"] == 2
    assert {r["lemma"]: list(r["variants"]) for r in index.variants(tok).collect()}["jump"] == ["jump", "jumped", "jumping"]
    assert tok.count() == tokens.tokens(papers, suffixes=False).count()


def test_index_build_cleans(spark):
    text = "Directions: The trade grew fast.\nPart B\nParticipants in the study slept.\n21. What does it imply?\n[A] first option"
    papers = spark.createDataFrame([(0, "y", "s", text)], "paper_idx int, year string, section string, text string")
    tok, told = tokens.build(papers)
    assert {r["word"] for r in tok.collect()} == {"trade", "fast"}
    assert [(r["line_no"], r["text"]) for r in told.collect()] == [(0, "The trade grew fast.")]


def test_processed_sections_feed_the_index(spark, tmp_path):
    for year, said in (("2011", "Exports fell."), ("2010", "Choose the best answer. (10 points) Participants in the long study slept well.\n\nTrade grew fast.")):
        (tmp_path / year).mkdir()
        part = {"key": "reading_a", "label": "A", "label_en": "A", "file": "02.txt", "sentence_count": 1}
        (tmp_path / year / "meta.json").write_text(json.dumps({"year": year, "type": "x", "source": "a.pdf", "sections": [part]}))
        (tmp_path / year / "02.txt").write_text(said)
    tok, told = tokens.build(readers.processed_sections(spark, str(tmp_path)))
    assert sorted((r["paper_idx"], r["word"]) for r in tok.collect()) == [(0, "Trade"), (0, "fast"), (1, "Exports")]
    assert sorted((r["paper_idx"], r["text"]) for r in told.collect()) == [(0, "Trade grew fast."), (1, "Exports fell.")]
