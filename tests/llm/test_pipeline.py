"""The corpus pipeline against a plain version of each stage on a small corpus."""

import os
import random
import re

import pytest

pytest.importorskip("glossaria.llm")
import corpus_pipeline
from glossaria.llm.quality_classifier import CoTraining

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no model file")
def test_pipeline(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = []
    for i in range(160):
        text = make(60)
        if i % 8 == 0:
            text = " ".join(x + "$$$" for x in text.split())
        if i % 20 == 3:
            text = rows[i - 1][1] + " end"
        if i % 20 == 7:
            text = make(8) + " " + "same old words " * 30
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "too short", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {r["doc_id"] for r in CoTraining().score(docs, labels).collect() if r["kept"]}
    assert {i for i in range(160) if i % 8 > 0 and i % 20 != 7} <= kept

    def passes(text):
        w = WORD.findall(text)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    left = [r for r in rows if r[0] in kept and passes(r[1])]
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in left for w in [WORD.findall(r[1])]}
    single = [r for r in left if not any(o < r[0] and 100 * len(s & sets[r[0]]) >= 80 * len(s | sets[r[0]]) for o, s in sets.items())]
    total = {s: sum(len(WORD.findall(r[1])) for r in single if r[3] == s) for s in ("s0", "s1", "s2")}
    lib = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    text = {r[0]: r for r in single}
    assert {r["doc_id"] for r in got} <= set(text)
    assert all(r["ids"] == lib.encode(text[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"]) for r in got)
    weights = {"s0": 5, "s1": 2, "s2": 1}
    for s, w in weights.items():  # no source reaches three times its size here
        words = sum(len(WORD.findall(text[r["doc_id"]][1])) for r in got if r["source"] == s)
        assert abs(words - sum(total.values()) * w / 8) <= 130
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_join", "source_mix", "sentencepiece"]
    assert list(corpus_pipeline.classify(spark, docs, str(tmp_path)).columns) == docs.columns


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no model file")
def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables give an empty result; repeated rows, clashing columns and a null doc_id pass through the stages."""
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, copies int, rep long, __row string"
    rows = [(i, x, "en", f"s{i % 2}", len(x), "i", 1, 2, "r") for i in range(40) for x in [make(40)]]
    rows += [rows[3], rows[3], (None, make(40), None, None, None, None, None, None, None)]
    labels = "doc_id long, quality int, toxic int"
    for name, docs, said in (("empty", [], []), ("odd", rows, [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(said, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r["doc_id"] for r in got]
    assert got and all(ids.count(i) <= 3 for i in set(ids)) and all(r["n_tokens"] == len(r["ids"]) for r in got)
