"""Tables that are read in part, the section sink and look-ups within a plan."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from glossaria.operators import senses, serving, stored
from glossaria.sources import readers, writers

INDEX = "lemma string, variants array<string>, units int, frequency double, first_seen int"


def index(spark, n=230):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(3 * n)})[:n]
    return spark.createDataFrame([(w, [w, w + "ing"][: rng.randint(1, 2)], 1, rng.choice([0.1, 0.2, 0.5]), i) for i, w in enumerate(words)], INDEX)


@pytest.mark.parametrize("sort,order", [("frequency", "desc"), ("frequency", "asc"), ("lemma", "desc"), ("lemma", "asc")])
def test_stored_pages_equal_the_sort(spark, tmp_path, sort, order):
    rows = index(spark)
    kept = stored.Ranked(spark, str(tmp_path / "r")).write(rows, sort, order, ranges=5)
    for number, size in ((1, 10), (3, 50), (5, 50), (9, 50)):
        got = kept.page(number, size)
        assert [r["lemma"] for r in got.collect()] == [r["lemma"] for r in serving.page(rows, sort, order, number, size).collect()]
        assert len(got.inputFiles()) >= 0
    held = [r["part"] for r in spark.read.parquet(f"{kept.path}/rows").where("rank between 20 and 29").select("part").distinct().collect()]
    plan = kept.page(3, 10)._jdf.queryExecution().executedPlan().toString()
    assert len(held) <= 2 and "PartitionFilters: [part" in plan.replace("PartitionFilters: [isnotnull(part", "PartitionFilters: [part")
    with pytest.raises(ValueError):
        kept.page(0)


def test_trigram_search_equals_the_scan(spark, tmp_path):
    rows = index(spark)
    kept = stored.Trigrams(spark, str(tmp_path / "t"), parts=8).write(rows)
    for needle in ("abc", "ABC", "ing", "aing", "a", "", "zzz", "%", "bcd", "abcabc", "caba"):
        assert sorted(r["lemma"] for r in kept.search(needle).collect()) == sorted(r["lemma"] for r in serving.search(rows, needle).collect()), needle
    plan = kept.search("abcd")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan


def test_section_files_appear_at_the_commit(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame(
        [(f"{2000 + y}", k, k, k, "s", y, ["One thing grew fast.", "Another fell."]) for y in range(30) for k in ("reading_a", "writing_a", "no_section")],
        "year string, key string, label string, label_en string, source string, ord int, sentences array<string>",
    )
    assert writers.write_sections(rows, out) == 30 * 3
    assert not [x for x in os.listdir(out) if x.startswith("_staged")]
    back = readers.processed_sections(spark, out).collect()
    assert len(back) == 60 and {tuple(r["sentences"]) for r in back} == {("One thing grew fast.", "Another fell.")}
    assert json.load(open(f"{out}/2003/meta.json"))["sections"][0]["key"] == "reading_a"
    broken = F.when(F.col("year") == "2007", F.raise_error(F.lit("lost"))).otherwise(F.col("label"))
    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="lost"):
        writers.write_sections(rows.withColumn("label", broken), other)
    assert not [x for d, _, names in os.walk(other) for x in names if x.endswith((".txt", ".json"))] and not [d for d, _, _ in os.walk(other) if "_staged" in d]
    assert writers.write_sections(rows.limit(0), str(tmp_path / "none")) == 0


def test_uploads_are_numbered_in_order(spark):
    pages = spark.createDataFrame([(f"/u/{n}.docx", 1, "The economy of most countries grew fast. It fell.") for n in ("b2011", "a2010", "c")], "path string, page int, text string")
    got = {r["filename"]: r["paper_idx"] for r in readers.uploaded(pages, 5).collect()}
    assert got == {"a2010.docx": 5, "b2011.docx": 6, "c.docx": 7}


def test_each_word_is_asked_for_once(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    os.mkdir(log)

    def source(word):
        open(f"{log}/{word}-{time.time_ns()}-{random.random()}", "w").close()
        if word == "fails":
            raise OSError
        if word == "slow":
            time.sleep(20)
        return None if word == "unknown" else [("noun", [word.upper(), "b", "c"]), ("verb", ["d"])]

    def append(rows):
        writers.write_dictionary(rows, cache)
        return spark.read.schema("lemma string, pos string, meaning string, ord int").parquet(cache)

    known = spark.createDataFrame([("Known", "n", "x", 0)], "lemma string, pos string, meaning string, ord int")
    words = spark.createDataFrame([(w,) for w in ["Run", "run", "fails", "unknown", "slow", "known", None, "go"] * 5], "lemma string")
    begun = time.time()
    got = senses.resolved(words, known, append, source, tasks=2, at_once=3, seconds=2.0)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted([("known", "n", "x", 0)] + [(w, *x) for w in ("run", "go") for x in (("noun", w.upper(), 0), ("noun", "b", 1), ("verb", "d", 2))])
    asked = [x.split("-")[0] for x in os.listdir(log)]
    assert sorted(asked) == ["fails", "go", "run", "slow", "unknown"]
    both = known.unionByName(spark.read.schema(known.schema).parquet(cache))
    again = senses.looked_up(words.join(both.select(F.lower("lemma").alias("lemma")), "lemma", "left_anti").where("lemma = 'unknown'"), source)
    assert again.collect() == [] and len(os.listdir(log)) == 6  # a word without an answer is asked for again
    assert time.time() - begun < 120
