"""A changing index equals one built from the papers that are left, whatever came before."""

import random

import pytest
from pyspark.sql import functions as F

from glossaria.operators import filters, index, tokens
from glossaria.sources import folders
from glossaria.streaming.incremental import IndexStore, follow

SCHEMA = "paper_idx int, year string, section string, text string, enabled boolean"
WORDS = "study studies studied dog dogs happy happily run running planned plan rivers The of water words banks".split()


def batch(rng, start, n):
    years, sections = ["2010", "2011", "2012", None], ["a", "b", None]
    return [(start + i, rng.choice(years), rng.choice(sections), " ".join(rng.choices(WORDS, k=rng.randint(0, 9))), True) for i in range(n)]


def shown(df):
    cols = [c for c in df.columns if c != "pos_counts"]
    rows = df.select(*cols, F.array_sort(F.map_entries("pos_counts")).alias("p")).collect()
    return sorted(map(str, rows))


def rebuilt(spark, papers):
    df = spark.createDataFrame(papers, SCHEMA)
    return shown(index.assembled(tokens.cells(tokens.active(df)), tokens.active(df)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng, papers, n = random.Random(seed), [], 0
    store = IndexStore(spark, str(tmp_path / "store"))
    assert store.index().collect() == []
    for step in range(7):
        kind = rng.choice(["append", "append", "delete", "toggle", "compact"]) if step else "append"
        if kind == "append":
            new = batch(rng, n, 6)
            n += 6
            papers += new
            assert store.append(spark.createDataFrame(new, SCHEMA), f"b{step}")
            assert not store.append(spark.createDataFrame(new, SCHEMA), f"b{step}")  # taken once
        elif kind == "delete":
            year = rng.choice(["2010", "2011"])
            papers = [p for p in papers if p[1] != year]
            store.delete_year(year)
        elif kind == "toggle":
            year, section, on = rng.choice(["2010", "2012"]), rng.choice(["a", "b", None]), rng.random() < 0.4
            papers = [(*p[:4], on) if p[1] == year and (section is None or p[2] == section) else p for p in papers]
            store.toggle(year, section, on)
        else:
            store.compact()
            assert len(store.steps()) == 1
        if step in (2, 4, 6):
            assert shown(store.index()) == rebuilt(spark, papers), (step, kind)


def test_a_failed_step_leaves_nothing_and_a_restart_repeats_nothing(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "store"))
    rng = random.Random(5)
    first, second = batch(rng, 0, 5), batch(rng, 5, 5)
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not k:
            monkeypatch.setattr(folders, "mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(Exception, match="lost"):
                follow(store, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp")).awaitTermination()
            assert store.steps() == [] and store.index().collect() == []
            monkeypatch.undo()
        follow(store, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp")).awaitTermination()
        assert shown(IndexStore(spark, store.path).index()) == rebuilt(spark, first + (second if k else []))
    follow(store, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp")).awaitTermination()
    assert [name for _, name in store.steps()] == ["stream0", "stream1"]


def test_bitmaps_equal_sets_of_units(spark):
    rng = random.Random(8)
    papers = [(i, f"y{rng.randint(0, 40)}", f"s{rng.randint(0, 6)}", " ".join(rng.choices(WORDS, k=4)), True) for i in range(600)]
    df = spark.createDataFrame(papers, SCHEMA)
    tok, cells = tokens.tokens(df, clean=True), tokens.cells(df)
    key = lambda x: sorted(map(str, x.collect()))
    assert key(index.pos_counts(tok)) == key(index.pos_counts(cells)) and key(index.frequency(tok, df)) == key(index.frequency(cells, df))
    assert shown(index.assembled(tok, df)) == shown(index.assembled(cells, df))
    assert cells.select("w").distinct().count() > 3  # several longs
    for kept in (filters.delete_year(df, "y3"), tokens.active(tokens.toggle(df, "y1", "s2", False)), df.limit(0)):
        assert key(index.without_units(tokens.word_bits(df), df, kept)) == key(index.frequency(tokens.tokens(kept, clean=True), kept))


def test_an_index_reads_its_texts_once(spark, tmp_path):
    rng = random.Random(9)
    spark.createDataFrame(batch(rng, 0, 50), SCHEMA).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for rows in (index.frequency(tokens.cells(df), df), index.assembled(tokens.cells(df), df)):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and "collect_list(struct(year" not in plan
        assert sum("ReadSchema: struct<" in x and "text" in x for x in final.splitlines()) <= 1
