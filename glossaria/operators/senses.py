"""Dictionary senses of lemmas: matched by part of speech, or a fallback row for each part of speech."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matched(pos_counts: DataFrame, senses: DataFrame) -> DataFrame:
    """lemma, pos, meaning, pos_count, ord of senses whose part of speech occurs. senses(lemma, pos, meaning, ord)."""
    return senses.join(pos_counts, ["lemma", "pos"]).select("lemma", "pos", "meaning", "pos_count", "ord")


def with_fallback(pos_counts: DataFrame, senses: DataFrame) -> DataFrame:
    """Matched senses; a lemma without any has one row a part of speech, in code-point order, with an empty meaning."""
    hit = matched(pos_counts, senses)
    rest = pos_counts.join(hit.select("lemma").distinct(), "lemma", "left_anti")
    place = F.row_number().over(W.partitionBy("lemma").orderBy("pos")) - 1
    return hit.unionByName(rest.select("lemma", "pos", F.lit("").alias("meaning"), "pos_count", place.alias("ord")))


def attached(index: DataFrame, senses: DataFrame) -> DataFrame:
    """An assembled index with the array `senses` (ord, pos, meaning, pos_count): with_fallback() by one join, within each row."""
    book = senses.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "meaning"))).alias("__book"))
    told = lambda s: F.struct(s["ord"].alias("ord"), s["pos"].alias("pos"), s["meaning"].alias("meaning"), F.element_at("pos_counts", s["pos"]).alias("pos_count"))
    found = F.filter(F.transform(F.coalesce("__book", F.array().cast("array<struct<ord:int,pos:string,meaning:string>>")), told), lambda s: s["pos_count"].isNotNull())
    parts = F.array_sort(F.map_entries("pos_counts"))
    bare = F.transform(parts, lambda e, i: F.struct(i.alias("ord"), e["key"].alias("pos"), F.lit("").alias("meaning"), e["value"].alias("pos_count")))
    out = index.join(book, "lemma", "left").withColumn("__found", found)
    return out.withColumn("senses", F.when(F.size("__found") > 0, F.col("__found")).otherwise(bare)).drop("__book", "__found")


def sense_rows(index: DataFrame) -> DataFrame:
    """lemma, pos, meaning, pos_count, ord of an index with senses."""
    return index.select("lemma", F.explode("senses").alias("s")).select("lemma", "s.pos", "s.meaning", "s.pos_count", "s.ord")


def lookup(word: str, index: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lemma, source, units, meaning of one word: from the index, else from the dictionary with 0 units. The index knows exact words only."""
    hit = index.where(F.col("lemma") == word).select("lemma", F.lit("index").alias("source"), F.col("units").cast("long").alias("units"), F.lit("").alias("meaning"))
    other = dictionary.where(F.lower("lemma") == word.lower()).select("lemma", F.lit("dictionary").alias("source"), F.lit(0).cast("long").alias("units"), "meaning")
    return hit.unionByName(other.where(~hit.exists()))


def looked_up(words: DataFrame, source: Callable[[str], list[tuple[str, list[str]]] | None], tasks: int = 8, at_once: int = 8, seconds: float = 5.0) -> DataFrame:
    """lemma, pos, meaning, ord of what a source outside of Spark says of distinct words(lemma): each is asked for once, in lower case.

    `tasks` partitions ask `at_once` words at a time each. A word whose answer fails, or takes longer than `seconds`, has no rows; neither has one that
    the source doesn't know. Two definitions a part of speech are kept.
    """

    def ask(batches):
        schema = pa.schema([("lemma", pa.string()), ("pos", pa.string()), ("meaning", pa.string()), ("ord", pa.int32())])
        pool = ThreadPoolExecutor(at_once)
        try:
            for batch in batches:
                asked = batch.column(0).to_pylist()
                for k in range(0, len(asked), at_once):
                    part = [(w, pool.submit(source, w)) for w in asked[k : k + at_once]]
                    until, rows = time.monotonic() + seconds, []
                    for w, answer in part:
                        try:
                            found = answer.result(max(0.0, until - time.monotonic())) or []
                        except Exception:  # a source may fail in any way; a miss is no error of the query
                            found = []
                            if not answer.done():  # a stuck call keeps its thread, so the words after it get threads of their own
                                pool.shutdown(wait=False, cancel_futures=False)
                                pool = ThreadPoolExecutor(at_once)
                        said = [(pos, d) for pos, defs in found for d in defs[: Dictionary.DEFINITIONS]]
                        rows += [{"lemma": w, "pos": pos, "meaning": d, "ord": i} for i, (pos, d) in enumerate(said)]
                    yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    asked = words.where("lemma is not null").select(F.lower("lemma").alias("lemma")).distinct().repartition(tasks, "lemma")
    return asked.mapInArrow(ask, "lemma string, pos string, meaning string, ord int")


def resolved(words: DataFrame, cache: DataFrame, append: Callable[[DataFrame], DataFrame], source, **limits) -> DataFrame:
    """lemma, pos, meaning, ord of words(lemma): from the cache, else from the source. What is found is given to `append`, which keeps it and returns it to be
    read, so no word is asked for twice; misses and failures are not kept."""
    words = words.select(F.lower("lemma").alias("lemma")).distinct()
    known = cache.withColumn("lemma", F.lower("lemma"))
    new = append(looked_up(words.join(known.select("lemma").distinct(), "lemma", "left_anti"), source, **limits))
    return known.join(words, "lemma", "left_semi").select("lemma", "pos", "meaning", "ord").unionByName(new)


class Dictionary:
    """A cache of look-ups before a source outside of Spark, which the caller gives: word -> [(part of speech, [definitions])], or None if it fails.

    Two definitions a part of speech are kept. Only words that the source knows are cached; failures give nothing and are asked for again.
    """

    DEFINITIONS = 2

    def __init__(self, source: Callable[[str], list[tuple[str, list[str]]] | None], cache: dict[str, list[dict]] | None = None):
        self.source, self.cache = source, dict(cache or {})

    def lookup(self, word: str) -> list[dict]:
        key = word.lower()
        if key not in self.cache:
            try:
                found = self.source(key)
            except Exception:  # a source may fail in any way; a miss is no error of the query
                found = None
            if found is None:
                return []
            self.cache[key] = [{"pos": pos, "meaning": d} for pos, defs in found for d in defs[: self.DEFINITIONS]]
        return self.cache[key]

    def table(self, spark) -> DataFrame:
        """lemma, pos, meaning, ord of all that is cached."""
        rows = [(w, s["pos"], s["meaning"], i) for w, senses in self.cache.items() for i, s in enumerate(senses)]
        return spark.createDataFrame(rows, "lemma string, pos string, meaning string, ord int")
