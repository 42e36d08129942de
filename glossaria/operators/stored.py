"""An index as tables that are read in part: a stored order for deep pages, and trigrams for searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import serving as sv


class Ranked:
    """Rows in an order, in ranges of ranks: page k reads the range or two that hold it, and sorts nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, index: DataFrame, sort: str = "frequency", order: str = "desc", ranges: int | None = None) -> Ranked:
        """Rows are range-partitioned by the order once; a row's rank is its place in its range and the sizes of those before."""
        keys = sv.keys(sort, order)
        n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        index.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{self.path}/ranges")
        rows = self.spark.read.parquet(f"{self.path}/ranges")
        before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
        rows.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", before.alias("first")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/offsets")
        rank = F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1 + F.col("first")
        ranked = rows.join(self.spark.read.parquet(f"{self.path}/offsets").drop("n"), "part").withColumn("rank", rank).drop("first")
        ranked.write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/rows")
        return self

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """A page of serving.page, in order."""
        sv.check_page(number, size)
        a = (number - 1) * size
        held = self.spark.read.parquet(f"{self.path}/offsets").where((F.col("first") < a + size) & (F.col("first") + F.col("n") > a))
        parts = [r["part"] for r in held.select("part").collect()]  # at most as many as a page has rows
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("part").isin(parts) & F.col("rank").between(a, a + size - 1))
        return rows.orderBy("rank").drop("part", "rank")


class Trigrams:
    """(three letters, lemma) of lemmas and variants, parted by the letters: a search reads the parts of its own trigrams, and checks what they name once."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def write(self, index: DataFrame) -> Trigrams:
        """index(lemma, variants, ...)."""
        index.write.mode("overwrite").parquet(f"{self.path}/index")
        index = self.spark.read.parquet(f"{self.path}/index")
        forms = index.select("lemma", F.explode(F.array_distinct(F.concat(F.array("lemma"), "variants"))).alias("form")).where("length(form) >= 3")
        tri = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("form") - 2), lambda i: F.substring(F.col("form"), i, F.lit(3))))
        rows = forms.select("lemma", F.explode(tri).alias("tri")).distinct().withColumn("part", self._part("tri"))
        rows.repartition("part").sortWithinPartitions("part", "tri").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/trigrams")
        return self

    def search(self, text: str) -> DataFrame:
        """Rows of serving.search. Fewer than three characters have no trigram: the index is read whole then."""
        index = self.spark.read.parquet(f"{self.path}/index")
        needle = text.lower()
        if len(needle) < 3:
            return sv.search(index, text)
        asked = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        parts = [self._part(F.lit(x)) for x in asked]
        rows = self.spark.read.parquet(f"{self.path}/trigrams").where(F.col("part").isin(*parts) & F.col("tri").isin(asked))
        hits = rows.groupBy("lemma").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("lemma")
        return sv.search(index.join(hits, "lemma", "left_semi"), text)
