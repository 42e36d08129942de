"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source is shuffled by a seeded hash and gets a virtual finish time: the words
of its source queued up to and including it, divided by the source's target. A source whose target
exceeds its size is queued again, up to `cap` times. All queue entries are range-sorted by finish time
and the sorted queue is cut where the total budget is used up.

Scale: only light rows (keys, sizes, finish times) are sorted, never texts. Running sums are two-level:
a source's documents fall into bins by the leading bits of their hash, bin totals are summed over a small
window, and one window per (source, bin) keeps the order, so a source holding a third of all rows is as many
partitions as any other rows. The number of bins has no influence on the result, as bins follow the order of the
hash. The range sort gives every partition a span of finish times; partition totals tell in which
one the budget ends, and only there a running sum is needed. As a source's finish times rise with the hash, the
cut is, for each source and round, the last hash taken: a table of one row a source, by which every row of the
documents is judged where it lies.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, last in
order; rows that share doc_id, source and text are one entry of the queue, so they are taken alike, other columns
may differ; documents of one hash are queued by doc_id, then text hash; an empty table gives an empty result; other columns
are ignored, `apply` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, word_count

#: Entries a range of finish times holds, about; more ranges than shuffle partitions only where these are fewer.
_RANGE = 1 << 20


class FairMix:
    """weights repeat over the sources in code-point order; targets stop at `cap` times a source's size."""

    def __init__(self, weights=(5, 2, 1), cap: int = 3, seed: int = 20240607, rows_per_bin: int = 256):
        self.weights, self.cap, self.seed, self.rows_per_bin = tuple(weights), cap, seed, rows_per_bin

    def targets(self, sources: DataFrame) -> DataFrame:
        """sources(key, source, source_size) -> adds rank, target. One row a source.

        Water level: with sources ordered by cap / weight, the level is the first at which the
        words left over the weights left do not reach the next cap.
        """
        n = len(self.weights)
        ordered = W.orderBy(F.col("source").asc_nulls_last())
        w = F.element_at(F.array(*[F.lit(float(x)) for x in self.weights]), ((F.col("rank") - 1) % n + 1).cast("int"))
        s = sources.withColumn("rank", F.row_number().over(ordered)).withColumn("w", w)
        by = W.orderBy("ratio", "rank")
        all_ = W.partitionBy()
        s = s.withColumn("limit", self.cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("w"))
        s = (
            s.withColumn("total", F.sum("source_size").over(all_).cast("double"))
            .withColumn("before", F.coalesce(F.sum("limit").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("left", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
            .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        )
        first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_)
        s = s.withColumn("water", F.coalesce(first["level"], F.lit(float("inf"))))
        return s.select("key", "source", "source_size", "rank", F.least("limit", F.col("w") * F.col("water")).alias("target"))

    def sizes(self, docs: DataFrame, *columns: str) -> DataFrame:
        """doc_id, size and the place in the queue: source `key`, hash `u`, then `at`; `columns` are kept. No shuffle."""
        tie = F.xxhash64(F.col("text"), F.col("source"), F.col("doc_id"))
        place = F.struct(
            F.xxhash64(F.lit(self.seed), F.col("doc_id"), tie).alias("u"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), tie.alias("tie")
        )
        key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
        return docs.select("doc_id", "source", key.alias("key"), word_count("text").alias("size"), place.alias("at"), *columns)

    def queue(self, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of sizes(): (entries of one round with key, at, words, cum, rank, target, source_size; sources with their targets)."""
        rows = base.count()
        bits = 4
        while (self.rows_per_bin << bits) < rows and bits < 20:
            bits += 1
        items = base.groupBy("key", "at").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
        items = durable(items.withColumn("bin", F.shiftright(F.col("at.u"), 64 - bits)), "mix-items")
        cells = items.groupBy("key", "bin").agg(F.sum("words").alias("cell"), F.first("source").alias("source"))
        sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("cell").alias("source_size"))
        sources = durable(self.targets(sources), "mix-sources")
        before = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.select("key", "bin", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("offset"))
        within = W.partitionBy("key", "bin").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
        out = (
            items.where("words > 0")
            .withColumn("run", F.sum("words").over(within))
            .join(cells, ["key", "bin"])
            .join(sources, "key")
            .select("key", "at", "words", "source_size", "rank", "target", (F.col("offset") + F.col("run")).alias("cum"))
        )
        out = durable(out, "mix-queue")
        release(items)
        return out, sources

    @staticmethod
    def _finish(e):
        return (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")

    def cut(self, queue: DataFrame) -> tuple[float, int] | None:
        """The last entry within the budget, as (finish, rank); both identify it, as a source's finish times differ.

        The queue's entries of all rounds are range-sorted; an entry is within the budget if the words before it don't use it up.
        """
        budget, rows = queue.agg(F.sum("words"), F.count("*")).first()
        if not budget:
            return None
        round_ = F.explode(F.array(*[F.lit(e) for e in range(self.cap)])).alias("e")
        entries = queue.select("words", "rank", "target", "source_size", "cum", round_).select("words", "rank", self._finish(F.col("e")).alias("finish"))
        spans = max(int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * self.cap // _RANGE + 1)
        ranged = durable(entries.repartitionByRange(spans, "finish", "rank").withColumn("span", F.spark_partition_id()), "mix-ranged")
        per = ranged.groupBy("span").agg(F.sum("words").alias("n")).withColumn("run", F.sum("n").over(W.orderBy("span")))
        hit = per.where(F.col("run") >= F.lit(budget)).orderBy("span").first()
        last = W.orderBy("finish", "rank")
        left = budget - (hit["run"] - hit["n"])
        run = F.sum("words").over(last.rowsBetween(W.unboundedPreceding, 0))
        inside = ranged.where(F.col("span") == F.lit(hit["span"])).withColumn("run", run).where(F.col("run") - F.col("words") < F.lit(left))
        found = inside.agg(F.max(F.struct("finish", "rank")).alias("m")).first()["m"]
        release(ranged)
        return found["finish"], found["rank"]

    def rounds(self, base: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, int] | None]:
        """(sources with key, source_size, target and t0, t1, ...: the last place that each round takes; the queue; the cut)."""
        queue, sources = self.queue(base)
        cut = self.cut(queue)
        if cut is None:
            none = F.lit(None).cast(queue.schema["at"].dataType)
            return sources.withColumns({f"t{e}": none for e in range(self.cap)}), queue, None
        taken = [self._taken(F.lit(e), cut) for e in range(self.cap)]
        last = queue.groupBy("key").agg(*[F.max(F.when(t, F.col("at"))).alias(f"t{e}") for e, t in enumerate(taken)])
        return durable(sources.join(last, "key", "left"), "mix-rounds"), queue, cut

    def _taken(self, e, cut):
        finish = self._finish(e)
        return (finish < F.lit(cut[0])) | ((finish == F.lit(cut[0])) & (F.col("rank") <= F.lit(cut[1])))

    def _judged(self, rows: DataFrame, rounds: DataFrame) -> DataFrame:
        """rows of sizes() with source_size, target and copies. The table of sources is broadcast by Spark as long as it is small."""
        copies = sum((F.when((F.col("size") > 0) & (F.col("at") <= F.col(f"t{e}")), 1).otherwise(0) for e in range(self.cap)), start=F.lit(0))
        return rows.join(rounds.drop("source", "rank"), "key", "left").withColumn("copies", copies)

    def plan(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, source, text) -> doc_id, size, source_size, target, copies, taken of every row."""
        base = durable(self.sizes(docs), "mix-sizes")
        rounds, queue, _ = self.rounds(base)
        release(queue)
        return self._judged(base, rounds).select(
            "doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
        )

    def apply(self, docs: DataFrame, ordered: bool = False) -> DataFrame:
        """The mixed documents: each row as many times as it was taken, all columns kept.

        `ordered`: range-sorted by finish time, which shuffles the texts; else every row is judged where it lies and no text moves.
        """
        base = durable(self.sizes(docs), "mix-sizes")
        rounds, queue, _ = self.rounds(base)
        release(base)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
        held = docs.select("doc_id", "source", "text", row)
        judged = self._judged(self.sizes(held, "__row"), rounds).where("copies > 0")
        keep = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
        if not ordered:
            release(queue)
            return judged.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*keep)
        # Text rows meet their finish time at equal places; a place is a document's own, so no key is hot but for repeated rows.
        judged = judged.select("__row", "at", "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("e"))
        timed = judged.join(queue, ["key", "at"]).withColumn("finish", self._finish(F.col("e")))
        return timed.orderBy("finish", "rank").select(*keep)
