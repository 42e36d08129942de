"""An index that changes with its papers instead of being built anew.

What is kept is a counted view: for every batch of papers the words of each (year, section) unit with their number and first place
(tokens.counted), and the batch's units. Appending a batch reads that batch's texts alone. Deleting a year and toggling a section are rows of an
operations table, read when the index is: no text is read again. Lemmas, bitmaps and all else follow from the words that are left, so the index
always equals one built from the papers that are left.

Steps have a place in one sequence. A step is written to a folder of its own and counts once its commit mark is there; a step of
the same name is not taken twice, so a repeated micro-batch changes nothing, and what a failed one left is overwritten. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import index as ix
from ..operators import senses as sn
from ..operators import tokens as tk
from ..operators import units as un
from ..sources import folders

CELLS = "low string, year string, section string, place decimal(38,0), n_tokens long, seq long, enabled boolean"
UNITS = "year string, section string, seq long, enabled boolean"
OPS = "seq long, kind string, year string, section string, enabled boolean"


class IndexStore:
    """Steps of a changing corpus below one path."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    # ------------------------------------------------------------ the sequence

    def steps(self) -> list[tuple[int, str]]:
        """(seq, name) of the committed steps since the last compaction, that one included, in order."""
        done = [(int(x.split("-", 1)[0]), x.split("-", 1)[1]) for x in folders.names(self.spark, f"{self.path}/commits")]
        base = max((i for i, (_, name) in enumerate(done) if name.startswith("base")), default=0)
        return done[base:]

    def _taken(self) -> set[str]:
        return {x.split("-", 1)[1] for x in folders.names(self.spark, f"{self.path}/commits")}

    def _next(self) -> int:
        return max((seq for seq, _ in self.steps()), default=-1) + 1

    def _commit(self, seq: int, name: str) -> None:
        folders.mark(self.spark, f"{self.path}/commits/{seq:012d}-{name}")

    # ------------------------------------------------------------ changes

    def append(self, papers: DataFrame, name: str) -> bool:
        """Take a batch of papers in; False if a step of this name was taken before."""
        if name.startswith("base"):
            raise ValueError("names that begin with base are those of compactions")
        if name in self._taken():
            return False
        seq = self._next()
        mark = [F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("enabled")]
        cells = tk.counted(papers, self.settings.stop_words)
        cells.select("low", "year", "section", "place", "n_tokens", *mark).write.mode("overwrite").parquet(f"{self.path}/cells/{name}")
        un.units(papers).select("year", "section", *mark).write.mode("overwrite").parquet(f"{self.path}/units/{name}")
        self._commit(seq, name)
        return True

    def _operation(self, kind: str, year: str, section: str | None, enabled: bool | None, name: str | None) -> bool:
        seq = self._next()
        name = name or f"{kind}{seq}"
        if name in self._taken():
            return False
        rows = self.spark.createDataFrame([(seq, kind, year, section, enabled)], OPS)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ops/{name}")
        self._commit(seq, name)
        return True

    def delete_year(self, year: str, name: str | None = None) -> bool:
        """Papers of the year that are there go; later ones of it stay."""
        return self._operation("delete", year, None, None, name)

    def toggle(self, year: str, section: str | None, enabled: bool, name: str | None = None) -> bool:
        """Papers of a section, or of a whole year, that are there count or don't."""
        return self._operation("toggle", year, section, enabled, name)

    # ------------------------------------------------------------ reading

    def _read(self, kind: str, schema: str | None) -> DataFrame | None:
        there = set(folders.names(self.spark, f"{self.path}/{kind}"))
        paths = [f"{self.path}/{kind}/{name}" for _, name in self.steps() if name in there]
        if not paths:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(*paths)

    def _standing(self) -> DataFrame:
        """year, section, seq, was, enabled of the units of every batch that later operations left; `was`: enabled as the batch has it.

        The operations on a unit are few rows: they meet the units, not the words.
        """
        ops = self._read("ops", OPS).select(*[F.col(c).alias("o_" + c) for c in ("seq", "kind", "year", "section", "enabled")])
        on = (F.col("o_year") == F.col("year")) & (F.col("o_seq") > F.col("seq"))
        on &= (F.col("o_kind") == "delete") | F.col("o_section").isNull() | (F.col("o_section") == F.col("section"))
        rows = self._read("units", UNITS).join(ops, on, "left")
        last = F.max(F.when(F.col("o_kind") == "toggle", F.struct("o_seq", "o_enabled")))
        rows = rows.groupBy("year", "section", "seq", "enabled").agg(last.alias("last"), F.max(F.coalesce(F.col("o_kind") == "delete", F.lit(False))).alias("gone"))
        return rows.where("not gone").select("year", "section", "seq", F.col("enabled").alias("was"), F.coalesce("last.o_enabled", "enabled").alias("enabled"))

    def _cells(self, standing: DataFrame) -> DataFrame | None:
        cells = self._read("cells", None)
        if cells is None:
            return None
        s = standing.select(*[F.col(c).alias("s_" + c) for c in standing.columns])
        same = F.col("year").eqNullSafe(F.col("s_year")) & F.col("section").eqNullSafe(F.col("s_section")) & (F.col("seq") == F.col("s_seq"))
        rows = cells.join(s, same & (F.col("enabled") == F.col("s_was")))
        return rows.drop("enabled", "s_year", "s_section", "s_seq", "s_was").withColumnRenamed("s_enabled", "enabled")

    def units(self) -> DataFrame:
        """year, section of the units that count."""
        return un.units(self._standing().where("enabled"))

    def cells(self) -> DataFrame:
        """tokens.cells() of the papers that count."""
        kept = self.units()
        cells = self._cells(self._standing().where("enabled"))
        if cells is None:
            cells = self.spark.createDataFrame([], CELLS)
        rows = cells.groupBy("low", "year", "section").agg(F.min("place").alias("place"), F.sum("n_tokens").alias("n_tokens"))
        return tk.with_lemmas(tk.or_bits(un.marked(rows, un.numbered(kept)), "low"), rows, self.settings.stop_words)

    def index(self, book: DataFrame | None = None, lists: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
        """What index.build() gives for the papers that count."""
        rows = ix.assembled(ix.excluded(self.cells(), lists, groups, self.settings), self.units())
        return sn.attached(rows, book) if book is not None else rows

    def compact(self) -> None:
        """Replace the steps so far by one: the counts of each unit and state, without what was deleted. Earlier folders go after the commit."""
        old, seq = self.steps(), self._next()
        name = f"base{seq}"
        standing = self._standing()
        cells = self._cells(standing)
        mark = F.lit(seq).cast("long").alias("seq")
        if cells is not None:
            rows = cells.groupBy("low", "year", "section", "enabled").agg(F.min("place").alias("place"), F.sum("n_tokens").alias("n_tokens"))
            rows.select("low", "year", "section", "place", "n_tokens", mark, "enabled").write.mode("overwrite").parquet(f"{self.path}/cells/{name}")
        standing.select("year", "section", mark, "enabled").distinct().write.mode("overwrite").parquet(f"{self.path}/units/{name}")
        self._commit(seq, name)
        for _, gone in old:
            for kind in ("cells", "units", "ops"):
                folders.remove(self.spark, f"{self.path}/{kind}/{gone}")


def follow(store: IndexStore, incoming: str, schema: str, checkpoint: str, label: str = "stream"):
    """Start a query that takes arriving Parquet papers into a store. After a restart the checkpoint repeats the last batch at most, and its name is known."""
    stream = store.spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(lambda papers, n: store.append(papers, f"{label}{n}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
