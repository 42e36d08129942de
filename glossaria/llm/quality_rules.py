"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base rules are fixed. Beyond them every rule is a statistic of the text with a cutoff chosen on
labelled documents (quality 1 is good), per stratum (language). All rules are tightened along one fixed path: a
step tightens one rule by one place of its grid, in turn, so a step stands for a cutoff of every rule at once.
Of each step the hypothesis "of the stratum's good documents that pass the base rules, more than `alpha` exceed some
cutoff" is tested with the exact binomial tail P(Bin(n, alpha) <= k), k of n labelled ones exceeding one. Steps are tested
in order up to the first that is not rejected (fixed-sequence testing needs no correction within the
sequence); the level is `delta` over the number of strata (Bonferroni). So, with confidence 1 - delta, at once
in all strata, the learned rules reject at most `alpha` of the good documents that pass the base rules, whatever the rules'
dependence. With delta = 0.05 and four strata 217 good labels in a stratum suffice for a first step at alpha = 0.02.

All counts cover all documents and all labels; every language is a stratum, and so are rows without one. The table of chosen
steps has one row a stratum.

Defined cases: null or empty text has no words and fails the base rules; very long texts take
O(n log n) array work in one row; repeated rows are judged alike; a document labelled several times
counts as good only if all its labels are; no labels: no learned cutoff; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, durable, release

#: The statistics and their cutoffs, from the loosest to the tightest.
RULES = {
    "symbol_rate": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "repeat_rate": (0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.15, 0.1, 0.05),
    "upper_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "chars_per_word": (40.0, 30.0, 24.0, 20.0, 18.0, 16.0, 14.0, 12.0, 10.0, 8.0),
}
STEPS = len(RULES) * max(map(len, RULES.values()))
#: Up to so many good labels their texts' statistics are taken by a broadcast join of the ids (8 bytes each).
_FEW_LABELS = 1 << 21


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series at x + 8, shifted back."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + i)
    return series - F.log(shift)


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k) where k < n a (else 1), summed downwards from k.

    Below the mean, terms fall at least like a normal density; beyond nine deviations they are under the
    precision of a double, so no more are summed and nothing is left out that a double could hold.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(
        log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(a)) + (nd - kd) * F.log(F.lit(1 - a))
    )
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(s, j):
        i = kd - j
        return F.struct(
            (s["term"] * i * F.lit(1 - a) / ((nd - i + 1) * F.lit(a))).alias("term"), (s["sum"] + s["term"]).alias("sum")
        )

    terms = F.least(k, F.ceil(9 * F.sqrt(nd * F.lit(a * (1 - a)))) + 40).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), terms), zero, step, lambda s: s["sum"])
    return F.when((n == 0) | (kd >= nd * a), F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


class RiskControlledRules:
    def __init__(self, alpha: float = 0.02, delta: float = 0.05, window: int = 8):
        self.alpha, self.delta, self.window = alpha, delta, window

    def statistics(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """doc_id, lang and the counts of every whole text; one row a document, no shuffle. carry: columns kept as __row."""
        text, w = F.coalesce(F.col("text"), F.lit("")), self.window
        row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row")] if carry else []
        also = ["__row"] if carry else []
        s = docs.select("doc_id", "lang", text.alias("text"), *row)
        s = s.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
        s = s.withColumn("n_words", F.size("words").cast("long")).withColumn(
            "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
        )
        s = s.select(
            *also,
            "doc_id",
            "lang",
            "n_words",
            "words",
            (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        )
        # Hashes of all windows; only a text in which one repeats is looked at further.
        s = s.withColumn(
            "win",
            F.when(
                F.col("n_words") >= w,
                F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (w - 1)), lambda i: F.xxhash64(F.slice("words", i, w))),
            ).otherwise(F.array().cast("array<bigint>")),
        ).drop("words")
        s = s.withColumn(
            "at",
            F.when(
                F.size(F.array_distinct("win")) < F.size("win"),
                F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        ).drop("win")
        same = lambda i, j: F.get(F.col("at"), i)["h"] == F.get(F.col("at"), j)["h"]
        s = s.withColumn(
            "hits",
            F.array_sort(
                F.transform(
                    F.filter("at", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        covered = F.aggregate(
            F.transform("hits", lambda p, i: F.least(F.lit(w), F.coalesce(F.get(F.col("hits"), i + 1) - p, F.lit(w)))),
            F.lit(0),
            lambda a, x: a + x,
        )
        return s.select(
            *also,
            "doc_id",
            "lang",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            "n_lines",
            "n_upper",
        )

    @staticmethod
    def rates(stats: DataFrame) -> DataFrame:
        per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
        return stats.withColumns(
            {
                "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
                "symbol_rate": per("n_symbols", "n_words"),
                "dup_line_rate": per("n_dup_lines", "n_lines"),
                "repeat_rate": per("n_repeat_words", "n_words"),
                "upper_rate": per("n_upper", "word_chars"),
                "chars_per_word": per("word_chars", "n_words"),
            }
        )

    @staticmethod
    def own_step(rule: str) -> Column:
        """The first step of the path whose cutoff of this rule the document exceeds; null if none does."""
        place, out = list(RULES).index(rule), None
        for j, cutoff in enumerate(RULES[rule]):
            hit = F.lit(j * len(RULES) + place)
            out = F.when(F.col(rule) > F.lit(cutoff), hit) if out is None else out.when(F.col(rule) > F.lit(cutoff), hit)
        return out

    @staticmethod
    def stratum() -> Column:
        return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))

    @staticmethod
    def good(labels: DataFrame) -> DataFrame:
        """doc_id of the documents all of whose labels are good."""
        one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
        return one.where("q = 1").select("doc_id")

    def cutoffs(self, held: DataFrame) -> DataFrame:
        """rates() of the good documents -> stratum, n, last (the last step that is safe, -1 if none), k, p, and each rule's cutoff (null: none)."""
        first = F.least(*[self.own_step(r) for r in RULES])
        counts = F.array(*[F.sum(F.when(F.col("first") <= t, 1).otherwise(0)) for t in range(STEPS)])
        held = held.where("not base_failed").select(self.stratum().alias("stratum"), first.alias("first"))
        per = held.groupBy("stratum").agg(F.count("*").alias("n"), counts.alias("counts"))
        per = per.withColumn("strata", F.count("*").over(W.partitionBy()))  # one row a stratum
        flat = per.select("stratum", "n", "strata", F.posexplode("counts").alias("t", "k"))
        tested = flat.withColumn("p", binomial_tail(F.col("k"), F.col("n"), self.alpha))
        safe = F.col("p") <= F.lit(self.delta) / F.col("strata")
        stop = F.coalesce(F.min(F.when(~safe, F.col("t"))).over(W.partitionBy("stratum")), F.lit(STEPS))
        tested = tested.withColumn("last", stop - 1)
        out = tested.groupBy("stratum", "n", "last").agg(F.max(F.when(F.col("t") == F.col("last"), F.struct("k", "p"))).alias("at"))
        place = lambda i: F.floor((F.col("last") - i) / len(RULES)).cast("int")
        values = [F.when(F.col("last") >= i, F.get(F.array(*map(F.lit, RULES[r])), place(i))).alias(f"max_{r}") for i, r in enumerate(RULES)]
        return out.select("stratum", "n", "last", "at.k", "at.p", *values)

    def _verdicts(self, rates: DataFrame, found: DataFrame) -> DataFrame:
        """failed_rules and kept, by the last step of the row's stratum."""
        out = rates.withColumn("__stratum", self.stratum()).join(found.select(F.col("stratum").alias("__stratum"), F.col("last").alias("__last")), "__stratum", "left")
        fails = [F.when(self.own_step(rule) <= F.col("__last"), F.lit(rule)) for rule in RULES]
        out = out.withColumn("failed_rules", F.array_compact(F.array(*fails))).drop("__stratum", "__last")
        return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))

    def judge(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The statistics with base_failed, kept and failed_rules (names of the learned rules that the document exceeds)."""
        rates = durable(self.rates(self.statistics(docs)), "rule-stats")
        found = durable(self.cutoffs(rates.join(self.good(labels), "doc_id", "left_semi")), "rule-cutoffs")
        return self._verdicts(rates, found)

    def filter(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of docs that are kept, all columns kept.

        Cutoffs are learned from the statistics of the labelled documents alone; then every document's are taken in the scan that filters
        it, so no text is shuffled and none but the labelled are read twice. With very many labels all statistics are taken first, as
        light rows that the labels are joined with: the same result by another way.
        """
        good = durable(self.good(labels), "rule-good")
        if good.count() <= _FEW_LABELS:
            held = rates = durable(self.rates(self.statistics(docs.join(F.broadcast(good), "doc_id", "left_semi"))), "rule-stats")
        else:
            rates = durable(self.rates(self.statistics(docs)), "rule-stats")
            held = rates.join(good, "doc_id", "left_semi")
        found = durable(self.cutoffs(held), "rule-cutoffs")
        release(good, rates)
        # The generator keeps the filter above it: pushed further down, the statistics would be inlined and taken many times.
        stats = self.statistics(docs, carry=docs.columns)
        once = F.explode(F.array(F.struct(*[c for c in stats.columns if c != "__row"]))).alias("__s")
        judged = self._verdicts(self.rates(stats.select("__row", once).select("__row", "__s.*")), found)
        return judged.where("kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
