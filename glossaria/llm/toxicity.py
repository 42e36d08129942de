"""Toxicity by a classifier chain of linear models.

The chain's categories are what annotators said, never a function of the text: each is a condition on the columns of
`labels`, by default `unfit` (quality 0), then `toxic`. They are predicted in order, and each model sees the
probabilities of the categories before it. For training, those probabilities are out-of-fold
predictions: a document's comes from terms and weights that were learned without its fold, so a later
model never sees an earlier one's fit to the same document.

Each category has a lexicon, which is learned, not given: words and word beginnings (4 and 5 bytes) that documents
labelled so hold far more often than others; out of fold, it is learned anew in every fold. It holds the `size` most telling terms:
a model's number of features, not a cut of the corpus. Documents are whole; the sample of labelled documents that lexicons
and models are fitted on is bounded by `labelled`, a documented parameter.

Defined cases: null text and text without letters or digits has probability 0 and is not toxic; without labels of both
kinds in the last category nothing is toxic; a document labelled several times is in a category if any label says so; a document
without a label of some category doesn't train that category's model;
repeated rows are judged alike; very long texts are read whole, in one slice each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches
from .linear import fit_logistic, sampled, sigmoid

#: (category, condition on the columns of labels), in the chain's order; the last one is the verdict.
CHAIN = (("unfit", "quality = 0"), ("toxic", "toxic = 1"))
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every lower-cased word and of its first 4 and 5 bytes; a word is a run of letters and digits."""
    a, b, row = tk.word_spans(np.where(_LETTER[buf], buf, np.uint8(32)), off)
    out = [tk.word_hashes(buf, a, b, tk.LOWER)]
    rows = [row]
    for n in (4, 5):
        long = b - a >= n
        out.append(tk.word_hashes(buf, a[long], a[long] + n, tk.LOWER) ^ np.uint64(n))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def _sample(batches):
    """Distinct terms with counts of sampled documents, for the driver."""
    for batch in batches:
        for i, j, buf, off in tk.slices(batch.column(1)):
            h, row = terms(buf, off)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            ends = np.searchsorted(row, np.arange(j - i + 1))
            packed = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                u, c = np.unique(h[a:b], return_counts=True)
                packed.append(u.tobytes() + np.minimum(c, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(packed, pa.binary())], names=["doc_id", "said", "terms"])


class Sample:
    """Terms of the sampled documents: `words` sorted and distinct, and for every (document, term) the term's number, its row and count."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(docs)
        self.row = np.repeat(np.arange(self.n), [len(h) for h, _ in docs])
        self.words, self.at = np.unique(np.concatenate([h for h, _ in docs]), return_inverse=True)
        self.count = np.concatenate([c for _, c in docs]).astype(float)

    def lexicon(self, y: np.ndarray, fit: np.ndarray, size: int, least: int = 4, lift: float = 25.0) -> np.ndarray:
        """Sorted hashes of the terms most telling of the documents with y = 1 among those to fit on."""
        pos, neg = fit & (y == 1), fit & (y == 0)
        c1 = np.bincount(self.at[pos[self.row]], minlength=len(self.words))
        c0 = np.bincount(self.at[neg[self.row]], minlength=len(self.words))
        score = (c1 / max(1, pos.sum())) / ((c0 + 0.5) / (neg.sum() + 1))
        good = np.flatnonzero((c1 >= least) & (score >= lift))
        good = good[np.lexsort((self.words[good], -score[good] * np.sqrt(c1[good])))][:size]
        return np.sort(self.words[good])

    def features(self, lex: np.ndarray) -> np.ndarray:
        return features(self.n, self.words[self.at], self.row, self.count, lex)


def features(n: int, h: np.ndarray, row: np.ndarray, count: np.ndarray, lex: np.ndarray) -> np.ndarray:
    """rows x (terms + 3): presence of each term, of any, their number, and their density."""
    x = np.zeros((n, len(lex) + 3), np.float32)
    total = np.bincount(row, weights=count, minlength=n)
    if len(lex):
        at = np.minimum(np.searchsorted(lex, h), len(lex) - 1)
        hit = lex[at] == h
        x[row[hit], at[hit]] = 1
        hits = np.bincount(row[hit], weights=count[hit], minlength=n)
    else:
        hits = np.zeros(n)
    x[:, -3] = hits > 0
    x[:, -2] = np.log1p(hits)
    x[:, -1] = np.minimum(hits / np.maximum(total, 1) * 20, 2)
    return x


def _with(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.concatenate([x, earlier.astype(np.float32)], axis=1)


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid((x @ w[:-1].astype(np.float32) + w[-1]).astype(np.float64))


def out_of_fold(sample: Sample, y: np.ndarray, earlier: np.ndarray, size: int, folds: int = 5) -> np.ndarray:
    """Probabilities of every document by terms and weights learned on the other folds; y is nan where nobody said."""
    fold = tk.mix(np.arange(sample.n, dtype=np.uint64) + np.uint64(31)) % np.uint64(folds)
    known, p = ~np.isnan(y), np.zeros(sample.n)
    for k in range(folds):
        out, fit = fold == k, (fold != k) & known
        if out.any() and fit.any():
            x = _with(sample.features(sample.lexicon(y, fit, size)), earlier)
            p[out] = _probability(fit_logistic(x[fit], y[fit], l2=1e-4), x[out])
    return p


def train_chain(sample: Sample, targets: list[np.ndarray], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lexicon, weights) of each category over its features and the earlier categories' out-of-fold probabilities."""
    models, earlier = [], np.zeros((sample.n, 0))
    for i, y in enumerate(targets):
        known = ~np.isnan(y)
        lex = sample.lexicon(y, known, size)
        x = _with(sample.features(lex), earlier)
        models.append((lex, fit_logistic(x[known], y[known], l2=1e-4) if known.any() else np.append(np.zeros(x.shape[1]), -9.0)))
        if i + 1 < len(targets):
            earlier = np.concatenate([earlier, out_of_fold(sample, y, earlier, size)[:, None]], axis=1)
    return models


def run_chain(models: list, n: int, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """rows x categories."""
    out = np.zeros((n, 0))
    for lex, w in models:
        p = _probability(w, _with(features(n, h, row, np.ones(len(h)), lex), out))
        out = np.concatenate([out, p[:, None]], axis=1)
    return out


def _predict(batches, shared, names: list[str]):
    models = shared.value
    for batch in batches:
        for i, j, buf, off in tk.slices(batch.column(1)):
            n = j - i
            p, some = np.zeros((n, len(names))), np.zeros(n, bool)
            if models is not None:
                h, row = terms(buf, off)
                some[row] = True
                p = run_chain(models, n, h, row) * some[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= 0.5)], names=["doc_id", *[f"p_{c}" for c in names], "toxic"]
            )


class ToxicityChain:
    def __init__(self, chain: tuple[tuple[str, str], ...] = CHAIN, labelled: int = 6000, size: int = 512):
        self.chain, self.labelled, self.size = chain, labelled, size

    def fit(self, docs: DataFrame, labels: DataFrame) -> list | None:
        small_batches(docs.sparkSession)
        said = F.array(*[F.max(F.expr(condition).cast("double")) for _, condition in self.chain])
        one = labels.where("doc_id is not null").groupBy("doc_id").agg(said.alias("said")).where(F.element_at("said", -1).isNotNull())
        ids = one.where(sampled(F.col("doc_id"), one.count(), self.labelled, 23)).withColumnRenamed("doc_id", "__id")
        rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).drop("__id")
        got = rows.mapInArrow(_sample, "doc_id long, said array<double>, terms binary").toArrow().sort_by("doc_id")
        targets = np.array([[np.nan if v is None else v for v in x] for x in got.column("said").to_pylist()]).reshape(-1, len(self.chain)).T
        if len(set(targets[-1].tolist())) < 2:
            return None
        packed = []
        for raw in got.column("terms").to_pylist():
            n = len(raw) // 10
            packed.append((np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint16, n, 8 * n)))
        return train_chain(Sample(packed), list(targets), self.size)

    def predict(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, a probability p_<category> each, and toxic (the last one's verdict) of every row."""
        shared = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels))
        names = [c for c, _ in self.chain]
        schema = ", ".join(["doc_id long", *[f"p_{c} double" for c in names], "toxic boolean"])
        return docs.select("doc_id", "text").mapInArrow(lambda it: _predict(it, shared, names), schema)
