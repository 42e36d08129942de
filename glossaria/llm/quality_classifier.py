"""Quality classification by co-training of a text view and a metadata view.

The text view sees hashed words, hashed word endings and a few rates of the whole text; the metadata
view sees source, language and declared length, never the text. Each is a logistic regression.
Both start from a bounded labelled sample. In every round one distributed pass lets each view judge all documents; of
those that it is confident of, `per_round` of either kind, drawn evenly by hash, are handed to the other view as pseudo-labels,
and that view is trained again with them. At the
end each view is calibrated (Platt) on labelled documents kept apart, the calibrated logits
are added (the prior counted once), and every document is scored in one pass.

A document is rejected if its probability of being good is below 0.5 and below the score that all but
`false_rejects` of the calibration's good documents reach.

Bounds (documented parameters): the models are fitted on about `labelled` labelled documents and, a round, view and kind, at
most about `per_round` pseudo-labelled ones (up to 20 times that if a view gives nearly all documents to a kind that is rare
among the labelled). Every document may be drawn in every round; all documents are
scored on their whole texts. Documents of the labelled sample are never pseudo-labelled.

Defined cases: null text and text without words scores 0 and is rejected; without labels of both
kinds every other document gets the prior and is kept; null source, lang or n_chars are values of
their own; repeated rows are scored alike; very long texts are read whole, in one slice each; an empty table gives an empty result;
other columns are ignored, `filter` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .common import lean, small_batches
from .linear import fit_logistic, fit_platt, labelled_sample, sigmoid

WORDS, ENDS, RATES = 768, 256, 4
TEXT = WORDS + ENDS + RATES
META = 192


def text_view(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x TEXT features, number of words)."""
    n = len(off) - 1
    a, b, row = tk.word_spans(buf, off)
    count = np.bincount(row, minlength=n)
    h = tk.word_hashes(buf, a, b, tk.LOWER)
    e = tk.word_hashes(buf, np.maximum(a, b - 3), b, tk.SHAPE)
    out = np.zeros((n, TEXT), np.float32)
    some = np.maximum(count, 1)[:, None]
    bag = np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :WORDS] = np.sqrt(bag / some)
    out[:, WORDS : WORDS + ENDS] = np.sqrt(np.bincount(row * ENDS + (e % np.uint64(ENDS)).astype(np.int64), minlength=n * ENDS).reshape(n, ENDS) / some)
    same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    chars = np.bincount(row, weights=b - a, minlength=n)
    out[:, -4] = same / some[:, 0] * 3
    out[:, -3] = (bag > 0).sum(axis=1) / np.minimum(some[:, 0], WORDS)
    out[:, -2] = np.minimum(chars / some[:, 0] / 10, 3)
    out[:, -1] = np.log1p(count) / 8
    return out, count


def meta_view(source, lang, n_chars) -> np.ndarray:
    """rows x META: one-hot hashed source, language, and length in powers of two."""
    from zlib import crc32

    out = np.zeros((len(source), META), np.float32)
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0 if s is None else 1 + crc32(s.encode()) % 127] = 1
        out[i, 128 if g is None else 129 + crc32(g.encode()) % 31] = 1
        out[i, 160 if c is None else 161 + min(30, max(0, int(c)).bit_length())] = 1
    return out


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _features(batches):
    """Features of sampled documents for the driver: two rows of half floats."""
    for batch in batches:
        meta = meta_view(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        for i, j, buf, off in tk.slices(batch.column(1)):
            x, _ = text_view(buf, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(5)[i:j], pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array([r.tobytes() for r in meta[i:j].astype(np.float16)], pa.binary())],
                names=["doc_id", "target", "text", "meta"],
            )


def draw(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) of each doc_id, another in every round."""
    return tk.mix(ids.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))).astype(np.float64) / 2.0**64


def _confident(batches, shared):
    """Features of the documents that a view is confident of and that are drawn: target 1 or 0, view 0 (text judged) or 1."""
    w, turn, rate, sure, labelled = shared.value
    for batch in batches:
        meta = meta_view(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        ids = np.nan_to_num(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        for i, j, buf, off in tk.slices(batch.column(1)):
            x, count = text_view(buf, off)
            u, free = draw(ids[i:j], turn), (count > 0) & ~np.isin(ids[i:j], labelled)
            for number, (view, part) in enumerate((("text", x), ("meta", meta[i:j]))):
                p = sigmoid(part @ w[view][:-1].astype(np.float32) + w[view][-1])
                said = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
                at = np.flatnonzero(free & (said >= 0) & (u < np.where(said == 1, rate[1], rate[0])))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[i:j][at]),
                            pa.array(said[at].astype(np.int32)),
                            pa.array([r.tobytes() for r in x[at].astype(np.float16)], pa.binary()),
                            pa.array([r.tobytes() for r in meta[i:j][at].astype(np.float16)], pa.binary()),
                            pa.array(np.full(len(at), number, np.int32)),
                        ],
                        names=["doc_id", "target", "text", "meta", "view"],
                    )


def _retrain(x: np.ndarray, y: np.ndarray, more: np.ndarray, said: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labelled and pseudo-labelled documents together; these weigh half in all, each kind as among the labelled."""
    weight = np.ones(len(x))
    if len(more):
        many = np.bincount(said.astype(int), minlength=2)
        share = np.array([1 - y.mean(), y.mean()])
        weight = np.concatenate([weight, 0.5 * len(x) * share[said.astype(int)] / many[said.astype(int)]])
    return fit_logistic(np.concatenate([x, more]), np.concatenate([y, said]), weight, steps=60, rate=0.1, start=start)


def _score(batches, shared):
    model = shared.value
    for batch in batches:
        meta = meta_view(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        for i, j, buf, off in tk.slices(batch.column(1)):
            x, count = text_view(buf, off)
            p_text, p_meta, p = combine(model, x, meta[i:j])
            known = count > 0
            p = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(np.where(known, p_text, 0.0)), pa.array(p_meta), pa.array(p), pa.array(known & (p >= model["cut"]))],
                names=["doc_id", "p_text", "p_meta", "score", "kept"],
            )


def combine(model: dict, text: np.ndarray, meta: np.ndarray):
    """Calibrated probabilities of the two views and of both together."""
    if model["w"] is None:
        p = np.full(len(text), model["prior"])
        return p, p, p
    logit = {}
    for v, x in (("text", text), ("meta", meta)):
        w, (a, b) = model["w"][v], model["platt"][v]
        logit[v] = a * (x @ w[:-1].astype(np.float32) + w[-1]).astype(np.float64) + b
    prior = np.log(model["prior"] / (1 - model["prior"]))
    return sigmoid(logit["text"]), sigmoid(logit["meta"]), sigmoid(logit["text"] + logit["meta"] - prior)


class CoTraining:
    def __init__(self, labelled: int = 5000, per_round: int = 500, rounds: int = 3, sure: float = 0.9, false_rejects: float = 0.002):
        self.labelled, self.per_round, self.rounds, self.sure, self.false_rejects = labelled, per_round, rounds, sure, false_rejects

    @staticmethod
    def _read(got: pa.Table):
        """Features of both views, targets and doc_ids."""
        read = lambda c, d: np.frombuffer(b"".join(got.column(c).to_pylist()), np.float16).reshape(-1, d).astype(np.float32)
        return read("text", TEXT), read("meta", META), np.array(got.column("target").to_pylist(), dtype=float), np.array(got.column("doc_id").to_pylist(), dtype=np.int64)

    def _exchange(self, docs: DataFrame, w: dict, turn: int, rate: tuple[float, float], labelled: np.ndarray) -> dict:
        """What each view is told by the other: (its features, pseudo-labels)."""
        shared = docs.sparkSession.sparkContext.broadcast((w, turn, rate, self.sure, labelled))
        shape = "doc_id long, target int, text binary, meta binary, view int"
        got = docs.mapInArrow(lambda it: lean(_confident(it, shared)), shape).toArrow().sort_by([("doc_id", "ascending"), ("view", "ascending")])
        text, meta, said, _ = self._read(got)
        by = np.array(got.column("view").to_pylist(), dtype=int)
        shared.unpersist()
        return {"meta": (meta[by == 0], said[by == 0]), "text": (text[by == 1], said[by == 1])}

    def fit(self, docs: DataFrame, labels: DataFrame) -> dict:
        small_batches(docs.sparkSession)
        docs = docs.select(*COLUMNS)
        sample = labelled_sample(docs, labels, "quality", self.labelled)
        got = sample.mapInArrow(_features, "doc_id long, target int, text binary, meta binary").toArrow().sort_by("doc_id")
        text, meta, y, ids = self._read(got)
        y = (y > 0).astype(float)
        model = {"w": None, "prior": (y.sum() + 1) / (len(y) + 2), "cut": 0.0}
        if len(set(y.tolist())) < 2:
            return model
        apart = tk.mix(ids.astype(np.uint64) + np.uint64(99)) % np.uint64(4) == 0
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart = np.zeros(len(y), bool)
        fit, cal = ~apart, apart if apart.any() else ~apart
        views = {"text": text, "meta": meta}
        w = {v: fit_logistic(x[fit], y[fit]) for v, x in views.items()}
        rows, n, good = docs.where("text is not null"), docs.count(), min(0.95, max(0.05, model["prior"]))
        rate = tuple(min(1.0, self.per_round / (n * share)) for share in (1 - good, good))
        for turn in range(self.rounds):
            told = self._exchange(rows, w, turn, rate, ids)
            w = {v: _retrain(x[fit], y[fit], *told[v], start=w[v]) for v, x in views.items()}
        model["w"], model["platt"] = w, {}
        for v, x in views.items():
            model["platt"][v] = fit_platt(x[cal] @ w[v][:-1] + w[v][-1], y[cal])
        _, _, p = combine(model, text[cal], meta[cal])
        good = np.sort(p[y[cal] == 1])
        model["cut"] = float(min(0.5, good[int(self.false_rejects * len(good))]))
        return model

    def score(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, p_text, p_meta, score, kept of every row."""
        shared = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels))
        return docs.select(*COLUMNS).mapInArrow(lambda it: lean(_score(it, shared)), "doc_id long, p_text double, p_meta double, score double, kept boolean")

    def filter(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of docs that are not rejected, all columns kept; no join, each row carries its own judgement."""
        shared = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels))
        names = docs.columns

        def keep(batches):
            for batch in batches:
                part = pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in COLUMNS], names=list(COLUMNS))
                mask = pa.concat_arrays([b.column(4) for b in _score([part], shared)]) if len(batch) else pa.array([], pa.bool_())
                yield batch.filter(mask)

        return docs.mapInArrow(lambda it: lean(keep(it)), docs.schema)
