"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Every byte of a text gets a label distribution from a forward and a backward GRU with `hidden` units;
a document's probability is the mean over its bytes. Whole texts are read, cut into windows of
`window` bytes that start from a zero state, so a text of any length needs bounded memory.
Every language that rows carry is learned, however many there are: beyond 64 training steps grow in
proportion, and fewer windows are labelled at once, so that memory stays bounded.
Gates are hard sigmoids and the candidate a hard tanh (both cheap, both differentiable almost
everywhere). Training is backpropagation through time with Adam on at most `docs_per_language`
documents a language and `pieces` windows of each, a documented bound; it never looks at held-out
documents (crc32 of doc_id mod 4 is 2), and only text and lang are read.

Defined cases: null text and text without a letter give `und` with score 0; rows with null lang or null doc_id are never
learned from; without training rows every document is `und`; ties go to the first language in code-point
order; repeated rows are labelled alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches

#: Symbol of padding: its update gate is 1, so the state passes through it unchanged.
PAD = 256
_PLAIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Does the text hold a character of a Unicode letter category? Digits, fractions and enclosed numbers are none."""
    return _PLAIN.search(text) is not None or any(map(str.isalpha, text))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class ByteGru:
    """Two GRUs and a softmax. Arrays are (units, batch), so a step is a few operations on contiguous rows."""

    def __init__(self, labels: int, hidden: int = 8, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        f4 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"wo": f4(labels, 2 * h, scale=0.3), "bo": np.zeros((labels, 1), np.float32)}
        for d in "fb":
            self.p["x" + d] = f4(3 * h, 257, scale=0.3)
            self.p["x" + d][: 2 * h] += 0.5  # gates start half open
            self.p["u" + d] = f4(3 * h, h, scale=0.4 / np.sqrt(h))
        self._pad()

    def _pad(self) -> None:
        for d in "fb":
            x = self.p["x" + d]
            x[:, PAD] = 0
            x[: self.h, PAD] = 1e6

    def _run(self, d: str, seq: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, H, B) over seq (T, B)."""
        h, n_h, (T, B) = np.zeros((self.h, seq.shape[1]), np.float32), self.h, seq.shape
        x_all, u = self.p["x" + d], self.p["u" + d]
        out = np.empty((T, n_h, B), np.float32)
        x = np.empty((3 * n_h, B), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.take(x_all, seq[t], axis=1, out=x, mode="clip")
            a = u @ h
            g = x[: 2 * n_h] + a[: 2 * n_h]
            raw_g = g.copy() if keep is not None else None
            np.clip(g, 0, 1, out=g)
            c = g[n_h:] * a[2 * n_h :]
            c += x[2 * n_h :]
            raw_c = c.copy() if keep is not None else None
            np.clip(c, -1, 1, out=c)
            if keep is not None:
                keep.append((t, h, a, raw_g, raw_c, g, c))
            h = h - c
            h *= g[:n_h]
            h += c
            out[t] = h
        return out

    def _states(self, d: str, seq: np.ndarray) -> np.ndarray:
        """As _run without what training keeps; every step works in buffers made once."""
        n_h, (T, B) = self.h, seq.shape
        x_all, u = self.p["x" + d], self.p["u" + d]
        out = np.empty((T, n_h, B), np.float32)
        x, a, c = np.empty((3 * n_h, B), np.float32), np.empty((3 * n_h, B), np.float32), np.empty((n_h, B), np.float32)
        h, g, rest = np.zeros((n_h, B), np.float32), x[: 2 * n_h], a[2 * n_h :]
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.take(x_all, seq[t], axis=1, out=x, mode="clip")
            np.dot(u, h, out=a)
            g += a[: 2 * n_h]
            np.clip(g, 0, 1, out=g)
            np.multiply(g[n_h:], rest, out=c)
            c += x[2 * n_h :]
            np.clip(c, -1, 1, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= g[:n_h]
            new += c
            h = new
        return out

    def label(self, seq: np.ndarray) -> np.ndarray:
        """Label distributions (T, L, B) of every position."""
        seq = seq.astype(np.intp)
        f, b = self._states("f", seq), self._states("b", seq)
        w = self.p["wo"]
        left, right = np.ascontiguousarray(w[:, : self.h]), np.ascontiguousarray(w[:, self.h :])
        z = np.empty((len(seq), len(w), seq.shape[1]), np.float32)
        more = np.empty(z.shape[1:], np.float32)
        for t in range(len(seq)):
            np.dot(left, f[t], out=z[t])
            z[t] += np.dot(right, b[t], out=more)
        z += self.p["bo"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def train(self, seq: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int = 11) -> None:
        """seq (N, T) symbols, y (N) labels."""
        rng, n_h = np.random.default_rng(seed), self.h
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(seq), batch)
            s, want = np.ascontiguousarray(seq[pick].T), y[pick]
            kept = {"f": [], "b": []}
            st = {d: self._run(d, s, kept[d]) for d in "fb"}
            w = self.p["wo"]
            z = w[:, :n_h] @ st["f"] + w[:, n_h:] @ st["b"] + self.p["bo"]
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            z[:, want, np.arange(batch)] -= 1
            z *= (s != PAD)[:, None, :] / max(1, int((s != PAD).sum()))
            g = {"bo": z.sum(axis=(0, 2))[:, None]}
            g["wo"] = np.concatenate([np.einsum("tlb,thb->lh", z, st[d], optimize=True) for d in "fb"], axis=1)
            for d, part in (("f", w[:, :n_h]), ("b", w[:, n_h:])):
                g["x" + d], g["u" + d] = self._back(d, s, kept[d], part.T @ z)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            self._pad()

    def _back(self, d: str, s: np.ndarray, kept: list, top: np.ndarray):
        """Backpropagation through time of one direction; top (T, H, B) is the gradient of its states."""
        n_h, u = self.h, self.p["u" + d]
        gx, gu = np.zeros((257, 3 * n_h), np.float32), np.zeros_like(u)
        dh = np.zeros((n_h, s.shape[1]), np.float32)
        for t, h, a, raw_g, raw_c, g, c in reversed(kept):
            dh = dh + top[t]
            z = g[:n_h]
            dc = dh * (1 - z) * (np.abs(raw_c) < 1)
            dgate = np.concatenate([dh * (h - c), dc * a[2 * n_h :]]) * ((raw_g > 0) & (raw_g < 1))
            da = np.concatenate([dgate, dc * g[n_h:]])
            gu += da @ h.T
            np.add.at(gx, s[t], np.concatenate([dgate, dc]).T)
            dh = dh * z + u.T @ da
        return gx.T, gu


def _windows(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, N) symbols of all rows in windows, padded, and the row of each window."""
    lens = np.diff(off)
    count = -(-lens // width)
    row = np.repeat(np.arange(len(lens)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[row] + nth * width
    at = start[:, None] + np.arange(width)
    inside = at < off[row + 1][:, None]
    sym = np.full(at.shape, PAD, np.int16)
    sym[inside] = buf[at[inside]]
    return np.ascontiguousarray(sym.T), row


def _label_batches(batches, shared, width: int, rows: int):
    labels, params, hidden = shared.value
    net = ByteGru(len(labels), hidden) if labels else None
    if net:
        net.p = params
    for batch in batches:
        for i, j, buf, off in tk.slices(batch.column(2), 1 << 19):
            n = j - i
            total = np.zeros((n, max(1, len(labels))))
            if net:
                sym, row = _windows(buf, off, width)
                for a in range(0, sym.shape[1], rows):
                    part = np.ascontiguousarray(sym[:, a : a + rows])
                    p = net.label(part)
                    p *= (part != PAD)[:, None, :]
                    np.add.at(total, row[a : a + rows], p.sum(axis=0).T)
            total /= np.maximum(np.diff(off), 1)[:, None]
            best = total.argmax(axis=1)
            text = batch.column(2)[i:j].to_pylist()
            known = [net is not None and x is not None and has_letter(x) for x in text]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j],
                    batch.column(1)[i:j],
                    pa.array([labels[b] if k else "und" for b, k in zip(best, known, strict=True)]),
                    pa.array(np.where(known, np.minimum(total[np.arange(n), best], 1.0), 0.0)),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


class LanguageId:
    def __init__(self, hidden=8, window=64, docs_per_language=600, pieces=6, steps=260, batch=256, rate=0.02, seed=17):
        self.hidden, self.window, self.docs, self.pieces = hidden, window, docs_per_language, pieces
        self.steps, self.batch, self.rate, self.seed = steps, batch, rate, seed

    def fit(self, docs: DataFrame) -> tuple[list[str], dict]:
        """(languages, parameters) of every language, from a sample of rows that are not held out, bounded by language."""
        rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
        sizes = rows.groupBy("lang").count().collect()
        labels = sorted(x["lang"] for x in sizes)
        if not labels:
            return [], {}
        rates = docs.sparkSession.createDataFrame([(x["lang"], min(1.0, self.docs / x["count"])) for x in sizes], "lang string, rate double")
        draw = lambda k: F.pmod(F.xxhash64(F.lit(self.seed + k), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        span = F.greatest(F.length("text") - self.window, F.lit(0))
        cut = [F.substring("text", (F.floor(draw(k + 1) * (span + 1)) + 1).cast("int"), F.lit(self.window)) for k in range(self.pieces)]
        rows = rows.join(F.broadcast(rates), "lang").where(draw(0) < F.col("rate"))
        sample = rows.select("lang", F.array(*cut).alias("cut")).orderBy("lang", F.xxhash64("cut")).collect()
        number = {x: k for k, x in enumerate(labels)}
        seq, y = [], []
        for x in sample:
            for piece in x["cut"]:
                raw = np.frombuffer(piece.encode()[: self.window], np.uint8)
                seq.append(np.concatenate([raw, np.full(self.window - len(raw), PAD)]).astype(np.int16))
                y.append(number[x["lang"]])
        net = ByteGru(len(labels), self.hidden)
        y = np.array(y)
        seq = np.stack(seq)
        # languages weigh alike
        many = np.bincount(y, minlength=len(labels))
        take = np.concatenate([np.resize(np.flatnonzero(y == k), many.max()) for k in range(len(labels)) if many[k]])
        steps = max(self.steps, self.steps * len(labels) // 64)
        net.train(seq[take], y[take], steps, self.batch, self.rate)
        return labels, net.p

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, lang_pred, score for every row."""
        small_batches(docs.sparkSession)
        labels, params = self.fit(docs)
        shared = docs.sparkSession.sparkContext.broadcast((labels, params, self.hidden))
        width, at_once = self.window, max(1, 2048 * 64 // max(64, len(labels)))
        rows = docs.select("doc_id", held_out().alias("held_out"), "text")
        return rows.mapInArrow(
            lambda it: _label_batches(it, shared, width, at_once), "doc_id long, held_out boolean, lang_pred string, score double"
        )
