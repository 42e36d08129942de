"""Parts of speech from context: a bigram hidden Markov model, learned from the corpus without tags.

Tags are the index's own. Words of closed classes can only have their class, so they are fixed points; other words can have an open class
(noun, verb, adjective, adverb), told at first by their ending alone. Frequent words are symbols of their own (the `most` most frequent, a bound of the
model's size), others stand for their ending. A line of words is a sequence.

Learning is Baum and Welch's: every round is one distributed pass in which tasks run forward and backward over their lines and give the sums
of what they expect, matrices of a fixed size that are added up. Decoding is Viterbi's, line by line, where the lines are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textops as t
from ..functions.lexicon import CLOSED, ENDINGS, STOP_WORDS
from . import tokens as tk
from . import units as un
from .index import POS

#: Classes that any word outside of the closed ones can have.
OPEN = ("n", "v", "adj", "adv")
_N = len(POS)
_ENDS = ("ly", "ous", "ful", "ive", "able", "ible", "al", "ic", "less", "ish", "ing", "ed", "ize", "ise", "ify", "ate", "tion", "ment", "ness", "ity", "er", "or", "est", "es", "s", "y", "e")


def fixed() -> dict[str, str]:
    """word -> its class, of the closed classes."""
    return {w: pos for pos, words in CLOSED.items() for w in words.split()}


class Model:
    """start (tags), move (tags x tags), say (tags x symbols): probabilities. The last symbols are the endings and the rest."""

    def __init__(self, words: list[str], start=None, move=None, say=None):
        closed = fixed()
        self.words = sorted(set(words) | set(closed))
        self.number = {w: i for i, w in enumerate(self.words)}
        n = len(self.words) + len(_ENDS) + 1
        self.start = np.full(_N, 1 / _N) if start is None else start
        self.move = np.full((_N, _N), 1 / _N) if move is None else move
        if say is None:
            # Every class says a symbol as often as its words are of the class by their form, with some room for other open classes.
            say = np.zeros((_N, n))
            rows = [POS.index(p) for p in OPEN]
            for i, w in enumerate([*self.words, *_ENDS, ""]):
                if w in closed:
                    say[POS.index(closed[w]), i] = 1
                else:
                    say[rows, i] = 0.1
                    say[POS.index(by_ending(w)), i] = 0.7
            say /= np.maximum(say.sum(axis=1, keepdims=True), 1e-300)
        self.say = say
        self._logs = None

    def symbols(self, words: list[str]) -> np.ndarray:
        return np.array([self.number[w] if w in self.number else len(self.words) + ending(w) for w in words], np.int64)

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of start, move and say, worked out once a process."""
        if self._logs is None:
            with np.errstate(divide="ignore"):
                self._logs = np.log(self.start), np.log(self.move), np.log(self.say)
        return self._logs

    def lines_of(self, column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        """The symbols of every list of words, and the ends of the lists: a batch's words are looked up once each."""
        ends = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int32)
        words = column.flatten().dictionary_encode()
        known = self.symbols([w.lower() for w in words.dictionary.to_pylist()])
        flat = known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], ends


def by_ending(word: str) -> str:
    return next((pos for pos, pattern in ENDINGS if re.search(pattern, word)), "n")


def ending(word: str) -> int:
    """The number of the first known ending."""
    return next((i for i, e in enumerate(_ENDS) if len(word) > len(e) + 1 and word.endswith(e)), len(_ENDS))


def _side_by_side(lines: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of lines that hold a word, shortest first, in groups whose padded size is bounded."""
    order = sorted((i for i, x in enumerate(lines) if len(x)), key=lambda i: len(lines[i]))
    k = 0
    while k < len(order):
        stop = k + 1
        while stop < len(order) and (stop + 1 - k) * len(lines[order[stop]]) <= 1 << 15:
            stop += 1
        yield order[k:stop]
        k = stop


def _padded(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (words x lines) and whether there is a word."""
    obs, on = np.zeros((len(part[-1]), len(part)), np.int64), np.zeros((len(part[-1]), len(part)), bool)
    for j, x in enumerate(part):
        obs[: len(x), j], on[: len(x), j] = x, True
    return obs, on


def expected(model: Model, lines: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and symbols, and the log-likelihood, over lines of symbols; counts: how often each line stands. Lines of like length run side by side."""
    start, move, say, total = np.zeros(_N), np.zeros((_N, _N)), np.zeros_like(model.say), 0.0
    for group in _side_by_side(lines):
        obs, on = _padded([lines[i] for i in group])
        (T, B), often = obs.shape, np.ones(len(group)) if counts is None else counts[group].astype(float)
        emit = model.say.T[obs]  # T, B, tags
        ahead, scale = np.zeros((T, B, _N)), np.ones((T, B))
        a = np.broadcast_to(model.start, (B, _N))
        for s in range(T):
            a = (a if s == 0 else a @ model.move) * emit[s]
            scale[s] = np.maximum(a.sum(axis=1), 1e-300)
            a = a / scale[s][:, None]
            ahead[s] = a
        total += float((np.log(scale) * on * often).sum())
        back, each = np.ones((B, _N)), np.zeros((T, B, _N))
        for s in range(T - 1, -1, -1):
            live = on[s][:, None]
            g = ahead[s] * back
            each[s] = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300) * (on[s] * often)[:, None]
            if s == 0:
                start += each[0].sum(axis=0)
            else:
                after = emit[s] * back * live / scale[s][:, None]
                move += model.move * (ahead[s - 1].T @ (after * often[:, None]))
                # A line that is over keeps 1 until its last word is reached.
                back = np.where(live > 0, after @ model.move.T, 1.0)
        for i in range(_N):
            say[i] += np.bincount(obs.ravel(), weights=each[:, :, i].ravel(), minlength=say.shape[1])
    return start, move, say, total


def best_of(model: Model, lines: list[np.ndarray]) -> list[np.ndarray]:
    """best() of many lines, those of like length side by side."""
    start, move, say = model.logs()
    out = [np.zeros(0, np.int8)] * len(lines)
    for group in _side_by_side(lines):
        obs, on = _padded([lines[i] for i in group])
        T, B = obs.shape
        p, back = start + say.T[obs[0]], np.zeros((T, B, _N), np.int8)
        for s in range(1, T):
            top = p[:, :1] + move[0]
            for i in range(1, _N):
                q = p[:, i : i + 1] + move[i]
                back[s][q > top] = i  # of equals the first
                top = np.maximum(top, q)
            p = np.where(on[s][:, None], top + say.T[obs[s]], p)
        tags, at, row = np.zeros((T, B), np.int8), p.argmax(axis=1), np.arange(B)
        for s in range(T - 1, -1, -1):
            tags[s] = at
            at = np.where(on[s], back[s][row, at], at) if s else at
        for j, i in enumerate(group):
            out[i] = tags[: len(lines[i]), j]
    return out


def best(model: Model, symbols: np.ndarray) -> list[int]:
    """The likeliest sequence of tags; of equals the one whose tags come first."""
    if not len(symbols):
        return []
    p, move, say = model.logs()
    p = p + say[:, symbols[0]]
    back = []
    for o in symbols[1:]:
        q = p[:, None] + move
        back.append(q.argmax(axis=0))
        p = q.max(axis=0) + say[:, o]
    at = int(p.argmax())
    tags = [at]
    for b in reversed(back):
        at = int(b[at])
        tags.append(at)
    return tags[::-1]


def _sequences(papers: DataFrame, clean: bool, min_ratio: float | None) -> DataFrame:
    """paper_idx, year, section, line_no, line, words: the word runs of every line with enough English."""
    rows = tk.lines(papers, clean)
    if min_ratio is not None:
        rows = rows.where(t.en_ratio("line", clean) > min_ratio)
    return rows.withColumn("words", t.runs("line")).where(F.size("words") > 0).drop("line")


class Tagger:
    """most: words that are symbols of their own; rounds: passes of learning; floor: what a class may always say or move to, in expected counts."""

    def __init__(self, most: int = 4096, rounds: int = 4, floor: float = 0.01):
        self.most, self.rounds, self.floor = most, rounds, floor

    def fit(self, papers: DataFrame, clean: bool = True, min_ratio: float | None = 0.3) -> tuple[Model, list[float]]:
        """The model learned from all lines of the papers, and the log-likelihood before each round and after the last."""
        lines = _sequences(papers, clean, min_ratio).select(F.transform("words", F.lower).alias("words"))
        # Equal lines count together: the passes read distinct lines, kept by the session while it learns.
        lines = lines.groupBy("words").agg(F.count("*").alias("n")).persist()
        try:
            seen = lines.select(F.explode("words").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(self.most)
            model, told = Model([r["w"] for r in seen.collect()]), []
            for k in range(self.rounds + 1):
                start, move, say, likely = self._round(lines, model)
                told.append(likely)
                if k == self.rounds:
                    break
                norm = lambda x, floor: (x + floor) / np.maximum((x + floor).sum(axis=-1, keepdims=True), 1e-300)
                floor = np.where(model.say > 0, self.floor, 0.0)  # what a class can't say it never learns
                model = Model(model.words, norm(start, self.floor), norm(move, self.floor), norm(say, floor))
        finally:
            lines.unpersist()
        return model, told

    @staticmethod
    def _round(lines: DataFrame, model: Model):
        shared = lines.sparkSession.sparkContext.broadcast(model)
        size = _N + _N * _N + model.say.size + 1

        def work(batches) -> Iterator[pa.RecordBatch]:
            net, sums = shared.value, np.zeros(size)
            for batch in batches:
                got = expected(net, net.lines_of(batch.column(0))[0], batch.column(1).to_numpy())
                sums += np.concatenate([got[0], got[1].ravel(), got[2].ravel(), [got[3]]])
            at = np.flatnonzero(sums)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(sums[part])], names=["at", "x"])

        rows = lines.mapInArrow(work, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # as large as the model
        shared.unpersist()
        flat = np.zeros(size)
        flat[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
        a, b = _N, _N + _N * _N
        return flat[:a], flat[a:b].reshape(_N, _N), flat[b:-1].reshape(_N, -1), float(flat[-1])

    @staticmethod
    def tag(model: Model, papers: DataFrame, clean: bool = True, min_ratio: float | None = 0.3) -> DataFrame:
        """paper_idx, year, section, line_no, tok_idx, word, pos of every word run of lines with enough English."""
        rows = _sequences(papers, clean, min_ratio)
        shared = papers.sparkSession.sparkContext.broadcast(model)
        at = rows.columns.index("words")

        def work(batches):
            net = shared.value
            for batch in batches:
                lines, ends = net.lines_of(batch.column(at))
                flat = np.concatenate([np.zeros(0, np.int8), *best_of(net, lines)])
                tags = pa.DictionaryArray.from_arrays(pa.array(flat, pa.int8()), pa.array(POS)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), tags)], names=[*batch.schema.names, "tags"])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = rows.mapInArrow(work, f"{shape}, tags array<string>")
        rows = rows.select("paper_idx", "year", "section", "line_no", F.posexplode(F.arrays_zip("words", "tags")).alias("tok_idx", "x"))
        return rows.select("paper_idx", "year", "section", "line_no", "tok_idx", F.col("x.words").alias("word"), F.col("x.tags").alias("pos"))


def tagged_cells(papers: DataFrame, model: Model, stop_words=None, clean: bool = True, min_ratio: float | None = 0.3) -> DataFrame:
    """tokens.cells() with a part of speech for every place of a word, in place of one for every word."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    rows = Tagger.tag(model, papers, clean, min_ratio).where(t.is_token(F.col("word"))).withColumn("low", F.lower("word")).where(f"NOT {t.within('low', stop)}")
    rows = rows.groupBy("low", "pos", "year", "section").agg(F.min(tk.place()).alias("place"), F.count("*").alias("n_tokens"))
    names = tk.named(rows, stop).drop("pos")
    bits = tk.or_bits(un.marked(rows, un.numbered(papers)), "low", "pos")
    return bits.join(names, "low").withColumnRenamed("low", "word")
