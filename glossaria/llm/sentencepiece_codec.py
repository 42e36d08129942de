"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

A marked word is a run of spaces (written as U+2581) and the characters up to the next space; no
piece reaches from one into the next, so words are encoded on their own. The distinct words of a
slice of texts are sorted, which is a depth-first walk of their trie: each word takes over the
forward states of the prefix that it shares with the one before it, and only its own suffix is computed.

The forward state of a position is its best last piece. For a unigram model that is the piece with
the greatest score sum (Viterbi). A BPE model's scores are merge ranks, whose sum does not give the
model's segmentation; there the state is the one piece that can follow the state at its start, where
"can follow" means that merging the two pieces' text gives back those two pieces. A prefix's encoding
determines it, so it is shared among words in the same way, and the result equals merging pair by pair.

Defined cases: null text gives null ids and null count; empty text gives no ids; a character without a piece
becomes its UTF-8 bytes, or the unknown piece in a model without byte pieces; U+2581 in a text
counts as a space and decodes to one; a word of any length is encoded whole; repeated rows
are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkernel as tk
from .common import lean, small_batches

MARK = "▁"
#: Words, and bytes of them, whose ids a worker keeps from slice to slice, some 40 MB.
CACHE_WORDS = 1 << 19
CACHE_BYTES = 1 << 24
_UNIGRAM, _BPE = 1, 2
_UNKNOWN, _CONTROL, _BYTE = 2, 3, 6  # piece types; 1 is normal, 4 user-defined, 5 unused


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    """(field, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n, form = (4, "<f") if kind == 5 else (8, "<d")
            value, i = struct.unpack(form, b[i : i + n])[0], i + n
        yield tag >> 3, value


class Model:
    """A model file's pieces, and the forward pass over words."""

    def __init__(self, raw: bytes):
        self.kind, self.prefix = _UNIGRAM, True
        pieces = []
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, 1)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                self.prefix = bool(norm.get(3, 1))
                if norm.get(4, 1) or norm.get(2, b""):
                    raise ValueError("models that normalize text are not supported")
        self.vocab = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == _UNKNOWN), 0)
        self.text = [
            bytes([int(p[1:-1], 16)]) if t == _BYTE else b"" if t == _CONTROL else " ⁇ ".encode() if t == _UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, t in pieces
        ]
        self.text_len = np.array([len(x) for x in self.text], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.piece = [p for p, _, _ in pieces]
        if self.kind == _BPE and any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("a piece reaches across words")
        tails: dict[str, set[int]] = {}
        for p in self.vocab:
            tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.worst = min((self.score[i] for i in self.vocab.values()), default=0.0) - 10.0
        self._forget()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, word: str) -> list[str]:
        """Merging of pairs, best score first, then leftmost: what a BPE model means. A heap of the pairs that have a piece."""
        s: list[str | None] = list(word)
        n, vocab, score = len(s), self.vocab, self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            pair = s[i] + s[j]
            k = vocab.get(pair)
            if k is not None:
                heapq.heappush(heap, (-score[k], i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            # Of date if either side has been merged since.
            if s[i] is None or s[j] is None or after[i] != j or s[i] + s[j] != pair:
                continue
            s[i], s[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in s if x is not None]

    def _follows(self, a: int, b: int) -> bool:
        """May piece b follow piece a (-1: the word's start) in a BPE segmentation?"""
        if a < 0:
            if b not in self.whole:
                self.whole[b] = len(self.merge(self.piece[b])) == 1
            return self.whole[b]
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            x, y = self.piece[a], self.piece[b]
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(x + y) == [x, y]
        return found

    def _char(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode()] if self.byte else [self.unknown]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted, distinct marked words."""
        out = []
        vocab, tails, bpe = self.vocab, self.tails, self.kind == _BPE
        score, follows, pairs = self.score, self._follows, self.pairs
        state = [-1]  # last piece of each prefix; None: a character without a piece
        start = [0]  # where it starts
        best = [0.0]
        before = ""
        for w in words:
            if bpe and w.startswith(MARK * 2):  # runs of spaces have pieces of equal score, whose order counts
                ids: list[int] = []
                for p in self.merge(w):
                    k = vocab.get(p)
                    ids.extend([k] if k is not None else self._char(p))
                out.append(ids)
                continue
            same, n = 0, min(len(before), len(w))
            while same < n and before[same] == w[same]:
                same += 1
            del state[same + 1 :], start[same + 1 :], best[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                tail = w[i - 2 : i] if i > 1 else w[:1]
                lens = tails.get(tail, ())
                if i > 1 and w[i - 1] in vocab:
                    lens = (*lens, 1)
                piece, at, top = None, i - 1, None
                for n in lens:
                    j = i - n
                    if j < 0:
                        continue
                    k = vocab.get(w[j:i])
                    if k is None:
                        continue
                    if bpe:
                        a = state[j]
                        if a is None or a < 0:
                            ok = follows(-1, k)
                        else:
                            ok = pairs.get(a << 24 | k)
                            if ok is None:
                                ok = follows(a, k)
                        if ok:
                            piece, at = k, j
                            break
                    else:
                        s = best[j] + score[k]
                        if top is None or s > top:
                            piece, at, top = k, j, s
                state.append(piece)
                start.append(at)
                best.append(top if top is not None else best[at] + self.worst)
            before = w
            ids, i = [], len(w)
            while i:
                k = state[i]
                if k is None:
                    ids.extend(reversed(self._char(w[start[i] : i])))
                else:
                    ids.append(k)
                i = start[i]
            ids.reverse()
            out.append(ids)
        return out

    def encode_slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice and their offsets."""
        n = len(off) - 1
        mark = np.frombuffer(MARK.encode(), np.uint8)
        if len(buf) > 2 and ((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2])).any():
            texts = [buf[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        if self.prefix:  # a space before every text that isn't empty
            full = off[1:] > off[:-1]
            buf = np.insert(buf, off[:-1][full], 32)
            off = off + np.concatenate([[0], np.cumsum(full)])
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        blank = buf == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[off[:-1][off[1:] > off[:-1]]] = True
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(buf))
        row = np.searchsorted(off, a, side="right") - 1
        words = self._words(buf, a, b)
        begin, lens = self.begin[words], self.lens[words]
        total = np.cumsum(lens)
        take = np.arange(int(total[-1])) + np.repeat(begin - (total - lens), lens)
        per = np.bincount(row, weights=lens, minlength=n).astype(np.int64)
        return self.flat[take], np.concatenate([[0], np.cumsum(per)])

    def _words(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each word of a slice in the table of known words; new words are encoded.

        Words are looked up by a 64-bit hash and then compared byte by byte with the word that the table holds: the words
        tile the slice, so one gather rebuilds it. Words of earlier slices are kept up to a fixed number, then forgotten.
        """
        if len(self.seen) > CACHE_WORDS or len(self.bytes) > CACHE_BYTES:
            self._forget()
        hashes, at, which = np.unique(tk.word_hashes(buf, a, b), return_index=True, return_inverse=True)
        place = np.searchsorted(self.seen, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.seen):
            new = self.seen[np.minimum(place, len(self.seen) - 1)] != hashes
        fresh = np.flatnonzero(new)
        if len(fresh):
            numbers = self._learn([buf[x:y].tobytes() for x, y in zip(a[at[fresh]].tolist(), b[at[fresh]].tolist(), strict=True)])
            self.seen = np.insert(self.seen, place[fresh], hashes[fresh])
            self.number = np.insert(self.number, place[fresh], numbers)
            place = np.searchsorted(self.seen, hashes)
        found = self.number[place][which]
        size = self.stop[found] - self.start[found]
        if (size == b - a).all():
            back = np.arange(len(buf)) + np.repeat(self.start[found] - a, size)
            if np.array_equal(self.bytes[back], buf):
                return found
        # Two words share a hash: this slice's words are told apart by their bytes.
        own: dict[bytes, int] = {}
        raw = [buf[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        new_words = list(dict.fromkeys(raw))
        for w, k in zip(new_words, self._learn(new_words).tolist(), strict=True):
            own[w] = k
        return np.fromiter((own[w] for w in raw), np.int64, len(raw))

    def _learn(self, raw: list[bytes]) -> np.ndarray:
        """Encodes distinct words and adds them to the table; their numbers."""
        words = [x.decode().replace(" ", MARK) for x in raw]
        order = sorted(range(len(words)), key=words.__getitem__)
        found = self.encode_words([words[i] for i in order])
        lens = np.fromiter(map(len, found), np.int64, len(found))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        begin = (np.cumsum(lens) - lens + len(self.flat))[place]
        ends = np.cumsum([len(x) for x in raw]) + len(self.bytes)
        numbers = np.arange(len(raw)) + len(self.begin)
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lens.sum()))])
        self.begin, self.lens = np.concatenate([self.begin, begin]), np.concatenate([self.lens, lens[place]])
        self.start = np.concatenate([self.start, np.concatenate([[len(self.bytes)], ends[:-1]])])
        self.stop = np.concatenate([self.stop, ends])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        return numbers

    def _forget(self) -> None:
        self.seen, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.begin, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start, self.stop = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode_slice(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of rows of ids; row i has ids[ends[i]:ends[i + 1]]. Piece bytes are gathered, with no loop over ids or rows."""
        lens = self.text_len[ids]
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        raw = self.text_bytes[np.arange(int(total[-1])) + np.repeat(self.text_at[ids] - total[:-1], lens)]
        off = total[ends]
        if self.prefix:  # the space that encoding put before the text
            first = off[:-1][off[1:] > off[:-1]]
            first = first[raw[first] == 32]
            raw = np.delete(raw, first)
            off = off - np.searchsorted(first, off)
        out = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # byte pieces that make no character
            out = pa.array([raw[x:y].tobytes().decode(errors="replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.large_string())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int64)
        return self.decode_slice(ids, np.array([0, len(ids)]))[0].as_py()


_MODELS: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    key = hash(raw)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(raw)
    return _MODELS[key]


def _list(ids: np.ndarray, ends: np.ndarray, null: pa.Array) -> pa.Array:
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
    return pc.if_else(null, pa.scalar(None, out.type), out)


def _encode(batches, shared, back: bool = False):
    """ids of the last column's texts; `back`: with the text that the ids decode to. Words are kept for a task: the worker may idle after it."""
    model = _model(shared.value)
    try:
        yield from _encoded(batches, model, back)
    finally:
        model._forget()


def _encoded(batches, model: Model, back: bool):
    for batch in batches:
        text, names = batch.column(batch.num_columns - 1), batch.schema.names[:-1]
        for i, j, buf, off in tk.slices(text, 1 << 20):
            ids, ends = model.encode_slice(buf, off)
            null = pc.is_null(text[i:j])
            out = [*[c[i:j] for c in batch.columns[:-1]], _list(ids, ends, null)]
            if back:
                again = model.decode_slice(ids, ends).cast(pa.string())
                out.append(pc.if_else(null, pa.scalar(None, pa.string()), again))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "ids", "text"][: len(out)])


def _decode(batches, shared):
    model = _model(shared.value)
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        for i in range(0, len(batch), 256):
            part = ids[i : i + 256]
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            text = model.decode_slice(part.flatten().to_numpy(zero_copy_only=False), ends).cast(pa.string())
            text = pc.if_else(part.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*[c[i : i + 256] for c in batch.columns[:-1]], text], names=[*batch.schema.names[:-1], "text"])


class SentencePieceCodec:
    """model_file is read on the driver and broadcast; a model is some MB at most."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            self.raw = f.read()

    def _run(self, rows: DataFrame, column: str, keep: tuple[str, ...], work, added: str) -> DataFrame:
        small_batches(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self.raw)
        cols = rows.select(*keep, column)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]), added])
        return cols.mapInArrow(lambda it: lean(work(it, shared)), schema)

    def encode(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The kept columns and ids (array of int) of every row."""
        return self._run(docs, text, keep, _encode, "ids array<int>")

    def decode(self, rows: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The kept columns and the text of every row's ids."""
        return self._run(rows, ids, keep, _decode, "text string")

    def round_trip(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The kept columns, ids and the text that those ids decode to, in one pass: ids don't go through the JVM between the two."""
        return self._run(docs, text, keep, lambda it, shared: _encode(it, shared, back=True), "ids array<int>, text string")
