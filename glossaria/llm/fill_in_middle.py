"""Fill-in-middle transformation with a sparse checkpoint index over each text.

A text is a run of units (`[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`, and white space at its end). While the units are counted, the byte and
code-point offsets after every `every`-th unit are recorded. A cut after k units is found by a binary search of these checkpoints and a
short scan from the one before it: at most `every` units are read again. No unit but the checkpoints is ever stored, and a text is read
in pieces of `piece` bytes, so working memory is a piece, the text itself, and two numbers for every `every` units.

Where a text is cut and in which form it is written follows from SHA-256 of the seed and doc_id alone, so any rerun or lost
executor gives the same rows. Rows stay where they are: there is no shuffle.

Defined cases: null text is empty; an empty text, and one that holds a marker, stays plain; a null doc_id counts as an empty one; a
text without white space is one unit, so a cut falls before or after it; repeated rows give equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches

#: Markers of prefix, suffix and middle. None may begin inside another one: each starts with < and holds no other.
MARKERS = ("<P>", "<S>", "<M>")


def unit_ends(buf: np.ndarray, at: int, stop: int) -> np.ndarray:
    """Offsets behind the units that end in buf[at:stop]. A unit ends with a word's last byte, or with the text."""
    ink = ~tk.IS_SPACE[buf[at : stop + 1]]
    last = ink[: stop - at].copy()
    if stop == len(buf):
        last[:-1] &= ~ink[1:]
        last[-1:] = True
    else:
        last &= ~ink[1:]
    return np.flatnonzero(last) + at + 1


def _points(part: np.ndarray) -> np.ndarray:
    """1 for every byte that begins a code point."""
    return (part & 0xC0) != 0x80


class Checkpoints:
    """Units and code points of a text, and the byte and code-point offsets behind every `every`-th unit."""

    def __init__(self, buf: np.ndarray, every: int = 256, piece: int = 1 << 16):
        self.buf, self.every = buf, every
        self.units = self.points = 0
        at_bytes, at_points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(buf), piece):
            stop = min(at + piece, len(buf))
            ends = unit_ends(buf, at, stop)
            marks = ends[every - 1 - self.units % every :: every]
            lead = _points(buf[at:stop])
            if len(marks):
                at_bytes.append(marks)
                at_points.append(self.points + np.cumsum(lead, dtype=np.int64)[marks - at - 1])
            self.units += len(ends)
            self.points += int(np.count_nonzero(lead))
        self.bytes, self.chars = np.concatenate(at_bytes), np.concatenate(at_points)
        self.numbers = np.arange(len(self.bytes)) * every

    def cut(self, k: int, step: int = 1 << 12) -> tuple[int, int]:
        """(byte, code point) offsets behind the first k units."""
        i = int(np.searchsorted(self.numbers, k, side="right")) - 1
        units, at, points = int(self.numbers[i]), int(self.bytes[i]), int(self.chars[i])
        while units < k:
            stop = min(at + step, len(self.buf))
            ends = unit_ends(self.buf, at, stop)
            if units + len(ends) >= k:
                stop = int(ends[k - units - 1])
                units = k
            else:
                units += len(ends)
            points += int(np.count_nonzero(_points(self.buf[at:stop])))
            at = stop
        return at, points


class FillInMiddle:
    """rate: percent of the texts that are rearranged; spm: percent of those that are written suffix first; every: units between checkpoints."""

    def __init__(self, rate: int = 50, spm: int = 80, seed: int = 42, every: int = 256):
        self.rate, self.spm, self.seed, self.every = rate, spm, seed, every

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four numbers below 2^32 of a document."""
        digest = sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))

    def rearrange(self, doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """(units, form, code points of the prefix, of the middle, output) of one text in UTF-8."""
        index = Checkpoints(np.frombuffer(text, np.uint8), self.every)
        h1, h2, h3, h4 = self.draws(doc_id)
        p, s, m = (x.encode() for x in MARKERS)
        if not text or h3 % 100 >= self.rate or p in text or s in text or m in text:
            return index.units, "plain", None, None, text
        first, second = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
        (a, a_points), (b, b_points) = index.cut(first), index.cut(second)
        parts = (p, text[:a], s, text[b:], m) if h4 % 100 >= self.spm else (s, text[b:], p, text[:a], m)
        return index.units, "psm" if parts[0] == p else "spm", a_points, b_points - a_points, b"".join((*parts, text[a:b]))

    def _rows(self, batches):
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1)):
                ids = batch.column(0)[i:j]
                whole = buf.tobytes()
                out = [self.rearrange(d, whole[a:b]) for d, a, b in zip(ids.to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
                n, form, prefix, middle, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    def transform(self, docs: DataFrame) -> DataFrame:
        """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, the text as written for training."""
        small_batches(docs.sparkSession)
        return docs.select("doc_id", "text").mapInArrow(self._rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text, from an output and its form. A marker can't begin within a part, nor where a part and a marker meet, so the first one found is it."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    prefix, suffix, middle = MARKERS

    def split(second: str):
        rest = F.substring(output, F.lit(len(prefix) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + 1 + len(second), F.length(rest))
        two = F.substring_index(rest, middle, 1)
        return one, two, F.substring(rest, F.length(two) + 1 + len(middle), F.length(rest))

    before, after, between = split(suffix)
    psm = F.concat(before, between, after)
    after, before, between = split(prefix)
    spm = F.concat(before, between, after)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
