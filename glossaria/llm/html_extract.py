"""Main-text extraction from HTML: a recurrent block labeller in numpy.

A page is cut into leaf blocks (runs of text between block-level tags), each with its path of open
tags, their class and id words, its text and the part of it inside links. A bidirectional LSTM
reads the page's sequence of block vectors (embedded hashed path words, mean of embedded hashed text words, a few
numbers) and gives every block a probability of being main text, in the light of the whole page.
Blocks of 0.5 and more are kept in page order, joined by an empty line.

The labeller is trained here, by backpropagation through time, on pages that a seeded generator
writes from varied layouts (where the article stands, what stands around it, in which tags and class
names), so labels are exact and no page of the corpus is needed.

Defined cases: null html and a page without main text give an empty text; a page cut off inside a tag or
character reference loses only that tag; unclosed and stray tags are tolerated: script, style, textarea and title
without an end tag run to the end of the page, as in browsers, of other skipped elements only the tag is skipped, and
head ends where <body> or anything shown begins; pages of any
length and depth are read whole, in time and memory that grow with the page (a block refers to its path, paths share the tags above); repeated rows give equal texts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .common import small_batches

# HTML's element categories.
TEXT_ONLY = frozenset("script style textarea title".split())
FALLBACK = frozenset("noscript iframe".split())
RAW = TEXT_ONLY | FALLBACK | frozenset("template object svg canvas audio video select option button datalist annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

# A start or end tag runs to the first > outside a quoted value. A quote opens a value only after =; anywhere else, and without its
# other end, it is a common character. Groups are possessive, so a page is read once.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=])*+)(?:>|(\Z))|<[!?/][^>]*(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in TEXT_ONLY | FALLBACK}
_RAW_START = {t: re.compile(rf"<{t}\b", re.I) for t in FALLBACK}


def _ends(page: str, at: int) -> dict[int, int]:
    """Where the skipped elements from `at` on end, by the end of their start tag; those without an end tag of their own are left out.

    One pass over the page: of every tag the next end tag is looked for once.
    """
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    following: dict[str, tuple[int, int]] = {}

    def closing(tag: str) -> tuple[int, int]:
        if following.get(tag, (-1, -1))[0] < at:
            done = _RAW_END[tag].search(page, at)
            following[tag] = done.span() if done else (len(page) + 1, 0)
        return following[tag]

    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag not in RAW or m[4] is not None:
            continue
        if m[1]:
            if open_.get(tag):
                ends[open_[tag].pop()] = at
        elif m[3].endswith("/"):
            continue
        elif tag in TEXT_ONLY:
            if not open_.get("svg"):  # within a picture they are common elements
                at = closing(tag)[1] or at
        elif tag in FALLBACK:
            start, stop = closing(tag)
            if stop and not _RAW_START[tag].search(page, at, start):
                ends[at] = stop
                at = stop
        else:
            open_.setdefault(tag, []).append(at)
    return ends


class Path:
    """The open tags at a place: the tag above, the words that no tag above has, the last two words, and the number of tags."""

    __slots__ = ("above", "new", "tail", "depth")

    def __init__(self, above: Path | None, new: tuple[str, ...], tail: tuple[str, ...]):
        self.above, self.new, self.tail = above, new, tail
        self.depth = above.depth + 1 if above else 0


class _Open:
    """The stack of open tags. A step costs what it adds or takes away, however many tags are open."""

    def __init__(self):
        self.path: Path | None = None
        self.tags: list[tuple[str, list[str]]] = []
        self.at: dict[str, list[int]] = {}
        self.held: dict[str, int] = {}

    def push(self, tag: str, names: list[str]) -> None:
        new = []
        for w in names:
            if not self.held.get(w):
                new.append(w)
            self.held[w] = self.held.get(w, 0) + 1
        tail = (*(self.path.tail if self.path else ()), *names)[-2:]
        self.path = Path(self.path, tuple(new), tail)
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append((tag, names))

    def top(self, tags) -> int:
        """The place of the innermost of some tags, -1 without any."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, names, stop=frozenset()) -> None:
        """Close the innermost of `names`, and all within it, unless one of `stop` stands further in."""
        place = self.top(names)
        if place < 0 or place < self.top(stop):
            return
        while len(self.tags) > place:
            tag, words = self.tags.pop()
            self.at[tag].pop()
            self.path = self.path.above
            for w in words:
                self.held[w] -= 1


_INNER = {tag: frozenset({"td", "th", "li", "div", "article", "section", "body"} - {tag}) for tag in BLOCK}


def blocks(page: str) -> list[tuple[Path | None, str, int]]:
    """(path, text, characters inside links) of the page's leaf blocks with text; time and memory grow with the page alone."""
    out: list[tuple[Path | None, str, int]] = []
    stack = _Open()
    text: list[str] = []
    linked = 0
    at, end = 0, len(page)
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html_lib.unescape("".join(text)).split())
            if whole:
                out.append((stack.path, whole, linked))
            text.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            linked += (end - at) * bool(stack.at.get("a"))
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * bool(stack.at.get("a"))
        at = m.end()
        tag = m[2]
        if tag is None or m[4] is not None:  # a comment, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            stack.close((tag,))
            continue
        if tag == "head":
            continue
        if tag in RAW:
            if m[3].endswith("/") or tag == "option":
                pass
            elif tag in TEXT_ONLY:
                done = _RAW_END[tag].search(page, at)
                at = done.end() if done else end
            else:
                if ends is None:
                    ends = _ends(page, m.start())
                at = ends.get(at, at)
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            stack.close(("p",), _INNER[tag])
            if tag in CLOSES:
                stack.close(*CLOSES[tag])
        elif tag == "br":
            text.append(" ")
        if tag in VOID or m[3].endswith("/"):
            continue
        names = [tag]
        for value in _NAMES.findall(m[3]):
            names += ["." + w for w in _WORD.findall(value.lower())]
        stack.push(tag, names)
    flush()
    return out


class BlockLstm:
    """Embeddings, two LSTMs and a logistic output. Sequences are (steps, pages, units)."""

    PATHS, WORDS, NUM = 1024, 2048, 8

    def __init__(self, hidden: int = 16, size: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        f4 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.h, self.e = hidden, size
        n = 2 * size + self.NUM
        self.p = {"path": f4(self.PATHS, size, scale=0.3), "word": f4(self.WORDS, size, scale=0.1), "o": f4(2 * hidden, 1, scale=0.3), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["w" + d] = f4(n + hidden, 4 * hidden, scale=1 / np.sqrt(n + hidden))
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)

    def _tree(self, paths: list[Path | None]) -> dict:
        """Rows of a tree of paths, those above first, with the numbers of their new words; and the row of every block."""
        rows: dict[Path | None, int] = {None: 0}
        order: list[Path] = []
        for p in paths:
            chain = []
            while p not in rows:
                rows[p] = -1
                chain.append(p)
                p = p.above
            for p in reversed(chain):
                order.append(p)
                rows[p] = len(order)
        new = [[crc32(w.encode()) % self.PATHS for w in p.new] for p in order]
        return {
            "above": np.array([0, *(rows[p.above] for p in order)]),
            "depth": np.array([0, *(p.depth + 1 for p in order)]),
            "path": np.array([x for ids in new for x in ids], np.int64),
            "n_path": np.array([0, *map(len, new)]),
            "row": np.array([rows[p] for p in paths], np.int64),
        }

    def _path_means(self, f: dict) -> np.ndarray:
        """Mean vector of the words on each block's path: a tag's sum is that of the tag above and its new words'."""
        n, table = f["n_path"], self.p["path"]
        total, count = np.zeros((len(n), self.e), np.float32), n.astype(np.float32)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(table[f["path"]], (np.cumsum(n) - n)[some])
        order = np.argsort(f["depth"], kind="stable")
        edge = np.searchsorted(f["depth"][order], np.arange(2, int(f["depth"].max()) + 2))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            at = order[a:b]
            total[at] += total[f["above"][at]]
            count[at] += count[f["above"][at]]
        out = (total / np.maximum(count, 1)[:, None])[f["row"]]
        out[count[f["row"]] == 0] = table[0]  # outside of all tags
        return out

    def features(self, found: list) -> dict:
        """Index arrays and numbers of blocks (any number, of any pages). Paths are all of pages, or all tuples of words, as training has them."""
        tuples = not found or isinstance(found[0][0], tuple)
        tails = [p[-2:] if tuples else p.tail if p else () for p, _, _ in found]
        paths = [[crc32(w.encode()) % self.PATHS for w in dict.fromkeys(p)] or [0] for p, _, _ in found] if tuples else []
        raw = [t.encode() for _, t, _ in found]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        a, b, row = tk.word_spans(buf, off)
        words = (tk.word_hashes(buf, a, b, tk.LOWER) % np.uint64(self.WORDS)).astype(np.int64)
        n_words = np.bincount(row, minlength=len(found))
        chars = np.array([len(t) for _, t, _ in found], np.float32)
        link = np.array([x for _, _, x in found], np.float32)
        ends = np.array([t[-1] in ".!?:;\"'”’)" for _, t, _ in found], np.float32)
        num = np.zeros((len(found), self.NUM), np.float32)
        num[:, 0], num[:, 1] = np.minimum(np.log1p(chars) / 5, 2), np.minimum(np.log1p(n_words) / 4, 2)
        num[:, 2], num[:, 3] = np.minimum(link / np.maximum(chars, 1), 1), ends
        num[:, 4] = [p[-1:] == ("a",) or "li" in p for p in tails]
        num[:, 5] = [len(p) > 0 and len(p[-1]) == 2 and p[-1][0] == "h" for p in tails]
        num[:, 6], num[:, 7] = n_words < 4, 1
        said = {"word": words, "n_word": n_words, "num": num}
        if not tuples:
            return self._tree([p for p, _, _ in found]) | said
        return {"path": np.concatenate([np.array(x) for x in paths]), "n_path": np.array([len(x) for x in paths])} | said

    def _embed(self, f: dict) -> np.ndarray:
        def mean(table, index, count):
            out = np.zeros((len(count), self.e), np.float32)
            some = count > 0
            if some.any():
                begin = (np.cumsum(count) - count)[some]
                step = 1 << 18  # bounded working memory: whole blocks at a time
                if len(index) <= step:
                    out[some] = np.add.reduceat(table[index], begin)
                else:
                    rows = np.flatnonzero(some)
                    k = 0
                    while k < len(rows):
                        stop = max(k + 1, int(np.searchsorted(begin, begin[k] + step)))
                        last = int(begin[stop]) if stop < len(rows) else len(index)
                        out[rows[k:stop]] = np.add.reduceat(table[index[begin[k] : last]], begin[k:stop] - begin[k])
                        k = stop
            return out / np.maximum(count, 1)[:, None]

        paths = (self._path_means(f) if "above" in f else mean(self.p["path"], f["path"], f["n_path"])) * 3
        return np.concatenate([paths, mean(self.p["word"], f["word"], f["n_word"]), f["num"]], axis=1)

    def _run(self, d: str, x: np.ndarray, on: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (T, B, n), on (T, B) 1 for blocks and 0 for padding, where the state stays zero."""
        T, B, _ = x.shape
        H, w, bias = self.h, self.p["w" + d], self.p["c" + d]
        h = c = np.zeros((B, H), np.float32)
        out = np.zeros((T, B, H), np.float32)
        n = x.shape[2]
        xw = x @ w[:n] + bias
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = xw[t] + h @ w[n:]
            g = 1 / (1 + np.exp(-z[:, : 3 * H]))
            a = np.tanh(z[:, 3 * H :])
            i, f, o = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :]
            was_h, was_c = h, c
            m = on[t][:, None]
            c = (f * c + i * a) * m
            th = np.tanh(c)
            h = o * th * m
            out[t] = h
            if keep is not None:
                keep.append((t, was_h, was_c, i, f, o, a, th, m))
        return out

    def _both(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """What _run gives of both directions, side by side, in one loop over steps (a logistic function is a scaled tanh)."""
        T, B, n = x.shape
        H = self.h
        half = np.concatenate([np.full(3 * H, 0.5), np.ones(H)]).astype(np.float32)
        w, bias = np.stack([self.p["wf"], self.p["wb"]]) * half, np.stack([self.p["cf"], self.p["cb"]]) * half
        xw, m = np.empty((T, 2, B, 4 * H), np.float32), np.empty((T, 2, B, 1), np.float32)
        for k, way in ((0, slice(None)), (1, slice(None, None, -1))):
            xw[:, k], m[:, k, :, 0] = (x @ w[k, :n] + bias[k])[way], on[way]
        u, full = w[:, n:].copy(), bool(on.all())
        out = np.empty((T, 2, B, H), np.float32)
        h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        z, part = np.empty((2, B, 4 * H), np.float32), np.empty((2, B, H), np.float32)
        g, i, f, o, a = z[..., : 3 * H], z[..., :H], z[..., H : 2 * H], z[..., 2 * H : 3 * H], z[..., 3 * H :]
        for t in range(T):
            np.matmul(h, u, out=z)
            z += xw[t]
            np.tanh(z, out=z)
            g *= 0.5
            g += 0.5
            c *= f
            np.multiply(i, a, out=part)
            c += part
            if not full:
                c *= m[t]
            h = np.multiply(np.tanh(c, out=part), o, out=out[t])
            if not full:
                h *= m[t]
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)

    def probabilities(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        s = self._both(x, on)
        return 1 / (1 + np.exp(-(s @ self.p["o"] + self.p["ob"])[..., 0]))

    def train(self, pages: list[list], labels: list[list[int]], steps: int = 220, batch: int = 24, rate: float = 0.02, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        feats = [self.features(p) for p in pages]
        order = np.argsort([len(p) for p in pages], kind="stable")
        for step in range(1, steps + 1):
            k = int(rng.integers(0, max(1, len(order) - batch + 1)))
            pick = order[k : k + batch]
            f = {key: np.concatenate([feats[i][key] for i in pick]) for key in feats[0]}
            lens = [len(pages[i]) for i in pick]
            T, B = max(lens), len(pick)
            rows = np.concatenate([np.arange(n) for n in lens]), np.repeat(np.arange(B), lens)
            flat = self._embed(f)
            hide = (rng.random((len(flat), 1)) < 0.5) * np.float32(1)  # half of the blocks are judged without their words
            flat[:, self.e : 2 * self.e] *= 1 - hide
            x, on, y = np.zeros((T, B, flat.shape[1]), np.float32), np.zeros((T, B), np.float32), np.zeros((T, B), np.float32)
            x[rows], on[rows], y[rows] = flat, 1, np.concatenate([labels[i] for i in pick])
            kept = {"f": [], "b": []}
            s = np.concatenate([self._run(d, x, on, kept[d]) for d in "fb"], axis=2)
            p = 1 / (1 + np.exp(-(s @ self.p["o"] + self.p["ob"])[..., 0]))
            dz = ((p - y) * on / on.sum())[..., None]
            g = {"o": np.einsum("tbh,tbo->ho", s, dz), "ob": dz.sum(axis=(0, 1))}
            ds = dz @ self.p["o"].T
            dx = np.zeros_like(x)
            for d, part in (("f", ds[..., : self.h]), ("b", ds[..., self.h :])):
                g["w" + d], g["c" + d], more = self._back(d, x, kept[d], part)
                dx += more
            flat = dx[rows]
            g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
            for key, a, scale in (("path", 0, 3.0), ("word", self.e, None)):
                count = f["n_" + key]
                part = flat[:, a : a + self.e] * (scale if key == "path" else 1 - hide) / np.maximum(count, 1)[:, None]
                np.add.at(g[key], f[key], np.repeat(part, count, axis=0))
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for key, q in g.items():
                q = q / max(1.0, norm)
                m[key] = 0.9 * m[key] + 0.1 * q
                v[key] = 0.99 * v[key] + 0.01 * q * q
                self.p[key] = (self.p[key] - lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _back(self, d: str, x: np.ndarray, kept: list, top: np.ndarray):
        H, w = self.h, self.p["w" + d]
        n = x.shape[2]
        gw, dx = np.zeros_like(w), np.zeros_like(x)
        gb = np.zeros(4 * H, np.float32)
        dh, dc = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
        for t, h, c, i, f, o, a, th, m in reversed(kept):
            dh = (dh + top[t]) * m
            dc = (dc + dh * o * (1 - th * th)) * m
            dz = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            gw[:n] += x[t].T @ dz
            gw[n:] += h.T @ dz
            gb += dz.sum(axis=0)
            dx[t] = dz @ w[:n].T
            dh, dc = dz @ w[n:].T, dc * f
        return gw, gb, dx

    def label(self, pages: list[list], cells: int = 1 << 14) -> list[np.ndarray]:
        """Probability of every block of every page; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        k = 0
        while k < len(order):
            stop = k + 1
            while stop < len(order) and (stop + 1 - k) * len(pages[order[stop]]) <= cells:
                stop += 1
            pick = order[k:stop]
            lens = [len(pages[i]) for i in pick]
            flat = self._embed(self.features([b for i in pick for b in pages[i]]))
            x, on = np.zeros((max(lens), len(pick), flat.shape[1]), np.float32), np.zeros((max(lens), len(pick)), np.float32)
            rows = np.concatenate([np.arange(n) for n in lens]), np.repeat(np.arange(len(pick)), lens)
            x[rows], on[rows] = flat, 1
            p = self.probabilities(x, on)
            for j, i in enumerate(pick):
                out[i] = p[: lens[j], j]
            k = stop
        return out


class PageWriter:
    """Writes training pages of varied layout with the label of every block."""

    # Names that sites give to their parts.
    MAIN = ["article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.article-body", "div.story", "div#main-text", "div.post-body"]
    AROUND = {
        "nav": ["nav", "div.menu", "ul.nav", "div#navigation", "div.navbar", "ul.menu", "nav.breadcrumb", "div.breadcrumbs"],
        "head": ["header", "div.header", "div#masthead", "header.site-header", "div.topbar"],
        "foot": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom"],
        "side": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "div.widget", "section.related-posts", "div.share", "div.tags"],
        "note": ["div.cookie-notice", "div.notice", "div.cookie-banner", "div#gdpr", "div.alert", "div.popup", "div.newsletter", "section.consent"],
        "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.sponsored", "aside.ad", "div.promo", "ins.ad"],
        "form": ["form", "form.search", "form#subscribe", "form.login", "div.search-form"],
        "talk": ["div.comments", "section#comments", "ol.comment-list", "div.comment", "div#disqus", "ul.comments", "section.comments", "div.responses"],
    }
    SAID = {
        "nav": "home about contact news menu archive blog shop help",
        "head": "welcome sign in log in register search subscribe",
        "foot": "© copyright all rights reserved privacy policy terms imprint contact",
        "side": "related popular read more latest tags share follow archive",
        "note": "we use cookies accept this site uses cookies agree settings consent",
        "ad": "advertisement sponsored buy now offer sale click here",
        "form": "name email password search submit subscribe send",
        "talk": "reply comments said wrote ago thanks great post",
    }

    def __init__(self, seed: int = 9):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def words(self, n: int, kind: str = "") -> str:
        r = self.rng
        letters = "abcdefghilmnoprstuvéäöñç"
        w = ["".join(letters[i] for i in r.integers(0, len(letters), int(r.integers(1, 10)))) for _ in range(n)]
        if kind and r.random() < 0.6:
            said = self.SAID[kind].split()
            for i in r.integers(0, n, max(1, n // 3)):
                w[i] = self.pick(said)
        if r.random() < 0.1:
            w = [x + self.pick(["***", "$$$", "###", "!!", " |"]) for x in w]
        s = " ".join(w).capitalize()
        return s + ("." if n > 4 or r.random() < 0.3 else "")

    @staticmethod
    def open(name: str) -> tuple[str, tuple[str, ...]]:
        tag, _, cls = name.partition(".")
        tag, _, own = tag.partition("#")
        return tag, (tag, *("." + w for w in _WORD.findall(cls or own)))

    def around(self, kind: str, path: tuple) -> list:
        r = self.rng
        _, names = self.open(self.pick(self.AROUND[kind]))
        path = path + names
        out = []
        n = int(r.integers(1, 10)) if kind in ("nav", "side", "talk") else int(r.integers(1, 3))
        for _ in range(n):
            t = self.words(int(r.integers(1, 4)) if kind == "nav" else int(r.integers(1, 9)) if kind != "talk" else int(r.integers(2, 40)), kind)
            if kind == "nav" or (kind in ("side", "foot") and r.random() < 0.5):
                out.append(((*path, "ul", "li", "a") if "ul" not in path else (*path, "li", "a"), t, len(t)))
            else:
                inner = self.pick([(), ("p",), ("div",), ("span",), ("label",), ("h3",)])
                out.append((path + inner, t, 0))
        return [(b, 0) for b in out]

    def page(self) -> tuple[list, list[int]]:
        r = self.rng
        body = ("html", "body")
        if r.random() < 0.4:
            body += self.pick([("div", ".wrapper"), ("div", ".container"), ("div",), ("div", ".page")])
        _, main = self.open(self.pick(self.MAIN) if r.random() < 0.6 else "article")
        row: list = []
        for kind in ("head", "nav", "note", "ad", "side"):
            if r.random() < (0.8 if kind == "nav" else 0.35):
                row += self.around(kind, body)
        path = body + (("main",) if r.random() < 0.2 else ()) + main
        if r.random() < 0.95:
            text: list = []
            if r.random() < 0.8:
                inner = ("header",) if r.random() < 0.1 else ()
                text.append(((path + inner + (self.pick(["h1", "h1", "h2"]),), self.words(int(r.integers(1, 12))), 0), 1))
            n = int(r.integers(1, 12)) if r.random() < 0.85 else int(r.integers(12, 70))
            for _ in range(n):
                inner = self.pick([("p",)] * 9 + [("p", "b"), ("h2",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("div",), ("figure", "figcaption")])
                t = self.words(int(r.integers(1, 60)) if inner[0] != "h2" else int(r.integers(1, 7)))
                text.append(((path + inner, t, 0 if r.random() < 0.85 else int(len(t) * r.random())), 1))
                if r.random() < 0.06:
                    text += self.around(self.pick(["ad", "side", "note", "form"]), path)
            row += text
        for kind in ("side", "ad", "form", "talk", "nav", "note", "foot"):
            if r.random() < (0.8 if kind == "foot" else 0.3):
                row += self.around(kind, path if kind in ("talk", "side") and r.random() < 0.15 else body)
        return [b for b, _ in row], [y for _, y in row]


@lru_cache(maxsize=2)
def train(pages: int = 1000, steps: int = 420, seed: int = 9) -> BlockLstm:
    writer, net = PageWriter(seed), BlockLstm()
    made = [x for x in (writer.page() for _ in range(pages)) if x[0]]
    net.train([b for b, _ in made], [y for _, y in made], steps=steps)
    return net


def extract(net: BlockLstm, pages: list[str | None]) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    return ["\n\n".join(b[1] for b, p in zip(f, prob, strict=True) if p >= 0.5) for f, prob in zip(found, net.label(found), strict=True)]


def _extract(batches, shared):
    net = BlockLstm()
    net.p = shared.value
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            text = extract(net, part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


class MainText:
    def __init__(self, net: BlockLstm | None = None):
        self.net = net or train()

    def extract(self, pages: DataFrame) -> DataFrame:
        """page_id, url, text, n_chars of every row."""
        small_batches(pages.sparkSession)
        shared = pages.sparkSession.sparkContext.broadcast(self.net.p)
        return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extract(it, shared), "page_id long, url string, text string, n_chars long")
