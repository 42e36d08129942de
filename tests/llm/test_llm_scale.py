"""What must not grow with the square of a page, of the centroids, or of a shingle's documents; and the labeller against a plain version."""

import random

import numpy as np
import pytest

pytest.importorskip("glossaria.llm")
from glossaria.llm.embedding_dedup import _guests
from glossaria.llm.html_extract import BlockLstm, Path, blocks
from glossaria.llm.ngram_join import NgramJaccardJoin


def above(path):
    out = []
    while path is not None:
        out.append(path)
        path = path.above
    return out


def test_deep_pages_hold_each_tag_once():
    for page in ('<div class="a b">x</span>' * 30_000, "<font>x<p>y" * 20_000, "<ul><li>a" * 20_000):
        found = blocks(page)
        seen, stack = set(), [p for p, _, _ in found]
        while stack:
            p = stack.pop()
            if p is not None and p not in seen:
                seen.add(p)
                stack.append(p.above)
        assert len(seen) <= page.count("<") and sum(len(p.new) for p in seen) <= page.count("<") + 2  # a word that stands above is not held again
    assert len(blocks("<div>" * 100_000 + "end")) == 1


def test_path_means_equal_those_of_all_words_on_a_path():
    rng = random.Random(5)
    net = BlockLstm(seed=4)
    page = "bare" + "".join(rng.choice(['<div class="x y">', "</div>", "<p>", "<b>", "</b>", "<ul><li>", "</ul>", "word ", '<a href=u id="z">', "</a>"]) for _ in range(3000))
    found = blocks(page)
    got = net._path_means(net.features(found))
    for (p, _, _), row in zip(found, got, strict=True):
        words = [w for q in above(p) for w in q.new]
        assert len(words) == len(set(words))
        ids = [__import__("zlib").crc32(w.encode()) % net.PATHS for w in words] or [0]
        assert np.allclose(row, net.p["path"][ids].mean(axis=0), atol=1e-5)
    assert isinstance(found[-1][0], Path)


def plain_lstm(net, d, x, on):
    T, B, n = x.shape
    out = np.zeros((T, B, net.h))
    for b in range(B):
        h = c = np.zeros(net.h)
        for t in range(T) if d == "f" else reversed(range(T)):
            z = net.p["c" + d] + x[t, b] @ net.p["w" + d][:n] + h @ net.p["w" + d][n:]
            i, f, o, a = (z[k * net.h : (k + 1) * net.h] for k in range(4))
            s = lambda v: 1 / (1 + np.exp(-v))
            c = (s(f) * c + s(i) * np.tanh(a)) * on[t, b]
            h = s(o) * np.tanh(c) * on[t, b]
            out[t, b] = h
    return out


def test_labeller_equals_plain_forward_pass_and_its_gradient_is_right():
    rng = np.random.default_rng(2)
    net = BlockLstm(hidden=3, size=2, seed=7)
    T, B, n = 6, 3, 2 * 2 + net.NUM
    x = rng.standard_normal((T, B, n)).astype(np.float32)
    on = np.ones((T, B), np.float32)
    on[4:, 1] = on[2:, 2] = 0
    for mask in (on, np.ones_like(on)):
        want = np.concatenate([plain_lstm(net, d, x, mask) for d in "fb"], axis=2)
        assert np.allclose(net._both(x, mask), want, atol=1e-5)
        assert np.allclose(np.concatenate([net._run(d, x, mask) for d in "fb"], axis=2), want, atol=1e-5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = x.astype(np.float64)
    top = rng.standard_normal((T, B, net.h))
    for d in "fb":
        kept = []
        net._run(d, x, on, kept)
        gw, gb, dx = net._back(d, x, kept, top)
        loss = lambda: float((net._run(d, x, on) * top).sum())  # noqa: E731, B023
        for table, grad in ((net.p["w" + d], gw), (net.p["c" + d], gb), (x, dx)):
            for _ in range(12):
                at = tuple(rng.integers(0, s) for s in table.shape)
                was, step = table[at], 1e-3
                table[at] = was + step
                up = loss()
                table[at] = was - step
                down = loss()
                table[at] = was
                assert abs((up - down) / (2 * step) - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def test_guests_of_many_cells_equal_the_distances_of_all_centroids():
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    c, x = unit(rng.standard_normal((1024, 12))), unit(rng.standard_normal((300, 12)))
    s = x @ c.T
    home = s.argmax(axis=1)
    reach = np.sqrt(1 - 0.95**2)
    rows, cells = _guests(s, home, c, reach)
    gap = np.linalg.norm(c[:, None] - c[None], axis=2)[home]
    near = (s[np.arange(len(x)), home][:, None] - s <= reach * gap) & (np.arange(len(c)) < home[:, None])
    assert set(zip(*np.nonzero(near), strict=True)) <= set(zip(rows.tolist(), cells.tolist(), strict=True))
    assert len(rows) <= near.sum() + 5 and len(rows) == len(set(zip(rows.tolist(), cells.tolist(), strict=True)))


def test_template_documents_do_not_meet(spark):
    body = "please read the terms of this service before you begin today".split()
    rows = [(k, " ".join([f"a{k}", *body, f"b{k}"])) for k in range(4000)]
    rows += [(9000 + k, " ".join([f"a{k}", *body, f"b{k}"])) for k in range(3)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = NgramJaccardJoin()
    made = []
    keep = join.links
    join.links = lambda d, pairs: (made.append(pairs.count()), keep(d, pairs))[1]
    got = {r["doc_id"]: r["component_id"] for r in join.groups(docs).collect()}
    assert got == {k: k - 9000 if k >= 9000 else k for k, _ in rows}
    assert max(made) < 4 * len(rows)  # candidates grow with the documents, not with their square


def test_quality_rules_are_the_same_by_either_plan(spark, monkeypatch):
    """Statistics of labelled documents alone, or of all documents joined with very many labels."""
    from glossaria.llm import quality_rules

    rng = random.Random(4)
    rows = [(i, " ".join(["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(22, 60))] + ["###"] * rng.choice([0, 0, 0, 9])), "en", "s") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("###" not in x), 0) for i, x, _, _ in rows[:380]], "doc_id long, quality int, toxic int")
    kept = []
    for few in (1 << 21, -1):
        monkeypatch.setattr(quality_rules, "_FEW_LABELS", few)
        kept.append(sorted(r["doc_id"] for r in quality_rules.RiskControlledRules().filter(docs, labels).collect()))
    assert kept[0] == kept[1] and 200 < len(kept[0]) < 420
