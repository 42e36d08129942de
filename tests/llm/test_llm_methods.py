"""The methods of the training-data operators: guarantees, plain re-computations, gradients, hot groups and odd inputs."""

import html.parser
import itertools
import os
import random
import re

import numpy as np
import pytest

pytest.importorskip("glossaria.llm")
import pyarrow as pa
from glossaria.llm import textkernel as tk
from glossaria.llm.chat_format import ROLES, START, ChatFormat, Repair, render, role_class
from glossaria.llm.common import spread_join
from glossaria.llm.embedding_dedup import CosineGroups
from glossaria.llm.html_extract import MainText, PageWriter, blocks, extract, train
from glossaria.llm.language_id import PAD, ByteGru, LanguageId, has_letter
from glossaria.llm.linear import sigmoid
from glossaria.llm.ngram_join import NgramJaccardJoin
from glossaria.llm.quality_classifier import CoTraining, combine, meta_view, text_view
from glossaria.llm.quality_rules import RULES, STEPS, RiskControlledRules
from glossaria.llm.sentencepiece_codec import MARK, Model, SentencePieceCodec
from glossaria.llm.toxicity import Sample, ToxicityChain, features, out_of_fold, terms

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, copies int, rep long, key string, at string, __last int"


def documents(spark, rows):
    return spark.createDataFrame([(i, x, g, s, None if x is None else len(x), "r", 1, 2, "k", "a", 3) for i, x, g, s in rows], SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, i) for i in range(400) for k in ([7] if i % 2 else [i])], "k long, i long")
    right = rows.groupBy("k").count().selectExpr("k", "k * 10 as v", "count").where("k <> 4")
    got = sorted((r["k"], r["i"], r["v"]) for r in spread_join(rows, right, ["k"], "count").collect())
    assert got == sorted((r["k"], r["i"], None if r["k"] == 4 else r["k"] * 10) for r in rows.collect())


# ------------------------------------------------------------------ 1 quality rules


def test_risk_is_controlled(spark):
    """Many strata whose good documents exceed cutoffs at known rates: hardly any may get a step beyond alpha."""
    rng, strata, n, alpha = np.random.default_rng(1), 150, 300, 0.05
    at = {r: len(RULES[r]) for r in RULES}
    rows, truth = [], {}
    for s in range(strata):
        odds = rng.dirichlet(np.full(STEPS + 1, 0.3)) * 0.5
        odds[-1] += 1 - odds.sum()  # the last kind exceeds nothing
        truth[f"={s}"] = np.cumsum(odds)[:-1]
        for f in rng.choice(STEPS + 1, n, p=odds):
            v = {r: 0.0 for r in RULES}
            if f < STEPS:
                rule = list(RULES)[f % len(RULES)]
                j = f // len(RULES)
                v[rule] = RULES[rule][j] + (1e-9 if j == 0 else (RULES[rule][j - 1] - RULES[rule][j]) / 2)
            rows.append((str(s), False, *v.values()))
    held = spark.createDataFrame(rows, "lang string, base_failed boolean, " + ", ".join(f"{r} double" for r in RULES))
    # delta over the strata is the level of each: 0.05
    got = RiskControlledRules(alpha=alpha, delta=0.05 * strata).cutoffs(held).collect()
    assert len(got) == strata and set(at.values()) == {10}
    beyond = sum(truth[r["stratum"]][r["last"]] > alpha for r in got if r["last"] >= 0)
    assert beyond <= 0.05 * strata + 3 * np.sqrt(0.05 * 0.95 * strata)
    assert sum(r["last"] >= 0 for r in got) > strata / 2  # and power
    for r in got:
        for i, rule in enumerate(RULES):
            steps = [j for j in range(10) if j * len(RULES) + i <= r["last"]]
            assert r[f"max_{rule}"] == (RULES[rule][steps[-1]] if steps else None)


def test_rules_with_odd_tables(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30)), None if i % 2 else "", "s") for i in range(60)] * 2 + [(None, None, None, None), (99, "x " * 20000, "en", "s")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    kept = RiskControlledRules().filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 120
    assert RiskControlledRules().filter(documents(spark, []), labels).count() == 0
    assert RiskControlledRules().filter(docs, labels.limit(0)).count() == 120


# ------------------------------------------------------------------ 2 quality classifier


def _slice(texts):
    raw = [(x or "").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_co_training_brute_force(spark):
    rng = random.Random(13)
    bad = lambda: " ".join(x + "###" for x in words(rng, 25))
    rows = [(i, bad() if i % 4 == 0 else " ".join(words(rng, 25)), "en", "spam" if i % 4 == 0 else "site") for i in range(240)]
    rows += [(900, "x y " * 30000, "en", "site"), (901, "same text", "en", "site"), (901, "same text", "en", "site"), (None, "no id here", None, None)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    job = CoTraining()
    model = job.fit(docs, labels)
    got = job.score(docs, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, text, lang, source) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        # every feature anew, word by word
        w = [x.encode() for x in re.findall("[^\x20\x09-\x0d]+", text)]
        one = lambda x, fold: int(tk.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), fold)[0])
        h, e = [one(x, tk.LOWER) for x in w] if len(w) < 200 else None, [one(x[-3:], tk.SHAPE) for x in w] if len(w) < 200 else None
        x, _ = text_view(*_slice([text]))
        if h is not None:
            plain = np.zeros(x.shape[1])
            for a, b in zip(h, e, strict=True):
                plain[a % 768] += 1
                plain[768 + b % 256] += 1
            rich = (plain[:768] > 0).sum() / min(len(w), 768)
            plain = np.sqrt(plain / len(w))
            plain[-4:] = [sum(a == b for a, b in zip(h, h[1:])) / len(w) * 3, rich, min(sum(map(len, w)) / len(w) / 10, 3), np.log1p(len(w)) / 8]
            assert np.allclose(x[0], plain, atol=1e-6)
        p_text, p_meta, p = combine(model, x, meta_view([source], [lang], [len(text)]))
        assert (r["p_text"], r["p_meta"], r["score"]) == pytest.approx((p_text[0], p_meta[0], p[0]), abs=1e-6)
        assert r["kept"] == (p[0] >= model["cut"])
    # A null quality, repeated labels, empty tables
    assert job.score(documents(spark, []), labels).count() == 0 and job.filter(docs, labels.limit(0)).count() == len(rows)


# ------------------------------------------------------------------ 3 toxicity


def _packed(texts):
    h, row = terms(*_slice(texts))
    return [np.unique(h[row == i], return_counts=True) for i in range(len(texts))]


def test_out_of_fold_probabilities_do_not_leak():
    rng = random.Random(15)
    texts = [" ".join(words(rng, 60, "abcd")) for _ in range(600)]
    y = np.array([float(rng.random() < 0.2) for _ in texts])  # labels that no text tells
    sample = Sample(_packed(texts))
    fit = sample.features(sample.lexicon(y, y >= 0, 512, lift=2.0))
    assert fit[:, :-3].shape[1] > 0  # a lexicon that has seen the labels finds something
    p = out_of_fold(sample, y, np.zeros((600, 0)), 512)
    gap = p[y == 1].mean() - p[y == 0].mean()
    assert abs(gap) < 0.05
    fold = tk.mix(np.arange(600, dtype=np.uint64) + np.uint64(31)) % np.uint64(5)
    flipped = y.copy()
    flipped[fold == 2] = 1 - flipped[fold == 2]  # a fold's own labels have no influence on its probabilities
    assert np.array_equal(out_of_fold(sample, flipped, np.zeros((600, 0)), 512)[fold == 2], p[fold == 2])


def test_toxicity_brute_force(spark):
    rng = random.Random(16)
    texts = []
    for i in range(300):
        w = words(rng, 30)
        if i % 5 == 0:
            w[rng.randrange(30)] = rng.choice(["vileword", "nastyterm"])
        texts.append(" ".join(w))
    rows = [(i, x, "en", "s") for i, x in enumerate(texts)] + [(7, texts[7], "en", "s"), (900, "vileword " * 20000, "en", "s")]
    labels = spark.createDataFrame([(i, 1 - int(i % 7 == 0), int(i % 5 == 0)) for i in range(200)] + [(201, None, 0), (202, 0, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    chain = ToxicityChain()
    models = chain.fit(docs, labels)
    seen = {}
    for i, x in enumerate(texts[:200]):  # the lexicon by plain counting
        for t in set(terms(*_slice([x]))[0].tolist()):
            seen.setdefault(t, [0, 0])[int(i % 5 == 0)] += 1
    n1, n0 = 40, 162  # two more documents, one said to be clean, one not judged
    for t in set(terms(*_slice([texts[201]]))[0].tolist()):
        seen.setdefault(t, [0, 0])[0] += 1
    n0 = 161
    want = {t for t, (c0, c1) in seen.items() if c1 >= 4 and (c1 / n1) / ((c0 + 0.5) / (n0 + 1)) >= 25}
    assert set(models[-1][0].tolist()) == want and len(want) < 512
    got = chain.predict(docs, labels).collect()
    key = lambda r: (r[0], r[1])
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["p_unfit"], r["p_toxic"], r["toxic"]))
    for i in range(300):
        h, row = terms(*_slice([texts[i]]))
        p = []
        for lex, w in models:
            f = features(1, h, row, np.ones(len(h)), lex)[0]
            z = w[-1] + sum(float(a) * float(b) for a, b in zip(w, [*f, *p]))
            p.append(float(sigmoid(z)))
        assert all(r[:2] == pytest.approx(tuple(p), abs=1e-5) and r[2] == (p[1] >= 0.5) for r in by[i])
    assert len(by[7]) == 2 and by[900][0][2] and key(got[0])


# ------------------------------------------------------------------ 4 language


def test_gru_gradient_and_plain_forward(spark):
    rng = np.random.default_rng(2)
    net = ByteGru(3, hidden=4)
    seq, y = rng.integers(97, 110, (5, 9)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    seq[1, 6:] = PAD

    def loss(p):
        net.p = p
        z = net.label(np.ascontiguousarray(seq.T))
        on = (seq.T != PAD)
        return -float((np.log(z[:, y, np.arange(5)]) * on).sum() / on.sum())

    base = {k: v.astype(np.float64) for k, v in net.p.items()}
    s = np.ascontiguousarray(seq.T)
    net.p = {k: v.astype(np.float32) for k, v in base.items()}
    kept = {"f": [], "b": []}
    st = {d: net._run(d, s, kept[d]) for d in "fb"}
    z = net.label(s).astype(np.float64)
    z[:, y, np.arange(5)] -= 1
    z *= (s != PAD)[:, None, :] / (s != PAD).sum()
    grads = {}
    for d, part in (("f", net.p["wo"][:, :4]), ("b", net.p["wo"][:, 4:])):
        grads["x" + d], grads["u" + d] = net._back(d, s, kept[d], (part.T @ z).astype(np.float32))
    assert st["f"].shape == (9, 4, 5)
    for k in ("xf", "uf", "xb", "ub"):
        for _ in range(6):
            i, j = int(rng.integers(0, base[k].shape[0])), int(rng.integers(97, 110)) if k[0] == "x" else int(rng.integers(0, 4))
            up = {q: v.astype(np.float32) for q, v in base.items()}
            down = {q: v.copy() for q, v in up.items()}
            up[k][i, j] += 2e-3
            down[k][i, j] -= 2e-3
            assert (loss(up) - loss(down)) / 4e-3 == pytest.approx(float(grads[k][i, j]), abs=2e-3)
    # The operator against a plain loop over bytes
    r = random.Random(6)
    rows = [(i, " ".join(words(r, 12, "abcde" if i % 2 else "vwxyz")), "aa" if i % 2 else "bb", "s") for i in range(60)] + [(70, "z" * 300 + " ", "bb", "s"), (71, "² ½ ① 12", "aa", "s"), (72, "漢", None, "s")]
    job = LanguageId(steps=30, batch=32)
    docs = documents(spark, rows)
    labels, params = job.fit(docs)
    got = {x["doc_id"]: x for x in job.predict(docs).collect()}
    for i in (0, 1, 31, 70, 72):
        raw = rows[[q[0] for q in rows].index(i)][1].encode()
        total = np.zeros(len(labels))
        for a in range(0, len(raw), job.window):
            part = raw[a : a + job.window]
            states = {}
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros(job.hidden)
                for t in order:
                    x, u = params["x" + d][:, part[t]].astype(float), params["u" + d].astype(float) @ h
                    zg, rg = np.clip(x[:8] + u[:8], 0, 1), np.clip(x[8:16] + u[8:16], 0, 1)
                    c = np.clip(x[16:] + rg * u[16:], -1, 1)
                    h = zg * h + (1 - zg) * c
                    states[d, t] = h
            for t in range(len(part)):
                q = params["wo"].astype(float) @ np.concatenate([states["f", t], states["b", t]]) + params["bo"][:, 0]
                total += np.exp(q - q.max()) / np.exp(q - q.max()).sum()
        p = total / len(raw)
        assert got[i]["lang_pred"] == labels[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-4)
    assert got[71]["lang_pred"] == "und" and not any(map(has_letter, ("²", "½", "①", "1_2", ""))) and has_letter("é")


# ------------------------------------------------------------------ 5 embeddings


def test_cosine_groups_hot_and_clashing(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 6))
    near = base[0] + 0.05 * rng.standard_normal((80, 6))
    v = np.concatenate([base, near, np.repeat(base[1:2], 90, axis=0)]).astype(np.float32)
    rows = [(i, x.tolist(), 0, 1, 2, 3, 4) for i, x in enumerate(v)] + [(900 + i, None, 0, 1, 2, 3, 4) for i in range(100)]
    schema = "vec_id long, embedding array<float>, label int, rep int, h1 int, cell int, mult int"
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp, len(x)).min(axis=1))
    for settings in ({}, {"per_cell": 9, "block": 5}, {"block": 33}):
        got = {r["vec_id"]: r for r in CosineGroups(**settings).groups(spark.createDataFrame(rows, schema)).collect()}
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), comp[i], comp[i] == i) for i in range(len(x)))
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 1000))


# ------------------------------------------------------------------ 7 HTML


def test_pages_of_missing_tags():
    text = lambda p: [t for _, t, _ in blocks(p)]
    assert text("<html><head><title>T</title><body><article><p>One two.</p></article>") == ["One two."]
    assert text("<p title=it's>First</p><p>Second isn't lost?</p>") == ["First", "Second isn't lost?"]
    assert text('<a href=foo">link</a> text') == ["link text"]
    assert text('<a href="x>y">z</a> q') == ["z q"] and text('<p a="open>one</p> two') == ["one", "two"]
    assert text("<select><option>a<option>b</select><p>c") == ["c"] and text("a<!-- b") == ["a"]
    long = '<a x="' * 100000
    assert text(long) == [] and len(text("<p>x</p>" + "<a b=\">\" " * 50000)) == 1 and text("<p>y" + "<select><option>" * 30000) is not None


class Plain(html.parser.HTMLParser):
    """All text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], None

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.out.append(" ")

    def handle_data(self, data):
        self.out.append(data)


def test_blocks_equal_plain_parser():
    rng = random.Random(21)
    attrs = ["", ' class="a b"', " id=x", " title='it''s'", " title=it's", ' data-x="a>b"', " hidden", ' href=/a?b=c&d="e"', " alt = 'q'", ' x="1"y="2"']
    for _ in range(400):
        page, open_ = [], []
        for _ in range(rng.randrange(30)):
            k = rng.random()
            if k < 0.4:
                page.append(rng.choice(["word ", "x &amp; y ", "1 &lt; 2 ", "é — ", "isn't ", 'say "so" ']))
            elif k < 0.7:
                tag = rng.choice(["p", "div", "span", "b", "a", "li", "h2", "article", "td"])
                page.append(f"<{tag}{rng.choice(attrs)}>")
                open_.append(tag)
            elif k < 0.9 and open_:
                page.append(f"</{open_.pop(rng.randrange(len(open_)))}>")
            else:
                page.append(rng.choice(["<br>", "<br/>", "<!-- no > no -->", "<hr>", "<!doctype html>"]))
        page = "".join(page)
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert "".join(t for _, t, _ in blocks(page)).replace(" ", "") == "".join("".join(plain.out).split()), page


def _written(found) -> str:
    """HTML of blocks, each in its own path of tags."""
    out = []
    for path, text, linked in found:
        tags = []
        for w in path:
            if w.startswith("."):
                tags[-1].append(w[1:])
            else:
                tags.append([w])
        inner = f"<a>{text[:linked]}</a>{text[linked:]}" if linked and path[-1] != "a" else text
        out.append("".join(f"<{t[0]}" + (f' class="{" ".join(t[1:])}"' if t[1:] else "") + ">" for t in tags) + inner.replace("&", "&amp;") + "".join(f"</{t[0]}>" for t in reversed(tags)))
    return "".join(out)


def test_main_text_on_spark(spark):
    writer = PageWriter(77)
    pages = [writer.page() for _ in range(60)]
    rows = [(i, f"u{i}", _written([(tuple(w for w in p if w not in ("html", "body")), t, n) for p, t, n in found])) for i, (found, _) in enumerate(pages)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", rows[0][2]), (None, None, rows[0][2]), (103, "u", "<article>" + "<p>Some words of a sentence here.</p>" * 4000)]
    table = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: r for r in MainText().extract(table).collect()}
    right = total = 0
    for i, (found, labels) in enumerate(pages):
        said = set(got[i]["text"].split("\n\n"))
        for (_, t, _), y in zip(found, labels, strict=True):
            right += (t in said) == bool(y)
            total += 1
    assert right >= 0.97 * total
    assert len(got) == len(rows) and got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == got[0]["text"] == got[None]["text"]
    assert got[103]["text"].count("Some words") == 4000 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert MainText().extract(table.limit(0)).count() == 0 and extract(train(), [None]) == [""]


# ------------------------------------------------------------------ 8 n-gram join


def brute_links(rows, num):
    sets = []
    for _, x, _, _ in rows:
        w = (x or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    comp = {i: i for i, *_ in rows}
    change = True
    while change:
        change = False
        for ((i, *_), a), ((j, *_), b) in itertools.combinations(zip(rows, sets, strict=True), 2):
            if a and b and 100 * len(a & b) >= num * len(a | b) and comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                change = True
    return comp


@pytest.mark.parametrize("num", [50, 80, 95])
def test_join_is_exact_at_any_threshold(spark, num):
    rng = random.Random(num)
    rows = []
    for k in range(30):
        base = words(rng, rng.randint(12, 60))
        for m in range(4):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.random()}"
            rows.append((10 * k + m, " ".join(w[: len(w) - rng.randrange(5)]), "en", "s"))
    comp = brute_links(rows, num)
    got = {r["doc_id"]: r["component_id"] for r in NgramJaccardJoin(num=num).groups(documents(spark, rows)).collect()}
    assert got == comp and 30 <= len(set(comp.values())) < len(rows)


def test_join_with_hot_groups(spark):
    """Many copies, many near copies with outsiders on their shingles, many empty texts, rows that share a doc_id."""
    rng = random.Random(31)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(i, " ".join(a), "en", "s") for i in range(200)]
    for i in range(200, 280):
        w = list(b)
        w[rng.randrange(40)] = f"n{i}"
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(300 + i, " ".join(b[:7] + words(rng, 2 + i)), "en", "s") for i in range(20)]
    rows += [(400 + i, None if i % 2 else " ", "en", "s") for i in range(150)]
    comp = brute_links(rows, 80)
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in NgramJaccardJoin().groups(docs).collect()}
    assert got == comp
    twice = documents(spark, [*rows[:2], (0, "quite another text of the same id here", "en", "s"), (0, "quite another text of the same id here", "en", "s")])
    left = [[r["text"] for r in NgramJaccardJoin().one_of_each(twice.repartition(n)).collect()] for n in (1, 4)]
    assert left[0] == left[1] == [min(" ".join(a), "quite another text of the same id here")]


# ------------------------------------------------------------------ 9 chat


def test_parts_do_not_depend_on_partitions(spark):
    rng, repair = random.Random(41), Repair()
    rows = [(c, t, rng.choice([*ROLES, "tool", None]), f"c{c}t{t}") for c in range(40) for t in range(rng.randrange(1, 8))]
    rows += [(99, t, rng.choice([*ROLES, None]), f"long{t}") for t in range(333)] + [(None, 0, "user", "n"), (None, 0, "user", "n")]
    schema = "conv_id long, turn long, role string, text string, part string, count int"
    table = spark.createDataFrame([(*r, "p", 1) for r in rows], schema)
    order = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or "")
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=order)
        cost, steps, tail = repair.best([role_class(r[2]) for r in mine])
        want[c] = (cost, render(steps, tail, [r[3] for r in mine], True, True)[0], len(mine))
    seen = []
    for partitions in (1, 7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            got = [tuple(r) for r in ChatFormat(whole=100).format(table.repartition(partitions)).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        by = {}
        for r in sorted(got, key=lambda r: r[1]):
            cost, text, parts = by.get(r[0], (0.0, "", 0))
            by[r[0]] = (cost + r[3], text + r[7], parts + 1)
        assert {c: x[:2] for c, x in by.items()} == {c: x[:2] for c, x in want.items()}
        assert all(by[c][2] == -(-n // 100) for c, (_, _, n) in want.items())
        seen.append(sorted(got, key=str))
    assert seen[0] == seen[1] == seen[2] and START == 0


# ------------------------------------------------------------------ 10 pieces


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no model file")
def test_long_runs_collisions_and_round_trip(spark, monkeypatch):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(51)
    with open(PIECES, "rb") as f:
        model = Model(f.read())
    ids = lambda m, text: m.encode_slice(*_slice([text]))[0].tolist()
    for text in (" " * 100000, "  " + "".join(rng.choice("abcdefghij") for _ in range(30000)), "".join(rng.choice("abcdefghij") for _ in range(1000000)), " a" * 5 + " " * 3000 + "b"):
        assert ids(model, text) == lib.encode(text)
    for _ in range(300):  # merges of random letters and marks
        word = MARK * 2 + "".join(rng.choice("aehinorst▁") for _ in range(rng.randrange(30)))
        assert [model.vocab[p] for p in model.merge(word)] == ids(model, word.replace(MARK, " ")[1:])
    texts = [" ".join(words(rng, 50)) for _ in range(40)] + [None, "", "🙂 é", "  two", "tab\t"]
    docs = documents(spark, [(i, x, None, None) for i, x in enumerate(texts)])
    got = {r["doc_id"]: r for r in SentencePieceCodec(PIECES).round_trip(docs).collect()}
    assert all((got[i]["ids"], got[i]["text"]) == ((None, None) if x is None else (lib.encode(x), x)) for i, x in enumerate(texts))
    # Words that share a hash are told apart by their bytes.
    real = tk.word_hashes
    monkeypatch.setattr(tk, "word_hashes", lambda *a: real(*a) % np.uint64(5))
    model._forget()
    for x in texts[:6]:
        assert ids(model, x) == lib.encode(x)
    monkeypatch.undo()
    model._forget()
    byte = [model.byte[0xC3], model.byte[0x41], model.byte[0xE2]]
    assert model.decode(byte) == b"\xc3A\xe2".decode(errors="replace")
    assert model.decode_slice(np.array(lib.encode("a b") + lib.encode(" c"), np.int64), np.array([0, 0, len(lib.encode("a b")), len(lib.encode("a b")) + len(lib.encode(" c"))])).to_pylist() == ["", "a b", " c"]
    assert pa.types.is_large_string(model.decode_slice(np.zeros(0, np.int64), np.array([0])).type)
