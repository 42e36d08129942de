"""What is learned from the corpus: sentence ends and parts of speech."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from glossaria.operators import examples, index, sentence_ends, tagger, tokens
from glossaria.operators.index import POS

PAPERS = "paper_idx int, year string, section string, text string"


def papers(spark, *texts):
    return spark.createDataFrame([(i, "y", f"s{i}", x) for i, x in enumerate(texts)], PAPERS)


def planted(spark, n=60):
    rng = random.Random(2)
    words = [f"{a}{b}ing" for a in "abcdefgh" for b in "lmnop"]
    line = lambda: " ".join(rng.choices(words, k=9))
    texts = [f"The rate rose by approx. {line()}. {line()}. In fact cf. {line()} and e.g. {line()}. Then J. Smith said {line()}!" for _ in range(n)]
    return papers(spark, *texts)


def test_planted_abbreviations_are_found_and_end_nothing(spark):
    p = planted(spark)
    found = {r["word"] for r in sentence_ends.abbreviations(sentence_ends.scores(sentence_ends.counts(p))).collect()}
    assert {"approx", "cf", "e.g"} <= found and found <= {"approx", "cf", "e.g", "j"}
    said = [r["text"] for r in sentence_ends.sentences(p).orderBy("paper_idx", "line_no", "sent_idx").collect()]
    assert len(said) == 4 * 60
    assert all(x.startswith(("The rate", "In fact", "Then J. Smith")) or x[0].islower() for x in said)
    assert len(tokens.sentences(p).collect()) > 4 * 60
    told = examples.told(p, split=sentence_ends.split, known=sentence_ends.known(p))
    got = examples.with_texts(examples.places(told), told).collect()
    assert any("approx. " in r["text"] and r["text"].endswith("ing.") for r in got)


def test_scores_equal_the_formula_and_odd_papers_are_whole(spark):
    rows = {r["word"]: r for r in sentence_ends.scores(sentence_ends.counts(planted(spark, 12))).collect()}
    counts = sentence_ends.counts(planted(spark, 12)).collect()
    p = sum(r["with_stop"] for r in counts) / sum(r["with_stop"] + r["without"] for r in counts)
    for w in ("approx", "e.g", "cf"):
        a, b, n = rows[w]["with_stop"], rows[w]["without"], len(w.replace(".", ""))
        ratio = 2 * (a * (math.log(0.99) - math.log(p)) + (b * (math.log(0.01) - math.log(1 - p)) if b else 0))
        assert math.isclose(rows[w]["score"], ratio * math.exp(-n) * (w.count(".") + 1) * n**-b, rel_tol=1e-9)
    for odd in (papers(spark, None, "", "no stops here at all"), papers(spark).limit(0), papers(spark, "Every. word. stops. here.")):
        assert {r["text"].rstrip(".") for r in sentence_ends.sentences(odd).collect()} <= {"no stops here at all", "Every", "word", "stops", "here"}


def small_model(seed=1, words=("bank", "run", "light", "the", "quick")):
    rng = np.random.default_rng(seed)
    m = tagger.Model(list(words))
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return tagger.Model(m.words, norm(rng.random(12)), norm(rng.random((12, 12))), m.say)


def likelihood(m, symbols, tags):
    p = m.start[tags[0]] * m.say[tags[0], symbols[0]]
    for a, b, o in zip(tags, tags[1:], symbols[1:], strict=False):
        p *= m.move[a, b] * m.say[b, o]
    return p


def test_decoder_and_expectations_equal_brute_force():
    m = small_model()
    lines = [["bank", "run", "each"], ["quickly", "light"], ["the"], ["over", "run", "light", "running"], ["zzz", "bank", "run", "run"]]
    start, move, say, total = tagger.expected(m, [m.symbols(x) for x in lines])
    want = [np.zeros(12), np.zeros((12, 12)), np.zeros_like(m.say), 0.0]
    for line in lines:
        symbols = m.symbols(line)
        able = [np.flatnonzero(m.say[:, o]).tolist() for o in symbols]
        every = {tags: likelihood(m, symbols, tags) for tags in itertools.product(*able)}
        z = sum(every.values())
        want[3] += math.log(z)
        assert math.isclose(likelihood(m, symbols, tagger.best(m, symbols)), max(every.values()), rel_tol=1e-9)
        for tags, p in every.items():
            want[0][tags[0]] += p / z
            for a, b in itertools.pairwise(tags):
                want[1][a, b] += p / z
            for a, o in zip(tags, symbols, strict=True):
                want[2][a, o] += p / z
    assert np.allclose(start, want[0]) and np.allclose(move, want[1]) and np.allclose(say, want[2]) and math.isclose(total, want[3])
    assert tagger.best(m, np.zeros(0, np.int64)) == []


def test_context_tells_and_likelihood_rises(spark):
    rng = random.Random(4)
    nouns, verbs = ["river", "garden", "table", "window", "bread", "stone"], ["realize", "modify", "organize", "simplify", "motivate", "imagine"]
    lines = []
    for _ in range(300):
        lines.append(rng.choice([f"every {rng.choice(nouns)} should {rng.choice(verbs)} each {rng.choice(nouns)}", f"each {rng.choice(nouns)} may {rng.choice(verbs)} every {rng.choice(nouns)}"]))
    lines += ["every plan should modify each river", "each river should plan every table", "every garden may plan each window", "each plan may simplify every bread"] * 12
    p = papers(spark, *lines)
    model, told = tagger.Tagger(rounds=6).fit(p)
    assert all(b > a - 1e-6 * abs(a) for a, b in itertools.pairwise(told)) and told[-1] > told[0]
    rows = {(r["paper_idx"], r["tok_idx"]): (r["word"], r["pos"]) for r in tagger.Tagger.tag(model, p).collect()}
    first = lines.index("every plan should modify each river")
    assert rows[first, 1] == ("plan", "n") and rows[first + 1, 3] == ("plan", "v")
    assert all(pos == "det" for w, pos in rows.values() if w in ("every", "each")) and all(pos == "aux" for w, pos in rows.values() if w in ("should", "may"))
    cells = tagger.tagged_cells(p, model)
    counts = {r["lemma"]: r["pos_counts"] for r in index.assembled(cells, p).collect()}
    assert counts["plan"] == {"n": 24, "v": 24} and set(counts["river"]) == {"n"}
    assert {r["pos"] for r in cells.select("pos").distinct().collect()} <= set(POS)
    empty = papers(spark, None, "")
    assert tagger.Tagger.tag(tagger.Tagger(rounds=1).fit(empty)[0], empty).collect() == []


def test_lines_are_decoded_side_by_side():
    """F7, F8: the same tags as line by line, also among equals, with the logarithms of a model taken once; counted lines weigh as repeated ones."""
    rng = np.random.default_rng(5)
    words = ["dog", "runs", "quickly", "blue", "before", "oddities", "unseen"]
    m = small_model(5, words)
    lines = [m.symbols([words[i] for i in rng.integers(0, len(words), n)]) for n in rng.integers(0, 12, 200)]
    for model in (m, tagger.Model(words)):  # all of the second one's moves are equal
        assert [x.tolist() for x in tagger.best_of(model, lines)] == [tagger.best(model, x) for x in lines]
        assert model.logs() is model.logs()
    counts = rng.integers(1, 4, len(lines))
    repeated = [x for x, n in zip(lines, counts, strict=True) for _ in range(n)]
    for a, b in zip(tagger.expected(m, lines, counts), tagger.expected(m, repeated), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    column = pa.array([["Dog", "runs"], [], ["zzz"]])
    got, ends = m.lines_of(column)
    assert [x.tolist() for x in got] == [m.symbols([w.lower() for w in x]).tolist() for x in column.to_pylist()] and ends.tolist() == [0, 2, 2, 3]
