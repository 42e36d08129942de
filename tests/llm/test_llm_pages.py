"""Pages with unclosed tags, and many languages."""

import random

import pytest

pytest.importorskip("glossaria.llm")
from glossaria.llm.html_extract import blocks, extract, train
from glossaria.llm.language_id import LanguageId

SKIPPED = "noscript template iframe object svg canvas audio video select button datalist"


def said(page):
    return [t for _, t, _ in blocks(page)]


def test_unclosed_head_keeps_the_page():
    page = "<html><head><title>x</title>{}<body><nav><a>Home</a></nav><article><h1>Rivers</h1><p>The river rose in spring and fell again.</p></article></html>"
    assert said(page.format("")) == said(page.format("</head>")) == ["Home", "Rivers", "The river rose in spring and fell again."]
    assert extract(train(), [page.format("")]) == ["Rivers\n\nThe river rose in spring and fell again."]
    assert said("<head><meta charset=x><style>p{}</style><p>first") == ["first"]
    assert said("<head><title>x</title>bare text") == ["bare text"]


@pytest.mark.parametrize("tag", SKIPPED.split())
def test_unclosed_skipped_tags_lose_only_the_tag(tag):
    assert said(f"<p>a</p><{tag} class=x><p>b</p>") == ["a", "b"]
    assert said(f"<p>a</p><{tag}><p>b</p><{tag}>no</{tag}><p>c</p>") == ["a", "b", "c"]
    assert said(f"<p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"]


def test_closed_skipped_elements_end_at_their_own_tag():
    assert said("<object><object>no</object>no</object><p>a</p>") == ["a"]
    assert said("<button><script>'<button>'</script>no</button><p>a</p>") == ["a"]
    assert said("<svg><title>no</svg><p>a</p><svg><title>no</title></svg><p>b</p>") == ["a", "b"]
    assert said("<iframe><script></iframe><p>a</p>") == ["a"]


def test_text_only_elements_run_to_the_end():
    for tag in ("script", "style", "textarea", "title"):
        assert said(f"<p>a</p><{tag}>no <p>no</p>") == ["a"]


def test_formulas_are_text():
    page = '<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="application/x-tex">x = 1</annotation></math> hold.</p>'
    assert said(page) == ["Let x=1 hold."]


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    names = [f"l{k:02}" for k in range(70)]
    letters = {n: [chr(0x4E00 + 3 * k + j) for j in range(3)] for k, n in enumerate(names)}
    told = [n for k, n in enumerate(names) for _ in range(16 if k < 64 else 8)]
    rows = [(i, "".join(rng.choices(letters[n], k=40)), n) for i, n in enumerate(told)]
    got = {r["doc_id"]: r["lang_pred"] for r in LanguageId().predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(got.values()) == set(names)
    assert sum(got[i] == n for i, _, n in rows if n > "l63") >= 44  # of 48 documents of the six rarest languages
