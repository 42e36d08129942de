"""Column builders: ratios, the paragraph cleaner, meaning cleaners, tokens. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CLOSED, ENDINGS, IRREGULAR, PENN

#: White space as Unicode has it, spelled out: a class of ranges is matched several times faster than a property.
S = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NOT_BLANK = S.replace(" ", "", 1)
#: What counts as white space at the ends of a text.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# The patterns that decide what counts as exam scaffolding.
OPTION = r"(?:^|\s)(?:\d{1,2}[.)]\s*)?[\[［（(]?[A-EＡ-Ｅ][\]］）)、.\s]"
NUMBERED_OPTION = r"\s+\d{1,2}[.)]\s*[\[［（(]?[A-EＡ-Ｅ][\]］）)、.\s]"
QUESTION_START = (
    r"^(?:\d{1,2}[.)]\s*)?(which of the following|according to (the|paragraph)|the author|what (can|does|is|will|would)|why (does|is|are)|"
    r"how (does|is|can)|it can be inferred|we can infer|we can learn|the word|the phrase|the passage|this text|from the text|paragraph \d+)\b"
)
QUESTION_HINT = (
    r"(as mentioned in the passage|according to the passage|can best be described|is most likely to|are most likely to|"
    r"the author (suggests|indicates|believes|argues)|the passage (suggests|indicates|implies)|we can infer from|we can learn from)"
)
INSTRUCTIONS = (
    "directions", "answer sheet", "choose the best", "mark your answer", "mark your answers", "read the following", "answer the questions",
    "write an essay", "write a letter", "you should write", "your composition", "word limit", "do not sign", "do not write", "your translation",
    "translate the following", "study the following",
)
HEADING = r"^(Section|Part|Text|Passage)\s*[A-Z\dⅠⅡⅢⅣⅤ]*\b"
TEN_POINTS = r"\(?\s*10\s+points\s*\)?\.?\s*(.+)$"
CHOICE_LINE = r"^\[?[A-E]\]?\s+.+(\[?[A-E]\]?\s+.+){2,}$"
HEADER_LINE = r"^(Directions|Section|Part|Text\s*\d|Passage\s*\d)"
TRANSLATION_MARK = r"\(?(4[6-9]|50)\)?"
YEAR_LINE = r"(19|20)(\d{2})年.*(?:研究生|硕士).*(?:英语|英文)"
HAN = r"[一-鿿]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Both ends without any white space."""
    return F.btrim(col(c), F.lit(WHITE))


def spaced(c: Column) -> Column:
    """Every run of white space as one space; single spaces aren't matched, so most texts pass unchanged."""
    return F.regexp_replace(c, f" {S}+|{_NOT_BLANK}{S}*", " ")


def ratio(c: Column | str, pattern: str, clean: bool = False) -> Column:
    """Characters of a class among those that aren't white space, 0 without any. Runs are removed, not characters counted.

    `clean`: the text has gone through spaced(), so its only white space is the space.
    """
    total = F.length(F.replace(col(c), F.lit(" "), F.lit(""))) if clean else F.length(F.regexp_replace(col(c), f"{S}+", ""))
    return F.when(total > 0, (F.length(col(c)) - F.length(F.regexp_replace(col(c), f"{pattern}+", ""))) / total).otherwise(F.lit(0.0))


def en_ratio(c: Column | str, clean: bool = False) -> Column:
    return ratio(c, "[a-zA-Z]", clean)


def zh_ratio(c: Column | str) -> Column:
    return ratio(c, HAN)


def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?iu)" + pattern)


def _instructs(c: Column) -> Column:
    any_ = lambda low: reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in INSTRUCTIONS))
    return F.get(F.transform(F.array(F.lower(c)), any_), F.lit(0))  # lower-cased once


def clean_paragraph(c: Column | str) -> Column:
    """One pass of the cleaner: the article text of a paragraph, or null for instructions, questions and options.

    The steps are let-bound one after another, so that each is evaluated once a row.
    """
    ten = lambda x: strip(F.regexp_extract(x, "(?iu)" + TEN_POINTS, 1))
    steps = [
        lambda x: strip(F.replace(F.replace(strip(spaced(x)), F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))),
        lambda x: strip(F.regexp_replace(x, r"^(?iu)Directions[:：]?\s*", "")),
        lambda x: F.when((x != "") & ~_has(x, HEADING), x),
        lambda x: F.when(~_instructs(x), x).when(F.length(ten(x)) > 30, ten(x)),
        lambda x: strip(F.regexp_replace(x, f"(?ius){NUMBERED_OPTION}.*$", "")),
        lambda x: F.when(
            (x != "")
            & ~_has(x, f"^(?:{OPTION})")
            & ~_has(x, QUESTION_START)
            & ~((F.length(x) < 180) & _has(x, QUESTION_HINT))
            & (F.regexp_count(x, F.lit("(?iu)" + OPTION)) < 2)
            & (en_ratio(x, clean=True) > 0.15),
            x,
        ),
    ]
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return reduce(let, steps, col(c))


def clean_passes(c: Column | str, passes: int = 3) -> Column:
    """The cleaner is not idempotent; corpora are cleaned three times, unsplit uploads twice."""
    return reduce(lambda x, _: clean_paragraph(x), range(passes), col(c))


def rejoin_hyphenated(c: Column | str) -> Column:
    joined = F.regexp_replace(col(c), r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")
    return F.regexp_replace(joined, r"(?U)\n\s*([a-z]{2,})\s*\n", "$1\n")


PUNCT = "；; ，,。."


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{PUNCT}]+|[{PUNCT}]+$", "")


def _first_if_han(c: Column) -> Column:
    head = F.get(F.split(c, rf"{S}+"), F.lit(0))
    return F.when(head.rlike(HAN), head).otherwise(c)


def clean_meaning(c: Column | str) -> Column:
    """Meaning as a vocabulary book line gives it: punctuation and English after the Chinese cut."""
    text = _bare(strip(col(c)))
    cut = F.regexp_extract(text, rf"^([\s\S]*?{HAN})\s*[a-zA-Z].*$", 1)
    han = F.when(cut != "", strip(cut)).otherwise(text)
    return _bare(F.when(text.rlike(HAN), _first_if_han(han)).otherwise(text))


def clean_loaded_meaning(c: Column | str) -> Column:
    """Meaning as the loaded vocabulary shows it: a capitalised English tail cut."""
    text = F.regexp_replace(strip(col(c)), rf"{S}+[A-Z][A-Za-z].*$", "")
    return _bare(_first_if_han(strip(text)))


def runs(c: Column | str) -> Column:
    """Maximal runs of word characters; plain ones are named first, as ranges are tested faster than properties."""
    return F.regexp_extract_all(col(c), F.lit(r"[a-zA-Z0-9_\p{L}\p{N}]+"), F.lit(0))


def is_token(w: Column) -> Column:
    low = F.lower(w)
    return w.rlike("^[a-zA-Z]+$") & F.length(w).between(2, 28) & ~(low.contains("answer") & low.contains("sheet"))


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def within(name: str, words) -> str:
    """SQL: is a column one of the words? Long lists are parsed as one text: a call for every word would cost more than the query."""
    return f"{name} IN ({', '.join(map(_quoted, words))})" if words else f"({name} IS NULL AND {name} IS NOT NULL)"


def irregular(name: str) -> Column:
    """The lemma of an irregular form in a column; null for any other word."""
    return F.expr(f"element_at(map({', '.join(f'{_quoted(a)}, {_quoted(b)}' for a, b in IRREGULAR.items())}), {name})")


def lemma_of(name: str) -> Column:
    """Irregular forms by table; any other word is its own lemma (see operators.lemmas for suffix rules)."""
    return F.coalesce(irregular(name), F.col(name))


def pos_of(name: str) -> Column:
    """Deterministic part of speech of the words of a column: closed classes, the last named first, then endings, else a noun."""
    cases = [(within(name, words.split()), pos) for pos, words in reversed(CLOSED.items())] + [(f"{name} RLIKE {_quoted(pattern)}", pos) for pos, pattern in ENDINGS]
    return F.expr("CASE " + " ".join(f"WHEN {test} THEN '{pos}'" for test, pos in cases) + " ELSE 'n' END")


def penn_to_simple(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PENN.items() for x in kv])
    return F.coalesce(F.element_at(table, tag), F.lit("other"))


def _kind(c: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(c, F.lit(n)) for n in names))


def exam_type(c: Column | str) -> Column:
    """Of a text or a name. The names of the two kinds."""
    one, two = _kind(col(c), ("英语（一）", "英语一")), _kind(col(c), ("英语（二）", "英语二"))
    return F.when(one, F.lit("英语一")).when(two, F.lit("英语二")).otherwise(F.lit("未知"))


def exam_type_of_pages(pages: Column | str) -> Column:
    """Of an array of page texts: the first of the first two pages that tells."""
    told = F.filter(F.transform(F.slice(col(pages), 1, 2), exam_type), lambda x: x != "未知")
    return F.coalesce(F.get(told, F.lit(0)), F.lit("未知"))


def year_of_name(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(c), r"(\d{4})", 1), F.lit("")), F.lit("unknown"))


def band(frequency: Column, high: float, medium: float) -> Column:
    return F.when(frequency >= high, F.lit("high")).when(frequency >= medium, F.lit("medium")).otherwise(F.lit("low"))


def treebank(c: Column | str) -> Column:
    """Words as a Treebank tokenizer parts them: contractions and closing punctuation split off, hyphenated words whole."""
    x = F.regexp_replace(col(c), r"(?i)([a-z])(n't|'s|'re|'ve|'ll|'d|'m)([^a-zA-Z]|$)", "$1 $2$3")
    x = F.regexp_replace(x, r"(?i)(^|[^a-zA-Z])(can)(not)([^a-zA-Z]|$)", "$1$2 $3$4")
    x = F.regexp_replace(x, r'[\[\](){}<>"“”‘,;:!?…@#$%&*]|--', " ")
    x = F.regexp_replace(x, r"\.+(\s|$)", " $1")
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def truncated(c: Column | str, limit: int = 70) -> Column:
    """At most `limit` characters, and an ellipsis if more follow."""
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit("…"))).otherwise(col(c))


def highlighted(c: Column | str, word: Column | str, left: str = "<mark>", right: str = "</mark>") -> Column:
    """The first place of a word marked, whatever its case, also inside another word; unchanged where it is absent."""
    c, word = col(c), col(word)
    at = F.instr(F.lower(c), F.lower(word))
    end = at + F.length(word)
    marked = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(left), F.substring(c, at, F.length(word)), F.lit(right), F.substring(c, end, F.length(c)))
    return F.when((at > 0) & (F.length(word) > 0), marked).otherwise(c)


def frequency_class(frequency: Column) -> Column:
    """How a list colours a frequency; its limits are fixed, whatever the settings are."""
    return band(frequency, 0.5, 0.2)
