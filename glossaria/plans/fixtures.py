"""Small inline tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (columns with types, rows)
PARAGRAPHS = (
    "id int, text string",
    [
        (1, "  [[ The economy   grew. ]] "), (2, "Directions:"), (3, "Directions: The economy grew fast."), (4, "Directions: Directions: Growth was slow."),
        (5, "Participants in the study slept."), (6, "Part B"), (7, "Choose the best answer. (10 points) The economy of most countries grew quickly last year."),
        (8, "Choose the best answer. (10 points) Too short."), (9, "He ran in all directions."), (10, "The rate fell sharply. 1. [A] low [B] high"),
        (11, "This is a test of a thing."), (12, "A man walked home."), (13, "He is a good man."), (14, "[A] first option"), (15, "21. What does it imply?"),
        (16, "Most people who read according to the passage agree."), (17, "经济增长率中文很多文字里 ab"), (18, "经济增长率中文很多文字 abc"),
        (19, "Choose the best answer. (10 points) Participants in the long study slept well."),
    ],
)
HYPHENS = ("id int, text string", [(1, "air-\nports"), (2, "air-\n\n  ports"), (3, "the\nword\nnext"), (4, "The\nWord\nnext")])
MEANINGS = ("id int, text string", [(1, "身份 identity card"), (2, "；放弃；抛弃。"), (3, "身份 证明"), (4, "abandon ship"), (5, "放弃 He left it.")])
SECTIONS = (
    "doc string, line_no int, line string",
    [("d", i, x) for i, x in enumerate(["Preamble", "Section I Use of English", "c1", "Section III Writing", "Part A", "w1", "Part B", "w2", "Part C", "t1", "Part B", "r1", "PART A", "r2", "Section IV writing", "x1"])],
)
YEARS = (
    "doc string, line_no int, line string",
    [("d", i, x) for i, x in enumerate(["cover", "1995年全国硕士研究生入学统一考试英语试题", "a b", "1996年全国硕士研究生入学统一考试英语试题", "c", "1995年硕士研究生英语试题", "d"])],
)
MARKS = ("doc string, line_no int, line string", [("d", i, x) for i, x in enumerate(["intro", "(46) The first", "goes on", "(47) The second", "", "plain", "in 1946 too", "中文译文在这里", "end"])])
PARAS = ("doc string, line_no int, line string", [("d", i, x) for i, x in enumerate(["The trade grew", "fast that year.", "", "It fell later", "[A] one [B] two [C] three", "Section II", "Prices rose", "(46) Markets moved.", "Nobody knew why."])])
LOOSE = ("doc string, line_no int, line string", [("d", i, x) for i, x in enumerate(["The first part", "goes on", "", "1. A numbered line", "continues", "2. Another", "中文的一行文字"])])
NAMES = ("id int, text string", [(1, "2010英语一.pdf"), (2, "考研英语（二）2015年"), (3, "notes.pdf"), (4, "英语（一）与英语（二）19991")])
SENSES = ("lemma string, pos string, meaning string, ord int", [("the", "n", "定冠词", 0), ("idiot", "n", "傻子", 0), ("idiot", "v", "犯傻", 1), ("worthless", "adj", "无价值的", 0), ("scum", "art", "x", 0), ("er", "n", "呃", 0), ("eron", "n", "甲", 0), ("eron", "v", "乙", 1)])
WORDBOOK = ("page int, line_no int, line string", [(1, 0, "001 core —— 核心"), (1, 1, "1 abandon v. 放弃"), (1, 2, "He had to abandon the ship."), (1, 3, "2 ability n. 能力"), (2, 0, "adj. 能干的"), (2, 1, "1 able adj. 有能力的"), (2, 2, "She is able to swim.")])
BOOKS = (
    "lemma string, grp string, ord int, senses array<struct<pos:string,meaning:string>>, examples array<string>",
    [("run", "main", 1, [("v", "跑"), ("n", "奔跑")], ["He ran."]), ("run", "basic", 2, [("v", "跑"), ("v", "经营")], ["Run it."]), ("act", "main", 3, [("n", "行为")], [])],
)
SPLIT = (
    "year string, key string, label string, label_en string, source string, ord int, sentences array<string>",
    [("2010", "reading_a", "阅读A", "Reading A", "a.pdf", 0, ["One.", "Two."]), ("2010", "use_of_english", "完形", "Use of English", "a.pdf", 1, ["Three."]), ("2010", "reading_a", "阅读A", "Reading A", "a.pdf", 2, ["Late."]), ("2011", "writing_b", "写作B", "Writing B", "b.pdf", 3, ["Four."])],
)


def frame(spark: SparkSession, fixture) -> DataFrame:
    return spark.createDataFrame(fixture[1], fixture[0])


def values(fixture) -> str:
    """The fixture as a SQL table expression; flat columns only."""
    names = [c.strip().split(" ")[0] for c in fixture[0].split(",")]
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in fixture[1]) + ") AS f(" + ", ".join(names) + ")"
