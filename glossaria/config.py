"""Settings of an index build and of the queries on it; passed along, never global."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Sections in their order with their labels, the unit of a text without sections, default limits.
SECTIONS = (
    ("use_of_english", "完形填空", "Use of English"),
    ("reading_a", "阅读理解A", "Reading Comprehension Part A"),
    ("reading_b", "阅读理解B", "Reading Comprehension Part B"),
    ("reading_c", "阅读理解C（翻译）", "Reading Comprehension Part C"),
    ("writing_a", "写作A（应用文）", "Writing Part A"),
    ("writing_b", "写作B（大作文）", "Writing Part B"),
)
#: Names of section files.
SECTION_FILES = {"use_of_english": "完形填空", "reading_a": "阅读A", "reading_b": "阅读B", "reading_c": "阅读C_翻译", "writing_a": "写作A", "writing_b": "写作B"}
WHOLE = ("full", "全文")
#: A section that a header names, rather than "Part C", has another English label.
HEADED = {"reading_c": "Translation"}
SECTION_ORDER = tuple(key for key, _, _ in SECTIONS)


@dataclass(frozen=True)
class Settings:
    high_threshold: float = 0.5
    medium_threshold: float = 0.2
    exclude_levels: tuple[str, ...] = ("primary", "zhongkao")
    exclude_groups: tuple[str, ...] = ()
    #: Example sentences of the vocabulary come before those of the papers.
    use_vocab_examples: bool = False
    #: None: the built-in function words; else the caller's list.
    stop_words: tuple[str, ...] | None = None

    def updated(self, given: dict) -> tuple[Settings, bool]:
        """Settings with the known keys of `given`, others ignored; and whether the index has to be built anew.

        Bands are worked out when an index is read, so only exclusions and stop words ask for a new one.
        """
        known = {f.name for f in fields(self)}
        new = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        return replace(self, **new), bool({"exclude_levels", "exclude_groups", "stop_words"} & set(new))
