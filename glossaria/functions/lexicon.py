"""Linguistic tables. Word lists and groups are tables that the caller gives."""

from __future__ import annotations

# Words that never count as vocabulary.
STOP_WORDS = tuple(
    """
    the a an is are was were be been being
    have has had having do does did doing
    will would shall should may might can could
    must i you he she it we they
    me him her us them
    my your his its our their
    this that these those
    and but or not no nor
    to of in for on with at by from
    as about into through during before after
    above below between under again further
    then once here there when where why how
    all both each few more most other some
    such only own same so than too very
    just because if while although though
    what which who whom whose
    also up out off over down
    one two three per much many
    new first last long great little
    said like make know get see go come
    take think say use find give tell
    work call try ask seem feel become leave
    put mean keep let begin show hear
    play run move live believe hold
    bring happen write provide sit stand
    lose pay meet include continue set
    learn change lead understand watch
    follow stop create speak read allow
    add spend grow open walk win offer
    remember love consider appear buy wait
    serve die send expect build stay fall
    cut reach kill remain yet
    re ve ll
    direction
    """.split()
)

# Forms whose lemma is given.
IRREGULAR = {
    "ran": "run", "running": "run", "runs": "run",
    "was": "be", "were": "be", "been": "be", "being": "be",
    "had": "have", "has": "have", "having": "have",
    "did": "do", "done": "do", "doing": "do", "does": "do",
    "went": "go", "gone": "go", "going": "go", "goes": "go",
    "said": "say", "saying": "say", "says": "say",
    "made": "make", "making": "make", "makes": "make",
    "took": "take", "taken": "take", "taking": "take", "takes": "take",
    "came": "come", "coming": "come", "comes": "come",
    "saw": "see", "seen": "see", "seeing": "see", "sees": "see",
    "knew": "know", "known": "know", "knowing": "know", "knows": "know",
    "got": "get", "gotten": "get", "getting": "get", "gets": "get",
    "gave": "give", "given": "give", "giving": "give", "gives": "give",
    "found": "find", "finding": "find", "finds": "find",
    "thought": "think", "thinking": "think", "thinks": "think",
    "told": "tell", "telling": "tell", "tells": "tell",
    "became": "become", "becoming": "become", "becomes": "become",
    "left": "leave", "leaving": "leave", "leaves": "leave",
    "felt": "feel", "feeling": "feel", "feels": "feel",
    "put": "put", "putting": "put", "puts": "put",
    "brought": "bring", "bringing": "bring", "brings": "bring",
    "began": "begin", "begun": "begin", "beginning": "begin", "begins": "begin",
    "kept": "keep", "keeping": "keep", "keeps": "keep",
    "held": "hold", "holding": "hold", "holds": "hold",
    "wrote": "write", "written": "write", "writing": "write", "writes": "write",
    "stood": "stand", "standing": "stand", "stands": "stand",
    "lost": "lose", "losing": "lose", "loses": "lose",
    "paid": "pay", "paying": "pay", "pays": "pay",
    "met": "meet", "meeting": "meet", "meets": "meet",
    "set": "set", "setting": "set", "sets": "set",
    "led": "lead", "leading": "lead", "leads": "lead",
    "spent": "spend", "spending": "spend", "spends": "spend",
    "built": "build", "building": "build", "builds": "build",
    "sent": "send", "sending": "send", "sends": "send",
    "won": "win", "winning": "win", "wins": "win",
    "fell": "fall", "fallen": "fall", "falling": "fall", "falls": "fall",
    "cut": "cut", "cutting": "cut", "cuts": "cut",
    "read": "read", "reading": "read", "reads": "read",
    "spoke": "speak", "spoken": "speak", "speaking": "speak", "speaks": "speak",
    "drove": "drive", "driven": "drive", "driving": "drive", "drives": "drive",
    "ate": "eat", "eaten": "eat", "eating": "eat", "eats": "eat",
    "grew": "grow", "grown": "grow", "growing": "grow", "grows": "grow",
    "rose": "rise", "risen": "rise", "rising": "rise", "rises": "rise",
    "threw": "throw", "thrown": "throw", "throwing": "throw", "throws": "throw",
    "wore": "wear", "worn": "wear", "wearing": "wear", "wears": "wear",
    "chose": "choose", "chosen": "choose", "choosing": "choose",
    "broke": "break", "broken": "break", "breaking": "break", "breaks": "break",
    "caught": "catch", "catching": "catch", "catches": "catch",
    "dealt": "deal", "dealing": "deal", "deals": "deal",
    "forgot": "forget", "forgotten": "forget", "forgetting": "forget",
    "meant": "mean", "meaning": "mean", "means": "mean",
    "sold": "sell", "selling": "sell", "sells": "sell",
    "taught": "teach", "teaching": "teach", "teaches": "teach",
    "drew": "draw", "drawn": "draw", "drawing": "draw",
    "flew": "fly", "flown": "fly", "flying": "fly",
}

# Suffix rules (part, ending, replacement), tried in this order: nouns, verbs, adjectives. The rules of double consonants follow
# from the list of consonants.
_DOUBLE = "bdfgklmnprstvz"
SUFFIXES = (
    ("n", "ies", "y"), ("n", "ses", "s"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "s", ""),
    ("v", "ied", "y"), *(("v", c + c + end, c) for end in ("ed", "ing") for c in _DOUBLE),
    ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("adj", "ier", "y"), ("adj", "iest", "y"), *(("adj", c + c + end, c) for end in ("er", "est") for c in _DOUBLE),
    ("adj", "er", ""), ("adj", "est", ""), ("adj", "er", "e"), ("adj", "est", "e"),
)
#: Letters that a base has at least.
SHORTEST = 3

# Closed word classes, then endings of open ones; anything else is a noun.
CLOSED = {
    "det": "each every some any all both such another",
    "prep": "over under between against during before after without within upon above below",
    "pron": "who whom whose which what someone anyone everyone nothing something",
    "conj": "because although though while whereas unless whether since",
    "num": "one two three four five six seven eight nine ten hundred thousand",
    "aux": "may might shall should ought",
    "int": "oh ah wow hello hey",
    "adv": "very too also then here there now never always often again soon",
}
ENDINGS = (("adv", "ly$"), ("adj", "(ous|ful|ive|able|ible|al|ic|less|ish)$"), ("v", "(ing|ed|ize|ise|ify|ate)$"))
PENN = {
    "VB": "v", "VBD": "v", "VBG": "v", "VBN": "v", "VBP": "v", "VBZ": "v", "NN": "n", "NNS": "n", "NNP": "n", "NNPS": "n",
    "JJ": "adj", "JJR": "adj", "JJS": "adj", "RB": "adv", "RBR": "adv", "RBS": "adv", "IN": "prep", "TO": "prep", "RP": "adv",
    "DT": "det", "PRP": "pron", "PRP$": "pron", "WP": "pron", "CC": "conj", "CD": "num", "MD": "aux", "UH": "int",
}
