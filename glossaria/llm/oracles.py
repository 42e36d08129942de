"""SQL (DuckDB) for the operators whose results SQL can state."""

from __future__ import annotations

from .quality_rules import RULES, STEPS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules(alpha: float = 0.02, delta: float = 0.05) -> str:
    """Statistics, base rules, the path of joint cutoffs tested by exact binomial tails in order, verdicts."""
    grid = ", ".join(f"('{r}', {j * len(RULES) + i}, {c})" for i, (r, g) in enumerate(RULES.items()) for j, c in enumerate(g))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    order = ", ".join(f"'{r}'" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, lang, w, len(w) AS n_words, length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS ls,
  length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(1)) AS x FROM b, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, x), range(8) AS r(k) GROUP BY doc_id),
s AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, n_upper FROM b LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_rate, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_rate,
  coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_rate, coalesce(n_upper / nullif(word_chars, 0), 0.0) AS upper_rate, coalesce(word_chars / nullif(n_words, 0), 0.0) AS chars_per_word FROM s),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT * FROM (VALUES {grid}) AS v(rule, t, cutoff)),
own AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, base_failed, rule, min(t) FILTER ({value} > cutoff) AS own FROM r, g GROUP BY ALL),
fst AS (SELECT doc_id, stratum, min(own) AS f FROM own WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
k AS (SELECT stratum, t, count(*) AS n, count(*) FILTER (f <= t) AS k FROM fst, range({STEPS}) AS q(t) GROUP BY ALL),
p AS (SELECT *, CASE WHEN n = 0 OR k >= n * {alpha!r} THEN 1.0 ELSE least(1.0, (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))) FROM range(k + 1) AS q(i))) END AS p,
  {delta!r} / (SELECT count(DISTINCT stratum) FROM k) AS level FROM k),
l AS (SELECT stratum, coalesce(min(CASE WHEN p > level THEN t END), {STEPS}) - 1 AS last FROM p GROUP BY stratum),
f AS (SELECT doc_id, list(rule ORDER BY list_position([{order}], rule)) AS failed_rules FROM own JOIN l USING (stratum) WHERE own <= last GROUP BY doc_id)
SELECT r.* EXCLUDE (lang), coalesce(failed_rules, []) AS failed_rules, NOT base_failed AND coalesce(len(failed_rules), 0) = 0 AS kept FROM r LEFT JOIN f USING (doc_id)"""


_REACH = """reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}, deg AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN deg ON vec_id = deg.a LEFT JOIN low ON vec_id = low.a"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON doc_id = low.a"""


_HASHES = ", ".join(f"('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
_SPLIT = "array_to_string(u[{}:{}], '')"

#: Units of the whole text by a regular expression, cuts by slices of them.
FILL_IN_MIDDLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_HASHES} FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {_SPLIT.format("1", "a")} AS prefix, {_SPLIT.format("a + 1", "b")} AS middle, {_SPLIT.format("b + 1", "n")} AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

#: CRC-32 by its table, prefixes as whole strings, subtrees by the paths of each node's smallest member.
PREFIX_TRIE = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS i, r, x FROM src),
tb AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tb),
cv AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
  xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1]), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), tb),
r1 AS (SELECT c.conv_id, t.i AS d, r, x FROM cv c JOIN t ON t.conv_id = c.base AND t.i <= c.h),
nb AS (SELECT c.conv_id, count(r1.d) AS n FROM cv c LEFT JOIN r1 USING (conv_id) GROUP BY c.conv_id),
re AS (SELECT * FROM r1 UNION ALL SELECT t.conv_id, t.i - c.h + nb.n, r, x FROM t JOIN cv c USING (conv_id) JOIN nb USING (conv_id) WHERE t.i > c.h),
ps AS (SELECT conv_id, d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
  sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM re),
pk AS (SELECT *, CASE WHEN d = 1 THEN '' ELSE lag(k) OVER (PARTITION BY conv_id ORDER BY d) END AS pk FROM ps UNION ALL SELECT conv_id, 0, 0, '', NULL FROM cv),
nd AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(pk) AS pk FROM pk GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM nd WHERE d > 0 GROUP BY ALL),
kn AS (SELECT nd.*, coalesce(kids.n, 0) AS n_children FROM nd LEFT JOIN kids ON kids.d = nd.d AND kids.k = nd.k),
sub AS (SELECT a.d, a.k, sum((kn.n_convs - 1) * kn.words)::BIGINT AS saved_tokens, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves FROM kn JOIN pk a ON a.conv_id = kn.conv_id AND a.d <= kn.d GROUP BY a.d, a.k),
fin AS (SELECT conv_id, max(d) AS d, arg_max(k, d) AS k FROM pk GROUP BY conv_id),
en AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM fin GROUP BY d, k)
SELECT kn.conv_id, kn.d AS depth, up.conv_id AS parent_conv_id, kn.n_convs, kn.n_children, sub.n_leaves, sub.saved_tokens, coalesce(en.e, sha256('')) AS ends_sha256
FROM kn JOIN sub ON sub.d = kn.d AND sub.k = kn.k LEFT JOIN kn up ON up.d = kn.d - 1 AND up.k = kn.pk LEFT JOIN en ON en.d = kn.d AND en.k = kn.k
"""

#: Base32 from five hexadecimal digits, which are four of its own, at a time.
ZIP_WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS hex FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS five FROM r)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM b
"""
