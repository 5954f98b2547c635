"""SQL twins of the text operators that SQL can express: substring copies, quality rules and decontamination."""

from __future__ import annotations

from . import decontamination, quality_rules, substrings

WORDS = r"[^\x20\x09-\x0D]+"

# rows of the documents, numbered in the order in which windows count as earlier or later
OP3 = rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i + 1, i + {substrings.WINDOW}), ' ') AS t FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {substrings.WINDOW - 1}, 0))) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY t ORDER BY r, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substrings.WINDOW})) AS i FROM again),
lost AS (SELECT r, list(i) AS g FROM gone GROUP BY r),
kept AS (SELECT d.r, list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i - 1)) AS k FROM d LEFT JOIN lost USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM d JOIN kept USING (r)"""


def _op6(labels: str = "labels", risk: float = quality_rules.RISK) -> str:
    strata = "CASE " + " ".join(f"WHEN n_words < {n} THEN {k}" for k, n in enumerate(quality_rules.STRATA)) + f" ELSE {len(quality_rules.STRATA)} END"
    level = f"{quality_rules.DELTA!r}::DOUBLE / {(len(quality_rules.STRATA) + 1) * len(quality_rules.RULES)}"
    limit = f"({risk!r}::DOUBLE / {len(quality_rules.RULES)})"
    shares = " UNION ALL ".join(
        f"SELECT r, doc_id, stratum, '{rule}' AS rule, CASE WHEN {size} > 0 THEN {count}::DOUBLE / {size} ELSE 0.0 END AS share FROM f WHERE NOT base_failed" for rule, (count, size, _) in quality_rules.RULES.items()
    )
    steps = ", ".join(f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, (_, _, cs) in quality_rules.RULES.items() for i, c in enumerate(cs))
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
tri AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {strata} AS stratum FROM c),
q AS (SELECT doc_id, min(quality) AS quality FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
s AS ({shares}), steps(rule, i, cut) AS (VALUES {steps}),
m AS (SELECT stratum, rule, i, cut, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1 AND share > cut) AS lost, count(*) FILTER (WHERE quality = 0 AND share > cut) AS caught FROM s JOIN q USING (doc_id) JOIN steps USING (rule) GROUP BY ALL),
tail AS (SELECT *, good > 0 AND lost < good AND list_sum(list_transform(range(0, lost + 1), lambda k: exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({limit}) + (good - k) * ln(1 - {limit})))) <= {level} AS fits FROM m),
runs AS (SELECT *, bool_and(fits) OVER (PARTITION BY stratum, rule ORDER BY i) AS admitted FROM tail),
chosen AS (SELECT stratum, rule, arg_min(cut, -caught * 1000 + i) AS cut FROM runs WHERE admitted AND caught > 0 GROUP BY stratum, rule),
bad AS (SELECT DISTINCT r FROM s JOIN chosen USING (stratum, rule) WHERE share > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM f LEFT JOIN bad USING (r)"""


_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t FROM (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM (SELECT *, least({decontamination.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, t)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS its FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(len(coalesce(its, [])) AS BIGINT) AS n_items, sha256(array_to_string(coalesce(its, []), ',')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND {decontamination.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; a step takes one row, after up to two insertions
OP11 = r"""WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) x(n)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
part AS (SELECT src.*, xor(list_reduce(range(1, len(k) + 1), lambda c, i: xor(c >> 8, t[(xor(c, ord(k[i])::BIGINT) & 255) + 1]), 4294967295), 4294967295) % 20 AS p FROM src, tab),
dam AS (SELECT conv_id, turn, CASE p WHEN 4 THEN 'user' ELSE role END AS role, CASE p WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE p WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM part WHERE p <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dam),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS w FROM r),
made(s, n) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)), kept(s, x, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
who(s, name) AS (VALUES (2, 'user'), (3, 'assistant')),
pre AS (SELECT s, 0 AS cost, '' AS e, [] AS l, s AS n FROM made UNION ALL SELECT m.s, 2, 'I', [name || ':'], m.n FROM made m JOIN who ON who.s = m.n
 UNION ALL SELECT m.s, 4, 'II', [v.name || ':', w.name || ':'], o.n FROM made m JOIN made o ON o.s = m.n JOIN who v ON v.s = m.n JOIN who w ON w.s = o.n),
dp(conv_id, i, s, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM conversations
 UNION ALL SELECT conv_id, i, s, min(best) FROM (
  SELECT d.conv_id, f.i, z.n AS s, {'cost': best.cost + pre.cost + z.cost, 'audit': best.audit || pre.e || z.e, 'lines': list_concat(list_concat(best.lines, pre.l), z.l)} AS best
  FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN pre ON pre.s = d.s,
  LATERAL (SELECT 3 AS cost, 'D' AS e, []::VARCHAR[] AS l, pre.n AS n UNION ALL SELECT f.cut::INT, 'K', [f.role || ':' || f.text], kept.n FROM kept WHERE kept.s = pre.n AND kept.x = f.x AND NOT f.blank AND NOT f.again
   UNION ALL SELECT 2 + f.cut::INT, 'R', [name || ':' || f.text], made.n FROM made JOIN who ON who.s = made.n WHERE made.s = pre.n AND NOT f.blank AND NOT f.again) z) GROUP BY conv_id, i, s),
size AS (SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id),
done AS (SELECT d.conv_id, min({'cost': best.cost + pre.cost, 'audit': best.audit || pre.e, 'lines': list_concat(best.lines, pre.l)}) AS best FROM dp d JOIN size z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.i = d.i JOIN pre ON pre.s = d.s WHERE pre.n IN (0, 3) GROUP BY d.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
 count(*) FILTER (i > 1 AND w || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
 sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256 FROM done LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM done.conv_id"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS words FROM f GROUP BY lang, source), sl AS (SELECT lang, sum(words) AS words FROM s GROUP BY lang),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 5)) // (s.words + 5 * v.v)::HUGEINT AS p FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
q AS (SELECT a.lang, a.term, 1 + (1000000000::HUGEINT * (a.n + 5)) // (sl.words + 5 * v.v)::HUGEINT AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term) a JOIN sl USING (lang) JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= 50"""

OP13 = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r"""

#: Labels that follow from the texts, so that every stratum has many good ones at any size.
PLANTED = "(SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) > 4 OR doc_id % 11 = 0 THEN 0 ELSE 1 END AS quality FROM documents)"

ORACLE_SQL = {"quality_rules_planted": _op6(PLANTED, 0.3), "op3_substrings": OP3, "op6_quality_rules": _op6(), "op9_decontamination": OP9, "op11_conversation_repair": OP11, "op12_source_divergence": OP12, "op13_exact_dedup": OP13}
