"""DuckDB SQL for the results of the operators that SQL can express: licenses, plain messages, secrets, line dedup, decontamination, quality rules, near duplicates, fill-in-middle, lexical search."""

from __future__ import annotations

from . import licenses, secrets
from .common import LOWER, UPPER
from .decontam import OVERLAP, SHORTEST, SUBSTITUTIONS
from .quality import GRIDS

BLANKS = r"'[\x20\x09-\x0D]+'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {BLANKS}), lambda x: x <> '')"


#: Lines by places; the different ones by first places; each without one word. `unit` stands between words.
LINE_DEDUP = f"""WITH lines AS (SELECT doc_id, line_no, line, ws, len(ws) AS n, array_to_string(ws, chr(31)) AS whole FROM
  (SELECT doc_id, line_no, line, {_words("line")} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))),
placed AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY doc_id, line_no) AS copy FROM lines),
firsts AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM placed WHERE copy = 1 AND n >= 5),
less AS (SELECT id, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), chr(31)) AS rest FROM (SELECT id, ws, unnest(range(1, n + 1)) AS i FROM firsts)),
edited AS (SELECT a.id FROM less a JOIN (SELECT i, rest, min(id) AS id FROM less GROUP BY 1, 2) b ON a.i = b.i AND a.rest = b.rest AND b.id < a.id
  UNION SELECT a.id FROM less a JOIN firsts b ON a.rest = b.whole AND b.id < a.id
  UNION SELECT a.id FROM firsts a JOIN (SELECT rest, min(id) AS id FROM less GROUP BY 1) b ON a.whole = b.rest AND b.id < a.id),
judged AS (SELECT p.*, n > 0 AND (copy > 1 OR whole IN (SELECT whole FROM firsts WHERE id IN (SELECT id FROM edited))) AS gone FROM placed p),
left_over AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(CASE WHEN gone THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no) AS removed, string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY line_no) AS text FROM judged GROUP BY 1)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END) AS text_sha256 FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id"""


def _alnum(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


#: Equal words of text and item by shift; windows that begin at an equal word are enough, as others hold no more.
DECONTAMINATION = f"""WITH texts AS (SELECT doc_id, {_alnum("text")} AS ws FROM documents), items AS (SELECT item_id, {_alnum("text")} AS ws FROM benchmark),
tw AS (SELECT doc_id, len(ws) AS n_text, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM texts), iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM items WHERE len(ws) >= {SHORTEST}),
met AS (SELECT doc_id, item_id, n, least({OVERLAP}, n) AS k, p - q AS shift, q, least(n_text - greatest(p - q, 0), n - greatest(q - p, 0)) AS words FROM tw JOIN iw ON tw.w = iw.w),
counted AS (SELECT *, CASE WHEN n < {OVERLAP} THEN count(*) OVER (PARTITION BY doc_id, item_id, shift) ELSE count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND {OVERLAP - 1} FOLLOWING) END AS equal FROM met),
found AS (SELECT DISTINCT doc_id, item_id, greatest(shift, 0) AS start, words FROM counted WHERE words >= k AND equal >= ceil(round(k * (1 - {SUBSTITUTIONS}), 9)))
SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, CAST(sum(c) AS BIGINT) AS n_hits FROM (SELECT doc_id, item_id, count(*) AS c FROM found GROUP BY 1, 2) GROUP BY 1"""


def _quality(risk: float, level: float) -> str:
    grid = ", ".join(f"('{rule}', CAST({c} AS DOUBLE))" for rule, cuts in GRIDS.items() for c in cuts)
    tail = f"CASE WHEN k >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END"
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    metrics = {"symbol_rate": rate("n_symbols", "word_chars"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"), "upper_rate": rate("upper", "word_chars"), "long_word_rate": rate("word_chars", "n_words")}
    without = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, chr(0) || 'null') AS stratum, coalesce(text, '') AS t, {_words("text")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
eights AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, p, ws[p + 1:p + 8] AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 7, 0))) AS p FROM d))),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM eights WHERE c > 1) GROUP BY 1),
counted AS (SELECT d.doc_id, stratum, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {without("[#*$%&|<>]")} AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {without("[A-Z]")} AS upper FROM d LEFT JOIN repeated r ON d.doc_id = r.doc_id),
rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in metrics.items())} FROM counted),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
seen AS (SELECT r.*, good, substr(md5(CAST(r.doc_id AS VARCHAR)), 1, 1) < '8' AS tune FROM rated r JOIN good g ON r.doc_id = g.doc_id WHERE NOT base_failed),
long AS (UNPIVOT (SELECT doc_id, stratum, good, tune, {", ".join(GRIDS)} FROM seen) ON {", ".join(GRIDS)} INTO NAME rule VALUE v),
gains AS (SELECT stratum, l.rule, cut, count(*) FILTER (NOT good) - 10 * count(*) FILTER (good) AS gain FROM long l JOIN (VALUES {grid}) g(rule, cut) ON l.rule = g.rule AND v > cut WHERE tune GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS i FROM (SELECT stratum, rule, cut, gain FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cut DESC) = 1)),
held AS (SELECT s.doc_id, s.stratum, min(CASE WHEN v > cut THEN i END) AS lost_at FROM long s JOIN best b ON s.stratum = b.stratum AND s.rule = b.rule WHERE good AND NOT tune GROUP BY 1, 2),
ks AS (SELECT stratum, i, count(*) AS n, count(*) FILTER (lost_at <= i) AS k FROM held, (SELECT unnest(range(1, {len(GRIDS) + 1})) AS i) GROUP BY 1, 2),
acting AS (SELECT stratum, count(*) FILTER ({tail} <= {level} / (SELECT greatest(1, count(DISTINCT stratum)) FROM best)) AS m FROM ks GROUP BY 1),
cuts AS (SELECT b.* FROM best b JOIN acting a ON b.stratum = a.stratum AND b.i <= a.m),
lost AS (SELECT DISTINCT doc_id FROM (UNPIVOT (SELECT doc_id, stratum, {", ".join(GRIDS)} FROM rated) ON {", ".join(GRIDS)} INTO NAME rule VALUE v) r JOIN cuts c ON r.stratum = c.stratum AND r.rule = c.rule AND v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM lost) AS kept FROM rated"""


QUALITY = _quality(0.01, 0.05)

#: Sets of shingles, links by shared shingles, components by what is reachable.
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END)) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reached GROUP BY 1) r ON r.a = d.doc_id"""



def _licenses(threshold: float) -> str:
    """Windows that begin at a template's token are enough, as others hold no more."""
    split = lambda t: t.split(" ")  # noqa: E731  templates and phrases are words with blanks between
    tokens = ", ".join(f"({i}, '{label}', {len(split(t))}, '{w}')" for i, (t, label) in enumerate(licenses.TEMPLATES.items()) for w in sorted(set(split(t))))
    phrases = ", ".join(f"({split(t)}, '{label}')" for t, label in licenses.PHRASES.items())
    return rf"""WITH texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
base AS (SELECT doc_id, p, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM texts) JOIN (VALUES {phrases}) f(phrase, label) ON ws[p + 1:p + len(phrase)] = phrase),
listed AS (SELECT * FROM (VALUES {tokens}) x(t, label, n_words, w)),
sized AS (SELECT t, count(*) AS n, CAST(ceil(round({threshold} * count(*), 9)) AS BIGINT) AS need FROM listed GROUP BY 1),
tokens AS (SELECT l.*, n, need, n_words + n - need AS span FROM listed l JOIN sized s ON s.t = l.t),
met AS (SELECT doc_id, p, t, label, n, need, span, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM texts) JOIN tokens USING (w)),
runs AS (SELECT a.doc_id, a.t, a.label, a.n, a.need, a.p, count(DISTINCT b.w) AS c FROM met a JOIN met b ON a.doc_id = b.doc_id AND a.t = b.t AND b.p BETWEEN a.p AND a.p + a.span - 1 GROUP BY ALL),
found AS (SELECT doc_id, label, c / n AS share FROM runs WHERE c >= need UNION ALL SELECT doc_id, label, 1.0 FROM base),
bases AS (SELECT doc_id, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM texts t LEFT JOIN bases b ON b.doc_id = t.doc_id LEFT JOIN every e ON e.doc_id = t.doc_id"""


def _secrets(scope: int) -> str:
    kinds = {"assign": (secrets.ASSIGN, 2, 8), "access": (secrets.ACCESS, 0, 16), "hex": (secrets.HEX, 0, 32), "identifier": (secrets.IDENTIFIER, 2, 3), "endpoint": (secrets.ENDPOINT, 2, 4), "run": ("[A-Za-z0-9+/_=-]+", 0, 8)}

    def places(kind: str, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        each = f"SELECT doc_id, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS g, unnest(string_split_regex(t, {p})) AS gap, unnest(range(len(string_split_regex(t, {p})))) AS i FROM d"
        return f"SELECT doc_id, '{kind}' AS kind, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(g) >= {least} AS fits FROM ({each}) WHERE m IS NOT NULL"

    near = lambda role: f"coalesce(bool_or(q.role = '{role}' AND (p.s - q.e BETWEEN 0 AND {scope} OR q.s - p.e BETWEEN 0 AND {scope})), false)"
    said = lambda when: f"coalesce(string_agg(CASE WHEN {when} THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, rank, e), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
places AS (SELECT doc_id, kind, m, e - length(m) AS s, e FROM ({" UNION ALL ".join(places(k, *v) for k, v in kinds.items())}) WHERE fits),
named AS (SELECT * FROM places WHERE kind IN ('identifier', 'endpoint')),
keys AS (SELECT r.* FROM places r WHERE kind = 'run' AND regexp_full_match(m, '[A-Za-z0-9+/_-]+={{0,2}}') AND doc_id IN (SELECT doc_id FROM places WHERE kind IN ('identifier', 'endpoint', 'access'))
  AND (length(rtrim(m, '=')) >= 32 OR (length(rtrim(m, '=')) >= 8 AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = r.doc_id AND r.s < n.e AND n.s < r.e)))),
parts AS (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, kind, s, e, CASE kind WHEN 'identifier' THEN 'id' WHEN 'access' THEN 'id' WHEN 'endpoint' THEN 'end' ELSE 'secret' END AS role, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'identifier' THEN 3 ELSE 5 END AS rank FROM places WHERE kind <> 'run'
  UNION ALL SELECT doc_id, 'key', s, e, 'secret', 4 FROM keys)),
weighed AS (SELECT p.id, p.kind, {near("id")} AS id_near, {near("secret")} AS secret_near, {near("end")} AS end_near, bool_or(q.rank < 3 AND q.id <> p.id AND q.s <= p.s AND p.e <= q.e) AS inside FROM parts p JOIN parts q ON p.doc_id = q.doc_id WHERE p.rank > 2 GROUP BY 1, 2),
shown AS (SELECT * FROM parts WHERE rank < 3 OR id IN (SELECT id FROM weighed WHERE NOT inside AND CASE kind WHEN 'identifier' THEN secret_near WHEN 'key' THEN id_near OR end_near ELSE id_near AND secret_near END)),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {said("rank < 3")} AS base, {said("true")} AS spans FROM shown GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told ON told.doc_id = d.doc_id"""


#: Runs of words as long as a template's window, with their distinct tokens.
LICENSES = _licenses(0.9)
#: All parts with their places, and joins of the parts of a text. A key is a whole run of its characters.
SECRETS = _secrets(300)

#: Plain messages, which is all that the given tables hold; where turns hold calls or results, it has no rows for them.
TOOL_CALLS = """SELECT conv_id, turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, false AS linked, true AS valid, turn AS anchor_turn, CAST(NULL AS INTEGER) AS level, CAST(0 AS INTEGER) AS part,
  CAST(to_json({'content': coalesce(text, ''), 'role': coalesce(role, '')}) AS VARCHAR) AS json, CAST(NULL AS VARCHAR) AS extra, CAST(NULL AS VARCHAR) AS turn_json, CAST(NULL AS BOOLEAN) AS declared, CAST(NULL AS VARCHAR) AS unchecked
  FROM conversations WHERE NOT coalesce(CASE WHEN json_valid(text) THEN role = 'assistant' AND json_array_length(text, '$.tool_calls') > 0 OR role = 'tool' AND json_exists(text, '$.tool_call_id') END, false)"""

#: Cuts by the hash of the id; the parts in the form's order.
FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def _terms(table: str, key: str) -> str:
    return rf"SELECT {key}, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM {table}"


#: All documents' scores for all items, ranked.
LEXICAL = f"""WITH words AS ({_terms("documents", "doc_id")}), asked AS (SELECT item_id, term, count(*) AS times FROM ({_terms("benchmark", "item_id")}) GROUP BY 1, 2),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1), whole AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY 1),
scored AS (SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings p USING (term) JOIN sizes s ON s.doc_id = p.doc_id, whole GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""

ALL = {"op1_license_scan": LICENSES, "op3_tool_calls": TOOL_CALLS, "op4_secrets": SECRETS, "op5_line_dedup": LINE_DEDUP, "op6_decontamination": DECONTAMINATION, "op7_quality_rules": QUALITY, "op8_near_duplicates": NEAR_DUPLICATES, "op11_fill_in_middle": FILL_IN_MIDDLE, "op13_lexical_search": LEXICAL}
