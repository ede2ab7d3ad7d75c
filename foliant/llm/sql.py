"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from foliant.llm.quality import STOP_WORDS, THRESHOLDS
from foliant.llm.secrets import BASE_RULES, MORE_RULES

_WORD, _SPACES = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _quality() -> str:
    """Counts by words, windows and lines as rows, and the threshold table as one condition."""
    forms = ", ".join(_text(x) for x in dict.fromkeys(x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())))
    measures = {
        "n_words": "n_words",
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbols_per_word": "n_symbols / nullif(n_words, 0)",
        "stop_word_share": "n_stop / nullif(n_words, 0)",
        "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
        "upper_share": "n_upper / nullif(word_chars, 0)",
    }
    terms = [f"coalesce({measures[name]} {sign} {bound}, true)" for name, low, high in THRESHOLDS for sign, bound in ((">=", low), ("<=", high)) if bound is not None]
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY 1),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({forms}))) AS n_stop, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z\\x{{00c0}}-\\x{{00de}}]')) AS n_upper FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(terms)} AS kept FROM b"""


def _secrets() -> str:
    """Spans from the pieces between the matches of each rule and the matches themselves."""
    rules = [*BASE_RULES, *MORE_RULES]
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        p = _text(pattern)
        lists = f"string_split_regex(t, {p}) AS gap, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS own"
        before = "list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
        rows = f"SELECT doc_id, gap, m, own, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, {lists} FROM d)"
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST({before} AS BIGINT) AS s, length(m[k]) AS n FROM ({rows}) WHERE length(own[k]) >= {least}")
    base = ", ".join(f"'{kind}'" for kind, *_ in BASE_RULES)
    joined = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT doc_id, {counts}, {joined} FILTER (kind IN ({base})) AS base, {joined} AS spans FROM f GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _near_duplicates() -> str:
    """All pairs that share a shingle, by exact sets, and what is reachable by links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m, d.doc_id), d.doc_id) AS component_id, d.doc_id = coalesce(least(m, d.doc_id), d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON d.doc_id = r.a"""


def _fill_in_middle() -> str:
    """Cuts by summed lengths of units and substrings of the text."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS UBIGINT)"
    chars = lambda k: f"CAST(coalesce(list_sum(list_transform(u[1:{k}], lambda x: length(x))), 0) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '{_SPACES}*{_WORD}|{_SPACES}+') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST({draw(1)} % (len(u) + 1) AS BIGINT) AS x, CAST({draw(2)} % (len(u) + 1) AS BIGINT) AS y,
  CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR {draw(3)} % 100 >= 50 THEN 'plain' WHEN {draw(4)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, {chars("least(x, y)")} AS a, {chars("greatest(x, y)")} AS b FROM c),
o AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


def _warc() -> str:
    five = lambda k: f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT)"
    digit = lambda k, shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({five(k)} >> {shift}) & 31), 1)"
    base32 = " || ".join(digit(k, shift) for k in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM f"""


def _resample() -> str:
    """CRC-32 by its table over the bytes of distinct words; gains, weights and one global ranking."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = lambda key, name: f"SELECT {key} AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')) AS w FROM {name}"
    bytes_of = "list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH d AS ({words("doc_id", "documents")}), b AS ({words("item_id", "benchmark")}),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
v AS (SELECT w, xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS slot FROM (SELECT w FROM d UNION SELECT w FROM b), tab),
s AS (SELECT slot, count(*) AS n FROM d JOIN v USING (w) GROUP BY 1), t AS (SELECT slot, count(*) AS n FROM b JOIN v USING (w) GROUP BY 1),
g AS (SELECT s.slot, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS gain FROM s LEFT JOIN t ON s.slot = t.slot),
x AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM d JOIN v USING (w) JOIN g USING (slot) GROUP BY 1),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN x ON doc_id = k),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS pos, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= (10 * eligible) // 100 THEN pos END AS rank FROM o"""


ORACLES: dict[str, str] = {
    "op3_minhash_neardup": _near_duplicates(),
    "op4_quality_rules": _quality(),
    "op9_secret_scan": _secrets(),
    "op11_fill_in_middle": _fill_in_middle(),
    "op12_warc": _warc(),
    "op13_resample": _resample(),
}
