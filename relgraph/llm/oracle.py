"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the operators' code."""

from __future__ import annotations

from .common import LOWER, UPPER
from .secret_scan import RULES

_TEXT = "coalesce(text, '')"
_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
#: The contracts' white space, for trim().
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(rank: int) -> str:
    """A list of (at, rank, kind, upto, g): pieces between the matches give where they start."""
    r = RULES[rank]
    p = _quoted(r.pattern)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1), lambda i: struct_pack(
        at := list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p}, 0)[1:i - 1], lambda x: length(x))), 0),
        rank := {rank}, kind := '{r.kind}', m := length(regexp_extract_all(t, {p}, 0)[i]), g := length(regexp_extract_all(t, {p}, {r.group})[i]))), lambda s: s.g >= {r.least})"""


_LIST = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.at::BIGINT || ':' || (s.at + s.m)::BIGINT), ',')"

SECRETS = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents),
s AS (SELECT doc_id, {", ".join(f"{_spans(i)} AS s{i}" for i in range(len(RULES)))} FROM d)
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex,
    sha256({_LIST.format("list_sort(s0 || s1 || s2)")}) AS base_sha256,
    {_LIST.format(f"list_sort({' || '.join(f's{i}' for i in range(len(RULES)))})")} AS spans
FROM s"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split({_TEXT}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {_FOLD.format(f"trim(line, {_WHITE})")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, line, pos, coalesce(owner = k.doc_id, true) AS stays FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR || ':' || {_TEXT}), 1, 14))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER x, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER x, 0) AS rest_w
    FROM s WINDOW x AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(rest_w) AS free_w, arg_max(rest, rest_w) AS free FROM r WHERE NOT cap / w <= rest / rest_w),
t AS (SELECT source, source_size, CASE WHEN cap / w <= rest / rest_w THEN cap::DOUBLE ELSE (free * w)::DOUBLE / free_w::DOUBLE END AS target FROM r, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS run FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target, (p.passes * d.size + CASE WHEN g.run <= floor(target)::BIGINT - passes * source_size THEN d.size
    WHEN g.run - g.n < floor(target)::BIGINT - passes * source_size THEN (floor(target)::BIGINT - passes * source_size - g.run + g.n) * d.size // g.n ELSE 0 END)::BIGINT AS taken
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h"""

_WORDS = f"regexp_extract_all({_FOLD.format(_TEXT)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[k:k + 12], ' ') AS win FROM i, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM w),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
m AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) AS k)),
hit AS (SELECT m.doc_id, m.k, m.n, w.item FROM m JOIN w ON w.n = m.n AND w.win = m.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x),
b AS (SELECT page_id, strlen(t) AS payload_bytes, first, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(p.x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest FROM p JOIN f ON f.x = p.x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

#: Words in windows of a size that occur twice or more; the union of all repeats of 8 words or more is that of repeated windows of 8.
_WINDOWS = """
k{n} AS (SELECT doc_id, i, hash(ws[i:i + {n} - 1]) AS h, hash(ws[i:i + {n} - 1], {n}) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(0, len(ws) - {n} + 1) + 1)) AS i)),
r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h, g) AS n FROM k{n}) WHERE n > 1),
c{n} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM r{n}) GROUP BY doc_id)"""

QUALITY = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
{_WINDOWS.format(n=5)}, {_WINDOWS.format(n=8)}, {_WINDOWS.format(n=101)},
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c8.n, 0) AS covered_words, coalesce(c101.n, 0) AS far
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN c101 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 5 * covered_words <= n_words AND far = 0 AS kept FROM m"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format(_TEXT)}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON b.x = a.x AND b.doc_id <> a.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

ORACLE: dict[str, str] = {
    "op1_secret_scan": SECRETS,
    "op2_line_dedup": LINES,
    "op3_source_mix": MIX,
    "op4_repetition": QUALITY,
    "op5_decontaminate": DECONTAMINATE,
    "op7_near_dedup": NEAR,
    "op9_warc": WARC,
}
