"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quern.llm.mixing import SPREAD
from quern.llm.quality_rules import BIT, MEASURES, POLICIES, RULES, mask

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '')"


def quality_sql(docs: str = "documents") -> str:
    """The ledger of the quality rules over a relation."""
    bits = " + ".join(f"(CASE WHEN {fails} THEN {BIT[name]} ELSE 0 END)" for name, fails in RULES)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws, row_number() OVER () AS rid FROM {docs}),
win AS (SELECT rid, p, hash_of FROM (
  SELECT rid, unnest(range(1, greatest(len(ws) - 6, 1))) AS p, ws FROM w) x, LATERAL (SELECT array_to_string(x.ws[x.p:x.p + 7], ' ') AS hash_of) y),
dup AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, hash_of) AS c FROM win) q WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM dup) q GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(regexp_replace(array_to_string(ws, ''), '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
  CAST(length(regexp_replace(array_to_string(ws, ''), '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN cov USING (rid)),
led AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, {", ".join(MEASURES)}, (failed_bits & {mask("base-1")}) <> 0 AS base_failed, (failed_bits & {mask("web-1")}) = 0 AS kept, failed_bits FROM led"""


def mixing_sql(docs: str = "documents", seed: int = 7) -> str:
    """The systematic sample over a relation: doc_id, size, source_size, target, taken."""
    number = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    return rf"""
WITH r AS (SELECT doc_id, source, text, CAST(len({WORDS}) AS BIGINT) AS size, row_number() OVER () AS rid FROM {docs}),
c AS (SELECT *, length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) AS cls, {number.format(f"concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), md5(text)))")} AS mx FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM k),
f AS (SELECT *, coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS full_, CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS open_, CAST(sum(source_size) OVER () AS BIGINT) AS all_ FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, k)),
l AS (SELECT *, (CAST(all_ AS DOUBLE) * CAST(1.5 AS DOUBLE) - full_) / open_ AS level_ FROM f),
g AS (SELECT *, level_ * w >= cap AS fills FROM l),
t AS (SELECT source, source_size, CASE WHEN fills THEN CAST(cap AS DOUBLE) ELSE (SELECT level_ FROM g WHERE NOT fills ORDER BY CAST(cap AS DOUBLE) / w, k LIMIT 1) * w END AS target FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, mx % {SPREAD}, size, mx, doc_id, rid) - 1 AS pos FROM c),
q AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.pos,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share,
  CAST({number.format(f"concat_ws(':', '{seed}', p.source)")} % 1048576 AS DOUBLE) / 1048576 AS off
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(off + share * (pos + 1)) - floor(off + share * pos), 2) AS BIGINT) AS taken FROM q"""


WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS f FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN f <> page_id AND n >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id AND n >= 100 THEN f END AS refers_to FROM d LEFT JOIN f USING (h)"""

URL_FILTERS = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 365 AS INTEGER)) AS t,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda v: v <> '') AS parts FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS n FROM c WHERE host <> ''),
e AS (SELECT 'hosts' AS l, host AS k, 'block' AS a, n % 300 AS d FROM h WHERE n % 4 = 0
  UNION SELECT 'hosts', host, 'remove', n % 300 + 60 FROM h WHERE n % 8 = 0
  UNION SELECT 'hosts', host, 'block', n % 300 + 90 FROM h WHERE n % 16 = 0
  UNION SELECT 'review', host || '/en', 'allow', n % 250 FROM h WHERE n % 12 = 0
  UNION VALUES ('spam', 'cheap-pills.example.com', 'block', 0), ('spam', 'casino.example.net', 'block', 40), ('spam', 'example.org', 'block', 200), ('spam', 'example.org', 'remove', 220)),
o AS (SELECT l, k, d, max(a) AS a FROM e GROUP BY l, k, d),
v AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS since, TIMESTAMP '2024-01-01' + to_days(CAST(lead(d) OVER (PARTITION BY l, k ORDER BY d) AS INTEGER)) AS until FROM o),
x AS (SELECT page_id, url, t, array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - g + 1, len(string_split(host, '.'))), '.') AS k, g AS depth
    FROM c, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS g) q WHERE host <> ''
  UNION ALL SELECT page_id, url, t, host || '/' || array_to_string(parts[1:g], '/'), g + 16777216 FROM c, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS g) q WHERE host <> ''),
m AS (SELECT x.page_id, x.depth, v.a, v.l, v.k FROM x JOIN v ON x.k = v.k AND x.t >= v.since AND (v.until IS NULL OR x.t < v.until) WHERE v.a <> 'remove'),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, a <> 'block', l, k) AS r FROM m)
SELECT c.page_id, c.t AS fetched_at, coalesce(b.a = 'block', FALSE) AS blocked, b.l AS by_list, b.k AS by_key FROM c LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (page_id)"""

UPPER = "".join(map(chr, range(65, 91)))


def near_sql(docs: str = "documents", percent: int = 80) -> str:
    """Two-word sets, links by sets that share one of their rarest shingles (a link has to), and all that is reachable."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM {docs}),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS p FROM e JOIN f USING (g)),
p AS (SELECT * FROM r WHERE p <= n - (n * {percent} + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}),
i AS (SELECT x, y, len(a.sh) + len(b.sh) AS both_, len(list_intersect(a.sh, b.sh)) AS inter FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y),
l AS (SELECT x, y FROM i WHERE 100 * inter >= {percent} * (both_ - inter)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t AS (SELECT doc_id AS id, doc_id AS root FROM {docs} UNION SELECT t.id, u.y FROM t JOIN u ON u.x = t.root),
m AS (SELECT id, min(root) AS component_id FROM t GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.id = s.doc_id"""


def repeats_sql(docs: str = "documents", window: int = 35) -> str:
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS ws FROM {docs}),
x AS (SELECT rid, p, array_to_string(ws[p:p + {window - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {window - 2}, 1))) AS p FROM w) a),
d AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY g) AS c FROM x) b WHERE c > 1),
g AS (SELECT DISTINCT rid, unnest(range(p, p + {window})) AS q FROM d),
k AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
v AS (SELECT rid, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS q FROM w),
o AS (SELECT rid, string_agg(v, ' ' ORDER BY q) AS kept FROM v ANTI JOIN g USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid) LEFT JOIN o USING (rid)"""


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32 by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


LETTER_BREAK = r"[^A-Za-z\x{00C0}-\x{00FF}]+"

SPELLING = rf"""
WITH RECURSIVE crc_table AS (SELECT {_crc_table()}::BIGINT[] AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(run, '{UPPER}', '{UPPER.lower()}') AS k, translate(run, '{UPPER}', '{UPPER.lower()}') AS run
  FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{LETTER_BREAK}')) AS run FROM documents) x WHERE length(run) >= 6),
c AS (SELECT k, run, count(*) AS n FROM r GROUP BY k, run),
b AS (SELECT run, n, hex(encode(k)) AS x, length(run) AS size FROM c),
h AS (SELECT run, n, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM b, crc_table),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v) x),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, e.n, v.word, v.n FROM e JOIN v ON e.d = v.word
  UNION SELECT v.word, v.n, e.word, e.n FROM e JOIN v ON e.d = v.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.near_n >= 5 * v.n THEN k.near END AS form, CASE WHEN k.near_n >= 5 * v.n THEN k.near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (word)),
o AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT o.word, f.word, f.form FROM o JOIN f ON o.nxt = f.word)
SELECT f.word, f.form, o.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN o USING (word) WHERE o.nxt IS NULL"""


def _turn_step() -> str:
    """Best (cost, audit, text) of each state behind one more row, from those before it."""
    add = lambda q, cost, letter, said: f"{{'c': a.s{q}.c + {cost}, 'a': a.s{q}.a || '{letter}', 't': a.s{q}.t || {said}}}"
    kept, user, bot = "chr(10) || x.r || ':' || x.t", "chr(10) || 'user:' || x.t", "chr(10) || 'assistant:' || x.t"
    stay = lambda ok, what: f"CASE WHEN x.f NOT IN (1, 2) AND {ok} THEN {what} ELSE {{'c': 1000000000, 'a': '', 't': ''}} END"
    late = "(CASE WHEN x.f = 3 THEN 5 ELSE 0 END)"
    new = {q: [add(q, 2, "D", "''")] for q in range(4)}
    new[1].append(stay("x.i = 's'", add(0, late, "K", kept)))
    for q in (0, 1, 3):
        new[2] += [stay("x.i = 'u'", add(q, late, "K", kept)), stay("true", add(q, f"1 + {late}", "R", user))]
    new[3] += [stay("x.i = 'a'", add(2, late, "K", kept)), stay("true", add(2, f"1 + {late}", "R", bot))]
    return "{" + ", ".join(f"'s{q}': list_min([{', '.join(new[q])}])" for q in range(4)) + "}"


def _turn_closed(a: str) -> str:
    """The same with turns inserted behind it."""
    ins = lambda s, who: f"{{'c': {s}.c + 5, 'a': {s}.a || 'I', 't': {s}.t || chr(10) || '{who}:'}}"
    s2 = f"list_min([{a}.s2, {ins(a + '.s0', 'user')}, {ins(a + '.s1', 'user')}, {ins(a + '.s3', 'user')}])"
    once = f"{{'s0': {a}.s0, 's1': {a}.s1, 's2': {s2}, 's3': {a}.s3}}"
    return f"list_transform([{once}], lambda z: {{'s0': z.s0, 's1': z.s1, 's2': z.s2, 's3': list_min([z.s3, {ins('z.s2', 'assistant')}])}})[1]"


_FAR = "{'c': 1000000000, 'a': '', 't': ''}"
_BEGIN = "{'s0': {'c': 0, 'a': '', 't': ''}, 's1': " + _FAR + ", 's2': {'c': 5, 'a': 'I', 't': chr(10) || 'user:'}, 's3': {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}"

TURN_REPAIR = rf"""
WITH crc_table AS (SELECT {_crc_table()}::BIGINT[] AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM k, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS time FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) || substr(role, 1, 1) AS pair FROM o),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM f),
s AS (SELECT conv_id, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, list({{'i': substr(role, 1, 1), 'f': fault, 'r': role, 't': text}} ORDER BY p) AS rows FROM g GROUP BY conv_id),
l AS (SELECT *, list_reduce(rows, lambda a, x: list_transform([{_turn_step()}], lambda y: {_turn_closed('y')})[1], {_BEGIN}) AS z FROM s),
b AS (SELECT *, list_min([z.s0, z.s3]) AS e FROM l)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, i, ls[i] AS line, translate(trim(ls[i], {SPACE}), '{UPPER}', '{UPPER.lower()}') AS k FROM (SELECT doc_id, rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) x),
c AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= 5),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM c.holder AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid"""


def ablation_sql() -> str:
    """Rules by policy version: rows that fail a rule, and rows that fail nothing else of the policy."""
    parts = []
    for policy, rules in POLICIES.items():
        for r in rules:
            parts.append(f"SELECT '{policy}' AS policy, '{r}' AS rule, count(*) FILTER (failed_bits & {BIT[r]} <> 0) AS failed, count(*) FILTER (failed_bits & {mask(policy)} = {BIT[r]}) AS only_failure FROM q")
    return f"WITH q AS ({quality_sql()}) " + " UNION ALL ".join(parts)


def leaks_sql(docs: str = "documents", items: str = "benchmark", percent: int = 80) -> str:
    """Item-sized windows and items by exact weighted similarity, for pairs that share weight enough in all."""
    toks = r"regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{M}\p{N}]+)', 1)"
    sh = "CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"
    return rf"""
WITH b AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, {toks} AS t FROM {items} WHERE item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS ik, item_id, {sh} AS sh FROM b WHERE len(t) > 0),
n AS (SELECT count(*) AS n FROM i),
e AS (SELECT ik, unnest(list_distinct(sh)) AS h FROM i),
w AS (SELECT h, CAST(round(ln(1.0 + n / count(*)) * 256) AS BIGINT) AS wt FROM e, n GROUP BY h, n),
a AS (SELECT ik, CAST(sum(wt) AS BIGINT) AS whole FROM e JOIN w USING (h) GROUP BY ik),
d AS (SELECT row_number() OVER () AS rid, doc_id, {sh} AS sh FROM (SELECT doc_id, {toks} AS t FROM {docs}) x),
u AS (SELECT rid, unnest(list_distinct(sh)) AS h FROM d),
c AS (SELECT rid, ik, whole FROM u JOIN e USING (h) JOIN w USING (h) JOIN a USING (ik) GROUP BY rid, ik, whole HAVING sum(wt) * 100 >= {percent} * whole),
p AS (SELECT rid, ik, whole, len(i.sh) AS size, d.sh, unnest(range(1, greatest(len(d.sh) - len(i.sh) + 2, 2))) AS pos FROM c JOIN d USING (rid) JOIN i USING (ik)),
x AS (SELECT rid, ik, whole, pos, unnest(list_distinct(sh[pos:pos + size - 1])) AS h FROM p),
s AS (SELECT x.rid, x.ik, x.whole, x.pos, sum(coalesce(w.wt, (SELECT round(ln(1.0 + greatest(n, 1)) * 256) FROM n))) AS held, sum(CASE WHEN e.h IS NULL THEN 0 ELSE w.wt END) AS shared FROM x LEFT JOIN w ON w.h = x.h LEFT JOIN e ON e.ik = x.ik AND e.h = x.h GROUP BY ALL),
m AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS item_ids, max(CAST(shared AS DOUBLE) / CAST(whole + held - shared AS DOUBLE)) AS similarity FROM s JOIN i USING (ik) WHERE shared * 100 >= {percent} * (whole + held - shared) GROUP BY rid)
SELECT doc_id, m.rid IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, coalesce(similarity, 0.0) AS similarity FROM d LEFT JOIN m USING (rid)"""


ORACLES = {
    "op1_warc": WARC,
    "op10_url_filters": URL_FILTERS,
    "op11_spelling": SPELLING,
    "op12_turn_repair": TURN_REPAIR,
    "op13_line_dedup": LINE_DEDUP,
    "op2_near_dedup": near_sql(),
    "op3_substring_dedup": repeats_sql(),
    "op4_quality_rules": quality_sql(),
    "op6_decontamination": leaks_sql(),
    "quality_ablation": ablation_sql(),
    "op7_mixing": mixing_sql(),
}
