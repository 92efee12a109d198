"""Oracle SQL (DuckDB) for the registered queries, on the driver's tables.

Pages are cut by their known layout (nav, ad, article, footer), so these statements check the extractor by another road.
"""

from __future__ import annotations

from glossmill.functions import text
from glossmill.jobs.queries import FLAT_SOURCES, FOREIGN, HIDDEN, HINTS, OPAQUE_HIDDEN, OPAQUE_WAYS, PAGE_TAGS, PAIRS, RULES, SCREEN, SIGNS, TAGS, TAILS, TARGETS


def java_to_re2(pattern: str) -> str:
    return pattern.replace(r"\p{IsHan}", r"\p{Han}").replace("'", "''")


BLANK, WHITE = text.BLANK, text.WHITE
INNER = BLANK.replace(r"\n", "")


def normal(x: str) -> str:
    """White space as in functions.text.normalized()."""
    lines = rf"regexp_replace({x}, '[{BLANK}]*\n[{BLANK}]*', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({lines}, '[{INNER}]+', ' ', 'g'), '^[{BLANK}]+|[{BLANK}]+\z', '', 'g')"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+\z', '', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{java_to_re2(pattern)}')"


def gate(x: str) -> str:
    return trim(rf"regexp_replace(nfc_normalize({x}), '[\x{{200B}}\x{{AD}}]', '', 'g')")


def reason(t: str, page: str) -> str:
    """CASE over a prepared text t."""
    pict = text.pictographs()
    letter, han = matches(t, r"\p{L}"), matches(t, r"\p{IsHan}")
    kana = rf"regexp_matches({t}, '[\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]')"
    token = f"NOT {matches(t, f'[{BLANK}]')}"
    ext = ", ".join(f"'{e}'" for e in text.EXTENSIONS)
    return rf"""CASE WHEN {matches(t, f'^[{WHITE}]*' + chr(92) + 'z')} THEN 'whitespace'
      WHEN NOT {letter} AND {matches(t, f'[{pict}]')} AND {matches(t, f'^[{pict}{WHITE}' + r'\p{P}\p{S}]*\z')} THEN 'emoji'
      WHEN {matches(t, r'^[\p{P}\p{S}' + WHITE + r']+\z')} AND NOT {matches(t, r'[\p{L}\p{N}]')} THEN 'punct'
      WHEN {matches(t, text.NUMERIC)} AND {matches(t, r'[\p{Nd}\p{No}\p{Nl}]')} AND NOT {letter} THEN 'numeric'
      WHEN {matches(t, text.EMAIL)} THEN 'email' WHEN {matches(t, text.URL)} THEN 'url' WHEN {matches(t, text.PATH)} THEN 'path'
      WHEN {token} AND strpos(substr({t}, 2), '.') > 0 AND lower(split_part({t}, '.', -1)) IN ({ext}) THEN 'filename'
      WHEN {page} AND {han} AND NOT {kana} THEN 'already-target'
      WHEN NOT {han} AND length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) < 2 THEN 'min-length' END"""


def units(x: str) -> str:
    """UTF-16 length."""
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def pages_as(html: str) -> str:
    """CTEs that end in seg: the segments of pages whose HTML is the given expression."""
    decode = "replace(replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    norm = normal(decode)
    parts = "".join(f", ({k}, '{r}', regexp_extract(h, '{p}', 1))" for k, r, p in ((1, "ad", '(?s)<div class="ad">(.*?)</div>'), (2, "main", "(?s)<article>(.*?)</article>"), (3, "chrome", "(?s)(<footer>.*)$")))[2:]
    return rf"""doc AS (SELECT page_id, regexp_extract({html}, '<html[^>]*lang="([^"]*)"', 1) AS page_lang,
      regexp_replace(regexp_replace({html}, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    part AS (SELECT page_id, page_lang, k, rg, p FROM doc, LATERAL (VALUES (0, 'chrome', regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1)), {parts}) v(k, rg, p)),
    cut AS (SELECT page_id, page_lang, k, rg, list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(p, '<br>', chr(10), 'g'), '</?(p|li|ul|div|h1|footer|body|html)[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)),
      lambda x: {norm}), lambda x: x <> '') AS l FROM part),
    flat AS (SELECT page_id, page_lang, k, rg, unnest(l) AS source, unnest(range(len(l))) AS i FROM cut),
    gated AS (SELECT page_id, page_lang, k, source, (row_number() OVER (PARTITION BY page_id ORDER BY k, i) - 1)::INT AS ord,
      CASE WHEN rg <> 'ad' THEN rg WHEN {units('source')} < 40 THEN 'chrome' ELSE 'main' END AS region, {units('source')}::INT AS char_count, {gate('source')} AS t FROM flat),
    seg AS (SELECT *, CASE WHEN skip_reason IS NULL THEN 'pending' ELSE 'skipped' END AS state FROM (SELECT *, {reason('t', 'false')} AS skip_reason FROM gated))"""


SEG = "WITH " + pages_as("html")
OPEN = "FROM seg WHERE state = 'pending'"
COUNTERS = """count(*) AS segment_count, sum(char_count)::BIGINT AS source_chars, 0::BIGINT AS button_segments, 0::BIGINT AS protected_spans,
  count(*) FILTER (state = 'pending') AS state_pending, count(*) FILTER (state = 'skipped') AS state_skipped, count(*) FILTER (region = 'main') AS region_main, count(*) FILTER (region = 'chrome') AS region_chrome"""
NAMES = "segment_count, source_chars, button_segments, protected_spans, state_pending, state_skipped, region_main, region_chrome"


def counter_rows(where: str) -> str:
    return f"""SELECT name AS key, value::BIGINT AS value FROM (UNPIVOT (SELECT {COUNTERS} FROM seg WHERE {where}) ON {NAMES}) WHERE value > 0 OR NOT (name LIKE 'state%' OR name LIKE 'region%')"""


DISTANCE = f"CASE WHEN bottom < 0 THEN -bottom WHEN top > {SCREEN} THEN top - {SCREEN} ELSE 0 END"
PLACED = SEG + f""", placed AS (SELECT *, {DISTANCE} AS distance FROM (SELECT *, ord * 60 - {2 * SCREEN} AS top, ord * 60 - {2 * SCREEN} + 40 AS bottom FROM seg))"""
PLACE = "row_number() OVER (PARTITION BY page_id ORDER BY (distance > 0)::INT, (region = 'chrome')::INT, CASE WHEN distance > 0 THEN distance // 300 ELSE 0 END, ord)::INT AS place"
#: Eager: the first ten open segments outside chrome.
EAGER = ", e AS (SELECT *, region <> 'chrome' AND row_number() OVER (PARTITION BY page_id, region <> 'chrome' ORDER BY ord) <= 10 AS eager FROM seg WHERE state = 'pending')"
REQUESTS = """WITH m AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN json_object('id', conv_id || '-' || turn, 'source', text, 'from', role) WHEN 1 THEN json_object('id', conv_id, 'source', text)
   WHEN 2 THEN json_object('id', conv_id || '-' || turn, 'source', [text], 'to', turn) ELSE json_object('id', conv_id || '-' || turn, 'source', text) END AS j FROM conversations),
 f AS (SELECT conv_id, turn, CASE WHEN json_type(j, '$.id') = 'VARCHAR' THEN j ->> '$.id' END AS id, CASE WHEN json_type(j, '$.source') = 'VARCHAR' THEN j ->> '$.source' END AS source,
   coalesce(CASE WHEN json_type(j, '$.from') = 'VARCHAR' THEN j ->> '$.from' END, 'en') AS "from", coalesce(CASE WHEN json_type(j, '$.to') = 'VARCHAR' THEN j ->> '$.to' END, 'zh-Hant') AS "to" FROM m),
 r AS (SELECT *, CASE WHEN id IS NULL THEN 'missing id' WHEN source IS NULL THEN 'missing source' END AS error FROM f)"""
ANSWERED = SEG + """, a AS (SELECT *, CASE WHEN length(source) <= 80 THEN CASE WHEN source LIKE '%.' THEN '' ELSE '~' || source END END AS tx FROM seg),
 b AS (SELECT *, CASE WHEN state <> 'pending' THEN state WHEN length(source) > 400 OR tx IS NULL THEN 'failed' ELSE 'drafted' END AS st,
   CASE WHEN state <> 'pending' THEN NULL WHEN length(source) > 400 THEN 'too long' WHEN tx IS NULL THEN 'no-text' END AS reason FROM a)"""
ATTEMPTS = """WITH log AS (SELECT user_id AS pair, CASE WHEN event_id % 2 = 0 THEN 'translate' ELSE 'availability' END AS entry, event_id AS id, ts,
   CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'cancelled' WHEN 'click' THEN 'error' ELSE 'success' END AS outcome,
   CASE WHEN event_id % 2 = 1 AND event_type NOT IN ('error', 'signup', 'click') THEN ['installed', 'supported', 'unsupported'][event_id % 3 + 1] END AS result FROM events)"""


def circuit(threshold: int, seconds: int) -> str:
    """Recursive: each attempt of a key changes its state, numbered k."""
    return f"""{ATTEMPTS.replace('WITH log', 'WITH RECURSIVE log')}, n AS (SELECT *, row_number() OVER (PARTITION BY pair, entry ORDER BY ts, id) AS k FROM log),
 s AS (SELECT pair, entry, 0::BIGINT AS k, 0 AS streak, NULL::TIMESTAMP AS til, 0 AS rejected, 0 AS opened FROM (SELECT DISTINCT pair, entry FROM log)
  UNION ALL SELECT s.pair, s.entry, n.k,
   CASE WHEN coalesce(n.ts < s.til, false) OR outcome = 'cancelled' THEN streak WHEN outcome = 'timeout' THEN streak + 1 ELSE 0 END,
   CASE WHEN coalesce(n.ts < s.til, false) OR outcome = 'cancelled' THEN til WHEN outcome = 'timeout' THEN CASE WHEN streak + 1 >= {threshold} THEN n.ts + INTERVAL {seconds} SECOND ELSE til END END,
   rejected + coalesce(n.ts < s.til, false)::INT, opened + (NOT coalesce(n.ts < s.til, false) AND outcome = 'timeout' AND streak + 1 >= {threshold})::INT
  FROM s JOIN n ON s.pair = n.pair AND s.entry = n.entry AND n.k = s.k + 1),
 z AS (SELECT pair, entry, max(k)::INT AS attempts, max_by(rejected, k) AS rejected, max_by(opened, k) AS opened, max_by(streak, k) AS streak, arg_max_null(til, k) AS til FROM s WHERE k > 0 GROUP BY ALL)"""


def zh(tag: str) -> str:
    n = f"replace(lower(trim({tag})), '_', '-')"
    own = f"list_slice(string_split({n}, '-'), 2, coalesce(list_position(list_transform(list_slice(string_split({n}, '-'), 2, 99), lambda p: length(p) = 1), true), 98))"
    region = f"list_filter({own}, lambda p: p IN ('tw','hk','mo','cn','sg','my'))[1]"
    cases = f"WHEN list_contains({own}, 'hant') THEN 'hant' WHEN list_contains({own}, 'hans') THEN 'hans' WHEN len(list_filter({own}, lambda p: length(p) = 4)) > 0 THEN 'unknown'"
    return f"CASE WHEN split_part({n}, '-', 1) = 'zh' THEN CASE WHEN {n} = 'zh' THEN 'zh' {cases} WHEN {region} IN ('tw','hk','mo') THEN 'hant' WHEN {region} IS NOT NULL THEN 'hans' ELSE 'unknown' END END"


SATISFIES = "CASE tv WHEN 'hans' THEN coalesce(variant = 'hans', false) WHEN 'hant' THEN coalesce(variant IN ('hant', 'zh'), false) ELSE false END"
INSTALLED = ATTEMPTS + """, i AS (SELECT *, coalesce(last_value(CASE WHEN result = 'installed' THEN true WHEN entry = 'translate' AND outcome = 'error' THEN false END IGNORE NULLS)
   OVER (PARTITION BY pair ORDER BY ts, id ROWS UNBOUNDED PRECEDING), false) AS cached FROM log)"""
def beside(html: str, first: str = "html") -> str:
    """CTEs of the pages' segments as seg, and of another version of the pages as new_seg."""
    other = pages_as(html)
    for name in ("doc", "part", "cut", "flat", "gated", "seg"):
        other = other.replace(f"{name} AS (", f"new_{name} AS (").replace(f"FROM {name})", f"FROM new_{name})").replace(f"FROM {name},", f"FROM new_{name},")
    return f"WITH {pages_as(first)}, {other}"


EDITED = beside("replace(html, ' the ', ' THE ')")
THIRD = beside("replace(html, ' the ', ' Thee ')", "replace(html, ' the ', ' THE ')")
#: Where texts lie beside elements is marked, for blocks that hold more than text.
MARKED = beside("replace(replace(html, ' the ', ' THE '), '<b>', chr(4))", "replace(html, '<b>', chr(4))")
LONGER = beside("CASE WHEN page_id % 2 = 0 THEN replace(html, ' the ', ' those ') ELSE html END")
OCC = "row_number() OVER (PARTITION BY page_id, source ORDER BY ord) AS occ"
NEW_ROWS = f"""o AS (SELECT page_id, source, {OCC} FROM seg), w AS (SELECT page_id, ord, source, {OCC} FROM new_seg)
  SELECT page_id, ord AS "order", source FROM w ANTI JOIN o USING (page_id, source, occ)"""
#: Pieces between marks of a source, outside and inside by turns; spans in their lengths.
SPANS = "WITH " + pages_as("regexp_replace(html, ' (the|der|la) ', ' ' || chr(2) || '\\1' || chr(3) || '  ', 'g')") + """, m AS (SELECT page_id, ord, string_split_regex(source, '[\\x02\\x03]') AS p FROM seg WHERE contains(source, chr(2)))"""
PATH = "'Read ' || substr(url, 9, (5 + page_id % 20)::INT)"
CONTROLS = f"""WITH c AS (SELECT page_id, {PATH} AS path, {FOREIGN!r}[page_id % {len(FOREIGN)} + 1] AS lang FROM pages),
  r AS (SELECT page_id, 0 AS ord, path AS source, length(path) <= 20 AS button, NULL AS lang, 'button' AS tag, false AS han, true AS alone FROM c
   UNION ALL SELECT page_id, 1, 'go ' || path, length(path) <= 17, NULL, 'label', false, true FROM c UNION ALL SELECT page_id, 2, 'x y', false, NULL, 'div', false, false FROM c
   UNION ALL SELECT page_id, 3, '简体字 ' || page_id, false, lang, 'p', true, true FROM c WHERE lang <> 'zh_TW' UNION ALL SELECT page_id, 4, '简体字', false, lang, 'p', true, false FROM c WHERE lang <> 'zh_TW'),
  x AS (SELECT *, button OR (han AND alone AND lang IN ('zh-CN', 'zh-Hans-HK')) AS rep FROM r)
 SELECT page_id, ord AS "order", source, CASE WHEN button THEN 'button' END AS kind, CASE WHEN rep THEN 'replace' ELSE 'after-segment' END AS insert_mode, lower(lang) AS eff_lang,
  CASE WHEN han THEN 'skipped' ELSE 'pending' END AS state, CASE WHEN han THEN 'already-target' END AS skip_reason, 'chrome' AS region, CASE WHEN rep THEN source END AS replace_snapshot, tag AS anchor_tag FROM x"""
REPLACED = f"""WITH c AS (SELECT page_id, {PATH} AS path, {FOREIGN!r}[page_id % {len(FOREIGN)} + 1] AS lang FROM pages),
  e AS (SELECT *, replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS p, length(path) <= 20 AND page_id % 3 <> 0 AS b, length(path) <= 20 AS b0, length(path) <= 17 AND page_id % 3 <> 0 AS l, length(path) <= 17 AS l0,
    lang IN ('zh-CN', 'zh-Hans-HK') AS h0, lang IN ('zh-CN', 'zh-Hans-HK') AND page_id % 3 <> 0 AS h, CASE WHEN page_id % 2 = 0 THEN ' title="own"' ELSE '' END AS own FROM c),
  m AS (SELECT *, '<div class="gm-translation" data-gm-id="k1-' AS mark FROM e)
 SELECT page_id, '<html><body><button' || own || CASE WHEN b THEN ' data-gm-source="' || p || '"' || CASE WHEN own = '' THEN ' title="' || p || '"' ELSE '' END || '>T&amp;' || p ELSE '>' || p END || '</button>'
  || CASE WHEN b0 THEN '' ELSE mark || '0">T&amp;' || p || '</div>' END
  || '<label' || CASE WHEN l THEN ' data-gm-source="go ' || p || '" title="go ' || p || '">T&amp;go ' || p ELSE '>go ' || p END || '</label>' || CASE WHEN l0 THEN '' ELSE mark || '1">T&amp;go ' || p || '</div>' END
  || '<div role="button">x <i>y</i></div>' || mark || '2">T&amp;x y</div><section lang="' || lang || '"><p' || CASE WHEN h THEN ' data-gm-source="简体字 ' || page_id || '" title="简体字 ' || page_id || '">T&amp;' ELSE '>' END || '简体字 ' || page_id || '</p>'
  || CASE WHEN h0 OR lang = 'zh_TW' THEN '' ELSE mark || '3">T&amp;简体字 ' || page_id || '</div>' END || '<p>简体<b>字</b></p>' || CASE WHEN lang = 'zh_TW' THEN '' ELSE mark || '4">T&amp;简体字</div>' END || '</section></body></html>' AS html FROM m"""
OPAQUE = f"""WITH c AS (SELECT page_id, page_id % {len(OPAQUE_WAYS)} < {OPAQUE_HIDDEN} AS gone, 'w' || page_id || '繁end' AS own, CASE WHEN page_id % 2 = 0 THEN 'code' ELSE 'time' END AS tag FROM pages)
 SELECT page_id, 0 AS "order", CASE WHEN gone THEN 'Open shut.' ELSE 'Open ' || own || ' shut.' END AS source, CASE WHEN gone THEN '' ELSE '5:' || (5 + length(own)) || ':' || tag END AS spans FROM c"""
FLATTENED = f"""SELECT page_id, i::INT AS "order", replace(l[i + 1], 'N', page_id::VARCHAR) AS source FROM (SELECT page_id, l, unnest(range(len(l))) AS i FROM (SELECT page_id, {FLAT_SOURCES!r}[page_id % {len(FLAT_SOURCES)} + 1] AS l FROM pages))"""
HINTED = f"""WITH c AS (SELECT page_id, {SIGNS!r}[page_id % {len(HINTS)} + 1] AS sign, length(rtrim(repeat('Read ' || page_id || ' ', (page_id % 40 + 1)::INT))) AS n FROM pages)
 SELECT page_id, 0 AS "order", CASE WHEN 2 * (sign = 'chrome')::INT + (n < 40)::INT > 2 * (sign = 'main')::INT + 2 * (n > 120)::INT THEN 'chrome' ELSE 'main' END AS region, n::INT AS char_count FROM c"""
SAMPLED = f"""WITH c AS (SELECT page_id, page_id % {len(PAGE_TAGS)} AS tag, page_id // {len(PAGE_TAGS)} % {len(TAILS)} AS tail FROM pages), g AS (SELECT *, tag = 3 OR (tag IN (0, 1) AND tail IN (0, 2)) AS target FROM c)
 SELECT page_id, 0 AS "order", '简体 ' || page_id AS source, CASE WHEN target THEN 'skipped' ELSE 'pending' END AS state, CASE WHEN target THEN 'already-target' END AS skip_reason, target AS page_is_target FROM g
 UNION ALL SELECT page_id, 1, 'かな', 'pending', NULL, target FROM g WHERE tail IN (1, 2)"""
ESCAPED = "replace(replace(replace(tx, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LEFT = "replace(replace(replace(replace(regexp_replace(html, '(?s)^.*<article>|</article>.*$|</?[a-z0-9]+>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
RENDERED = ANSWERED + f""", k AS (SELECT page_id, string_agg('k1-' || lower(to_base(ord, 36)) || ' ' || {ESCAPED}, chr(10) ORDER BY ord) AS marks FROM b WHERE st = 'drafted' AND tx <> '' GROUP BY page_id)
  SELECT page_id, coalesce(marks, '') AS marks, length({LEFT})::INT AS "left" FROM pages LEFT JOIN k USING (page_id)"""
AUDIT = f"""WITH b AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)(<body>.*)$', 1), '(?s)<!--.*?-->', '', 'g') AS h, len(regexp_extract_all(html, '<!--')) AS comments FROM pages),
  e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(h, '(?s)<div class="ad">.*?</div>', '', 'g'), '<([a-z0-9]+)[ >]', 1)) AS tag FROM b)
 SELECT tag, 'WALK' AS disposition, 'walk' AS rule, count(*) AS n FROM e GROUP BY tag UNION ALL SELECT '#comment', 'SKIP_SUBTREE', 'comment', sum(comments)::BIGINT FROM b HAVING sum(comments) > 0
 UNION ALL SELECT 'div', 'SKIP_SUBTREE', {RULES!r}[page_id % {len(HIDDEN)} + 1] AS rule, count(*) FROM b WHERE contains(h, '<div class="ad">') GROUP BY ALL"""
GATE = """WITH v AS (SELECT l_linenumber::VARCHAR AS key, l_returnflag = 'R' AS now, (100 + l_quantity * CASE WHEN l_linenumber > 5 THEN 8 ELSE 1 END)::DOUBLE AS value, CASE WHEN l_linenumber % 3 = 1 THEN 0.7 ELSE 1.0 END AS pace FROM lineitem),
  n AS (SELECT key, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, stddev_pop(value) / avg(value) AS cv FROM v WHERE now GROUP BY key),
  b AS (SELECT key, quantile_disc(value * pace, 0.5) AS b50, quantile_disc(value * pace, 0.95) AS b95 FROM v WHERE NOT now GROUP BY key)
 SELECT key, CASE WHEN key = '2' OR cv > 0.15 THEN 'not judged' WHEN p50 > 1.3 * b50 OR p95 > 1.5 * b95 THEN 'fail' ELSE 'pass' END AS verdict FROM n JOIN b USING (key)"""

SQL = {
    "segments": SEG + """ SELECT page_id, 'k1-' || lower(to_base(ord, 36)) AS seg_id, ord AS "order", region, source, state, skip_reason, 'after-segment' AS insert_mode, char_count FROM seg""",
    "page_counters": f"{SEG} SELECT page_id, {COUNTERS} FROM seg GROUP BY page_id",
    "corpus_counters": f"{SEG} {counter_rows('true')}",
    "skip_reasons": f"{SEG} SELECT page_lang, skip_reason, count(*) AS n FROM seg WHERE state = 'skipped' GROUP BY ALL",
    "counter_diff": SEG + f", a AS ({counter_rows(chr(39).join(['page_lang = ', 'en', '']))}), b AS ({counter_rows(chr(39).join(['page_lang = ', 'fr', '']))})"
    " SELECT key, a.value AS now, b.value AS base FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value",
    "counter_variants": LONGER + f", u AS (SELECT page_id, {COUNTERS} FROM seg GROUP BY page_id UNION SELECT page_id, {COUNTERS} FROM new_seg GROUP BY page_id) SELECT page_id, count(*) AS variants FROM u GROUP BY page_id",
    "counter_check": LONGER + f""", u AS (SELECT page_id, {COUNTERS} FROM seg GROUP BY page_id UNION SELECT page_id, {COUNTERS} FROM new_seg GROUP BY page_id), a AS ({counter_rows('true')}), b AS ({counter_rows('true').replace('FROM seg', 'FROM new_seg')})
      SELECT key, b.value AS now, a.value AS base FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value
      UNION ALL SELECT 'unsteady inputs', count(*), 0 FROM (SELECT page_id FROM u GROUP BY page_id HAVING count(*) > 1) HAVING count(*) > 0""",
    "segment_table": SEG + """ SELECT page_id, ord AS "order", CASE WHEN skip_reason IS NULL THEN json_object('order', ord, 'source', source, 'state', state)::VARCHAR
      ELSE json_object('order', ord, 'source', source, 'state', state, 'skipReason', skip_reason)::VARCHAR END AS golden FROM seg""",
    "protected_spans": SPANS + """ SELECT page_id, ord AS "order", (len(p) // 2)::INT AS n, array_to_string(list_transform(range(1, len(p) // 2 + 1), lambda k:
      list_sum(list_transform(p[1:2*k-1], lambda x: length(x)))::BIGINT || ':' || list_sum(list_transform(p[1:2*k], lambda x: length(x)))::BIGINT), ',') AS spans FROM m""",
    "insert_modes": CONTROLS,
    "bridge_messages": SEG + f""" SELECT page_id, json_object('type', 'translate', 'id', 'k1-' || lower(to_base(ord, 36)), 'source', source, 'from', page_lang, 'to', 'zh-Hant')::VARCHAR AS message {OPEN}""",
    "unmatched_responses": SEG + " SELECT page_id, 'k1-' || lower(to_base(ord, 36)) || '?' AS seg_id, source FROM seg WHERE ord % 3 = 2",
    "normalize_text": f"SELECT doc_id, {normal('text')} AS normalized, {units('text')}::INT AS units FROM documents",
    "worth_gate": f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\n| \\| ')) AS line FROM documents), g AS (SELECT doc_id, {gate('line')} AS t FROM l)
      SELECT doc_id, coalesce({reason('t', 'true')}, 'worth') AS reason, count(*) AS n FROM g GROUP BY ALL""",
    "gate_urls": f"WITH g AS (SELECT page_id, {gate('url')} AS t FROM pages) SELECT page_id, {reason('t', 'false')} AS reason FROM g",
    "page_lang_gate": f"""WITH p AS (SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS own FROM pages), r AS (SELECT unnest(list_append({TAGS!r}, own)) AS tag FROM p),
      x AS (SELECT tag, target, count(*) AS n FROM r, (SELECT unnest({TARGETS!r}) AS target) GROUP BY ALL), v AS (SELECT *, {zh('tag')} AS variant, {zh('target')} AS tv FROM x)
      SELECT tag, target, variant, CASE WHEN tag = '' THEN false ELSE {SATISFIES} END AS gate,
        CASE WHEN tv IS NOT NULL THEN {SATISFIES} ELSE tag <> '' AND split_part(lower(tag), '-', 1) = target END AS own, n FROM v""",
    "dispatch_plan": PLACED + f""" SELECT page_id, ord AS "order", region, distance, {PLACE} FROM placed WHERE state = 'pending'""",
    "eager_segments": SEG + EAGER + """ SELECT page_id, ord AS "order", source FROM e WHERE eager""",
    "lazy_tiers": SEG + EAGER + " SELECT page_id, region AS tier, count(*) AS blocks, count(*)::BIGINT AS n_segments FROM e WHERE NOT eager GROUP BY ALL",
    "admitted_blocks": PLACED + " SELECT page_id, region AS tier, count(*) AS n FROM placed WHERE distance <= CASE region WHEN 'chrome' THEN 400 ELSE 1200 END GROUP BY ALL",
    "resorted": SEG + EAGER + f""", d AS (SELECT *, ord * 60 AS distance FROM e WHERE NOT eager) SELECT page_id, ord AS "order", distance, {PLACE} FROM d""",
    "parse_requests": REQUESTS + """ SELECT conv_id, turn, id, source, "from", "to", error FROM r""",
    "responses": REQUESTS + """ SELECT conv_id, turn, CASE WHEN error IS NULL THEN json_object('id', id, 'text', '~' || source)::VARCHAR WHEN id IS NULL THEN json_object('error', error)::VARCHAR
      ELSE json_object('error', error, 'id', id)::VARCHAR END AS response,
      CASE WHEN source IS NULL THEN json_object('target', "to")::VARCHAR ELSE json_object('source', source, 'target', "to", 'text', '~' || source)::VARCHAR END AS cli FROM r""",
    "pair_precheck": SEG + f""", p(a, b, status) AS (VALUES {', '.join(map(str, PAIRS))})
      SELECT page_lang AS "from", 'zh-Hant' AS "to", CASE status WHEN 'supported' THEN 'not downloaded: ' || page_lang || ' to zh-Hant' WHEN 'unsupported' THEN 'unsupported pair: ' || page_lang || ' to zh-Hant' END AS pair_error,
      count(*) AS n FROM seg LEFT JOIN p ON a = page_lang AND b = 'zh-Hant' WHERE state = 'pending' GROUP BY ALL""",
    "engine_status": SEG + f""" SELECT page_lang AS "from", 'zh-Hant' AS "to", CASE page_lang WHEN 'en' THEN 'installed' WHEN 'fr' THEN 'supported' WHEN 'es' THEN 'unsupported' ELSE 'undetermined' END AS known,
      CASE page_lang WHEN 'fr' THEN 'not downloaded: fr to zh-Hant' WHEN 'es' THEN 'unsupported pair: es to zh-Hant' END AS pair_error, count(*) AS n {OPEN} GROUP BY ALL""",
    "distinct_work": SEG + f""" SELECT page_lang AS "from", 'zh-Hant' AS "to", source, count(*) AS wanted {OPEN} GROUP BY ALL""",
    "apply_responses": ANSWERED + " SELECT page_id, st AS state, reason, count(*) AS n FROM b GROUP BY ALL",
    "bilingual_pairs": ANSWERED + """ SELECT page_id, ord AS "order", source, tx AS text, 'after-segment' AS insert_mode FROM b WHERE st = 'drafted' AND tx <> ''""",
    "engine_translate": SEG + f""" SELECT page_lang AS "from", 'zh-Hant' AS "to", source, CASE WHEN page_lang <> 'de' THEN 'zh-Hant:' || reverse(source) END AS text, CASE WHEN page_lang = 'de' THEN 'no model' END AS error
      {OPEN} GROUP BY ALL""",
    "engine_attempts": SEG + f""", w AS (SELECT DISTINCT page_lang, source {OPEN}),
      x AS (SELECT *, CASE WHEN page_lang = 'de' THEN 'error' WHEN source[1] BETWEEN '0' AND '9' THEN 'cancelled' WHEN length(source) >= 100 THEN 'timeout' ELSE 'success' END AS outcome FROM w)
      SELECT page_lang || ' to zh-Hant' AS pair, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'cancelled') AS cancelled, count(*) FILTER (outcome = 'error') AS error,
        sum(length(source) + 8) FILTER (outcome = 'success')::BIGINT AS units, count(*)::INT AS attempts FROM x GROUP BY ALL""",
    "render_pages": RENDERED,
    "page_table": RENDERED,
    "replaced_pages": REPLACED,
    "opaque_rules": OPAQUE,
    "flattened_blocks": FLATTENED,
    "hint_regions": HINTED,
    "sample_gate": SAMPLED,
    "recollect": SEG + """ SELECT page_id, ord AS "order", source, state FROM seg""",
    "incremental_segments": EDITED + f""", o AS (SELECT page_id, source, {OCC} FROM seg), w AS (SELECT page_id, ord, source, {OCC} FROM new_seg)
      SELECT page_id, ord AS "order", source FROM w ANTI JOIN o USING (page_id, source, occ)""",
    "stream_changes": EDITED + f""", o AS (SELECT page_id, source, {OCC} FROM seg), w AS (SELECT page_id, ord, source, {OCC} FROM new_seg)
      SELECT page_id, ord AS "order", source FROM w ANTI JOIN o USING (page_id, source, occ)""",
    "stream_versions": f"""SELECT page_id, "order", source, 1 AS version FROM ({SEG} SELECT page_id, ord AS "order", source FROM seg)
      UNION ALL SELECT *, 2 FROM ({EDITED}, {NEW_ROWS}) UNION ALL SELECT *, 3 FROM ({THIRD}, {NEW_ROWS})""",
    "drift_guard": MARKED + """ SELECT page_id, seg.source <> new_seg.source AS drifted, count(*) AS n FROM seg JOIN new_seg USING (page_id, ord) WHERE seg.k > 0 AND NOT contains(seg.source, chr(4)) GROUP BY ALL""",
    "timeout_streaks": ATTEMPTS + """, g AS (SELECT *, sum((outcome <> 'timeout')::INT) OVER (PARTITION BY pair, entry ORDER BY ts, id) AS g FROM log WHERE outcome <> 'cancelled')
      SELECT pair, entry, id, sum((outcome = 'timeout')::INT) OVER (PARTITION BY pair, entry, g ORDER BY ts, id)::BIGINT AS streak FROM g""",
    "installed_pairs": INSTALLED + " SELECT pair, id, cached FROM i",
    "circuit_windows": circuit(2, 86_400) + " SELECT pair, entry, attempts, rejected, opened, streak FROM z",
    "pair_status": circuit(2, 86_400) + INSTALLED.replace(ATTEMPTS, "") + """,
      c AS (SELECT pair, max_by(cached, (ts, id)) AS cached FROM i GROUP BY pair), l AS (SELECT pair, arg_max(outcome, (ts, id)) AS outcome, arg_max_null(result, (ts, id)) AS result FROM log WHERE entry = 'availability' GROUP BY pair)
      SELECT c.pair, CASE WHEN cached THEN 'installed' WHEN coalesce(til > TIMESTAMP '2024-01-20', false) OR outcome IS DISTINCT FROM 'success' THEN 'undetermined' ELSE result END AS status
      FROM c LEFT JOIN l USING (pair) LEFT JOIN z ON z.pair = c.pair AND z.entry = 'availability'""",
    "stream_circuit": circuit(2, 86_400) + """ SELECT s.pair, s.entry, n.id, s.rejected > s.before AS rejected, s.streak FROM (SELECT *, lag(rejected) OVER (PARTITION BY pair, entry ORDER BY k) AS before FROM s) s
      JOIN n ON n.pair = s.pair AND n.entry = s.entry AND n.k = s.k""",
    "node_audit": AUDIT,
    "timing_summary": """SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean,
      round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) END, 6) AS cv FROM events GROUP BY event_type""",
    "timing_gate": GATE,
    "languages": f"WITH p AS (SELECT DISTINCT lang AS a, t AS b FROM documents, (SELECT unnest({TARGETS!r}) AS t) WHERE lang <> t) SELECT a AS language FROM p UNION SELECT b FROM p",
    "text_input_status": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'invalid_utf8' WHEN {trim('t')} = '' THEN 'empty' ELSE 'ok' END AS status,
      CASE WHEN doc_id % 7 <> 0 OR doc_id % 5 = 0 THEN length({trim('t')})::INT END AS size FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || source || chr(10) ELSE text END AS t FROM documents)""",
    "stream_segments": SEG + """ SELECT page_id, ord AS "order", source, state FROM seg""",
}
