"""DuckDB SQL with the rows of the corpus queries, written from their contracts.

Texts are split, windowed and compared as strings; nothing here follows the operators'
own methods. op8 (a trained model) and op10 (a tokenizer) have no SQL.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: A row number tells rows apart that repeat a doc_id.
_DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


def _words(name: str, source: str, text: str, separators: str = _SPACE) -> str:
    return f"{name} AS (SELECT * EXCLUDE (w0), [x FOR x IN w0 IF x <> ''] AS w FROM (SELECT *, string_split_regex({text}, '{separators}') AS w0 FROM {source}))"


_URL = f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
part AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM cut),
rules (verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
lists (rule) AS (VALUES ('spam-farm.example.org/')),
each AS (SELECT row_number() OVER () AS rid, * FROM part),
fit AS (SELECT rid, max_by(rule, length(rule) * 1000 + strpos(rule, '/')) AS rule FROM each, rules WHERE ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1),
onlist AS (SELECT rid, max(rule) AS listed FROM each, lists WHERE ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM each LEFT JOIN fit USING (rid) LEFT JOIN onlist USING (rid) LEFT JOIN rules USING (rule)"""

_SUFFIX = f"""WITH {_DOCS}, hexed AS (SELECT rid, doc_id, hex(encode(text)) AS h FROM docs), sized AS (SELECT *, length(h) // 2 AS n FROM hexed),
chunks AS (SELECT rid, c, substr(h, 4096 * c + 1, 4096 + 798) AS t FROM (SELECT rid, h, unnest(range(0, (n - 400) // 2048 + 1)) AS c FROM sized WHERE n >= 400)),
win AS (SELECT rid, 2048 * c + p AS p, md5_number(substr(t, 2 * p + 1, 800)) AS k FROM (SELECT rid, c, t, unnest(range(0, length(t) // 2 - 399)) AS p FROM chunks)),
twice AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1), hits AS (SELECT rid, p FROM win SEMI JOIN twice USING (k)),
marked AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS span FROM marked),
spans AS (SELECT rid, span, min(p) AS a, max(p) + 400 AS z FROM numbered GROUP BY 1, 2),
gaps AS (SELECT rid, a AS stop, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS start FROM (SELECT rid, a, z FROM spans UNION ALL SELECT rid, n, n FROM sized)),
kept AS (SELECT g.rid, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start, stop) AS h FROM gaps g JOIN sized s ON s.rid = g.rid GROUP BY 1),
gone AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT s.doc_id, s.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM sized s JOIN kept ON kept.rid = s.rid LEFT JOIN gone ON gone.rid = s.rid"""

_SUBSTRING = f"""WITH {_DOCS}, {_words('worded', 'docs', 'text')},
pos AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS d, w, unnest(range(1, len(w) - 11)) AS p FROM worded WHERE len(w) >= 13),
win AS (SELECT rid, d, p, array_to_string(w[p : p + 12], ' ') AS k FROM pos),
first AS (SELECT k, min(d) AS low FROM win GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS p FROM win JOIN first USING (k) WHERE low < d),
each AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM worded),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (rid, p) GROUP BY 1),
counts AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (fresh) AS n_spans FROM (SELECT rid, p, p > coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1) + 1 AS fresh FROM gone) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM worded LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)"""


def _similar(shingle: int, percent: int, more: str = "") -> str:
    """Components of texts whose sets of distinct word shingles are similar; `more` columns may follow."""
    return f"""WITH RECURSIVE {_DOCS}, {_words('worded', 'docs', f'translate(text, {_LOWER})')},
sets AS (SELECT rid, doc_id, CASE WHEN len(w) >= {shingle} THEN list_distinct([array_to_string(w[p : p + {shingle - 1}], ' ') FOR p IN range(1, len(w) - {shingle - 2})]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s, least(len(w), {shingle}) AS k FROM worded),
each AS (SELECT rid, len(s) AS n, k, unnest(s) AS t FROM sets),
common AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.t = b.t AND a.k = b.k AND a.rid <> b.rid GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
reach AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT reach.a AS rid, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.rid = reach.b GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id{more} FROM sets JOIN named USING (rid)"""


_JACCARD = _similar(5, 75)
_MINHASH = _similar(4, 80, ", coalesce(doc_id = component_id, component_id IS NULL) AS kept")

# Fixed values of the query: rules (name, rate, least spread, reach, direction) as quality_rules.RULES has them.
_RULES = (("symbols", "1000 * n_symbols // greatest(n_words, 1)", 15, 6.0, 1), ("upper", "1000 * n_upper // greatest(word_chars, 1)", 25, 6.0, 1), ("dup_lines", "1000 * n_dup_lines // greatest(n_lines, 1)", 60, 6.0, 1), ("repeats", "1000 * n_repeat_words // greatest(n_words, 1)", 60, 6.0, 1), ("long_words", "1000 * word_chars // greatest(n_words, 1)", 1000, 6.0, 1), ("short_words", "1000 * word_chars // greatest(n_words, 1)", 600, 6.0, -1))
_RATES = " UNION ALL ".join(f"SELECT rid, lang, source, {k} AS k, '{name}' AS rule, {rate} AS rate, {least} AS least, {reach} AS reach, {up} AS up FROM counts" for k, (name, rate, least, reach, up) in enumerate(_RULES))


def _quartiles(name: str, keys: str) -> str:
    own = keys + ", " if keys else ""
    return f"""{name}_n AS (SELECT {own}rule, value, count(*) AS n FROM rounded GROUP BY ALL), {name}_up AS (SELECT *, sum(n) OVER (PARTITION BY {own}rule ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {own}rule) AS size FROM {name}_n),
{name} AS (SELECT {own}rule, CAST(max(size) AS DOUBLE) AS size, min(value) FILTER (4 * upto >= size) AS q1, min(value) FILTER (4 * upto >= 3 * size) AS q3 FROM {name}_up GROUP BY ALL)"""


def _drawn(q: str) -> str:
    return f"(o.size * o.{q} + 30 * ((g.size * g.{q} + 30 * a.{q}) / (g.size + 30))) / (o.size + 30)"


_QUALITY = f"""WITH {_DOCS}, {_words('worded', 'docs', 'text')},
pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM worded WHERE len(w) >= 3),
win AS (SELECT rid, p, array_to_string(w[p : p + 2], ' ') AS k FROM pos),
again AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 3)) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS times FROM win) WHERE times > 1) GROUP BY 1),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
counts AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, coalesce(lines.n, 0) AS n_lines
 FROM worded LEFT JOIN lines USING (rid) LEFT JOIN again USING (rid)),
rates AS ({_RATES}),
rounded AS (SELECT *, (rate >> greatest(length(bin(rate)) - 6, 0)) << greatest(length(bin(rate)) - 6, 0) AS value FROM rates),
{_quartiles('o', 'lang, source')}, {_quartiles('g', 'lang')}, {_quartiles('a', '')},
bounds AS (SELECT o.lang, o.source, o.rule, {_drawn('q1')} AS q1, {_drawn('q3')} AS q3 FROM o JOIN g ON g.rule = o.rule AND g.lang IS NOT DISTINCT FROM o.lang JOIN a ON a.rule = o.rule),
fails AS (SELECT r.rid, string_agg(r.rule, ',' ORDER BY r.k) AS failed FROM rates r JOIN bounds b ON b.rule = r.rule AND b.lang IS NOT DISTINCT FROM r.lang AND b.source IS NOT DISTINCT FROM r.source
 WHERE CASE WHEN up = 1 THEN rate > q3 + reach * greatest(q3 - q1, least) ELSE rate < q1 - reach * greatest(q3 - q1, least) END GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM counts LEFT JOIN fails USING (rid)"""

_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAKS = f"""WITH {_DOCS}, {_words('worded', 'docs', f'translate(text, {_LOWER})', _ALNUM)}, {_words('items', 'benchmark', f"translate(coalesce(text, ''), {_LOWER})", _ALNUM)},
phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[p : p + least(len(w), 10) - 1], ' ') FOR p IN range(1, greatest(len(w) - 9, 1) + 1)]) AS k FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM phrases),
pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM worded, sizes WHERE len(w) >= n),
found AS (SELECT rid, p, n, item_id FROM (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM pos) JOIN phrases USING (n, k)),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY 1),
named AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {15 - 5 * c}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for c in range(4))
_ARCHIVE = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT *, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM d"""

_AUDIT = f"""WITH RECURSIVE {_DOCS}, {_words('worded', 'docs', 'text')},
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
flagged AS (SELECT coalesce(lang, '') AS part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
 coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM worded LEFT JOIN marks USING (doc_id)),
masked AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY 1, 2),
orders AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS letters(f) WHERE NOT contains(filter_order, f)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit, coalesce(list_sum([1 << (ascii(substr(filter_order, j, 1)) - 65) FOR j IN range(1, step)]), 0)::INT AS before
 FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders WHERE length(filter_order) = 5)),
told AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM masked, steps GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""

_RUN = "[a-z\u00C0-\u00FF]{7,}"
_SPELLING = f"""WITH RECURSIVE crc(tab) AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i)),
runs AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_RUN}')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (SELECT run, n, tab, [CAST('0x' || substr(hex(encode(s)), 2 * k + 1, 2) AS BIGINT) FOR k IN range(strlen(s))] AS b FROM runs, crc),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
longer AS (SELECT DISTINCT word, cut.n, part AS shorter, s.n AS m FROM cut JOIN words s (shorter, n) ON s.shorter = cut.part),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (part, k) WHERE a.word <> b.word UNION SELECT word, shorter, m FROM longer UNION SELECT shorter, word, n FROM longer),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (m, -rank)) AS other, max(m) AS m FROM (SELECT *, row_number() OVER (ORDER BY other) AS rank FROM near) GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN chain USING (word) JOIN forms last ON last.word = chain.root AND last.form IS NULL"""

SQL = {"op1_url_filter": _URL, "op2_suffix_dedup": _SUFFIX, "op3_substring_dedup": _SUBSTRING, "op4_jaccard_join": _JACCARD, "op6_quality_rules": _QUALITY, "op7_decontaminate": _LEAKS, "op9_warc": _ARCHIVE, "op11_filter_audit": _AUDIT, "op12_minhash_dedup": _MINHASH, "op13_spelling_variants": _SPELLING}
