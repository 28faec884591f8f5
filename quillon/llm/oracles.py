"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
grams AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM spots),
hits AS (SELECT doc_id, grams.n, k, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM d WHERE len(w) >= 4),
g AS (SELECT doc_id, k, w[k:k + 2] AS x FROM win), twice AS (SELECT doc_id, x FROM g GROUP BY doc_id, x HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM g JOIN twice USING (doc_id, x)) GROUP BY doc_id),
c AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(list_sum(list_transform(list_filter(lines, lambda l: (len(regexp_extract_all(l, '[|›•·]')) >= 3 AND 25 * len(regexp_extract_all(l, '[|›•·]')) > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))
    OR 6 * len(regexp_extract_all(l, '[#*$%&<>]')) > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))
    OR (len(regexp_extract_all(l, '!')) >= 3 AND 25 * len(regexp_extract_all(l, '!')) > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AND NOT regexp_matches(l, '\p{Ll}'))
    OR (length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) < 200 AND regexp_matches(l, '(?i)\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|javascript|subscribe to our newsletter|click here|sign in|log in|read more|share this|lorem ipsum|alle rechte vorbehalten|impressum|tous droits r.serv.s|mentions l.gales|todos los derechos reservados|aviso legal|pol.tica de (?:privacidad|cookies))\b|©|\(c\) (?:19|20)[0-9]{2}'))
    OR (regexp_matches(text, '[.!?…:;。！？।؟]["''”’»)\]]*(?:[\x20\x09-\x0D]|\z)') AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 12 AND NOT regexp_matches(l, '[.!?…:;。！？।؟]["''”’»)\]]*[\x20\x09-\x0D]*\z'))),
    lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))), 0) AS BIGINT) AS lost FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= 30 * word_chars AS kept FROM f
""",
    "op10_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, role, text, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsb;') AS safe,
  lag(role) OVER w AS was, lead(role) OVER w AS next FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT conv_id, turn, role, text, CASE WHEN was IS DISTINCT FROM role THEN '<|role|>' || role || chr(10) ELSE '<|turn|>' END || safe || CASE WHEN next IS DISTINCT FROM role THEN '<|end|>' ELSE '' END AS piece FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op11_prefix_trie": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS src, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
b AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN o ON o.conv_id = c.src AND o.k <= c.h UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, sha256(length(role) || ':' || role || text) AS x, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM b),
p AS (SELECT conv_id, 0 AS d, '' AS key, CAST(NULL AS VARCHAR) AS up, 0 AS w FROM c UNION ALL SELECT r.conv_id, p.d + 1, sha256(p.key || r.x), p.key, r.w FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
n AS (SELECT key, min(d) AS d, min(up) AS up, min(w) AS w, count(*) AS n, min(conv_id) AS conv_id FROM p GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT p.key, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (kids.key IS NULL) AS leaves FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids ON kids.key = n.key GROUP BY p.key),
last AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM p JOIN last USING (conv_id, d) GROUP BY key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM n LEFT JOIN n above ON above.key = n.up LEFT JOIN kids ON kids.key = n.key JOIN under ON under.key = n.key LEFT JOIN ends ON ends.key = n.key
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS m FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
cells AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, m),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) t(step)),
e AS (SELECT part, filter_order, step, own, n, good, toxic, m[own] AS fails, coalesce(list_bool_or(list_transform(before, lambda k: coalesce(m[k], false))), false) AS gone,
  len(list_filter(map_values(m), lambda v: v)) = 1 AS single FROM cells, s),
g AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND single), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
""",
}
