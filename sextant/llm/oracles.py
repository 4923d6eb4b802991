"""DuckDB statements that give the rows of the registered queries of this subpackage."""

#: 5-word windows found twice mark their words; a single repeat of over 50 words is a 51-word window found twice, and
#: longest_repeat is the longest chain of repeated windows (grown by doubling is not needed: runs are compared directly).
QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(w[i:i+4]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY doc_id),
pre AS (SELECT a.doc_id, a.i, b.i AS j FROM win a JOIN win b ON a.doc_id = b.doc_id AND a.h = b.h AND a.i < b.i),
run AS (SELECT doc_id, j - i AS gap, i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS grp FROM pre),
longest AS (SELECT doc_id, max(n) + 4 AS longest_repeat FROM (SELECT doc_id, gap, grp, count(*) AS n FROM run GROUP BY ALL) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(longest_repeat, 0) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND longest_repeat <= 50 AS kept FROM m
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, l[i:i+2] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d) WHERE regexp_matches(array_to_string(l[i:i+2], ''), '[^\x20\x09-\x0D]')),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, pos + k AS p FROM later, range(0, 3) r(k)),
each_line AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
kept AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM each_line e LEFT JOIN cov ON e.doc_id = cov.doc_id AND e.i - 1 = cov.p WHERE cov.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(l), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed FROM d LEFT JOIN kept USING (doc_id)
"""

URL_FILTER = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_on,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\\]+)', 1)), '\.$', ''), '') AS host FROM pages),
h AS (SELECT host AS domain, min(page_id) AS p FROM p WHERE host IS NOT NULL GROUP BY host HAVING min(page_id) % 3 = 0),
e AS (SELECT domain, DATE '2024-01-01' + CAST((p * 13) % 200 + k * 60 AS INTEGER) AS listed_on, CASE k WHEN 1 THEN 'remove' ELSE 'add' END AS action FROM h, range(0, 3) r(k) WHERE k <= p % 4),
v AS (SELECT domain, listed_on AS valid_from, action, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM e),
hit AS (SELECT page_id, arg_max(domain, length(domain)) AS blocked_by FROM p JOIN v ON (p.host = v.domain OR ends_with(p.host, '.' || v.domain))
  AND v.action = 'add' AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched_on, blocked_by IS NOT NULL AS blocked, blocked_by FROM p LEFT JOIN hit USING (page_id)
"""

#: All pairs with a common shingle are counted, and links are followed to their closure.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(2, len(w) - 2)) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+3], ' ')) AS h FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, l.y FROM reach JOIN l ON l.x = reach.r)
SELECT d AS doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""

#: CRC-32 is folded over the bytes of the decimal doc_id, -1 standing for a shift by one bit; the levels of all languages'
#: trees come from one recursion, those of the top tree from another.
MERKLE_MANIFEST = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang,
  list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [CAST(-1 AS BIGINT), -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS c,
  concat(octet_length(CAST(CAST(doc_id AS VARCHAR) AS BLOB)), ':', doc_id, coalesce(concat(octet_length(CAST(source AS BLOB)), ':', source), '-'), coalesce(concat(octet_length(CAST(lang AS BLOB)), ':', lang), '-')) AS head,
  coalesce(concat(length(CAST(n_chars AS VARCHAR)), ':', n_chars), '-') AS chars, coalesce(concat(length(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1), '-') AS more,
  CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END AS tail FROM documents),
leaf AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, sha256(concat(head, chars, tail)) AS leaf,
  CASE WHEN xor(c, 4294967295) % 7 = 0 THEN sha256(concat(head, more, tail)) END AS changed FROM f),
up AS (SELECT lang, 0 AS level, i, n, leaf AS d FROM leaf UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 2, n),
sub AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM up WHERE n = 1),
over_all AS (SELECT 0 AS level, g AS i, (SELECT count(*) FROM sub) AS n, subroot AS d FROM sub UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM over_all WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT l.doc_id, u.level AS k, s.d AS beside, (l.i >> u.level) % 2 = 1 AS is_right FROM leaf l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.i = l.i >> u.level AND u.n > 1
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.i = xor(u.i, 1)
  UNION ALL SELECT l.doc_id, 1000 + o.level, s.d, (g >> o.level) % 2 = 1 FROM leaf l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang JOIN over_all o ON o.i = sub.g >> o.level AND o.n > 1
    LEFT JOIN over_all s ON s.level = o.level AND s.i = xor(o.i, 1)),
paths AS (SELECT doc_id, list(coalesce(CASE WHEN is_right THEN '<' ELSE '>' END || beside, '.') ORDER BY k) AS p FROM steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, sub.subroot, r.d AS root, sha256(regexp_replace(array_to_string(coalesce(p, []), ''), '[<>.]', '', 'g')) AS proof_sha256, v.folded AS folded_root, v.folded = r.d AS verified
FROM leaf l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths USING (doc_id) CROSS JOIN (SELECT d FROM over_all WHERE n = 1) r,
  LATERAL (SELECT list_reduce(list_concat([coalesce(l.changed, l.leaf)], coalesce(p, [])), lambda a, s: CASE WHEN s = '.' THEN sha256(a) WHEN s[1] = '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded) v
"""

#: As the near duplicates, with 85 for 80 and without the verdict.
JACCARD_JOIN = NEAR_DUPLICATES.replace(">= 80 *", ">= 85 *").replace(", d = min(r) AS kept", "")

#: The cheapest and then least audit of each state, row by row; a move is some insertions and what becomes of the row.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(key, ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [CAST(-1 AS BIGINT), -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 20 AS k FROM t),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS c FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS whole FROM d),
o2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again AND NOT whole AS truncated, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o2),
due(q, next, word) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
kept(q, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins AS (SELECT q, q AS r, '' AS a, 0 AS c, '' AS s FROM due UNION ALL SELECT q, next, 'I', 3, chr(10) || word || ':' FROM due
  UNION ALL SELECT a.q, b.next, 'II', 6, chr(10) || a.word || ':' || chr(10) || b.word || ':' FROM due a JOIN due b ON b.q = a.next),
moves AS (SELECT i.q, CAST(NULL AS VARCHAR) AS initial, i.r AS next, i.a || 'D' AS a, i.c + 4 AS c, i.s, CAST(NULL AS VARCHAR) AS word, 'D' AS kind FROM ins i
  UNION ALL SELECT i.q, NULL, due.next, i.a || 'R', i.c + 3, i.s, word, 'R' FROM ins i JOIN due ON due.q = i.r
  UNION ALL SELECT i.q, kept.initial, kept.next, i.a || 'K', i.c, i.s, NULL, 'K' FROM ins i JOIN kept ON kept.q = i.r),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'c': CAST(0 AS BIGINT), 'a': '', 's': ''} AS best FROM d
  UNION ALL SELECT dp.conv_id, f.i, m.next, min({'c': best.c + m.c + CASE WHEN truncated AND kind <> 'D' THEN 3 ELSE 0 END, 'a': best.a || m.a, 's': best.s || m.s || CASE WHEN kind = 'D' THEN '' ELSE chr(10) || coalesce(word, role) || ':' || text END})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN moves m ON m.q = dp.q AND (kind = 'D' OR NOT (blank OR duplicate)) AND (kind <> 'K' OR m.initial = f.initial)
  GROUP BY dp.conv_id, f.i, m.next),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (i > 1 AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT dp.conv_id, min({'c': best.c + ins.c, 'a': best.a || ins.a, 's': best.s || ins.s}) AS best FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.q = dp.q AND ins.r IN (0, 3) GROUP BY dp.conv_id)
SELECT u.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.s[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM u.conv_id
"""
