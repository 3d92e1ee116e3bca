"""DuckDB SQL for the corpus queries that SQL can express, written apart from the operators."""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, md5(text) AS th, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
n AS (SELECT doc_id, th, no, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
d AS (SELECT line, length(line) AS len, min((doc_id, no)) AS first FROM n WHERE line <> '' GROUP BY line),
near AS (
  SELECT a.line, b.first FROM d a JOIN d b ON left(a.line, 12) = left(b.line, 12) AND abs(a.len - b.len) <= 1 AND b.first < a.first WHERE a.len >= 30 AND b.len >= 30 AND levenshtein(a.line, b.line) <= 1
  UNION ALL
  SELECT a.line, b.first FROM d a JOIN d b ON right(a.line, 12) = right(b.line, 12) AND abs(a.len - b.len) <= 1 AND b.first < a.first WHERE a.len >= 30 AND b.len >= 30 AND levenshtein(a.line, b.line) <= 1),
best AS (SELECT line, min(first) AS first FROM (SELECT line, first FROM d UNION ALL SELECT * FROM near) GROUP BY line),
marked AS (SELECT l.doc_id, l.th, l.no, l.raw, b.line IS NOT NULL AND (l.doc_id, l.no) > b.first AS gone FROM l JOIN n USING (doc_id, th, no) LEFT JOIN best b ON n.line = b.line)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
  coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (gone), '') AS removed_lines,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id, th
"""

QUALITY_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, len(ws) AS n, UNNEST(range(1, len(ws) - 1)) AS i, ws FROM w),
g3 AS (SELECT doc_id, i, ws[i:i+2] AS win FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g3) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM t)),
lw AS (SELECT *, len(ws) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(line) - length(replace(line, '!', '')) AS bang, lower(line) AS low,
       row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1 AS dup FROM l WHERE len(ws) > 0),
f AS (SELECT *, 4 * sym > n OR 2 * bang > n OR (n >= 4 AND low <> line AND upper(line) = line) OR (n >= 10 AND 10 * len(list_distinct(ws)) < 3 * n)
       OR (n <= 20 AND (contains(low, 'cookie') OR contains(low, 'javascript') OR contains(low, 'privacy policy') OR contains(low, 'terms of use') OR contains(low, 'terms of service')
         OR contains(low, 'all rights reserved') OR contains(low, 'licensed under') OR contains(low, 'subscribe to') OR contains(low, 'sign up') OR contains(low, 'log in')
         OR contains(low, 'click here') OR contains(low, 'share this') OR contains(low, 'read more')))
       OR (n <= 3 AND NOT regexp_matches(ws[-1], '[.!?:"'')\]”»…]$')) AS gone FROM lw),
s AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (gone) AS lines_removed, coalesce(sum(length(array_to_string(ws, ''))) FILTER (gone), 0) AS lost, count(*) FILTER (dup) AS n_dup FROM f GROUP BY doc_id),
j AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lines, 0) AS lines, coalesce(lines_removed, 0) AS lines_removed, coalesce(lost, 0) AS lost_chars
       FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(lines AS BIGINT) AS lines, CAST(lines_removed AS BIGINT) AS lines_removed,
  CAST(lost_chars AS BIGINT) AS lost_chars, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept
FROM j
"""

#: ``crcs(w, crc)``: CRC-32 of the strings that ``{words}`` gives, a byte at a time over a table made by its rule.
_CRCS = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
crc_bytes AS (SELECT w, list_transform(range(1, CAST(len(h) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)) AS bytes FROM (SELECT w, hex(encode(w)) AS h FROM ({words}))),
crcs AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, table_[xor(c & 255, b) + 1])), 4294967295) AS crc FROM crc_bytes, crc_table)"""

IMPORTANCE = (
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, UNNEST(ws) AS w FROM d), bw AS (SELECT UNNEST(ws) AS w FROM b),"""
    + _CRCS.format(words="SELECT w FROM dw UNION SELECT w FROM bw")
    + r""",
s AS (SELECT crc % 10000 AS bucket, count(*) AS s FROM dw JOIN crcs USING (w) GROUP BY 1),
t AS (SELECT crc % 10000 AS bucket, count(*) AS t FROM bw JOIN crcs USING (w) GROUP BY 1),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN crcs USING (w) JOIN g ON g.bucket = crc % 10000 GROUP BY doc_id),
sc AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_features, weight, score, CAST(CASE WHEN place <= 10 * n // 100 THEN place END AS BIGINT) AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
)

TRIE = (
    r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT conv_id, pos, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),"""
    + _CRCS.format(words="SELECT DISTINCT CAST(conv_id AS VARCHAR) AS w FROM conversations")
    + r""",
c AS (SELECT CAST(w AS BIGINT) AS conv_id, CAST(w AS BIGINT) - CAST(w AS BIGINT) % 20 AS base, crc % 4 AS h FROM crcs),
pieces AS (SELECT c.conv_id, 0 AS side, u.pos, k, words FROM c JOIN u ON u.conv_id = base AND u.pos < h UNION ALL SELECT c.conv_id, 1, u.pos, k, words FROM c JOIN u ON u.conv_id = c.conv_id AND u.pos >= h),
r AS (SELECT c.conv_id, coalesce(list(k ORDER BY side, pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(words ORDER BY side, pos) FILTER (k IS NOT NULL), []) AS ws FROM c LEFT JOIN pieces ON pieces.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(ks) AS n, UNNEST(range(CAST(len(ks) + 1 AS BIGINT))) AS depth, ks, ws FROM r),
q AS (SELECT conv_id, n, depth, ks[1:depth] AS key, CASE WHEN depth = 0 THEN 0 ELSE ws[depth] END AS words FROM p),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, key)),
up AS (SELECT UNNEST(range(CAST(depth + 1 AS BIGINT))) AS a, key, saved, n_children FROM full_),
sub AS (SELECT a AS depth, key[1:a] AS key, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1, 2)
SELECT CAST(f.conv_id AS BIGINT) AS conv_id, CAST(f.depth AS BIGINT) AS depth, CAST(o.conv_id AS BIGINT) AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub s ON f.depth = s.depth AND f.key = s.key LEFT JOIN nodes o ON o.depth = f.depth - 1 AND o.key = f.key[1:f.depth - 1]
"""
)

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ':', '\c')) AS n_role,
  length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h')) AS n_text FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + n_role + 2 + n_text + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
