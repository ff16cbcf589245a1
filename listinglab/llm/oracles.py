"""DuckDB SQL for the queries that SQL can express over whole tables."""

_TAILS = r"(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
_ESC = lambda c: rf"REGEXP_REPLACE({c}, '([<\[])(\\*{_TAILS})', '\1\\\2', 'g')"

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, SUM(32 + LENGTH({_ESC('role')}) + LENGTH({_ESC('text')})) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    LEAD(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM t)
SELECT conv_id, COUNT(*) AS n_turns,
  SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) END), 0) AS BIGINT) AS loss_chars,
  SHA256(COALESCE(STRING_AGG(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' OR last THEN upto END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""

OP2 = """
WITH u AS (SELECT vec_id, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR NOT ISFINITE(x)),
v AS (SELECT vec_id, i, CAST(FLOOR(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS c FROM u WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, SUM(q.c * v.c) AS score FROM v q JOIN v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, v.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 10"""

_SPACED = r"REGEXP_EXTRACT_ALL({}, '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(LEN({_SPACED.format('text')}), 0) AS BIGINT) AS size, MD5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight FROM s),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY size * 2e0 / weight, place) AS n FROM w),
c AS (SELECT *, size * 2e0 / weight AS ratio, COALESCE(SUM(size * 2e0) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS clamped, SUM(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT ((SELECT SUM(size) FROM s) * 1.5e0 - clamped) / free AS level FROM c WHERE ((SELECT SUM(size) FROM s) * 1.5e0 - clamped) / free <= ratio ORDER BY n LIMIT 1),
t AS (SELECT source, size AS source_size, LEAST(weight * level, size * 2e0) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(FLOOR(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(ROUND(p.target - p.whole * p.source_size) AS BIGINT) - COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + GREATEST(0, LEAST(rest, size)) AS BIGINT) AS taken FROM x"""

_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
g AS (SELECT doc_id, ARRAY_TO_STRING(w, ' ') AS s FROM d WHERE LEN(w) BETWEEN 1 AND 4
  UNION SELECT doc_id, ARRAY_TO_STRING(LIST_SLICE(w, i, i + 4), ' ') FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 3)) AS i FROM d WHERE LEN(w) >= 5) e),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
k AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, MIN(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, COALESCE(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

OP7 = """
WITH r AS (SELECT page_id, COALESCE(CAST(FLOOR(page_id / 5e2) AS BIGINT), -1) AS file,
  'WARC/1.1' || CHR(13) || CHR(10) || 'WARC-Type: response' || CHR(13) || CHR(10) || 'WARC-Record-ID: <urn:page:' || COALESCE(CAST(page_id AS VARCHAR), '') || '>' || CHR(13) || CHR(10)
  || 'WARC-Target-URI: ' || COALESCE(url, '') || CHR(13) || CHR(10) || 'Content-Length: ' || CAST(STRLEN(COALESCE(html, '')) AS VARCHAR) || CHR(13) || CHR(10) || CHR(13) || CHR(10) || COALESCE(html, '') || CHR(13) || CHR(10) || CHR(13) || CHR(10) AS record FROM pages),
i AS (SELECT *, CAST(COALESCE(SUM(STRLEN(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM r)
SELECT file, off AS "offset", CASE WHEN page_id % 1511 = 5 THEN 'missing' ELSE 'changed' END AS kind, SHA256(record) AS left_digest,
  CASE WHEN page_id % 1511 = 5 THEN NULL ELSE SHA256('X' || SUBSTRING(record, 2)) END AS right_digest
FROM i WHERE page_id % 1009 = 17 OR page_id % 1511 = 5"""

_PLAIN = r"REGEXP_EXTRACT_ALL({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH it AS (SELECT item_id, {_PLAIN.format(_LOWER)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, 10 AS m, ARRAY_TO_STRING(LIST_SLICE(w, i, i + 9), ' ') AS s FROM (SELECT item_id, w, UNNEST(RANGE(1, LEN(w) - 8)) AS i FROM it WHERE LEN(w) >= 10) t
  UNION SELECT item_id, LEN(w), ARRAY_TO_STRING(w, ' ') FROM it WHERE LEN(w) BETWEEN 1 AND 9),
d AS (SELECT doc_id, {_PLAIN.format(_LOWER)} AS w FROM documents),
m AS (SELECT DISTINCT m FROM win),
g AS (SELECT doc_id, i, m, ARRAY_TO_STRING(LIST_SLICE(w, i, i + m - 1), ' ') AS s FROM (SELECT doc_id, w, m, UNNEST(RANGE(1, LEN(w) - m + 2)) AS i FROM d, m WHERE LEN(w) >= m) t),
h AS (SELECT g.doc_id, g.i, g.m, win.item_id FROM g JOIN win ON g.s = win.s AND g.m = win.m),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(RANGE(i, i + m)) AS p FROM h) t GROUP BY doc_id),
its AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) t GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(d.w) AS BIGINT) AS n_words, CAST(COALESCE(hit.n, 0) AS BIGINT) AS n_hit, CAST(COALESCE(its.n, 0) AS BIGINT) AS n_items, SHA256(COALESCE(its.s, '')) AS items_sha256, COALESCE(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS ws FROM documents),
w AS (SELECT doc_id, UNNEST(ws) AS w, GENERATE_SUBSCRIPTS(ws, 1) AS i FROM d),
p AS (SELECT doc_id, w, LAG(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
one AS (SELECT w, COUNT(*) AS n FROM w GROUP BY w), two AS (SELECT v, w, COUNT(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
ctx AS (SELECT v, SUM(n) AS n FROM two GROUP BY v), total AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM w),
s AS (SELECT p.doc_id, SUM(CASE WHEN p.v IS NULL THEN LN(one.n / total.n) WHEN two.n >= 2 THEN LN(CAST(two.n AS DOUBLE) / ctx.n) ELSE LN(0.4e0 * one.n / total.n) END) AS s
  FROM p CROSS JOIN total JOIN one ON one.w = p.w LEFT JOIN two ON two.v = p.v AND two.w = p.w LEFT JOIN ctx ON ctx.v = p.v GROUP BY p.doc_id)
SELECT d.doc_id, CAST(LEN(d.ws) AS BIGINT) AS n_words, ROUND(COALESCE(s.s, 0e0), 4) AS log_score, ROUND(s.s / LEN(d.ws), 4) AS mean_log FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""

OP9_ORDER3 = f"""
WITH d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS ws FROM documents),
w AS (SELECT doc_id, UNNEST(ws) AS w, GENERATE_SUBSCRIPTS(ws, 1) AS i FROM d),
p AS (SELECT doc_id, w, LAG(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, LAG(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM w),
one AS (SELECT w, COUNT(*) AS n FROM w GROUP BY w), two AS (SELECT v, w, COUNT(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w), three AS (SELECT u, v, w, COUNT(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
ctx AS (SELECT v, SUM(n) AS n FROM two GROUP BY v), ctx2 AS (SELECT u, v, SUM(n) AS n FROM three GROUP BY u, v), total AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM w),
s AS (SELECT p.doc_id, SUM(CASE WHEN p.v IS NULL THEN LN(one.n / total.n) WHEN three.n >= 2 THEN LN(CAST(three.n AS DOUBLE) / ctx2.n)
    ELSE CASE WHEN p.u IS NULL THEN 0e0 ELSE LN(0.4e0) END + CASE WHEN two.n >= 2 THEN LN(CAST(two.n AS DOUBLE) / ctx.n) ELSE LN(0.4e0 * one.n / total.n) END END) AS s
  FROM p CROSS JOIN total JOIN one ON one.w = p.w LEFT JOIN two ON two.v = p.v AND two.w = p.w LEFT JOIN ctx ON ctx.v = p.v
  LEFT JOIN three ON three.u = p.u AND three.v = p.v AND three.w = p.w LEFT JOIN ctx2 ON ctx2.u = p.u AND ctx2.v = p.v GROUP BY p.doc_id)
SELECT d.doc_id, CAST(LEN(d.ws) AS BIGINT) AS n_words, ROUND(COALESCE(s.s, 0e0), 4) AS log_score, ROUND(s.s / LEN(d.ws), 4) AS mean_log FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""

# crc32 of an ASCII string, bit by bit.
_CRC = lambda s: (
    f"XOR(LIST_REDUCE(LIST_TRANSFORM(STRING_SPLIT({s}, ''), LAMBDA c: CAST(ASCII(c) AS UBIGINT)), "
    "LAMBDA h, b: LIST_REDUCE([CAST(k AS UBIGINT) FOR k IN RANGE(8)], "
    "LAMBDA v, k: CASE WHEN v & 1 = 1 THEN XOR(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, XOR(h, b)), "
    "CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"
)

# The four states' best ways so far, each {cost, audit, lines}: nothing yet, after s, u, a.
_WAY = lambda s, cost, letter, line="": (
    f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': " + (f"LIST_APPEND({s}.t, {line})" if line else f"{s}.t") + "}"
)
_FROM = lambda s, letter, to: (
    f"CASE WHEN NOT gone AND who = '{letter}' THEN {_WAY(s, 'own', 'K', "role || ':' || text")} END, CASE WHEN NOT gone THEN {_WAY(s, '1 + own', 'R', f"'{to}:' || text")} END"
)

OP11 = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    {_CRC("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN REGEXP_REPLACE(text, '[.!?]', '', 'g') ELSE text END AS text,
    UNNEST(RANGE(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, LEFT(role, 1) AS who FROM d),
f AS (
  SELECT *, LAG(who) OVER w || who AS pair,
    CASE WHEN NOT REGEXP_MATCHES(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT REGEXP_MATCHES(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, i, who, role, text, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS own FROM f),
start AS (SELECT {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS yes, {{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}} AS no),
v(conv_id, i, p, q, r, s) AS (
  SELECT conv_id, CAST(0 AS BIGINT), yes, no, no, no FROM (SELECT DISTINCT conv_id FROM conversations), start
  UNION ALL
  SELECT conv_id, i, {_WAY('p', 2, 'D')}, LIST_SORT(LIST_FILTER([{_WAY('q', 2, 'D')}, CASE WHEN NOT gone AND who = 's' THEN {_WAY('p', 'own', 'K', "role || ':' || text")} END], LAMBDA x: x IS NOT NULL))[1],
    LIST_SORT(LIST_FILTER([{_WAY('r', 2, 'D')}, {_FROM('p', 'u', 'user')}, {_FROM('q', 'u', 'user')}, {_FROM('s', 'u', 'user')}], LAMBDA x: x IS NOT NULL))[1],
    LIST_SORT(LIST_FILTER([{_WAY('s', 2, 'D')}, {_FROM('r', 'a', 'assistant')}], LAMBDA x: x IS NOT NULL))[1]
  FROM (
    SELECT conv_id, i, gone, who, role, text, own, p, q, r, LIST_SORT([s, {_WAY('r', 5, 'I', "'assistant:'")}])[1] AS s
    FROM (
      SELECT g.conv_id, g.i, gone, who, role, text, own, p, q, s, LIST_SORT([r, {_WAY('p', 5, 'I', "'user:'")}, {_WAY('q', 5, 'I', "'user:'")}, {_WAY('s', 5, 'I', "'user:'")}])[1] AS r
      FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1) x) y),
z AS (
  SELECT conv_id, LIST_SORT([p, s, {_WAY('r', 5, 'I', "'assistant:'")}, {{'c': q.c + 10, 'a': q.a || 'II', 't': q.t || ['user:', 'assistant:']}}])[1] AS best
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY i DESC) AS n FROM v) t WHERE n = 1),
e AS (
  SELECT conv_id, CAST(COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS BIGINT) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
    COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, best.a AS audit, SHA256(ARRAY_TO_STRING(best.t, CHR(10))) AS repaired_sha256
FROM z LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id"""

OP13 = f"""
WITH o AS (
  SELECT conv_id, LIST({{'r': COALESCE(role, ''), 'x': COALESCE(text, '')}} ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, CAST({_CRC('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h FROM o),
f AS (
  SELECT a.conv_id, LIST_CONCAT(CASE WHEN b.l IS NULL THEN LIST_SLICE(a.l, 1, 0) ELSE LIST_SLICE(b.l, 1, a.h) END, LIST_SLICE(a.l, a.h + 1, LEN(a.l))) AS l
  FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
u AS (SELECT conv_id, l, LEN(l) AS n, UNNEST(RANGE(LEN(l) + 1)) AS d FROM f),
p AS (
  SELECT conv_id, n, d, MD5(CAST(TO_JSON(LIST_SLICE(l, 1, d)) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN MD5(CAST(TO_JSON(LIST_SLICE(l, 1, d - 1)) AS VARCHAR)) END AS up,
    CASE WHEN d > 0 THEN LEN({_SPACED.format('l[d].x')}) ELSE 0 END AS words FROM u),
m AS (
  SELECT d, k, MIN(up) AS up, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * MIN(words) AS saved,
    SHA256(COALESCE(STRING_AGG(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends FROM p GROUP BY d, k),
c AS (SELECT up, COUNT(*) AS n FROM m WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT p.k, SUM(m.saved) AS saved, COUNT(*) FILTER (c.n IS NULL) AS leaves
  FROM m LEFT JOIN c ON c.up = m.k JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.k)
SELECT m.conv_id, m.d AS depth, a.conv_id AS parent_conv_id, m.n_convs, COALESCE(c.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m LEFT JOIN m a ON a.k = m.up LEFT JOIN c ON c.up = m.k JOIN s ON s.k = m.k"""

ORACLE_SQL = {"op1_chat_format": OP1, "op2_topk_search": OP2, "op5_mixing": OP5, "op6_jaccard_join": OP6, "op7_merkle_audit": OP7, "op8_decontaminate": OP8, "op9_lm_score": OP9_ORDER3, "op9_lm_score_order2": OP9, "op9_lm_score_order3": OP9_ORDER3, "op11_turn_repair": OP11, "op13_conversation_trie": OP13}
