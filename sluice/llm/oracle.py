"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A-Z in lower case, other letters as they are.
FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM w),
g AS (SELECT doc_id, p FROM s QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)),
i AS (SELECT doc_id, p, p - max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM g),
r AS (SELECT doc_id, p, sum((gap IS NULL OR gap > 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(x=FOLD.format(x="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s), e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
sym AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS spot FROM documents UNION SELECT r.node, sym.b FROM reach r JOIN sym ON sym.a = r.spot)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT node, min(spot) AS component_id FROM reach GROUP BY node) m ON m.node = n.doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT page_id, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha, 10 * (k // 8) + 1, 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31)::INT, 1)), '') AS payload_digest FROM p),
f AS (SELECT page_id, payload_bytes, payload_digest, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p JOIN b USING (page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

OP6 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
t AS (SELECT doc_id, line, content, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM t WHERE words > 0),
pairs AS (SELECT a.doc_id, a.seq, a.line, a.words, b.doc_id AS other, a.seq - b.seq AS shift FROM s a JOIN s b ON a.content = b.content AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))),
runs AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY seq) AS run FROM pairs),
gone AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, line, sum(words) OVER (PARTITION BY doc_id, other, shift, run) AS total FROM runs) WHERE total >= 20)
SELECT t.doc_id, count(*) AS n_lines, count(gone.line) AS n_deleted, sha256(coalesce(string_agg(t.content, chr(10) ORDER BY t.line) FILTER (gone.line IS NULL), '')) AS kept_sha256
FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.line = t.line GROUP BY t.doc_id
"""

OP7 = """
WITH m AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE role END AS kind, CASE role WHEN 'user' THEN 'turn-' || turn WHEN 'assistant' THEN 'turn-' || (turn - 1) END AS call_id FROM conversations),
k AS (SELECT conv_id, call_id, bool_or(kind = 'call') AS calls, bool_or(kind = 'result') AS results FROM m WHERE call_id IS NOT NULL GROUP BY ALL)
SELECT m.conv_id, m.turn, kind, m.call_id, CASE kind WHEN 'call' THEN results WHEN 'result' THEN calls END AS linked,
CASE kind WHEN 'call' THEN m.turn - min(m.turn) FILTER (kind = 'call') OVER c WHEN 'result' THEN m.turn - min(m.turn) FILTER (kind = 'call') OVER c ELSE 0 END::INT AS level,
row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) - 1 AS ordinal, CASE WHEN kind = 'call' THEN length(text) > 0 END AS valid,
sha256(CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || m.turn || '},"call_id":"' || m.call_id || '","kind":"call","name":"reply"}'
WHEN 'result' THEN '{"call_id":"' || m.call_id || '","content":' || to_json(text)::VARCHAR || ',"kind":"result"}' ELSE '{"content":' || to_json(text)::VARCHAR || ',"kind":' || to_json(kind)::VARCHAR || '}' END) AS json_sha256
FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.call_id = m.call_id WINDOW c AS (PARTITION BY m.conv_id)
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark), d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT places.doc_id, i, places.n, win.item_id FROM places JOIN win ON win.n = places.n AND win.k = places.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The unsigned CRC-32 of the UTF-8 bytes of {x}, by a table of 256 remainders.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS remainders FROM range(256) t(i))"
CRC = "xor(list_reduce(list_transform(range(0, octet_length(encode({x}))), lambda k: ('0x' || substr(hex(encode({x})), 2 * k + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

OP13 = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT {_ALNUM} AS w FROM benchmark),
de AS (SELECT doc_id, unnest(w) AS w FROM d), be AS (SELECT unnest(w) AS w FROM b),
h AS MATERIALIZED (SELECT w, {CRC.format(x="w")} % 10000 AS bucket FROM (SELECT w FROM de UNION SELECT w FROM be), crc),
s AS (SELECT bucket, count(*) AS s FROM de JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM be JOIN h USING (w) GROUP BY bucket),
st AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM st),
m AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM de JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_features, coalesce((total - ((total % len(w)) + len(w)) % len(w)) // len(w), 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""

OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, {FOLD.format(x="run")} AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, {CRC.format(x="(doc_id || ':' || run)")} AS h, length(run) AS n FROM r, crc),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % n)::INT) || substr(run, (h % n)::INT + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
less AS (SELECT DISTINCT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.rest),
p AS (SELECT a, b FROM less UNION SELECT b, a FROM less UNION SELECT x.word, y.word FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS b, first(w.n ORDER BY w.n DESC, b) AS bn FROM p JOIN w ON w.word = p.b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * w.n THEN b END AS form, CASE WHEN bn >= 5 * w.n THEN bn END AS form_n FROM w LEFT JOIN best USING (word)),
go AS (SELECT word, word AS spot FROM f UNION ALL SELECT go.word, f.form FROM go JOIN f ON f.word = go.spot WHERE f.form IS NOT NULL)
SELECT f.word, form, spot AS root, n, n_near, form_n FROM f JOIN (SELECT go.word, go.spot FROM go JOIN f ON f.word = go.spot WHERE f.form IS NULL) t USING (word)
"""

SQL = {"op11_spelling": OP11, "op13_resample": OP13, "op2_suffix_dedup": OP2, "op4_jaccard_join": OP4, "op5_warc": OP5, "op6_line_dedup": OP6, "op7_chat_format": OP7, "op10_decontaminate": OP10}
