"""DuckDB SQL of the queries that SQL can express, straight from their contracts."""

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS s FROM w),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k FROM starts),
first AS (SELECT k, min(doc_id) AS keeper FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS p FROM windows JOIN first USING (k) WHERE keeper < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS k
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS s FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM item_windows),
starts AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM docs, sizes),
hits AS (SELECT doc_id, s, i.n, item FROM (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM starts) d
         JOIN item_windows i ON i.n = d.n AND i.k = d.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS s FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.lowest, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS lowest FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op11_lexical_search": f"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM documents),
docs AS (SELECT d, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{ALNUM}')) AS term FROM benchmark),
tf AS (SELECT d, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, doc_id, n, unnest(ws) AS term FROM docs)
       WHERE term IN (SELECT term FROM asked) GROUP BY d, doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
impact AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS s FROM tf JOIN weight USING (term), size),
score AS (SELECT item_id, d, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM score WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10""",
    "op13_suffix_dedup": """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(generate_series(0, len(t) // 2 - 100)) AS s FROM texts WHERE len(t) >= 200),
windows AS (SELECT doc_id, s, md5_number(t[2 * s + 1:2 * s + 200]) AS k FROM starts),
first AS (SELECT k, min(struct_pack(d := doc_id, s := s)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM windows JOIN first USING (k) WHERE doc_id > f.d OR s > f.s),
edges AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens FROM later),
runs AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM edges),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS z FROM runs GROUP BY doc_id, run),
kept AS (SELECT doc_id, t[2 * coalesce(lag(z) OVER w, 0) + 1:2 * a] AS piece, a, z, t FROM spans JOIN texts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
cut AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) || any_value(t)[2 * max(z) + 1:] AS t, count(*) AS n, sum(z - a) AS gone FROM kept GROUP BY doc_id)
SELECT x.doc_id, CAST(len(x.t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(c.t, x.t))) AS kept_sha256
FROM texts x LEFT JOIN cut c USING (doc_id)""",
}
