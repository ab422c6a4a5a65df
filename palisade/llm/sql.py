"""DuckDB SQL of the queries that SQL can express."""

MIX = """
WITH sized AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|0')) AS o,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS lim, [5.0, 2.0, 1.0][class + 1]::DOUBLE AS w FROM sums),
filled AS (
  SELECT *, row_number() OVER z AS place,
    ((SELECT sum(source_size) FROM sums)::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0))
      / ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighted
  WINDOW z AS (ORDER BY lim / w, source NULLS LAST),
    b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, coalesce(least(lim, (SELECT min_by(level, place) FROM filled WHERE level * w < lim) * w), lim) AS target FROM filled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.class,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - done))
    + greatest(0, least(size, CAST(floor(target) AS BIGINT) - done - source_size)) AS BIGINT) AS taken FROM placed),
timed AS (
  SELECT *, [6.0, 2.0, 0.5][class + 1]::DOUBLE AS w0, [4.0, 2.0, 1.5][class + 1]::DOUBLE AS w1 FROM taken)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN
    CASE WHEN done / target * ((w0 + w1) / 2) >= (w0 + w1) / 2 THEN 1.0::DOUBLE
    WHEN done / target * ((w0 + w1) / 2) > 0 THEN 2 * (done / target * ((w0 + w1) / 2))
      / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * (w1 - w0) * (done / target * ((w0 + w1) / 2))))) ELSE 0.0::DOUBLE END
  END AS position
FROM timed
"""

_TERMS = """
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

CONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TERMS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS seq
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(seq) AS n FROM windows),
grams AS (
  SELECT row, n, i, w[i:i + n - 1] AS seq
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT g.row, g.n, g.i, windows.item_id FROM grams g JOIN windows USING (seq)),
hits AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row, i, n FROM found)) GROUP BY row),
named AS (
  SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""

LINES = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
lines AS (SELECT row, d, unnest(l) AS line, unnest(range(len(l))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(d) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
marked AS (SELECT k.*, c.last IS NOT NULL AND k.d <> c.last AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT any_value(docs.doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (row) GROUP BY row
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
counted AS (
  SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS a
  FROM places, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.p, c.k, c.a, x.a AS l, y.a AS r, c.j, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM counted WHERE k > 1) c
  JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:c.j] JOIN counted y ON y.lang = c.lang AND y.p = c.p[c.j + 1:c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, p[s:s + m - 1] AS p, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM counted WHERE k > 2))
  GROUP BY ALL),
ranked AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inner_parts i USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN sizes USING (lang) WHERE rank <= 2000
"""

_LEXICAL = """
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_LEXICAL} AS w FROM documents),
sizes AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM docs WHERE len(w) > 0),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM counts, sizes GROUP BY term),
impacts AS (
  SELECT c.row, d.doc_id, c.term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * N) // L)) AS impact
  FROM counts c JOIN docs d USING (row), sizes),
asked AS (SELECT row_number() OVER () AS item, item_id, {_LEXICAL} AS w FROM benchmark),
terms AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(w) AS term FROM asked) GROUP BY ALL),
scored AS (
  SELECT item, row, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score
  FROM terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed JOIN asked USING (item) WHERE rank <= 20
"""
