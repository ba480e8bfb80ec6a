"""The corpus queries in DuckDB SQL, where SQL can express them. Written from the definitions, not from the operators."""

from __future__ import annotations

ORACLE = {}

# Words of each text, in order, and the 5-word windows.
_WORDS = r"""
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
lined AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram
            FROM worded, unnest(range(1, len(words) - 3)) AS t(i)),
repeated AS (SELECT r, gram FROM windows GROUP BY r, gram HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n
            FROM windows JOIN repeated USING (r, gram), range(0, 5) AS s(k) GROUP BY r)
"""

_MEASURED = rf"""
WITH {_WORDS},
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals
  FROM worded JOIN lined USING (r) LEFT JOIN covered USING (r)),
failures AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
          + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
          + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
          + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM measured)
"""

ORACLE["op3_quality_rules"] = _MEASURED + "SELECT *, failed = 0 AS kept FROM failures"

ORACLE["op8_exact_dedup"] = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM digests WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

# The number of copies: the least n whose Poisson distribution function exceeds the document's hashed number.
_MIXED = r"""
sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS size FROM {table} GROUP BY source),
rates AS (SELECT source, coalesce(round((power(size::DOUBLE, 0.7) / (SELECT sum(power(size::DOUBLE, 0.7)) FROM sizes))
                 * ((SELECT sum(size) FROM sizes)::DOUBLE / size), 6), 0.0) AS rate FROM sizes),
draws AS (SELECT d.*, rate,
                 ('0x' || substr(md5('20240|poisson|1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
                 / 4503599627370496.0 AS u
          FROM {table} d JOIN rates ON d.source IS NOT DISTINCT FROM rates.source),
poisson AS (
  WITH RECURSIVE table_of(rate, k, p, below) AS (
    SELECT DISTINCT rate, 0, exp(-rate), exp(-rate) FROM rates
    UNION ALL
    SELECT rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM table_of WHERE k < 60)
  SELECT * FROM table_of),
counted AS (SELECT d.*, (SELECT count(*) FROM poisson p WHERE p.rate = d.rate AND p.below <= d.u)::INT AS n_copies
            FROM draws d)
"""

ORACLE["op9_mixing"] = "WITH " + _MIXED.format(table="documents") + """
SELECT doc_id, text, source, n_copies, copy_no::INT AS copy_no
FROM counted, unnest(range(0, n_copies)) AS t(copy_no)
"""

# All pairs that share a shingle; components by following the smallest reachable key.
_NEAR = r"""
texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM {table}),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {width} - 1], ' ') AS shingle
             FROM texts, unnest(range(1, greatest(len(words) - {width} + 1, least(len(words), 1)) + 1)) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, hash(list(shingle ORDER BY shingle)) AS h FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
reps AS (SELECT s.* FROM shingles s JOIN classes USING (doc_id) WHERE doc_id = rep),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM reps x JOIN reps y USING (shingle)
           WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
          WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes
          UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
components AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
near AS (SELECT t.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(rep, t.doc_id) AS class_id,
                coalesce(component_id, t.doc_id) AS component_id
         FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN components USING (rep))
"""

ORACLE["op6_minhash"] = "WITH RECURSIVE " + _NEAR.format(table="documents", width=2) + """
SELECT *, component_id = doc_id AS kept FROM near
"""

# CRC-32 by its definition, a byte at a time; ``crc_of`` is the checksum of each byte.
_CRC = """
crc_bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)) + z)) AS crc_of)
"""

ORACLE["op12_importance_resampling"] = rf"""
WITH {_CRC},
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents
  UNION ALL SELECT 1, item_id, item_id, text FROM benchmark),
words AS (
  SELECT kind, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT kind, row_no, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS g FROM words),
buckets AS (
  SELECT g, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)),
    lambda x, b: xor(x >> 8, crc_of[(xor(x, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g FROM grams), crc_bits),
placed AS (SELECT kind, row_no, b FROM grams JOIN buckets USING (g)),
counts AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed GROUP BY b),
gains AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weights AS (SELECT row_no, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (b) WHERE kind = 0 GROUP BY row_no),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row_no) WHERE kind = 0),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * fit // 100 THEN place END AS rank FROM ranked
"""

ORACLE["op13_prefix_trie"] = f"""
WITH {_CRC},
ordered AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, b: xor(x >> 8, crc_of[(xor(x, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM ordered, crc_bits),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1 : c.h], []), c.turns[c.h + 1 :]) AS turns
  FROM hashed c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 100),
starts AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[1 : d] AS path
  FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM starts GROUP BY path, depth),
children AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.path[n.depth].t) ELSE 0 END AS own
  FROM nodes n LEFT JOIN children c ON c.path = n.path),
below AS (
  SELECT w.path[1 : d] AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM whole w, LATERAL (SELECT unnest(range(w.depth + 1)) AS d) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON b.path = w.path LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[1 : w.depth - 1]
"""
