"""Expected results of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

# No dialogue of the tables fills a part of a rendering, so every rendering is one row here.
OP1 = r"""
WITH message AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
    regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM message WHERE speaker <> 'system'),
rotated AS (
  SELECT m.conv_id, perspective, turn, content, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || speaker || chr(10) END AS header
  FROM message m JOIN people p ON m.conv_id = p.conv_id),
placed AS (
  SELECT *, header || content || '<|im_end|>' || chr(10) AS whole,
    coalesce(sum(length(header) + length(content) + 11) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      ::BIGINT AS at_char
  FROM rotated)
SELECT conv_id, perspective, 0 AS part, 0::BIGINT AS start,
  string_agg(whole, '' ORDER BY turn) AS text, count(*)::INTEGER AS n_messages,
  coalesce(string_agg((at_char + length(header)) || ':' || (at_char + length(whole) - 1), ',' ORDER BY turn)
    FILTER (WHERE own), '') AS masks
FROM placed GROUP BY conv_id, perspective
"""

# CRC-32 of UTF-8 bytes by its table of 256 remainders (reversed polynomial 0xEDB88320).
_CRC = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    [i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sizes AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table)
"""

OP4 = _CRC + """,
placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    ::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total FROM sizes),
dealt AS (
  SELECT doc_id, size, text_crc32, ((2 * before + size) * 40 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""

OP6 = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n,
    unnest(list_transform(range(1, len(words) - least(13, len(words)) + 2),
      lambda i: array_to_string(words[i:i + least(13, len(words)) - 1], ' '))) AS w
  FROM item WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM wanted),
own AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i,
    unnest(list_transform(range(1, len(words) - n + 2),
      lambda i: array_to_string(words[i:i + n - 1], ' '))) AS w
  FROM doc, lengths WHERE len(words) >= n),
hits AS (SELECT doc_id, i, own.n, item_id FROM own JOIN wanted USING (n, w)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP12 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other_id, q.label = c.label AS same,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negative AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""
