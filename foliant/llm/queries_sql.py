"""SQL twins (DuckDB) of the registered queries that SQL can express as a whole."""

from __future__ import annotations

import re

from foliant.llm import chat

#: Table of the CRC-32 of single bytes, and the CRC of a text's UTF-8 bytes.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS bytes(b))"


def crc32(text: str, table: str = "(SELECT t FROM crc_table)") -> str:
    """SQL of the unsigned CRC-32 of a text that isn't empty."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP11 = rf"""
WITH {CRC_TABLE},
dw AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}')) AS word FROM documents) GROUP BY doc_id, word),
bw AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}')) AS word FROM benchmark) GROUP BY word),
vocabulary AS MATERIALIZED (SELECT word, {crc32("word", "t")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, sum(c) AS s FROM dw JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM bw JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(c) AS n, sum(c * gain) AS weight FROM dw JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN w USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM placed"""


def _part(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"


_FIELDS = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SMALL = LOWER.format("text")

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS MATERIALIZED (SELECT doc_id, source, sha256({_FIELDS} || {_part("text")}) AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)", "t")} % 5 = 0 THEN sha256({_FIELDS} || {_part(_SMALL)}) END AS tampered,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents, crc_table),
tree AS (SELECT source, 0 AS level, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM tree WHERE n > 1 GROUP BY source, level, pos // 16, n),
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM above WHERE n > 1 GROUP BY level, pos // 16, n),
upper AS MATERIALIZED (SELECT * FROM above),
steps AS MATERIALIZED (SELECT source, level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs FROM nodes WHERE n > 1),
upper_steps AS MATERIALIZED (SELECT level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs FROM upper WHERE n > 1),
way AS (SELECT doc_id, source, pos, 0 AS level, n, coalesce(tampered, leaf) AS value, '' AS proof FROM leaves
  UNION ALL SELECT w.doc_id, w.source, w.pos // 16, w.level + 1, (w.n + 15) // 16, sha256(s.lhs || w.value || s.rhs), w.proof || s.lhs || s.rhs
  FROM way w JOIN steps s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.pos = w.pos WHERE w.n > 1),
far AS (SELECT w.doc_id, w.source, r.pos, 0 AS level, r.n, w.value, w.proof FROM way w JOIN subroots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL SELECT f.doc_id, f.source, f.pos // 16, f.level + 1, (f.n + 15) // 16, sha256(s.lhs || f.value || s.rhs), f.proof || s.lhs || s.rhs
  FROM far f JOIN upper_steps s ON s.level = f.level AND s.pos = f.pos WHERE f.n > 1)
SELECT f.doc_id, l.leaf, r.digest AS subroot, u.digest AS root, sha256(f.proof) AS proof_sha256, f.value AS folded_root, f.value = u.digest AS verified
FROM far f JOIN leaves l ON l.doc_id = f.doc_id JOIN subroots r ON r.source IS NOT DISTINCT FROM f.source, (SELECT digest FROM upper WHERE n = 1) u WHERE f.n = 1"""


#: The template's own strings, and those of others, by their lengths and as one pattern whose every match is escaped by one more character.
_ESCAPABLE = "|".join(re.escape(x[0]) + r"\\*" + re.escape(x[1:]) for x in [chat.OPEN, chat.MIDDLE, chat.LEARN, chat.CLOSE, *chat.FOREIGN])


def _formatted(x: str) -> str:
    return f"length({x}) + len(regexp_extract_all({x}, '{_ESCAPABLE}'))"


OP3 = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
learned AS (SELECT *, role = 'assistant' AS learns FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (learns), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learns), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + len(chat.CLOSE)} + CASE WHEN learns THEN {len(chat.LEARN)} ELSE {len(chat.MIDDLE)} END + {_formatted("role")} + {_formatted("text")}) AS BIGINT) AS formatted_chars
FROM learned GROUP BY conv_id"""

OP5 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' .'] ELSE [] END AS s FROM words),
held AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(other, doc_id)) AS kept FROM sets LEFT JOIN least USING (doc_id)"""
