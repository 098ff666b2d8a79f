"""SQL of the queries of this folder, for comparison on the same tables."""

from __future__ import annotations

from assaytrail.llm import divergence, heapmeans
from assaytrail.llm.linededup import MIN_CHARS
from assaytrail.llm.sharding import BLOCKS, MULTIPLIER, SHARDS

_STATE = f"((key::HUGEINT * {MULTIPLIER} + 1) % 18446744073709551616)"


def _jump(shards: int) -> str:
    """The jump consistent hash of ``key`` (a HUGEINT from 0 to 2**64 - 1): steps of the loop as a reduction."""
    return f"""list_reduce(list_prepend({{'state': key, 'bucket': -1::BIGINT, 'jump': 0::BIGINT}},
      list_transform(range({shards}), lambda i: {{'state': 0::HUGEINT, 'bucket': 0::BIGINT, 'jump': 0::BIGINT}})),
      lambda now, _: CASE WHEN now.jump < {shards} THEN {{
        'state': (now.state * {MULTIPLIER} + 1) % 18446744073709551616,
        'bucket': now.jump,
        'jump': floor((now.jump + 1)::DOUBLE * (2147483648.0::DOUBLE
          / ((((now.state * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT}}
      ELSE now END).bucket"""


OP1 = f"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS crcs FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS bytes,
         (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key FROM documents),
placed AS (
  SELECT doc_id, octet_length(bytes) + 1 AS size, key, {_jump(SHARDS)}::INTEGER AS shard, {_jump(SHARDS + 1)}::INTEGER AS grown_shard,
         ({_STATE} // 4294967296) % {BLOCKS} AS block,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(regexp_replace(hex(bytes), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)),
           lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]))) AS text_crc32
  FROM docs, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
keyed AS MATERIALIZED (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS lo FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.line, k.n, coalesce(r.lo <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = r"[^\x20\x09-\x0D]+"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _js(counts: str, key: str) -> str:
    """Jensen-Shannon distance by rid between ``counts`` (rid, g, key, n) and their sums by group g."""
    return f"""
  SELECT rid, sqrt(greatest(sum(p * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)
              + 1 - sum(q), 0) / 2) AS distance
  FROM (SELECT c.rid, c.n / sum(c.n) OVER (PARTITION BY c.rid) AS p, r.q AS q FROM {counts} c
        JOIN (SELECT g, {key}, sum(n) / sum(sum(n)) OVER (PARTITION BY g) AS q FROM {counts} GROUP BY g, {key}) r USING (g, {key}) WHERE c.n > 0)
  GROUP BY rid"""


_CLASS_SETS = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r"\x20\x09\x0B-\x0D", "line": r"\n", "stop": ".,;:!?",
               "symbol": "#*$%&|<>", "bracket": r"()\[\]{}\x22\x27\x2D/"}

OP2 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({_list(divergence.LANGS)}) THEN lang ELSE '' END AS g,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
words AS MATERIALIZED (SELECT rid, g, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM docs),
windows AS (
  SELECT rid, i, word, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM words WINDOW w AS (PARTITION BY rid ORDER BY i)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM windows WHERE w3 IS NOT NULL) WHERE c > 1),
inside AS (SELECT rid, count(DISTINCT i + s) AS n_repeat_words FROM again, range(3) r(s) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE trim(line, {_SPACE}) <> '' GROUP BY rid),
plain AS (
  SELECT rid, g, t, {", ".join(f"length(regexp_replace(t, '[^{x}]', '', 'g')) AS {k}_n" for k, x in _CLASS_SETS.items())},
         length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS wide_n FROM docs),
classes AS MATERIALIZED (
  SELECT rid, g, unnest([{", ".join(f"{k}_n" for k in _CLASS_SETS)}, wide_n,
                         length(t) - wide_n - {" - ".join(f"{k}_n" for k in _CLASS_SETS)}])::DOUBLE AS n,
         unnest(range({len(_CLASS_SETS) + 2})) AS class FROM plain),
buckets AS MATERIALIZED (
  SELECT rid, g, CASE WHEN b IN ({_list(divergence.BUCKETS)}) THEN b ELSE '' END AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT rid, g, translate(trim(word, '{divergence.EDGES.replace("'", "''")}'), '{_UPPER}', '{_LOWER}') AS b FROM words) GROUP BY 1, 2, 3),
by_class AS ({_js("classes", "class")}),
by_word AS ({_js("buckets", "bucket")}),
counted AS (
  SELECT d.rid, d.doc_id, len(d.ws) AS n_words, length(d.t) - p.blank_n - p.line_n AS word_chars, p.symbol_n AS n_symbols,
         coalesce(u.n_dup_lines, 0) AS n_dup_lines, coalesce(s.n_repeat_words, 0) AS n_repeat_words,
         coalesce(c.distance, 0) AS class_distance, coalesce(w.distance, 0) AS word_distance
  FROM docs d JOIN plain p USING (rid) LEFT JOIN dup u USING (rid) LEFT JOIN inside s USING (rid)
  LEFT JOIN by_class c USING (rid) LEFT JOIN by_word w USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words
            OR (word_chars >= {divergence.CLASS_CHARS} AND class_distance > {divergence.CLASS_DISTANCE})
            OR (n_words >= {divergence.WORD_COUNT} AND word_distance > {divergence.WORD_DISTANCE})) AS kept
FROM counted
"""


def _lloyd(rounds: int) -> str:
    """SQL of the rounds of plain clustering: centroids c0 to c<rounds>, nearest ones n0 to n<rounds>."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, k, d FROM (SELECT rid, k, d, row_number() OVER (PARTITION BY rid ORDER BY d, k) AS place
    FROM (SELECT v.rid, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN cent{k} c USING (i) GROUP BY v.rid, c.k)) WHERE place = 1)""")
        if k < rounds:
            parts.append(f"""
cent{k + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM cent{k} c
  LEFT JOIN (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM near{k} JOIN parts USING (rid) GROUP BY k, i) USING (k, i))""")
    return ",".join(parts)


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({heapmeans.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {heapmeans.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept),
cent0 AS MATERIALIZED (
  SELECT k - 1 AS k, unnest(v) AS x, unnest(range(len(v))) AS i
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{heapmeans.SEED}:' || vec_id)) AS k FROM kept) WHERE k <= {heapmeans.CLUSTERS}),{_lloyd(heapmeans.ROUNDS)},
digests AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM cent{heapmeans.ROUNDS} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM near{heapmeans.ROUNDS} JOIN kept USING (rid) JOIN digests USING (k)
"""

OP13 = """
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS crcs FROM bits WHERE k = 8),
own AS MATERIALIZED (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]))) % 6 AS h
  FROM own, crc_table),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(d.turns[:h], []), c.turns[h + 1:]) AS path
  FROM heads c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT path[:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
children AS (SELECT p[:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
climbed AS (
  SELECT p, unnest(range(depth + 1)) AS upto, (n_children = 0)::BIGINT AS leaf,
         CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].text) ELSE 0 END AS saved FROM full_nodes),
sums AS (SELECT p[:upto] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climbed GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (p) LEFT JOIN full_nodes up ON n.depth > 0 AND up.p = n.p[:n.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {"op1_jump_sharding": OP1, "op2_divergence_rules": OP2, "op7_line_dedup": OP7, "op12_heap_kmeans": OP12,
                              "op13_prefix_trie": OP13}
