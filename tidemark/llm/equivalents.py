"""DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("[^ \\x09-\\x0D]+")} AS ws FROM documents),
 i AS (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS pos FROM w WHERE len(ws) > 0),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 4], ' ') AS shingle FROM i),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 edge AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT edge.b, r.c FROM r JOIN edge ON edge.a = r.v),
 m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.v = doc_id"""

_WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_WORD)} AS ws FROM documents),
 t AS (SELECT item_id, {_words(_WORD)} AS ws FROM benchmark),
 c AS (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS pos FROM t WHERE len(ws) > 0),
 pattern AS (SELECT DISTINCT item_id, m, array_to_string(ws[pos:pos + m - 1], ' ') AS p FROM c),
 o AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos FROM d, (SELECT DISTINCT m FROM pattern) WHERE len(ws) >= m),
 hit AS (SELECT doc_id, pos, o.m, item_id FROM o JOIN pattern ON pattern.m = o.m AND p = array_to_string(ws[pos:pos + o.m - 1], ' ')),
 place AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS x FROM hit) GROUP BY doc_id),
 item AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(place.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, place.n IS NOT NULL AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def _vector_codes(rounds: int = 4) -> str:
    """Each round is one assignment (``a``) and one update (``b``) over all parts."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE {_WHOLE}),
parts AS MATERIALIZED (SELECT n, vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, range(4) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT n, p, any_value(x) AS x, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c)
  + list_inner_product(c, c), e := e)) AS m FROM parts JOIN b{i} USING (p) GROUP BY n, p)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT p, m.e AS e, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM a{i}),
m{i} AS (SELECT p, e, place, floor(sum(value) / count(*)) AS value FROM s{i} GROUP BY ALL),
u{i} AS (SELECT p, e, list(value ORDER BY place) AS c FROM m{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN u{i} USING (p, e))""")
    return f"""WITH {','.join(steps)},
coded AS (SELECT n, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY n),
flat AS (SELECT p, e, unnest(c) AS value, generate_subscripts(c, 1) AS place FROM b{rounds}),
books AS (SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, place)) AS codebooks_sha256 FROM flat)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), books"""


VECTOR_CODES = _vector_codes()

HARD_NEGATIVES = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""
