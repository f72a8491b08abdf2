"""The operators' results in DuckDB SQL, written from their definitions."""

from __future__ import annotations

SPACED = r"'[^\x20\x09-\x0D]+'"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    coalesce(len(regexp_extract_all(text, {SPACED})), 0) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE class WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    2 * source_size AS most FROM s),
c AS (
  SELECT *, sum(most) OVER o AS filled, sum(weight) OVER o AS used,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
-- The share of one unit of weight if the sources up to this one stop at their limit.
e AS (
  SELECT max(share) AS share FROM (
    SELECT (words * 150 / 100 - filled) / nullif(weights - used, 0) AS share,
      lead(most / weight) OVER (ORDER BY most / weight, source NULLS LAST) AS next,
      most / weight AS own FROM c
    UNION ALL SELECT DISTINCT words * 150 / 100 / weights, NULL, 0 FROM c) x
  WHERE share >= own),
t AS (
  SELECT w.*, least(e.share * weight, CAST(most AS DOUBLE)) AS target FROM w, e),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.class,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(least(floor(target) - start, size), 0) AS once,
    greatest(least(floor(target) - source_size - start, size), 0) AS again FROM p),
u AS (
  SELECT *, start / target AS x, (start + source_size) / target AS y FROM k),
f AS (
  SELECT *,
    CASE class WHEN 0 THEN {{0}} WHEN 1 THEN {{1}} ELSE {{2}} END AS a,
    CASE class WHEN 0 THEN {{3}} WHEN 1 THEN {{4}} ELSE {{5}} END AS b FROM u)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(once + again AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN CAST(floor(a * 1000000) AS BIGINT) END AS first_at,
  CASE WHEN again > 0 THEN CAST(floor(b * 1000000) AS BIGINT) END AS again_at
FROM f
""".format(
    *[
        form.replace("z", v)
        for v in ("x", "y")
        for form in (
            # From 1.5 to 0.5; level; from 0.5 by 1.0 to 2.0 (areas 0.375 and 0.75).
            "0.0 + 2 * z / (1.5 + sqrt(greatest(2.25 - 2 * z, 0)))",
            "0.0 + 2 * z / (1.0 + sqrt(1.0))",
            "CASE WHEN z * 1.125 < 0.375"
            " THEN 0.0 + 2 * (z * 1.125) / (0.5 + sqrt(0.25 + 2 * (z * 1.125)))"
            " ELSE 0.5 + 2 * (z * 1.125 - 0.375)"
            " / (1.0 + sqrt(1.0 + 4 * (z * 1.125 - 0.375))) END",
        )
    ]
)

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {SPACED}) AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i+4], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (
  SELECT doc_id, doc_id AS component FROM documents
  UNION
  SELECT e.b, r.component FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles,
  min(component) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_CONTRACT_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_CONTRACT_WORDS}, []) AS w FROM documents),
b AS (
  SELECT item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, {_CONTRACT_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS seq
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
o AS (
  SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS seq
  FROM (SELECT d.doc_id, d.w, m.n, unnest(range(1, len(d.w) - m.n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM b) m)),
h AS (SELECT o.doc_id, o.s, o.n, i.item_id FROM o JOIN i USING (n, seq)),
c AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {SPACED}), []) AS w FROM documents),
o AS (
  SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS seq
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (
  SELECT doc_id, s FROM o
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS place FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
k AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
  FROM x ANTI JOIN g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id AS other, a.label = d.label AS same,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""

# Base 32 turns 20 bits, five hexadecimal digits, into four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (
  SELECT page_id, strlen(html) AS size, sha1(html) AS hex,
    max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
      (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER)
        >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1 AS BIGINT), 1)), '') AS digest FROM g)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

SQL = {
    "op1_exact_top_k": TOP_K,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op6_substring_dedup": PASSAGES,
    "op9_source_mixing": MIXING,
    "op10_ngram_jaccard_join": NGRAM_JOIN,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_warc": WARC,
}
