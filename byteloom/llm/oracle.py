"""DuckDB SQL for the training-data queries that SQL can express."""

SQL = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size::HUGEINT * size)::DOUBLE AS squares, max(size) AS longest FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at,
        sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped FROM w),
l AS (SELECT *, (all_size::DOUBLE * 1.5 - caps::DOUBLE) / (all_weight - capped)::DOUBLE AS lev FROM f),
l2 AS (SELECT min(full_at) AS at_full FROM l WHERE lev <= full_at),
l3 AS (SELECT min(lev) AS level FROM l WHERE full_at = (SELECT at_full FROM l2) AND lev <= full_at),
t AS (SELECT source, source_size, squares, longest, CASE WHEN (SELECT level FROM l3) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT level FROM l3) * weight) END AS target FROM l),
r AS (SELECT d.doc_id, d.text, d.u, t.source, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
        t.squares / greatest(t.source_size, 1) AS mean, t.longest
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, least(2.0::DOUBLE - r, CASE WHEN longest > mean THEN r / (longest / mean - 1) ELSE 0.0 END) AS room FROM r),
c AS (SELECT *, least(greatest(CASE WHEN size > 0 THEN r + room * 0.5::DOUBLE * (1 - size / mean) ELSE 0.0 END, 0.0), 2.0::DOUBLE) AS want FROM m),
p AS (SELECT *, floor(want)::BIGINT AS sure, want - floor(want) AS p FROM c),
o AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM p),
k AS (SELECT *, odds / (1 + odds) AS rank, target - sum(sure * size) OVER (PARTITION BY source) AS left_over FROM o),
a AS (SELECT *, coalesce(sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM k)
SELECT doc_id, size, source_size, target,
       (sure + CASE WHEN rank IS NOT NULL AND so_far + size / 2.0::DOUBLE <= left_over THEN 1 ELSE 0 END) * size AS taken
FROM a
""",
    "op6_exact_top_k": r"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and([x IS NOT NULL AND isfinite(x::DOUBLE) for x in embedding])),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_warc_archive": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p),
t AS (SELECT *, payload_bytes >= 1000 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM t
""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x WHERE shared >= 0.8 * (na + nb - shared) - 1e-9),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT doc_id, min(seen) AS class_id FROM r GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a),
k AS (SELECT doc_id, count(*) OVER (PARTITION BY list_sort(s)) AS copies FROM s)
SELECT c.doc_id, c.class_id, coalesce(n.links, 0)::BIGINT AS links, coalesce(k.copies, 1)::BIGINT AS copies
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}
