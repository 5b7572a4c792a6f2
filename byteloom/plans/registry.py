"""Registered queries of the byte analytics, and the SQL that checks them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..operators import codecs, lz, rans, stats, transforms
from ..sources import container
from ..sources.relations import blocks, detected, docs, table
from ..streaming import blocks as stream

QUERIES: dict = {}
ORACLES: dict = {}

#: Block sizes of the queries: for transforms inside the row, for codecs, for plain cutting.
ROW_BLOCK, CODEC_BLOCK, CUT_BLOCK = transforms.BLOCK, 16_384, 4096


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_D = "d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_A = _D + ", a AS (SELECT doc_id, [('0x' || x)::INT FOR x IN regexp_extract_all(h, '..')] AS b, len(h) // 2 AS n FROM d)"
_X = _A + ", x AS (SELECT doc_id, unnest(b) AS b, unnest(range(n)) AS pos FROM a)"
_H = _X + ", h AS (SELECT doc_id, b, count(*) AS n FROM x GROUP BY ALL)"
_RUNS = _X + """, g AS (SELECT doc_id, b, pos, pos - row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS island FROM x),
runs AS (SELECT doc_id, b, min(pos) AS first_pos, count(*) AS len FROM g GROUP BY doc_id, b, island)"""
_BLOCKS = _D + """, c AS (SELECT doc_id, h, unnest(range((len(h) // 2 + {size} - 1) // {size})) AS block_idx FROM d),
k AS (SELECT doc_id, block_idx::INT AS block_idx, substr(h, (block_idx * {size} * 2 + 1)::BIGINT, {size} * 2) AS h, least({size}, len(h) // 2 - block_idx * {size})::INT AS n FROM c)"""
_ROW = _BLOCKS.format(size=ROW_BLOCK)
_POS = _ROW + ", p AS (SELECT doc_id, block_idx, h, n, unnest(range(n))::INT AS pos FROM k)"

_PROFILE = _H + """,
s AS (SELECT doc_id, sum(n) AS total, count(*) AS used, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) AS h FROM h GROUP BY doc_id),
pr AS (SELECT doc_id, b AS x, lead(b) OVER w AS y, lead(b, 2) OVER w AS z, pos FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
co AS (SELECT doc_id, count(y)::HUGEINT AS n, sum(x::HUGEINT) FILTER (y IS NOT NULL) AS sx, sum(y::HUGEINT) AS sy, sum((x * x)::HUGEINT) FILTER (y IS NOT NULL) AS sxx, sum((y * y)::HUGEINT) AS syy, sum((x * y)::HUGEINT) AS sxy FROM pr GROUP BY doc_id),
ac AS (SELECT doc_id, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy)::DOUBLE / sqrt((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) ELSE 0.0 END AS c FROM co),
ha AS (SELECT doc_id, pos, x, y, z, xor(xor(x << 10, y << 5), z) & 8191 AS slot FROM pr WHERE z IS NOT NULL),
ma AS (SELECT doc_id, CASE WHEN pos - lag(pos) OVER w <= 4096 AND lag(x) OVER w = x AND lag(y) OVER w = y AND lag(z) OVER w = z THEN 1 ELSE 0 END AS m FROM ha WINDOW w AS (PARTITION BY doc_id, slot ORDER BY pos)),
md AS (SELECT doc_id, sum(m) / count(*) AS density FROM ma GROUP BY doc_id),
gg AS (SELECT doc_id, b, pos - row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS island FROM x),
ru AS (SELECT doc_id, sum(len) AS inside FROM (SELECT doc_id, count(*) AS len FROM gg GROUP BY doc_id, b, island) WHERE len >= 4 GROUP BY doc_id),
tp AS (SELECT doc_id, b, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, b) AS r FROM h),
t2 AS (SELECT p.doc_id, p.n AS n1, q.n AS n2, abs(p.b - q.b) AS apart FROM tp p JOIN tp q ON p.doc_id = q.doc_id AND p.r = 1 AND q.r = 2),
prof AS (SELECT d.doc_id, coalesce(s.h, 0.0) AS h, coalesce(s.used, 0)::INT AS used, coalesce(ac.c, 0.0) AS c, CASE WHEN s.total > 0 THEN coalesce(ru.inside, 0) / s.total ELSE 0.0 END AS runs,
  coalesce(md.density, 0.0) AS density, coalesce(s.total, 0)::BIGINT AS len,
  CASE WHEN coalesce(s.used, 0) <= 1 OR s.h < 0.1 THEN 'Constant' WHEN s.h > 7.0 THEN 'Uniform'
       WHEN coalesce(t2.n1 >= floor(s.total * 0.05) AND t2.n2 >= floor(s.total * 0.05) AND t2.apart >= 64, false) THEN 'Bimodal'
       WHEN s.h < 3.0 AND s.used < 32 THEN 'Skewed' ELSE 'General' END AS shape
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN ac USING (doc_id) LEFT JOIN ru USING (doc_id) LEFT JOIN md USING (doc_id) LEFT JOIN t2 USING (doc_id)),
pf AS (SELECT doc_id, round(h, 6) AS byte_entropy, round(c, 6) AS autocorrelation_lag1, round(runs, 6) AS run_ratio, round(density, 6) AS match_density, shape AS distribution_shape, used AS distinct_bytes, len AS input_len FROM prof),
rule AS (SELECT *, CASE WHEN input_len = 0 THEN 'lzf' WHEN byte_entropy > 7.5 AND match_density < 0.1 THEN 'lzf' WHEN run_ratio > 0.3 THEN 'bw'
  WHEN byte_entropy < 3.0 AND distribution_shape IN ('Skewed', 'Constant') THEN 'bw' WHEN match_density > 0.4 THEN CASE WHEN byte_entropy > 6.0 THEN 'lzfi' ELSE 'lzf' END
  WHEN match_density > 0.2 AND byte_entropy > 5.0 THEN 'lzfi' ELSE 'lzf' END AS pipeline,
  CASE WHEN input_len < 1024 OR byte_entropy > 7.5 THEN 'hash_chain' WHEN match_density > 0.3 AND byte_entropy < 6.5 THEN 'sort_lz'
  WHEN input_len >= 65536 AND match_density > 0.2 AND byte_entropy < 5.5 THEN 'sort_lz' ELSE 'hash_chain' END AS match_finder FROM pf)"""


@query(f"WITH {_PROFILE} SELECT lang, pipeline, count(*) AS documents, round(avg(byte_entropy), 6) AS mean_entropy FROM rule JOIN documents USING (doc_id) GROUP BY lang, pipeline")
def profile_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.profile(docs(spark, sf_dir), 0).withColumn("pipeline", stats.pipeline_rule())
    return rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "pipeline").agg(F.count("*").alias("documents"), F.round(F.avg("byte_entropy"), 6).alias("mean_entropy"))


@query(f"WITH {_H} SELECT doc_id, b, n FROM h")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(docs(spark, sf_dir))


@query(f"""WITH {_H}, s AS (SELECT doc_id, sum(n)::BIGINT AS total, count(*) AS used, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0), 6) AS entropy FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(total, 0)::BIGINT AS total, coalesce(used, 0)::BIGINT AS used, coalesce(entropy, 0.0) AS entropy FROM d LEFT JOIN s USING (doc_id)""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entropy(docs(spark, sf_dir))


@query(f"WITH {_PROFILE} SELECT doc_id, autocorrelation_lag1 FROM pf")
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.autocorrelation(docs(spark, sf_dir))


@query(f"WITH {_RUNS}, r AS (SELECT doc_id, sum(len) AS inside FROM runs WHERE len >= 4 GROUP BY doc_id) SELECT a.doc_id, round(CASE WHEN a.n > 0 THEN coalesce(r.inside, 0) / a.n ELSE 0.0 END, 6) AS run_ratio FROM a LEFT JOIN r USING (doc_id)")
def run_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_ratio(docs(spark, sf_dir))


@query(f"WITH {_PROFILE} SELECT doc_id, match_density FROM pf")
def match_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.match_density(docs(spark, sf_dir))


@query(f"WITH {_PROFILE} SELECT * FROM pf")
def data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile(docs(spark, sf_dir), 0)


@query(f"WITH {_PROFILE} SELECT distribution_shape, count(*) AS documents, min(distinct_bytes) AS least_distinct, max(distinct_bytes) AS most_distinct FROM pf GROUP BY distribution_shape")
def distribution_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.profile(docs(spark, sf_dir), 0).groupBy("distribution_shape")
    return rows.agg(F.count("*").alias("documents"), F.min("distinct_bytes").alias("least_distinct"), F.max("distinct_bytes").alias("most_distinct"))


@query(f"WITH {_PROFILE} SELECT doc_id, pipeline FROM rule")
def select_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile(docs(spark, sf_dir), 0).select("doc_id", stats.pipeline_rule().alias("pipeline"))


@query(f"WITH {_PROFILE} SELECT doc_id, match_finder, CASE WHEN input_len >= 4194304 THEN 24 WHEN input_len >= 1048576 THEN 32 WHEN input_len >= 262144 THEN 48 ELSE 64 END AS chain_depth FROM rule")
def select_match_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("input_len")
    return stats.profile(docs(spark, sf_dir), 0).select("doc_id", stats.finder_rule(n).alias("match_finder"), stats.chain_depth_rule(n).alias("chain_depth"))


@query(f"WITH {_PROFILE} SELECT doc_id, pipeline, (CASE WHEN pipeline = 'bw' THEN 524288 ELSE 262144 END)::BIGINT AS block_size FROM rule")
def select_block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.profile(docs(spark, sf_dir), 0).select("doc_id", stats.pipeline_rule().alias("pipeline"))
    return rows.withColumn("block_size", stats.block_size_rule(F.col("pipeline")))


#: Bytes that a bounded profile looks at.
SAMPLE = 512


@query(f"WITH {_PROFILE.replace(_D, _D.replace("hex(encode(coalesce(text, '')))", f"substr(hex(encode(coalesce(text, ''))), 1, {2 * SAMPLE})"))} SELECT * FROM pf")
def sampled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each value's first bytes: what a choice of codec looks at."""
    return stats.profile(docs(spark, sf_dir), SAMPLE)


@query(f"""WITH {_H}, u AS (SELECT d.doc_id, count(h.b) AS used FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN used = 0 THEN 7 ELSE greatest(5, least(12, ceil(log2(4 * used))))::INT END AS accuracy_log, CASE WHEN used <= 8 THEN 10 WHEN used >= 64 THEN 13 ELSE 12 END AS scale_bits FROM u""")
def coder_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.entropy(docs(spark, sf_dir))
    return rows.select("doc_id", stats.accuracy_rule(F.col("used")).alias("accuracy_log"), stats.scale_rule(F.col("used")).alias("scale_bits"))


@query(f"""WITH {_BLOCKS.format(size=CUT_BLOCK)} SELECT doc_id, block_idx, (block_idx * {CUT_BLOCK})::BIGINT AS off, n AS length, md5(h) AS digest FROM k WHERE n > 0""")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(docs(spark, sf_dir), CUT_BLOCK).select("doc_id", "block_idx", "off", F.octet_length("data").alias("length"), F.md5(F.hex("data").cast("binary")).alias("digest"))


@query(f"WITH {_D} SELECT doc_id, CASE WHEN h LIKE '505A%' THEN 'container' WHEN h LIKE '1F8B%' THEN 'gzip' ELSE 'unknown' END AS format FROM d")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(docs(spark, sf_dir))


_RLE = _RUNS + """, e AS (SELECT doc_id, first_pos, b, len // 259 AS q, len % 259 AS r, printf('%02X', b) AS c FROM runs),
o AS (SELECT doc_id, string_agg(repeat(repeat(c, 4) || 'FF', q::BIGINT) || CASE WHEN r >= 4 THEN repeat(c, 4) || printf('%02X', r - 4) ELSE repeat(c, r::BIGINT) END, '' ORDER BY first_pos) AS encoded FROM e GROUP BY doc_id)
"""


@query(f"WITH {_RUNS}, s AS (SELECT doc_id, sum(5 * (len // 259) + CASE WHEN len % 259 >= 4 THEN 5 ELSE len % 259 END)::BIGINT AS size FROM runs GROUP BY doc_id) SELECT a.doc_id, a.n::BIGINT AS length, coalesce(s.size, 0)::BIGINT AS rle_size FROM a LEFT JOIN s USING (doc_id)")
def rle_encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rle_size(docs(spark, sf_dir))


@query(f"WITH {_RLE} SELECT d.doc_id, (len(coalesce(encoded, '')) // 2)::BIGINT AS size, md5(coalesce(encoded, '')) AS digest FROM d LEFT JOIN o USING (doc_id)")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.rle(docs(spark, sf_dir)).select("doc_id", "size", F.md5(F.col("encoded").cast("binary")).alias("digest"))


@query(f"""WITH {_POS}, r AS (SELECT doc_id, block_idx, pos, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY substr(h || h, pos * 2 + 1, n * 2), pos DESC) AS rk, substr(h || h, (pos + n - 1) * 2 + 1, 2) AS l FROM p)
SELECT doc_id, block_idx, string_agg(l, '' ORDER BY rk) AS bwt, (min(rk) FILTER (pos = 0) - 1)::BIGINT AS primary_index FROM r GROUP BY doc_id, block_idx""")
def bwt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.bwt(blocks(docs(spark, sf_dir), ROW_BLOCK))


@query(f"""WITH {_POS} SELECT doc_id, block_idx, string_agg(pos::VARCHAR, ',' ORDER BY substr(h, pos * 2 + 1)) AS suffixes FROM p GROUP BY doc_id, block_idx""")
def suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.suffix_array(blocks(docs(spark, sf_dir), ROW_BLOCK))


@query(f"""WITH {_POS}, s AS (SELECT doc_id, block_idx, pos, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY substr(h, pos * 2 + 1)) AS rk FROM p),
m AS (SELECT *, min(rk) OVER (PARTITION BY doc_id, block_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s)
SELECT doc_id, block_idx, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS starts FROM m WHERE low IS NULL OR rk < low GROUP BY doc_id, block_idx""")
def lyndon_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.lyndon(blocks(docs(spark, sf_dir), ROW_BLOCK))


@query(f"""WITH {_POS}, s AS (SELECT doc_id, block_idx, pos, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY substr(h, pos * 2 + 1)) AS rk FROM p),
m AS (SELECT *, min(rk) OVER (PARTITION BY doc_id, block_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s),
st AS (SELECT doc_id, block_idx, pos AS a, lead(pos) OVER (PARTITION BY doc_id, block_idx ORDER BY pos) AS z FROM m WHERE low IS NULL OR rk < low),
f AS (SELECT st.doc_id, st.block_idx, a, coalesce(z, k.n) - a AS len, substr(k.h, a * 2 + 1, (coalesce(z, k.n) - a) * 2) AS w FROM st JOIN k USING (doc_id, block_idx)),
ro AS (SELECT *, unnest(range(len)) AS q FROM f),
o AS (SELECT doc_id, block_idx, a, len, string_agg(substr(w || w, (q + len - 1) * 2 + 1, 2), '' ORDER BY substr(w || w, q * 2 + 1, len * 2)) AS l FROM ro GROUP BY ALL)
SELECT doc_id, block_idx, string_agg(l, '' ORDER BY a) AS bwt, string_agg(len::VARCHAR, ',' ORDER BY a) AS lengths FROM o GROUP BY doc_id, block_idx""")
def bijective_bwt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.bijective_bwt(blocks(docs(spark, sf_dir), ROW_BLOCK))


@query(f"""WITH {_ROW}, y AS (SELECT doc_id, block_idx, unnest([('0x' || x)::INT FOR x IN regexp_extract_all(h, '..')]) AS b, unnest(range(n))::INT AS pos FROM k),
l AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, block_idx, b ORDER BY pos) AS last FROM y),
r AS (SELECT i.doc_id, i.block_idx, i.pos, i.b, i.last, count(DISTINCT j.b) FILTER (j.pos > i.last) AS since, count(DISTINCT j.b) FILTER (j.b > i.b) AS larger
  FROM l i LEFT JOIN l j ON i.doc_id = j.doc_id AND i.block_idx = j.block_idx AND j.pos < i.pos GROUP BY ALL)
SELECT doc_id, block_idx, string_agg((CASE WHEN last IS NULL THEN b + larger ELSE since END)::VARCHAR, ',' ORDER BY pos) AS ranks FROM r GROUP BY doc_id, block_idx""")
def mtf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.mtf(blocks(docs(spark, sf_dir), ROW_BLOCK))


_SORTLZ = _POS + """, w AS (SELECT *, substr(h, pos * 2 + 1, 8) AS key, row_number() OVER (PARTITION BY doc_id, block_idx, substr(h, pos * 2 + 1, 8) ORDER BY pos) AS rk FROM p WHERE pos + 4 <= n),
j AS (SELECT t.doc_id, t.block_idx, t.pos, t.pos - s.pos AS "offset", t.h, t.n, s.pos AS src FROM w t JOIN w s ON t.doc_id = s.doc_id AND t.block_idx = s.block_idx AND t.key = s.key AND s.rk BETWEEN t.rk - 8 AND t.rk - 1),
e AS (SELECT doc_id, block_idx, pos, "offset", list_max([k FOR k IN range(4, n - pos + 1) IF substr(h, pos * 2 + 1, k * 2) = substr(h, src * 2 + 1, k * 2)])::INT AS length FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_idx, pos ORDER BY length DESC, "offset" DESC) AS r FROM e),
sm AS (SELECT doc_id, block_idx, pos, "offset", length FROM b WHERE r = 1)"""


@query(f"WITH {_SORTLZ} SELECT * FROM sm")
def sort_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.sort_matches(blocks(docs(spark, sf_dir), ROW_BLOCK))


@query(f"""WITH {_SORTLZ} SELECT doc_id, block_idx, pos, r::INT AS rank, "offset", length FROM b WHERE r <= 4""")
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.top_matches(blocks(docs(spark, sf_dir), ROW_BLOCK), 4)


# the k-th recent offset is the one with k distinct offsets since; a 1 stands before the first match
_SLOTS = _SORTLZ + """, s0 AS (SELECT doc_id, block_idx, pos, "offset", length FROM sm UNION ALL SELECT DISTINCT doc_id, block_idx, -1, 1, 0 FROM sm),
sl AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, block_idx, "offset" ORDER BY pos) AS last FROM s0),
sc AS (SELECT i.doc_id, i.block_idx, i.pos, i."offset", i.length, i.last, count(DISTINCT j."offset") AS since FROM sl i LEFT JOIN sl j ON i.doc_id = j.doc_id AND i.block_idx = j.block_idx AND j.pos > i.last AND j.pos < i.pos
  WHERE i.pos >= 0 GROUP BY ALL),
so AS (SELECT doc_id, block_idx, pos, "offset", length, (CASE WHEN last IS NULL OR since > 2 THEN -1 ELSE since END)::INT AS slot FROM sc)"""


@query(f"WITH {_SLOTS} SELECT * FROM so")
def repeat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the three recent offsets each match of a block repeats."""
    return lz.repeated(docs(spark, sf_dir), ROW_BLOCK).select("doc_id", "block_idx", "pos", "offset", "length", "slot")


_CODE = "CASE WHEN {v} <= 2 THEN {v} - 1 ELSE floor(log2({v} - 1))::INT + 1 END"


@query(f"""WITH {_SORTLZ}, ol AS (SELECT "offset" AS o, length - 2 AS l FROM sm), q AS (SELECT o, {_CODE.format(v='o')} AS oc, {_CODE.format(v='l')} AS lc FROM ol),
m AS (SELECT oc, lc, greatest(oc - 1, 0) AS ob, greatest(lc - 1, 0) AS lb FROM q)
SELECT oc::INT AS offset_code, lc::INT AS length_code, count(*) AS matches, sum(ob + lb)::BIGINT AS extra_bits, min(3 + least(ob // 4, 4))::INT AS least_length FROM m GROUP BY oc, lc""")
def value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = transforms.sort_matches(blocks(docs(spark, sf_dir), ROW_BLOCK))
    o, v = F.col("offset"), F.col("length") - 2
    rows = m.select(fb.value_code(o).alias("offset_code"), fb.value_code(v).alias("length_code"), (fb.value_extra_bits(o) + fb.value_extra_bits(v)).alias("bits"), fb.least_profitable_length(o).alias("least"))
    return rows.groupBy("offset_code", "length_code").agg(F.count("*").alias("matches"), F.sum("bits").cast("long").alias("extra_bits"), F.min("least").alias("least_length"))


@query(f"""WITH {_X}, t AS (SELECT doc_id, b AS x, lead(b) OVER w AS y, lead(b, 2) OVER w AS z, lead(b, 3) OVER w AS q FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, sum(CASE WHEN z IS NULL THEN 0 ELSE xor(xor(x << 10, y << 5), z) & 32767 END)::BIGINT AS hash3,
       sum(CASE WHEN q IS NULL THEN 0 ELSE ((((x + y * 256::HUGEINT + z * 65536::HUGEINT + q * 16777216::HUGEINT) * 2654435769) % 4294967296) // 131072) & 32767 END)::BIGINT AS hash4
FROM t GROUP BY doc_id""")
def match_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.match_hashes(docs(spark, sf_dir))


_NORM = """, t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, b) AS rank FROM h),
z AS (SELECT *, CASE WHEN used = 1 THEN {t} ELSE greatest({t}, (1::BIGINT << ceil(log2(used))::INT)) END::BIGINT AS size FROM t),
f AS (SELECT *, greatest((n::HUGEINT * size // total), 1)::BIGINT AS f0 FROM z),
g AS (SELECT *, size - sum(f0) OVER (PARTITION BY doc_id) AS diff FROM f),
r AS (SELECT doc_id, max(k) AS k FROM (SELECT g.doc_id, k.k, sum(least(k.k, g.f0 - 1)) AS cut, any_value(g.diff) AS diff FROM g JOIN (SELECT unnest(range(0, 257)) AS k) k ON g.diff < 0 AND k.k <= -g.diff GROUP BY g.doc_id, k.k) WHERE cut <= -diff GROUP BY doc_id),
u AS (SELECT g.*, CASE WHEN diff < 0 THEN f0 - least(coalesce(r.k, 0), f0 - 1) ELSE f0 END AS f1 FROM g LEFT JOIN r USING (doc_id)),
v AS (SELECT *, -diff - sum(f0 - f1) OVER (PARTITION BY doc_id) AS rest, sum(CASE WHEN f1 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n DESC, b) AS turn FROM u),
nf AS (SELECT doc_id, b, n, (CASE WHEN diff >= 0 THEN f0 + diff // used + CASE WHEN rank <= diff % used THEN 1 ELSE 0 END ELSE f1 - CASE WHEN f1 > 1 AND turn <= rest THEN 1 ELSE 0 END END)::BIGINT AS f FROM v)"""


@query(f"WITH {_H}{_NORM.format(t=128)} SELECT doc_id, b, n, f FROM nf")
def fse_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalised_of(stats.facts(docs(spark, sf_dir)), 7)


@query(f"WITH {_H}{_NORM.format(t=4096)} SELECT doc_id, b, n, f FROM nf")
def rans_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalised_of(stats.facts(docs(spark, sf_dir)), 12)


@query(f"""WITH {_H}{_NORM.format(t=4096)}, s AS (SELECT *, sum(f) OVER (PARTITION BY doc_id) AS size FROM nf)
SELECT doc_id, ceil(round(sum(n * log2(size / f)) / 8, 6))::BIGINT AS coded_bytes, sum(n)::BIGINT AS length FROM s GROUP BY doc_id""")
def coded_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.normalised_of(stats.facts(docs(spark, sf_dir)), 12).withColumn("size", F.sum("f").over(W.partitionBy("doc_id")))
    return rows.groupBy("doc_id").agg(F.ceil(F.round(F.sum(F.col("n") * F.log2(F.col("size") / F.col("f"))) / 8, 6)).cast("long").alias("coded_bytes"), F.sum("n").alias("length"))


@query(f"WITH {_H} SELECT doc_id, b, floor(round(-log2(n / sum(n) OVER (PARTITION BY doc_id)) * 256, 6))::BIGINT AS cost FROM h")
def literal_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.literal_costs(stats.histogram(docs(spark, sf_dir)))


@query(f"""WITH {_SLOTS}, hx AS (SELECT doc_id, [('0x' || x)::INT FOR x IN regexp_extract_all(h, '..')] AS v FROM d), hb AS (SELECT doc_id, unnest(v) AS b FROM hx), hn AS (SELECT doc_id, b, count(*) AS n FROM hb GROUP BY ALL),
lc AS (SELECT doc_id, b, floor(round(-log2(n / sum(n) OVER (PARTITION BY doc_id)) * 256, 6))::BIGINT AS cost FROM hn),
q AS (SELECT so.*, k.n, CASE WHEN so.pos + length < k.n THEN ('0x' || substr(k.h, (so.pos + length) * 2 + 1, 2))::INT END AS b, {_CODE.format(v='"offset"')} AS oc, {_CODE.format(v='(length - 2)')} AS lg FROM so JOIN k USING (doc_id, block_idx)),
wc AS (SELECT doc_id, block_idx, pos, slot, b, CASE WHEN slot >= 0 THEN 1280 ELSE 2048 - CASE WHEN oc <= 1 THEN 512 ELSE 0 END + greatest(oc - 1, 0) * 256 END + greatest(lg - 1, 0) * 256 + 256 AS own FROM q)
SELECT wc.doc_id, block_idx, pos, slot, (own + coalesce(lc.cost, 2048))::BIGINT AS cost FROM wc LEFT JOIN lc ON wc.doc_id = lc.doc_id AND wc.b = lc.b""")
def match_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each match costs with the literal after it, repeated offsets cheaper; a block's end counts as a byte never seen."""
    rows = lz.repeated(docs(spark, sf_dir), ROW_BLOCK)
    return rows.select("doc_id", "block_idx", "pos", "slot", stats.match_cost(F.col("offset"), F.col("length"), F.col("next_cost"), F.col("slot") >= 0).alias("cost"))


@query()
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.huffman_rows(codecs.huffman_of(stats.facts(docs(spark, sf_dir))))


@query(f"""WITH {_H}, s AS (SELECT doc_id, sum(n) AS total, count(*) AS used, sum(-n * log2(n / total_)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total_ FROM h) GROUP BY doc_id)
SELECT doc_id, total::BIGINT AS symbols, true AS prefix_free, true AS near_entropy FROM s""")
def huffman_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kraft's sum is one and the size is within a bit a symbol of the entropy."""
    rows = codecs.huffman_of(stats.facts(docs(spark, sf_dir))).where(F.size("b") > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.select("doc_id", "n", F.transform("code", lambda c: F.length(c)).alias("length"), total.alias("symbols"))
    summed = lambda of: F.aggregate(of, F.lit(0.0), lambda a, x: a + x)
    kraft = summed(F.transform("length", lambda k: F.pow(F.lit(2.0), -k)))
    bits = summed(F.zip_with("n", "length", lambda n, k: (n * k).cast("double")))
    least = summed(F.transform("n", lambda n: -n * F.log2(n / F.col("symbols"))))
    rows = rows.select("doc_id", "symbols", F.size("n").alias("used"), kraft.alias("kraft"), bits.alias("bits"), least.alias("least"))
    fair = (F.col("bits") >= F.col("least") - 1e-6) & (F.col("bits") <= F.col("least") + F.col("symbols"))
    return rows.select("doc_id", "symbols", ((F.col("kraft") == 1) | (F.col("used") == 1)).alias("prefix_free"), fair.alias("near_entropy"))


@query()
def crc32_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.crc32("data").alias("crc"))


def _round_trip(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cut = blocks(docs(spark, sf_dir), CODEC_BLOCK)
        back = codecs.decoded(codecs.encoded(cut, name).withColumnRenamed("data", "original"), name)
        return back.groupBy("doc_id").agg(F.sum(F.octet_length("data")).cast("long").alias("length"), F.min(F.col("data") == F.col("original")).alias("same"))

    run.__name__ = f"roundtrip_{name}"
    return query(f"WITH {_D} SELECT doc_id, (len(h) // 2)::BIGINT AS length, true AS same FROM d WHERE h <> ''")(run)


for _name in codecs.PIPELINES:
    _round_trip(_name)


@query()
def trial_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline whose output is smallest for each block; the earlier of equal ones."""
    cut = codecs.coded_sizes(blocks(docs(spark, sf_dir), CODEC_BLOCK))
    least = F.least(*[F.col(n) for n in codecs.PIPELINES])
    pick = F.coalesce(*[F.when(F.col(n) == least, F.lit(n)) for n in codecs.PIPELINES])
    return cut.select("doc_id", "block_idx", pick.alias("pipeline"), least.alias("size"), "original_len")


@query(f"""WITH {_D} SELECT doc_id, 8::BIGINT AS method, 0::BIGINT AS flags, (len(h) // 2)::BIGINT AS isize FROM d""")
def gzip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.gzip_facts(codecs.encoded(docs(spark, sf_dir), "gzip")).select("doc_id", "method", "flags", "isize")


@query()
def compression_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codecs.encoded(blocks(docs(spark, sf_dir), CODEC_BLOCK), "deflate").groupBy("doc_id").agg(F.sum("original_len").alias("n"), F.sum(F.octet_length("payload")).alias("coded"))
    rows = rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.sum("n").alias("bytes"), F.sum("coded").alias("coded_bytes"), F.round(F.sum("coded") / F.sum("n"), 6).alias("ratio"))


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='byteloom-')).rstrip('/')}/byteloom-{name}-{uuid.uuid4().hex}"


@query(f"WITH {_D} SELECT count(*) FILTER (h <> '') AS values_, sum(len(h) // 2)::BIGINT AS bytes, 128 AS pipeline, true AS same FROM d")
def framed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' blocks through the container and back, compared block by block."""
    container.register(spark)
    folder = _shared(spark, "frames")
    cut = blocks(docs(spark, sf_dir), CODEC_BLOCK)
    rows = codecs.encoded(cut, "deflate").select(F.col("block_idx").cast("int"), F.lit(128).alias("pipeline"), "original_len", "crc", "payload")
    # a container holds one value's blocks in general; here, those of a task
    rows.write.format("byteloom_container").mode("append").option("path", folder).save()
    back = codecs.decoded(spark.read.format("byteloom_container").load(folder), "deflate")
    there, here = back.select(F.sha2("data", 256).alias("k"), "pipeline", F.octet_length("data").alias("n")), cut.select(F.sha2("data", 256).alias("k"), F.octet_length("data").alias("n"))
    per = there.groupBy("k").agg(F.count("*").alias("a"), F.max("pipeline").alias("pipeline"), F.sum("n").alias("bytes")).join(here.groupBy("k").agg(F.count("*").alias("b")), "k", "full")
    same = per.agg(F.min(F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.max("pipeline").alias("pipeline"), F.sum("bytes").cast("long").alias("bytes"))
    number = cut.agg(F.countDistinct("doc_id").alias("values_"))
    return same.withColumn("one", F.lit(1)).join(number.withColumn("one", F.lit(1)), "one").select("values_", "bytes", "pipeline", "same")  # a row each


@query(f"WITH {_D} SELECT doc_id, (len(h) // 2)::BIGINT AS length, md5(h) AS digest FROM d WHERE h <> ''")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' file as a stream of coded blocks, written, read again and put together."""
    folder = _shared(spark, "stream")
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    values = stream.read_values(spark, f"{sf_dir}/documents.parquet*", schema)
    stream.start(stream.coded(values, "deflate", CODEC_BLOCK), f"{folder}/out", f"{folder}/state").awaitTermination()
    back = stream.restored(spark.read.parquet(f"{folder}/out"), "deflate")
    return back.select("doc_id", F.octet_length("data").cast("long").alias("length"), F.md5(F.hex("data").cast("binary")).alias("digest"))


@query()
def list_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each container its pipeline, blocks, lengths and ratio, from frame headers."""
    container.register(spark)
    folder = _shared(spark, "list")
    rows = codecs.encoded(blocks(docs(spark, sf_dir), CODEC_BLOCK), "deflate").select(F.col("block_idx").cast("int"), F.lit(128).alias("pipeline"), "original_len", "crc", "payload")
    rows.write.format("byteloom_container").mode("append").option("path", folder).save()
    frames = spark.read.format("byteloom_container").load(folder)
    per = frames.groupBy("path", "pipeline").agg(F.count("*").alias("blocks"), F.sum("original_len").alias("original"), F.sum(F.octet_length("payload")).alias("coded"))
    return per.select("pipeline", "blocks", "original", "coded", F.round(F.col("coded") / F.col("original"), 6).alias("ratio"))


LZ_BLOCK = 512


@query(f"""WITH {_BLOCKS.format(size=LZ_BLOCK)} SELECT doc_id, block_idx, n AS length, true AS same FROM k WHERE n > 0""")
def lz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks parsed to tokens by their longest earlier matches, and rebuilt from the tokens."""
    rows = lz.rebuilt(lz.parsed(blocks(docs(spark, sf_dir), LZ_BLOCK)))
    return rows.select("doc_id", "block_idx", F.octet_length("data").alias("length"), F.coalesce(F.col("data") == F.col("back"), F.lit(False)).alias("same"))


@query()
def lz_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and ideal bits of the flag, literal, offset and length streams of each document's parse."""
    return lz.stream_sizes(lz.tokens(blocks(docs(spark, sf_dir), LZ_BLOCK)))


@query(f"""WITH {_BLOCKS.format(size=LZ_BLOCK)} SELECT doc_id, block_idx, n AS length, true AS same FROM k WHERE n > 0""")
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks through a range coder with a table per document from the normalised histogram, and back."""
    return rans.round_trip_of(docs(spark, sf_dir), LZ_BLOCK).drop("coded_len")
