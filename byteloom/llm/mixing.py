"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target number of words. Each document gets an expected number of copies
`r + tilt`, where r = target / size of its source and the tilt favours short documents while it
leaves the expected words of the source at exactly its target:

    tilt_i = d * (1 - size_i / m),  m = sum(size^2) / sum(size)

so the expected number of copies differs from document to document. Its whole part is
allotted for certain; the rest p is an inclusion probability. Documents are ranked by Pareto's
order statistic, random odds over inclusion odds, (U / (1 - U)) / (p / (1 - p)), and taken
in that order until the words left to the source are filled (size is counted in words, and the
document on the boundary is taken if that comes nearer).

No source is ever brought into one task: the boundary is found from sums of words over
4096 buckets of the rank, then over 4096 buckets inside the boundary's bucket; only the
rows of that small bucket are put in order.

Defined cases: null or empty text has size 0, so it is never taken; a null source is a source of
its own and comes last; null doc_id counts as ''; repeated rows are separate documents
with the same rank (ties are broken by doc_id, then size; equal rows are interchangeable); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights by position of the source, repeating; words to mix as a share of all; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: How far the expected copies lean to short documents, as a share of what stays in bounds.
LENGTH_TILT = 0.5
BUCKETS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, squares, longest, target) from (source, size): water-filling in closed form.

    One row per source reaches the unpartitioned windows, never the documents.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("double").alias("squares"),
        F.max("size").alias("longest"),
    )
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(most))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("cap").over(fill), F.lit(0)).alias("caps"),
        F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("capped"),
    )
    # the level if exactly the sources before this one are full; the first source that it leaves unfilled sets it
    level = (F.col("all_size") * F.lit(float(share)) - F.col("caps")) / (F.col("all_weight") - F.col("capped"))
    per = per.withColumn("level", F.when(level <= F.col("full_at"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "squares", "longest", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = LENGTH_TILT) -> DataFrame:
    """One row per document: doc_id, text_hash, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    sizes = common.texts_of(docs, source="string").select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"), F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).cast("long").alias("size")
    )
    sizes = common.stored(sizes, spark)  # one scan of the texts; the rest reads four small columns
    # one row per source: within the broadcast bound of the session's own threshold or else a shuffled join
    per = common.stored(targets(sizes, weights, share, most), spark)

    same = sizes["source"].eqNullSafe(per["source"])
    rows = sizes.join(per, same).select("doc_id", "text_hash", sizes["source"], "size", "source_size", "squares", "longest", "target")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.col("squares") / F.greatest(F.col("source_size"), F.lit(1))
    room = F.least(F.lit(float(most)) - r, F.when(F.col("longest") > mean, r / (F.col("longest") / mean - 1)).otherwise(F.lit(0.0)))
    copies = F.when(F.col("size") > 0, r + room * F.lit(float(tilt)) * (1 - F.col("size") / mean)).otherwise(F.lit(0.0))
    copies = F.least(F.greatest(copies, F.lit(0.0)), F.lit(float(most)))
    rows = rows.withColumn("want", copies).withColumn("sure", F.floor("want").cast("long")).withColumn("p", F.col("want") - F.col("sure"))
    # U from the id: 52 bits of md5, never 0 or 1
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    odds = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
    first = F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1))
    rows = rows.withColumn("b1", first).withColumn("b2", F.least(F.floor((F.col("rank") * BUCKETS - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)))

    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))  # joins below are plain equi-joins
    rows = rows.withColumn("key", key)
    left = rows.groupBy("key").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("left"))
    left = left.where(F.col("left") > 0)
    cut1 = _boundary(rows.groupBy("key", "b1").agg(F.sum("size").alias("n")).where("b1 is not null").join(left, "key"), "b1")
    inner = rows.join(cut1, ["key", "b1"]).groupBy("key", "b1", "b2", "left").agg(F.sum("size").alias("n"))
    cut2 = _boundary(inner, "b2").join(cut1.select("key", "b1"), "key")
    cut2 = common.stored(cut2.select("key", F.col("b1").alias("c1"), F.col("b2").alias("c2"), "left"), spark)
    # each source: whole buckets before the boundary are in, those after it are out
    rows = rows.join(F.broadcast(cut2) if _small(per) else cut2, "key", "left")
    before = (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2")))
    at = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    # sources whose words run out before the target have no boundary: everything with a chance is in
    edge = rows.where(at)
    so_far = F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy("rank", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("more", F.when(so_far + F.col("size") / 2.0 <= F.col("left"), 1).otherwise(0))
    rest = rows.where(~F.coalesce(at, F.lit(False))).withColumn("more", F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0))
    both = edge.unionByName(rest).withColumn("copies", F.col("sure") + F.col("more"))
    return both.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Sources for which the table of boundaries may be broadcast.
MOST_SOURCES = 10_000


def _small(per: DataFrame) -> bool:
    return per.count() <= MOST_SOURCES


def _boundary(buckets: DataFrame, by: str) -> DataFrame:
    """The bucket in which each source's words reach what is left, and what is left there. At most BUCKETS rows per source."""
    so_far = F.sum("n").over(W.partitionBy("key").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = buckets.withColumn("to", so_far).withColumn("from", F.col("to") - F.col("n"))
    cut = cut.withColumn("last", F.max(by).over(W.partitionBy("key")))
    cut = cut.where(((F.col("from") < F.col("left")) & (F.col("left") <= F.col("to"))) | ((F.col("to") < F.col("left")) & (F.col(by) == F.col("last"))))
    return cut.select("key", by, (F.col("left") - F.col("from")).alias("left"))


def copies_of(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it was taken, with their own columns, whatever their names.

    Rows with the same id and text share their copies: as many each, and one more for the first ones. They are counted by task
    before they are put in order, so a row that is repeated very often is neither numbered nor copied by one task. Empty
    tables, null ids and null texts (never taken) need no care.
    """
    rows, doc_id, text_hash = common.keyed(docs)
    own = rows.columns
    picked = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.sum("copies").alias("n"))
    all_rows = mixed.groupBy(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash")).agg(F.count("*").alias("of"))
    picked = picked.join(all_rows, F.col("k_id").eqNullSafe(F.col("a_id")) & (F.col("k_hash") == F.col("a_hash"))).select("k_id", "k_hash", "n", "of")
    rows = rows.withColumn("m_id", doc_id).withColumn("m_hash", text_hash)
    mine = F.col("m_id").eqNullSafe(F.col("k_id")) & (F.col("m_hash") == F.col("k_hash"))
    single = rows.join(picked.where("of = 1"), mine).select(*own, "n")
    several = rows.join(picked.where("of > 1"), mine).withColumn("task", F.spark_partition_id())
    several = several.groupBy(*own, "k_id", "k_hash", "n", "of", "task").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("k_id", "k_hash").orderBy("task", F.xxhash64(*own)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("n") % F.col("of") - before, F.lit(0)), F.col("rows"))
    several = several.withColumn("n", F.floor(F.col("n") / F.col("of")) * F.col("rows") + more).select(*own, "n")
    both = single.unionByName(several).where("n > 0")
    return both.select(*own, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).select(*own).toDF(*docs.columns)
