"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its runs of SHINGLE lower-cased words (a shorter text is one run). Two documents are linked
if the Jaccard similarity of their sets is at least THRESHOLD.

1. Documents with equal sets become one class. The join works on classes.
2. Chosen paths: each run of the search starts from one min-hash token that it samples; classes that share
   the token share a bucket. A bucket of more than LEAF classes is split again: it samples one or (so that
   1 / THRESHOLD are drawn on average) two more tokens of the classes' min-hash signatures. A linked pair stays
   together with a chance of at least THRESHOLD for each token drawn. A part that keeps WHOLE of its bucket's classes is made of sets that
   are alike, so it isn't split again. The search is repeated in as many runs as the target
   recall needs. Buckets are split level by level, as joins and counts over all rows.
3. Small buckets are compared by brute force on signatures of SKETCH min-hashes, with an allowance that
   loses a tenth of the misses which the target recall leaves. A bucket that doesn't get small (near copies share nearly all their tokens) is cut into blocks
   of about SKETCH_BLOCK classes, and each pair of blocks is compared by itself. A bucket reports a
   spanning forest of its matches, not its pairs.
4. The forests' components are candidate groups. Inside a group every pair of classes is checked exactly on the
   full sets, again block against block. Each block pair reports each class's number of linked
   documents and a spanning forest of the exact links. Pairs are never emitted.
5. The exact links' components give the groups.

Result: one row per document: doc_id, class_id (the smallest doc_id of its group), links (other documents linked to it),
copies (documents with the same set), kept (true for one document of each group).

Defined cases: texts without words (null, empty, blank) have no set: no links, their own group, kept;
repeated rows are copies of each other, and only one of them is kept; a null doc_id comes first; other columns are ignored;
an empty table gives an empty result. Classes are told apart by a 64-bit hash of the set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9999
LEAF, SKETCH_BLOCK, BLOCK, BLOCK_SHINGLES, DEPTH, SKETCH, WHOLE = 256, 2048, 512, 300_000, 5, 64, 0.8
_ODD = (common.mix(np.arange(1, 4096, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


def _spread(threshold: float) -> list[float]:
    """Chances of 0, 1, ... SKETCH equal sketch values of a pair at the threshold."""
    return [math.comb(SKETCH, x) * threshold**x * (1 - threshold) ** (SKETCH - x) for x in range(SKETCH + 1)]


def least_equal(threshold: float, recall: float) -> int:
    """Equal sketch values that a likely link has; a tenth of the allowed misses at the threshold have fewer."""
    lost, x = 0.0, 0
    for x, p in enumerate(_spread(threshold)):
        lost += p
        if lost > (1 - recall) / 10:
            break
    return x


def runs_needed(threshold: float, recall: float, depth: int | None = None) -> int:
    """Runs after which a pair at the threshold has met with the wanted chance, in buckets split down to `depth` (DEPTH).

    All runs draw their splits from one sketch, so the chance is taken over the sketch's equal values, and pairs below the filter are missed."""
    two = 1 / threshold - 1  # chance of drawing two tokens
    least, chances = least_equal(threshold, recall), []
    for x, p in enumerate(_spread(threshold)):
        stay = 1.0
        for _ in range((depth or DEPTH) - 1):
            one = x / SKETCH * stay
            both = one / SKETCH + (1 - 1 / SKETCH) * (1 - (1 - one) ** 2)  # the two may be the same
            stay = (1 - two) * one + two * both
        chances.append((p, threshold * stay if x >= least else 0.0))
    runs = 1
    while sum(p * (1 - meet) ** runs for p, meet in chances) > 1 - recall:
        runs += 1
    return runs


def shingles(text: str, n: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    ws = common.words(text.lower())
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(common.windows(common.kept("shingles", common.Lexicon)(ws), min(n, len(ws))))


def signatures(rows: DataFrame, runs: int, n: int) -> DataFrame:
    """doc_id, text_hash, k, size, roots, sketch of (doc_id, text_hash, text); k is null for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = [shingles(t, n) for t in part["text"]]
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                flat = np.concatenate([sets[i] for i in some]) if len(some) else np.empty(0, np.uint64)
                starts = (np.cumsum(sizes[some]) - sizes[some]).astype(np.int64)
                low = np.empty((len(some), runs + SKETCH), np.uint64)
                for j in range(runs + SKETCH) if len(some) else ():
                    x = flat * _ODD[j]
                    low[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
                sketch = (common.mix(low[:, runs:]) >> np.uint64(48)).astype("<u2")
                k = pd.array([pd.NA] * len(part), dtype="Int64")
                roots, sketches = [None] * len(part), [None] * len(part)
                for r, i in enumerate(some):
                    k[i] = int(np.uint64(xxhash.xxh3_64_intdigest(sets[i].tobytes())).astype(np.int64))
                    roots[i], sketches[i] = low[r, :runs].view(np.int64).tolist(), sketch[r].tobytes()
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object), "text_hash": part["text_hash"].to_numpy(), "k": k, "size": sizes, "roots": roots, "sketch": sketches})

    return rows.mapInPandas(run, "doc_id long, text_hash long, k long, size long, roots array<long>, sketch binary")


def buckets(classes: DataFrame, threshold: float) -> DataFrame:
    """(k, node, n): the leaves of all runs, of at least two classes each."""
    spark = classes.sparkSession
    rows = classes.select("k", F.posexplode("roots").alias("run", "token")).select("k", F.xxhash64("run", "token").alias("node"), F.lit(None).cast("long").alias("was"))
    out = None
    for depth in range(1, DEPTH + 1):
        rows = rows.distinct() if depth > 1 else rows
        rows = common.stored(rows, spark)
        # counts are stored: the join then reads no aggregate, and adaptive execution can split a hot node's partition
        counts = common.stored(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), spark)
        sized = common.stored(rows.join(counts, "node").select("k", "node", "n", "was"), spark)
        leaf = F.lit(depth == DEPTH) | (F.col("n") <= LEAF) | F.coalesce(F.col("n") >= F.col("was") * WHOLE, F.lit(False))
        leaves = sized.where(leaf).select("k", "node", "n")
        out = leaves if out is None else out.unionByName(leaves)
        large = sized.where(~leaf)
        if depth == DEPTH or not large.limit(1).count():
            break
        draw = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH)).cast("int")
        second = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
        drawn = F.when(second, F.array(draw(1), draw(2))).otherwise(F.array(draw(1)))
        rows = large.join(classes.select("k", "sketch"), "k").withColumn("at", F.explode(drawn))
        rows = rows.select("k", F.xxhash64("node", "at", F.substring("sketch", F.col("at") * 2 + 1, F.lit(2))).alias("node"), F.col("n").alias("was"))
    return out


def in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Adds i, j, side: a row of a group of `blocks` blocks goes to each pair of blocks that holds its own."""
    own = F.pmod(F.xxhash64("k", F.lit(3)), blocks).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    rows = rows.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
    return rows.withColumn("side", F.when(F.col("_own") == F.col("i"), 0).otherwise(1)).drop("_own", "_other")


def forest(alike, n: int) -> list[tuple[int, int]]:
    """Edges that span the components of n items; alike(i, rest) tells which of rest match item i."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = alike(i, left)
            found, left = left[hit], left[~hit]
            edges += [(i, x) for x in found]
            queue += found.tolist()
    return edges


def candidates(leaves: DataFrame, classes: DataFrame, threshold: float, recall: float = TARGET_RECALL) -> DataFrame:
    """(a, b): spanning forests of the leaves' likely links."""
    least = least_equal(threshold, recall)
    rows = in_blocks(leaves.join(classes.select("k", "sketch"), "k"), F.ceil(F.col("n") / SKETCH_BLOCK))
    rows = rows.repartition(common.parallelism(leaves.sparkSession), "node", "i", "j").sortWithinPartitions("node", "i", "j", "k").select("node", "i", "j", "side", "k", "sketch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.whole_groups(batches, ["node", "i", "j"]):
            sk = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(-1, SKETCH)
            k = pdf["k"].to_numpy()
            new = np.ones(len(pdf), bool)
            for c in ("node", "i", "j"):
                v = pdf[c].to_numpy()
                new[1:] = v[1:] != v[:-1] if c == "node" else new[1:] | (v[1:] != v[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(pdf)))
            two = at[n == 2]
            match = (sk[two] == sk[two + 1]).sum(axis=1) >= least
            a, b = [k[two[match]]], [k[two[match] + 1]]
            for start, size in zip(at[n > 2], n[n > 2]):
                own = sk[start : start + size]
                edges = forest(lambda i, rest, own=own: (own[rest] == own[i]).sum(axis=1) >= least, size)
                if edges:
                    x, y = np.array(edges).T
                    a.append(k[start + x])
                    b.append(k[start + y])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    return rows.mapInPandas(run, "a long, b long").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    s = len(sets)
    item, of = np.concatenate(sets), np.repeat(np.arange(s), [len(x) for x in sets])
    order = np.argsort(item, kind="stable")
    item, of = item[order], of[order]
    new = np.ones(len(item), bool)
    new[1:] = item[1:] != item[:-1]
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(item)))
    each = np.repeat(df, df)
    out = np.zeros((s, s), np.float32)
    few = each <= 8  # rare shingles: their pairs one by one
    f_item, f_of = item[few], of[few]
    for step in range(1, 8):
        same = f_item[step:] == f_item[:-step] if len(f_item) > step else np.empty(0, bool)
        out += np.bincount(f_of[:-step][same] * s + f_of[step:][same], minlength=s * s).reshape(s, s) if same.any() else 0
    out += out.T
    c_of, column = of[~few], np.repeat(np.arange((df > 8).sum()), df[df > 8])  # common ones: a product of 0/1 matrices
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = (column >= start) & (column < start + 2048)
        m = np.zeros((s, 2048), np.float32)
        m[c_of[part], column[part] - start] = 1
        out += m @ m.T
    return out


def verified(texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """(kind, a, b) from (root, i, j, side, k, weight, text): kind 0: class a links to b documents more; kind 1: a and b are linked."""
    rows = texts.repartition(common.parallelism(texts.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "k").select("root", "i", "j", "side", "k", "weight", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in common.whole_groups(batches, ["root", "i", "j"]):
            out = []
            for (_, i, j), pdf in whole.groupby(["root", "i", "j"], sort=False):
                pdf = pdf.drop_duplicates("k")  # repeated rows of a class's first document
                if len(pdf) < 2:
                    continue
                sets = [shingles(t, n) for t in pdf["text"]]
                size, k, w, side = np.array([len(x) for x in sets]), pdf["k"].to_numpy(), pdf["weight"].to_numpy(), pdf["side"].to_numpy()
                if len(sets) == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    shared = np.array([[0, both], [both, 0]], np.float64)
                else:
                    shared = _overlaps(sets).astype(np.float64)
                link = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(link, False)
                if i != j:  # pairs inside a block belong to that block's own pair
                    link &= side[:, None] != side[None, :]
                more = link @ w
                out.append(pd.DataFrame({"kind": 0, "a": k[more > 0], "b": more[more > 0]}))
                edges = forest(lambda x, rest, link=link: link[x, rest], len(k))
                if edges:
                    x, y = np.array(edges).T
                    out.append(pd.DataFrame({"kind": 1, "a": k[x], "b": k[y]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(run, "kind int, a long, b long")


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, links, copies, kept, blank (without words) of each document."""
    spark = docs.sparkSession
    rows = common.texts_of(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = common.written(signatures(rows, runs_needed(threshold, recall), n), common.run_dir(spark, "signed"))
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = common.stored(
        signed.where("k is not null").groupBy("k").agg(first.alias("first"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")), spark
    )
    group = common.stored(components(candidates(buckets(classes, threshold), classes, threshold, recall)), spark)
    members = group.join(classes.select(F.col("k").alias("node"), "first", "weight", "size"), "node").withColumnRenamed("node", "k")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    members = members.join(sizes, "root").select("k", "root", "weight", "blocks", F.col("first.doc_id").alias("m_id"), F.col("first.text_hash").alias("m_hash"))
    one = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    found = rows.join(members, (one == F.coalesce(F.col("m_id"), F.lit(-(2**63)))) & (F.col("text_hash") == F.col("m_hash")) & F.col("doc_id").eqNullSafe(F.col("m_id")))
    found = found.select("k", "root", "weight", "blocks", "text")
    checked = common.written(verified(in_blocks(found, F.col("blocks")), threshold, n), common.run_dir(spark, "links"))
    more = checked.where("kind = 0").groupBy(F.col("a").alias("k")).agg(F.sum("b").alias("more"))
    linked = common.stored(components(checked.where("kind = 1").select("a", "b")), spark)
    tops = linked.join(classes.select(F.col("k").alias("node"), "first"), "node")
    tops = tops.join(tops.groupBy("root").agg(F.min("first").alias("top")), "root").select(F.col("node").alias("k"), "top")
    facts = classes.select("k", "weight", "first").join(more, "k", "left").join(tops, "k", "left")
    facts = facts.select("k", "weight", F.coalesce("top", "first").alias("top"), (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    facts = common.stored(facts, spark)  # so that adaptive execution can split a class of very many copies
    out = signed.select("doc_id", "text_hash", "k").join(facts, "k", "left")
    mine = F.struct("doc_id", "text_hash").eqNullSafe(F.col("top"))
    return out.select(
        "doc_id", "text_hash", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("weight", F.lit(1)).cast("long").alias("copies"), (F.col("k").isNull() | mine).alias("kept"), F.col("k").isNull().alias("blank"),
    )


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The documents of which one stays per group, with their own columns, whatever their names.

    Of rows with the same id and text one stays (the texts without words, which have no set, all stay); an empty table stays empty.
    """
    rows, doc_id, text_hash = common.keyed(docs)
    own = rows.columns
    keep = joined.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "copies", "blank").distinct()
    out = rows.withColumn("m_id", doc_id).withColumn("m_hash", text_hash)
    out = out.join(keep, F.col("m_id").eqNullSafe(F.col("k_id")) & (F.col("m_hash") == F.col("k_hash")))
    single = out.where("copies = 1 or blank")
    several = out.where("copies > 1 and not blank").dropDuplicates(["m_id", "m_hash"])  # equal rows: one of them
    return single.unionByName(several).select(*own).toDF(*docs.columns)
