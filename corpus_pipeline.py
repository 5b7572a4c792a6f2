"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from byteloom.llm import common, decontaminate, mixing, ngramjoin, toxicity, wavelet
from byteloom.llm.queries import table, tokenizer


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose score is 0.3 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngramjoin.one_of_each(docs, ngramjoin.join(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, re-parameterised or not."""
    return decontaminate.clean_of(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.copies_of(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-ID shards and returns what they hold, per document."""
    return wavelet.read(wavelet.write(docs, common.run_dir(spark, "ids"), tokenizer("byte_bpe_50k.json"), 2))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token-ID output", token_ids),
]

#: Toxicity, the join's grouping and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.run_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"{folder}/{k}")
    return docs
