"""The base relations: documents as bytes, blocks of them, single bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import byte_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): texts as UTF-8; null is empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))


FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, data) of whole files under a folder; doc_id is the file's path. A file is one row; Spark passes over empty files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (read.option("pathGlobFilter", glob) if glob else read).load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("data"))


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, data) of the files that arrive in a folder, as a stream."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return read.load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("data"))


def blocks(data: DataFrame, block_size: int) -> DataFrame:
    """(doc_id, block_idx, off, data): values cut into blocks; an empty value has none."""
    last = F.greatest(F.ceil(F.octet_length("data") / block_size).cast("int") - 1, F.lit(0))
    cut = data.where(F.octet_length("data") > 0).select("doc_id", "data", F.explode(F.sequence(F.lit(0), last)).alias("block_idx"))
    off = F.col("block_idx").cast("long") * block_size
    return cut.select("doc_id", "block_idx", off.alias("off"), F.expr(f"substring(data, block_idx * {block_size} + 1, {block_size})").alias("data"))


def bytes_of(data: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, b): one row per byte."""
    return data.select(*keys, F.posexplode(byte_values(F.col("data"))).alias("pos", "b"))


def detected(data: DataFrame) -> DataFrame:
    """(doc_id, format): by the first bytes - the container's own magic, gzip's, or unknown."""
    magic = F.substring("data", 1, 2)
    kind = F.when(magic == F.lit(b"PZ"), "container").when(magic == F.lit(b"\x1f\x8b"), "gzip").otherwise("unknown")
    return data.select("doc_id", kind.alias("format"))
