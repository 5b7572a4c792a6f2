"""Block coding as a stateless stream: files in, coded blocks out, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import codecs
from ..sources.relations import blocks


def read_values(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """(doc_id, data) from a folder of Parquet files; files_per_trigger bounds what one trigger takes in."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))


def coded(values: DataFrame, pipeline: str, block_size: int) -> DataFrame:
    """Coded blocks of streamed values. Each block stands alone, so there is no state and no watermark."""
    rows = codecs.encoded(blocks(values, block_size), pipeline)
    return rows.select("doc_id", "block_idx", F.lit(codecs.PIPELINES[pipeline][0]).alias("pipeline"), "original_len", "crc", "payload")


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there and stops; the checkpoint makes a rerun go on where it left off."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restored(frames: DataFrame, pipeline: str) -> DataFrame:
    """(doc_id, data): values put together from their blocks in order."""
    rows = codecs.decoded(frames, pipeline).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "data"))).alias("parts"))
    return rows.select("doc_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"))
