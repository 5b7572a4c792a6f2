"""The container in both modes, malformed containers, the stream."""

import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from byteloom.operators import codecs
from byteloom.sources import container
from byteloom.sources.relations import blocks, detected
from byteloom.streaming import blocks as stream

FRAMES = [(3, zlib.crc32(b"abc"), b"xyz"), (1, zlib.crc32(b"q"), b"longer payload")]


@pytest.mark.parametrize("table", [False, True])
def test_pack_and_unpack(table):
    raw = container.pack(7, FRAMES, table)
    assert list(container.unpack(io.BytesIO(raw))) == [(k, 7, *f) for k, f in enumerate(FRAMES)]
    assert list(container.unpack(io.BytesIO(container.pack(7, [], table)))) == []
    for n in range(len(raw)):
        with pytest.raises(container.BadContainer):
            list(container.unpack(io.BytesIO(raw[:n])))
    for bad in (b"XX" + raw[2:], raw[:2] + b"\x09" + raw[3:], raw[:4] + b"\x63" + raw[5:]):
        with pytest.raises(container.BadContainer):
            list(container.unpack(io.BytesIO(bad)))


@pytest.mark.parametrize("mode", ["framed", "table"])
def test_data_source(spark, tmp_path, mode):
    container.register(spark)
    rng = random.Random(1)
    df = spark.createDataFrame([(k, bytearray(rng.randbytes(rng.randint(0, 300)))) for k in range(20)], "doc_id long, data binary")
    cut = blocks(df, 64)
    rows = codecs.encoded(cut, "deflate").select(F.col("block_idx").cast("int"), F.lit(128).alias("pipeline"), "original_len", "crc", "payload").coalesce(3)
    folder = f"file://{tmp_path}/c"
    rows.write.format("byteloom_container").mode("append").option("path", folder).option("mode", mode).save()
    back = codecs.decoded(spark.read.format("byteloom_container").load(folder), "deflate")
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted(bytes(r["data"]) for r in cut.collect())
    with pytest.raises(Exception, match="there already"):
        rows.write.format("byteloom_container").mode("append").option("path", folder).save()


def test_detected(spark):
    df = spark.createDataFrame([(1, bytearray(b"PZ\x02")), (2, bytearray(b"\x1f\x8b\x08")), (3, bytearray(b"")), (4, bytearray(b"P"))], "doc_id long, data binary")
    assert {r["doc_id"]: r["format"] for r in detected(df).collect()} == {1: "container", 2: "gzip", 3: "unknown", 4: "unknown"}


def test_stream(spark, tmp_path):
    rng, schema = random.Random(2), "doc_id long, text string"
    rows = [(k, "ab é" * rng.randint(0, 400)) for k in range(30)] + [(99, None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    coded = stream.coded(stream.read_values(spark, f"{tmp_path}/in", schema, 1), "bw", 256)
    stream.start(coded, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["doc_id"]: bytes(r["data"]).decode() for r in stream.restored(spark.read.parquet(f"{tmp_path}/out"), "bw").collect()}
    assert got == {k: t for k, t in rows if t}
    spark.createDataFrame([(500, "late")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.start(stream.coded(stream.read_values(spark, f"{tmp_path}/in", schema, 1), "bw", 256), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    again = stream.restored(spark.read.parquet(f"{tmp_path}/out"), "bw")
    assert again.count() == len(got) + 1
