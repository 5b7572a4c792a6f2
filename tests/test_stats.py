"""Statistics against direct computations on the synthetic vectors."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from byteloom.functions import bytes as fb
from byteloom.operators import codecs, lz, stats, transforms
from byteloom.sources.relations import blocks, file_stream, files

VECTORS = {
    "empty": b"", "single_byte": b"*", "two_bytes": b"\x00\xff", "zeros": bytes(500), "uniform": bytes(range(256)), "skewed": bytes(1 if i % 10 == 0 else 0 for i in range(1000)),
    "sawtooth": bytes(i % 256 for i in range(1024)), "runs": b"".join(bytes([i]) * max(256 - 4 * i, 1) for i in range(50)), "run_259": b"".join(bytes([i]) * 259 for i in range(4)),
    "descending": bytes(range(255, -1, -1)), "ab_repeat": b"ab" * 500, "window_boundary": bytes(4096) + b"\x01" * 100 + bytes(200), "banana": b"banana banana banana banana banana",
    "bimodal": b"\x05" * 300 + b"\xc8" * 300, "random": random.Random(7).randbytes(2000),
}


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in VECTORS.items()], "doc_id string, data binary").cache()


def rows(df, col):
    return {r["doc_id"]: r[col] for r in df.collect()}


def entropy(x):
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0


def correlation(x):
    if len(x) < 2:
        return 0.0
    a, b = x[:-1], x[1:]
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((i - ma) ** 2 for i in a), sum((i - mb) ** 2 for i in b)
    return sum((i - ma) * (j - mb) for i, j in zip(a, b)) / math.sqrt(va * vb) if va * vb > 1e-12 else 0.0


def run_share(x):
    share, k = 0, 0
    while k < len(x):
        j = k
        while j < len(x) and x[j] == x[k]:
            j += 1
        share += j - k if j - k >= 4 else 0
        k = j
    return share / len(x) if x else 0.0


def density(x):
    last, found = {}, 0
    for i in range(len(x) - 2):
        h = (x[i] << 10 ^ x[i + 1] << 5 ^ x[i + 2]) & 8191
        p = last.get(h)
        found += p is not None and i - p <= 4096 and x[p : p + 3] == x[i : i + 3]
        last[h] = i
    return found / (len(x) - 2) if len(x) > 2 else 0.0


def test_profile(data):
    got = {r["doc_id"]: r for r in stats.profile(data, 0).collect()}
    assert set(got) == set(VECTORS)
    for k, x in VECTORS.items():
        r = got[k]
        assert r["byte_entropy"] == pytest.approx(entropy(x), abs=1e-5)
        assert r["autocorrelation_lag1"] == pytest.approx(correlation(x), abs=1e-5)
        assert r["run_ratio"] == pytest.approx(run_share(x), abs=1e-5)
        assert r["match_density"] == pytest.approx(density(x), abs=1e-5)
        assert (r["distinct_bytes"], r["input_len"]) == (len(set(x)), len(x))
    assert got["zeros"]["distribution_shape"] == got["empty"]["distribution_shape"] == "Constant"
    assert (got["uniform"]["distribution_shape"], got["bimodal"]["distribution_shape"], got["skewed"]["distribution_shape"]) == ("Uniform", "Bimodal", "Skewed")


def test_single_statistics_agree_with_the_profile(data):
    whole = {r["doc_id"]: r for r in stats.profile(data, 0).collect()}
    for df, a, b in ((stats.entropy(data), "entropy", "byte_entropy"), (stats.autocorrelation(data), "autocorrelation_lag1", "autocorrelation_lag1"), (stats.run_ratio(data), "run_ratio", "run_ratio"), (stats.match_density(data), "match_density", "match_density")):
        assert rows(df, a) == {k: r[b] for k, r in whole.items()}


def test_sample_size_cuts(data):
    got = rows(stats.profile(data, 100), "input_len")
    assert got == {k: min(len(v), 100) for k, v in VECTORS.items()}


def test_rules(data):
    got = rows(stats.profile(data, 0).withColumn("p", stats.pipeline_rule()), "p")
    assert got["empty"] == "lzf" and got["zeros"] == "bw" and got["runs"] == "bw"
    assert {r[0] for r in data.select(stats.chain_depth_rule(F.lit(5 << 20))).collect()} == {24}


@pytest.mark.parametrize("bits", [7, 12])
def test_normalised_counts(data, bits):
    got = {}
    for r in stats.normalised(stats.histogram(data), bits).collect():
        got.setdefault(r["doc_id"], {})[r["b"]] = (r["n"], r["f"])
    for k, x in VECTORS.items():
        if not x:
            continue
        counts, size = Counter(x), 1 << bits
        size = size if len(counts) == 1 else max(size, 1 << (len(counts) - 1).bit_length())
        order = sorted(counts, key=lambda b: (-counts[b], b))
        f = {b: max(counts[b] * size // len(x), 1) for b in order}
        diff, i = size - sum(f.values()), 0
        while diff:
            b = order[i % len(order)]
            if diff > 0 or f[b] > 1:
                f[b] += 1 if diff > 0 else -1
                diff -= 1 if diff > 0 else -1
            i += 1
        assert {b: v[1] for b, v in got[k].items()} == f


def test_rle(data):
    got = {r["doc_id"]: r for r in transforms.rle(data).collect()}
    sizes = rows(stats.rle_size(data), "rle_size")
    for k, x in VECTORS.items():
        assert bytes.fromhex(got[k]["encoded"]) == codecs.rle_encode(x) and sizes[k] == got[k]["size"] == len(codecs.rle_encode(x))
        assert codecs.rle_decode(codecs.rle_encode(x)) == x
    with pytest.raises(ValueError):
        codecs.rle_decode(b"aaaa")


def test_block_transforms(data):
    cut = blocks(data, 32)
    own = {(r["doc_id"], r["block_idx"]): bytes(r["data"]) for r in cut.collect()}
    assert {k: b"".join(own[k, i] for i in range(99) if (k, i) in own) for k in VECTORS} == VECTORS | {k: v[: 99 * 32] for k, v in VECTORS.items()}
    for r in transforms.bwt(cut).collect():
        x = own[r["doc_id"], r["block_idx"]]
        order = sorted(range(len(x)), key=lambda p: (x[p:] + x[:p], -p))
        assert bytes.fromhex(r["bwt"]) == bytes(x[p - 1] for p in order) and r["primary_index"] == order.index(0)
        assert codecs.bwt_encode(x) == order.index(0).to_bytes(4, "little") + bytes.fromhex(r["bwt"])
    for r in transforms.mtf(cut).collect():
        assert [int(v) for v in r["ranks"].split(",")] == list(codecs.mtf_encode(own[r["doc_id"], r["block_idx"]]))
    for r in transforms.lyndon(cut).collect():
        x = own[r["doc_id"], r["block_idx"]]
        starts = [int(v) for v in r["starts"].split(",")]
        factors = [x[a:b] for a, b in zip(starts, [*starts[1:], len(x)])]
        assert all(f < f[k:] for f in factors for k in range(1, len(f))) and all(a >= b for a, b in zip(factors, factors[1:]))


@pytest.mark.parametrize("name", list(codecs.PIPELINES))
def test_codecs_round_trip(data, name):
    back = codecs.decoded(codecs.encoded(data, name).drop("data"), name)
    assert {k: bytes(v) for k, v in rows(back, "data").items()} == VECTORS


def test_damaged_block_stops(data):
    bad = codecs.encoded(data, "stored").withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="checksum"):
        codecs.decoded(bad.drop("data"), "stored").collect()


def test_value_codes(spark):
    values = [1, 2, 3, 4, 5, 8, 9, 16, 17, 18, 257, 4097, 65535, 65536, 65537]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", fb.value_code(F.col("v")).alias("c"), fb.value_extra_bits(F.col("v")).alias("b"), fb.value_extra(F.col("v")).alias("e"), fb.least_profitable_length(F.col("v")).alias("l")).collect():
        v, c = r["v"], 0 if r["v"] == 1 else 1 if r["v"] == 2 else (r["v"] - 1).bit_length()
        assert (r["c"], r["b"]) == (c, max(c - 1, 0))
        assert v == (c + 1 if c < 2 else 1 + (1 << (c - 1)) + r["e"])
        assert r["l"] == 3 + min(r["b"] // 4, 4)


def test_huffman(data):
    got = {}
    for r in codecs.huffman(stats.histogram(data)).collect():
        got.setdefault(r["doc_id"], {})[r["b"]] = r["code"]
    for k, x in VECTORS.items():
        if x:
            codes = sorted(got[k].values())
            assert all(not b.startswith(a) for a, b in zip(codes, codes[1:]))
            bits = sum(len(got[k][b]) for b in x)
            assert entropy(x) * len(x) - 1e-6 <= bits <= (entropy(x) + 1) * len(x)


def test_gzip_facts(data):
    got = {r["doc_id"]: r for r in codecs.gzip_facts(codecs.encoded(data, "gzip")).collect()}
    import zlib

    assert {k: (r["method"], r["isize"], r["crc"]) for k, r in got.items()} == {k: (8, len(v), zlib.crc32(v)) for k, v in VECTORS.items()}


def test_lz_tokens(data):
    from byteloom.operators import lz

    cut = blocks(data, 128)
    own = {(r["doc_id"], r["block_idx"]): bytes(r["data"]) for r in cut.collect()}
    best = {}
    for r in transforms.sort_matches(cut).collect():
        best[r["doc_id"], r["block_idx"], r["pos"]] = (r["length"], r["offset"])
    for (k, b), x in own.items():
        for p in range(len(x)):
            same = [q for q in range(p) if x[q : q + 4] == x[p : p + 4] and p + 4 <= len(x)][-8:]
            lengths = [(next((n for n in range(len(x) - p + 1) if x[q : q + n] != x[p : p + n]), len(x) - p + 1) - 1, p - q) for q in same]
            assert best.get((k, b, p)) == (max(lengths) if lengths else None)
    for lazy in (True, False):
        back = {(r["doc_id"], r["block_idx"]): bytes(r["data"]) for r in lz.restored(lz.tokens(cut, lazy)).collect()}
        assert back == own
    with pytest.raises(ValueError):
        lz.unparse([(97, None, None), (None, 2, 3)])


def test_rans(data):
    from byteloom.operators import rans

    got = rans.round_trip(blocks(data, 256), stats.normalised(stats.histogram(data), 12)).collect()
    assert sum(r["length"] for r in got) == sum(map(len, VECTORS.values())) and all(r["same"] for r in got)
    import numpy as np

    f = np.zeros((1, 256), np.int64)
    f[0, :2] = 2048
    state, words = rans.encode([np.array([0, 1] * 50)], f, np.cumsum(f, axis=1) - f)
    with pytest.raises(ValueError):
        rans.decode(state, [w[:-1] for w in words], np.array([100]), f, np.cumsum(f, axis=1) - f)


def test_rows_with_equal_and_null_ids_are_values_of_their_own(spark):
    rows = [("a", bytearray(b"aaaa")), ("a", bytearray(b"bb")), (None, bytearray(b"c")), (None, None), ("a", bytearray(b"aaaa"))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "doc_id string, data binary, n int")
    assert sorted((r["doc_id"] or "", r["b"], r["n"]) for r in stats.histogram(df).collect()) == [("", 99, 1), ("a", 97, 4), ("a", 97, 4), ("a", 98, 2)]
    assert sorted((r["doc_id"] or "", r["input_len"]) for r in stats.profile(df).collect()) == [("", 0), ("", 1), ("a", 2), ("a", 4), ("a", 4)]
    assert stats.profile(df.limit(0)).count() == stats.histogram(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 100, 4096])
def test_statistics_do_not_depend_on_the_piece(monkeypatch, piece):
    whole = {k: stats._facts_of(v) for k, v in VECTORS.items()}
    monkeypatch.setattr(stats, "PIECE", piece)
    assert {k: stats._facts_of(v) for k, v in VECTORS.items()} == whole


def test_repeat_slots():
    def brute(offsets):
        a = [1, 1, 1]
        for x in offsets:
            if x in a:
                k = a.index(x)
                yield k
                a = [a[k], *a[:k], *a[k + 1 :]]
            else:
                yield -1
                a = [x, a[0], a[1]]

    rng = random.Random(1)
    rows = [[5, 5, 7, 1], [], [1, 1], *[[rng.choice([1, 2, 5, 7, 9]) for _ in range(300)] for _ in range(5)]]
    assert lz.repeat_slots(pd.Series(rows)).tolist() == [list(brute(r)) for r in rows]
    assert lz.repeat_slots(pd.Series([[5, 5, 7, 1, 9, 5]])).tolist() == [[-1, 0, -1, 2, -1, -1]]


def test_block_size_rule(spark):
    df = spark.createDataFrame([("bw", 262144), ("bbw", 262144), ("lzf", 262144), ("bw", 1000)], "p string, asked int")
    p, asked = F.col("p"), F.col("asked")
    got = df.select(stats.block_size_rule(p, asked).alias("a"), stats.block_size_rule(p, asked, device=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(524288, 524288), (524288, 524288), (262144, 131072), (1000, 1000)]


def test_files(spark, tmp_path):
    for k, v in VECTORS.items():
        (tmp_path / "in" / k[0]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / k[0] / f"{k}.bin").write_bytes(v)
    (tmp_path / "in" / "note.txt").write_text("no")
    got = files(spark, f"{tmp_path}/in", "*.bin")
    assert {r["doc_id"].rsplit("/", 1)[1][:-4]: bytes(r["data"]) for r in got.collect()} == {k: v for k, v in VECTORS.items() if v}
    query = file_stream(spark, f"{tmp_path}/in", 4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/out").where("doc_id like '%.bin'")
    assert {r["doc_id"].rsplit("/", 1)[1][:-4]: bytes(r["data"]) for r in back.collect()} == {k: v for k, v in VECTORS.items() if v}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_steps_shuffle_nothing(data):
    cut = blocks(data, 64)
    per_block = [transforms.top_matches(cut), transforms.sort_matches(cut), transforms.bwt(cut), transforms.suffix_array(cut), transforms.lyndon(cut), transforms.bijective_bwt(cut), transforms.mtf(cut)]
    for df in [*per_block, lz.rebuilt(lz.parsed(cut)), lz.tokens(cut), lz.repeated(data, 64), stats.match_hashes(data), codecs.coded_sizes(cut), codecs.huffman_rows(codecs.huffman_of(stats.facts(data)))]:
        assert "Exchange" not in plan(df)


def test_tokens_in_arrays_rebuild_their_blocks(data):
    got = lz.rebuilt(lz.parsed(blocks(data, 512))).collect()
    assert {(r["doc_id"], r["block_idx"]): bytes(r["back"]) for r in got} == {(k, b): v[b * 512 : b * 512 + 512] for k, v in VECTORS.items() for b in range(-(-len(v) // 512))}
    assert all((o > 0) == (x < 0) for r in got for x, o in zip(r["lit"], r["off"]))
    for r in lz.tokens(blocks(data, 512)).where("off is not null").groupBy("doc_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("seq", "off", "slot"))).alias("m")).collect():
        assert [m["slot"] for m in r["m"]] == lz.repeat_slots(pd.Series([[m["off"] for m in r["m"]]]))[0]


def test_matches_of_values_with_their_costs(data):
    own = {(r["doc_id"], r["block_idx"], r["pos"]): r for r in lz.repeated(data, 64).collect()}
    best = transforms.sort_matches(blocks(data, 64)).collect()
    assert {k: (r["offset"], r["length"]) for k, r in own.items()} == {(r["doc_id"], r["block_idx"], r["pos"]): (r["offset"], r["length"]) for r in best}
    costs = {(r["doc_id"], r["b"]): r["cost"] for r in stats.literal_costs(stats.histogram(data)).collect()}
    for (k, b, p), r in own.items():
        after = VECTORS[k][b * 64 : b * 64 + 64][p + r["length"] :]
        assert r["next_cost"] == (costs[k, after[0]] if after else None)


def test_block_transforms_of_large_blocks(spark):
    rng = random.Random(5)
    values = {"zeros": bytes(20_000), "ab": b"ab" * 9000, "abx": b"ab" * 9000 + b"x", "text": b" ".join(rng.choice([b"one", b"two", b"three", b"a longer phrase of words"]) for _ in range(3000)), "random": rng.randbytes(20_000)}
    cut = blocks(spark.createDataFrame([(k, bytearray(v)) for k, v in values.items()], "doc_id string, data binary"), 20_000).where("block_idx = 0")
    for r in transforms.bwt(cut).collect():
        assert codecs.bwt_decode(r["primary_index"].to_bytes(4, "little") + bytes.fromhex(r["bwt"])) == values[r["doc_id"]][:20_000]
    for r in transforms.suffix_array(cut.where("doc_id in ('text', 'random')")).collect():
        x, order = values[r["doc_id"]][:20_000], [int(v) for v in r["suffixes"].split(",")]
        assert sorted(order) == list(range(len(x))) and all(x[a:] < x[b:] for a, b in zip(order, order[1:]))
    for r in transforms.bijective_bwt(cut).collect():
        assert sum(map(int, r["lengths"].split(","))) == len(bytes.fromhex(r["bwt"])) == len(values[r["doc_id"]][:20_000])
    assert {r["doc_id"]: [int(v) for v in r["ranks"].split(",")] for r in transforms.mtf(cut).collect()} == {k: list(codecs.mtf_encode(v[:20_000])) for k, v in values.items()}


def test_pieces_are_bounded_in_bytes():
    import pyarrow as pa

    from byteloom.operators import pieces

    values = [bytes([k % 7]) * (k % 50) for k in range(400)] + [None, bytes(5000), b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values, pa.binary())], ["k", "data"])
    got = []
    for rows, raw, ends in pieces.pieces(iter([batch.slice(3), batch.slice(0, 0)]), most=1000):
        assert ends[-1] <= 1000 or len(rows) == 1
        got += zip(rows.column("k").to_pylist(), [raw[a:z].tobytes() for a, z in zip(ends, ends[1:])])
    assert got == [(k, v or b"") for k, v in enumerate(values)][3:]


def test_rans_of_whole_values(data):
    from byteloom.operators import rans

    got = rans.round_trip_of(data, 256)
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rans.round_trip(blocks(data, 256), stats.normalised(stats.histogram(data), 12)).collect()))
    assert got.where("not same").count() == 0
