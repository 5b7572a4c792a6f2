"""The pipeline on a small table, stage by stage, against brute force."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import VOCAB, shingle_set


WORDS = random.Random(3)
TEXTS = [" ".join(WORDS.choice(VOCAB) for _ in range(30)) for _ in range(7)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    item = "The quick brown fox jumps over 3 lazy dogs while Anna counts 12 stars in the wide night sky"
    rows, labels = [], []
    for k in range(300):
        toxic = k % 6 == 0
        t = text(40) + (" wretchling " + text(5) + " gronkhead " + text(5) if toxic else "")
        rows.append((k, t, "en", f"src{k % 3}", len(t)))
        labels.append((k, 1, int(toxic)))
    base = rows[1][1]
    rows += [(1000, base, "en", "src1", 1), (1001, base + " tail", "en", "src2", 1), (1002, text(20) + " " + item + " " + text(20), "en", None, 1), (1003, None, None, None, None), (1004, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    ids = [Counter(r["doc_id"] for r in x) for x in kept]
    assert set(ids[0]) == {r[0] for r in rows} - set(range(0, 300, 6))
    assert set(ids[0]) - set(ids[1]) == {1000, 1001} and len({shingle_set(r["text"]) for r in kept[1]}) == len(kept[1]) - 1
    assert set(ids[1]) - set(ids[2]) == {1002}
    assert set(ids[3]) <= set(ids[2]) and set(ids[3].values()) <= {1, 2}
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, d in zip(sorted(kept[4], key=lambda r: r["start"]), sorted(kept[3], key=lambda d: d["doc_id"])):
        ids_ = [*code.encode(d["text"], add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids_), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids_)))
        at += len(ids_)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


ODD_NAMES = ["_h", "_id", "_n", "_hash", "_blank", "_copy", "a.b", "DOC_ID", "n", "copies", "k", "c0", "kept"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_odd_columns_and_rows(spark, tmp_path, stage):
    """Extra columns of any name stay as they are, repeated rows and nulls are handled, empty tables stay empty."""
    rows = [(k, TEXTS[k % 7], "en", None if k % 5 == 0 else "s", 1, *[k * 100 + x for x in range(len(ODD_NAMES))]) for k in range(30)]
    rows += [rows[3]] * 4 + [(None, None, None, None, None, *[None] * len(ODD_NAMES))] * 2 + [(40, "", "en", "s", 0, *[7] * len(ODD_NAMES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in ODD_NAMES)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(k, 1, int(k == 2)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[6]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = corpus_pipeline.STAGES[stage][1]
    out, none = run(spark, docs, str(tmp_path)), run(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0
    got = Counter(map(tuple, out.collect()))
    if stage == 4:
        assert sum(got.values()) == len(rows) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        return
    want = Counter(rows)
    assert out.columns == docs.columns and none.columns == docs.columns and set(got) <= set(want)
    if stage == 0:
        assert all(got[r] in (0, n) for r, n in want.items())
    elif stage == 1:
        assert got == Counter({r: 1 for r in rows[:7]} | {rows[34]: 2, rows[36]: 1})
    elif stage == 2:
        assert got == Counter({r: n for r, n in want.items() if r[1] != TEXTS[6]})
    else:
        assert all(n <= 2 * want[r] for r, n in got.items())
