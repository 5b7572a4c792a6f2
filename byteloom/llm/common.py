"""Shared helpers of the training-data operators: shared folder, words, hashing, group-wise batches."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: What str.split() also splits at, although it is not ASCII white space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words(text: str) -> list[str]:
    """The words of a text; str.split() where it gives the same."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z alone."""
    # of bytes, lower() knows A-Z alone, and no other letter's UTF-8 holds those bytes
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="byteloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for one run of an operator, in the shared folder."""
    return f"{shared_dir(spark)}/byteloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint."""
    shared_dir(spark)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fold(doc_id: Column, by: int) -> Column:
    """crc32 of an id's text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... and the new name of each: no name can clash, whatever dots or capitals it has."""
    new = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*new), {c.lower(): n for c, n in reversed(list(zip(df.columns, new)))} | dict(zip(df.columns, new))


def need(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast; other columns and clashing names stay out of the operator's way."""
    rows, name = numbered(df)
    return rows.select(*[F.col(name[c]).cast(kind).alias(c) for c, kind in kinds.items()])


def texts_of(docs: DataFrame, **more: str) -> DataFrame:
    """doc_id and text (null: empty) of documents, and other columns that are asked for."""
    return need(docs, doc_id="long", text="string", **more).withColumn("text", F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Documents with numbered columns, and expressions for their doc_id and the hash of their text, by which operators tell them apart."""
    rows, name = numbered(docs)
    return rows, F.col(name["doc_id"]).cast("long"), F.xxhash64(F.coalesce(F.col(name["text"]).cast("string"), F.lit("")))


_kept: dict[object, object] = {}


def kept(name: object, make):
    """What a Python worker remembers between tasks: of one operator at a time, so that stages don't add up their memories."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        if libc := ctypes.util.find_library("c"):
            trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)  # gives freed memory back to the machine
            if trim:
                trim(0)
        _kept[name] = make()
    return _kept[name]


class Lexicon:
    """word -> row of growing numpy columns. One per Python worker, so it is emptied at `most` words."""

    def __init__(self, most: int = 400_000):
        self.most, self.ids, self.values = most, {}, np.empty(1 << 12, np.uint64)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """64-bit hashes of the tokens."""
        ids = self.ids
        new = set(tokens).difference(ids)
        if new:
            if len(ids) + len(new) > self.most:
                ids.clear()
                new = set(tokens)
            while len(ids) + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            digest, at = xxhash.xxh3_64_intdigest, len(ids)
            for w in new:
                ids[w] = at
                self.values[at] = digest(w.encode("utf-8", "surrogatepass"))
                at += 1
        return self.values[np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values of h, in order (none if h is shorter)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MIX + h[k : len(h) - n + 1 + k]
    return mix(out)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups sorted batches so that the rows of a key are never split between two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        same = np.ones(len(pdf), bool)
        for k in keys:
            same &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        last = len(pdf) if same.all() else len(pdf) - int(np.argmin(same[::-1]))
        if same.all() and held and all(held[-1][k].iloc[-1] == pdf[k].iloc[-1] for k in keys):
            held.append(pdf)
            continue
        cut = 0 if same.all() else last
        if held or cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def store_file(path: str, data: bytes) -> None:
    """Writes a whole file in the shared folder from a task; a retried task replaces it by a rename."""
    fs, at = _fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def open_file(path: str):
    """A file in the shared folder, open for reading at any place."""
    fs, at = _fs(path)
    return fs.open_input_file(at)


def load_file(path: str) -> bytes:
    fs, at = _fs(path)
    with fs.open_input_stream(at) as src:
        return src.read()


def remove(path: str) -> None:
    """Removes a folder that an operator wrote in the shared folder and needs no more."""
    fs, at = _fs(path)
    fs.delete_dir(at)


def _fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
