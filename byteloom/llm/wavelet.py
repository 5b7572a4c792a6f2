"""Token-ID output: texts encoded with a public tokenizer, written as one compressed wavelet matrix per shard.

A shard holds the ids of whole documents, in ascending doc_id order. For each bit of the
ids, from the highest, it has a bit-plane; after each plane the ids are stably parted by that
bit. A directory of ranks for every 512 bits gives rank in constant time, and planes are compressed in
pieces of 64 KB, so that tokens can be read, counted and located from the compressed file by reading the directories
and the pieces they are in (WaveletMatrix, shard_at).

Defined cases: null and empty texts give the end id alone; a null doc_id sorts first; repeated rows
are separate documents, ordered by text; very long texts make a larger shard, since a shard
holds whole documents; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAGIC = b"BWM2"
#: Bits of a block of the directory, and its bytes; bytes of a plane that are compressed together; pieces kept by a reader; positions looked up at once.
BLOCK, WIDTH, PIECE, KEPT, AT_ONCE = 512, 64, 1 << 16, 256, 4096
#: For each place in a block, a mask of the bits before it.
_BELOW = np.packbits(np.tri(BLOCK, BLOCK, -1, dtype=bool), axis=1)
#: Ids at which a shard is closed; words that a worker's memory of encodings holds; characters encoded at a time.
SHARD_IDS, REMEMBERED, CHUNK = 4_000_000, 1_000_000, 4_000_000


class WaveletMatrix:
    """Reads one shard, from its bytes or from an open file: of a plane, its directory of ranks and the pieces that hold the wanted bits."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, bytes) else source
        if self._read(0, 4) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", self._read(4, 4))
        self.head = json.loads(self._read(8, size))
        self.base = 8 + size
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._directories: dict[int, np.ndarray] = {}
        self._pieces: dict[tuple[int, int], np.ndarray] = {}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _part(self, name: str) -> bytes:
        return b"".join(zstandard.decompress(self._read(self.base + at, size)) for at, size in self.head["parts"][name])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, whether each is there (not null), ids per document."""
        ids = np.frombuffer(self._part("doc_ids"), "<i8")
        return ids, np.frombuffer(self._part("known"), bool), np.frombuffer(self._part("lengths"), "<i8")

    def _ranks(self, level: int) -> np.ndarray:
        """Ones of a bit-plane before each block of 512 bits, and in all."""
        if level not in self._directories:
            self._directories[level] = np.frombuffer(self._part(f"ranks{level}"), "<u4").astype(np.int64)
        return self._directories[level]

    def _piece(self, level: int, k: int) -> np.ndarray:
        """A piece of a bit-plane, a row for each block; the last ones used are kept, up to a bound."""
        if (level, k) not in self._pieces:
            if len(self._pieces) >= KEPT:
                self._pieces.clear()
            where = self.head["parts"][f"plane{level}"]
            raw = zstandard.decompress(self._read(self.base + where[k][0], where[k][1])) if k < len(where) else b""
            self._pieces[level, k] = np.frombuffer(raw + bytes(-len(raw) % WIDTH), np.uint8).reshape(-1, WIDTH)
        return self._pieces[level, k]

    def _blocks(self, level: int, block: np.ndarray) -> np.ndarray:
        """The bytes of the given blocks of a bit-plane, a row each (0 beyond its end)."""
        out, per = np.zeros((len(block), WIDTH), np.uint8), PIECE // WIDTH
        for k in np.unique(block // per).tolist():
            rows = self._piece(level, k)
            here = np.flatnonzero((block // per == k) & (block - k * per < len(rows)))
            out[here] = rows[block[here] - k * per]
        return out

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i // BLOCK
        return self._ranks(level)[block] + np.bitwise_count(self._blocks(level, block) & _BELOW[i % BLOCK]).sum(axis=1, dtype=np.int64)

    def access(self, positions) -> np.ndarray:
        """The ids at the given positions."""
        wanted = np.asarray(positions, np.int64)
        out = np.zeros(len(wanted), np.int64)
        for start in range(0, len(wanted), AT_ONCE):
            i, found = wanted[start : start + AT_ONCE], out[start : start + AT_ONCE]
            for level in range(self.bits):
                block, cell = i // BLOCK, i % BLOCK
                rows = self._blocks(level, block)
                bit = rows[np.arange(len(i)), cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1
                ones = self._ranks(level)[block] + np.bitwise_count(rows & _BELOW[cell]).sum(axis=1, dtype=np.int64)
                found[:] = found << 1 | bit
                i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return out

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([start, end], np.int64))
            if symbol >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                start, end = start - int(a), end - int(b)
        return start, end

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol occurs before position i."""
        start, end = self._range(symbol, 0, i)
        return end - start

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        start, end = self._range(symbol, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        return int(self._places(symbol, np.array([start + k], np.int64))[0])

    def _places(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Positions in the text of places below the last plane, where equal symbols are together."""
        for level in reversed(range(self.bits)):
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] * one, one)
        return at

    def _select(self, level: int, k: np.ndarray, bit: int) -> np.ndarray:
        ranks = self._ranks(level)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(before, k, "right") - 1
        cells = np.unpackbits(self._blocks(level, block), axis=1) == bit
        return block * BLOCK + (np.cumsum(cells, axis=1, dtype=np.int16) > (k - before[block])[:, None]).argmax(axis=1)

    def occurrences(self, symbol: int) -> np.ndarray:
        """The positions of a symbol, in order."""
        start, end = self._range(symbol, 0, self.n)
        parts = [self._places(symbol, np.arange(at, min(at + AT_ONCE, end))) for at in range(start, end, AT_ONCE)]
        return np.concatenate([np.empty(0, np.int64), *parts])

    def ids(self) -> np.ndarray:
        """All ids: the planes are merged from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        low = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(np.frombuffer(self._part(f"plane{level}"), np.uint8), count=self.n).view(bool)
            z, out = self.zeros[level], np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = low[:z]
            out[np.flatnonzero(bit)] = low[z:] | kind(1 << (self.bits - 1 - level))
            low = out
        return low


def pack(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """A shard file."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts, body, at, zeros = {}, [], 0, []

    def add(name: str, raw: bytes, piece: int | None = None) -> None:
        nonlocal at
        parts[name] = []
        for k in range(0, len(raw), piece or max(1, len(raw))):
            body.append(squeeze(raw[k : k + piece] if piece else raw))
            parts[name].append([at, len(body[-1])])
            at += len(body[-1])

    add("doc_ids", doc_ids.astype("<i8").tobytes())
    add("known", known.astype(bool).tobytes())
    add("lengths", lengths.astype("<i8").tobytes())
    cur = ids
    for level in range(bits):
        bit = (cur & cur.dtype.type(1 << (bits - 1 - level))).astype(bool)
        plane = np.packbits(bit)
        per_block = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), BLOCK // 8)) if len(plane) else np.empty(0, np.int64)
        add(f"plane{level}", plane.tobytes(), PIECE)
        add(f"ranks{level}", np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes())
        zero = cur[np.flatnonzero(~bit)]  # positions, for speed: masks of mixed bits are slower
        zeros.append(len(zero))
        cur = np.concatenate([zero, cur[np.flatnonzero(bit)]])
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "parts": parts}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


# -- encoding ----------------------------------------------------------------------------------

#: White space beside white space: there, a cut could differ from the whole text.
_RUNS_RE2 = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Letters, then maybe ASCII punctuation without an apostrophe (contractions are pre-tokens too).
_WORD_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """A `tokenizers` file's encoding of whole texts, with what it gave for each stretch between spaces remembered.

    Byte-level BPE first parts a text where a space precedes a word, and merges nothing across that, so a
    text's ids are those of its stretches (a stretch keeps the space before it); a lone line break is such a
    border too. Each distinct stretch is encoded once by the library. The memory is emptied when it is full. Keys: a
    string stands for itself with a space before it unless it begins with a line break, a tuple for its string alone.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        state = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_stretch = state.get("type") == "ByteLevel" and state.get("use_regex", True) and not state.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(1 << self.bits)])
        self.most, self.memory = most, {}

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone, many in one call: each is one pre-token, and only its first id begins with a space."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            (e,) = self.tokenizer.encode_batch_fast(["".join(" " + w for w in part)], add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            cut = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.kind.itemsize
            if len(cut) == len(part) + 1:
                raw, cut = ids.tobytes(), cut.tolist()
                self.memory.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])]))

    def _learn(self, words: list[str], others: list) -> None:
        """Encodes words and other stretches that are not remembered yet."""
        memory = self.memory
        self._learn_words(words)
        others += [x for x in words if x not in memory]
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            strings = [x[0] if isinstance(x, tuple) else x if x.startswith("\n") else " " + x for x in part]
            for key, e in zip(part, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)):
                memory[key] = array(self.kind.char, e.ids).tobytes()

    def _remember(self, rest: list[str], firsts: list[str]) -> None:
        """Brings stretches with white space before them, and the first ones of texts, into the memory."""
        memory = self.memory
        new, begin = [x for x in rest if x not in memory], {(x,) for x in firsts}
        if len(memory) + len(new) + len(begin) > self.most:
            memory.clear()
            new = rest
        # letters before plain punctuation are a pre-token of their own: such a stretch is the two parts' ids on end
        words, others, two = set(), [x for x in begin if x not in memory], []
        for x in new:
            m = _WORD_TAIL.fullmatch(x)
            if not m:
                others.append(x)
            elif m[2]:
                two.append((x, m[1], (m[2],)))
            else:
                words.add(x)
        words.update([w for _, w, _ in two if w not in memory])
        others += {t for _, _, t in two if t not in memory and t not in begin}
        self._learn(list(words), others)
        for x, word, tail in two:
            memory[x] = memory[word] + memory[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind."""
        try:
            whole = pa.array(texts, pa.large_string())
        except UnicodeEncodeError:  # lone surrogates
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            whole = pa.array(texts, pa.large_string())
        if not self.by_stretch:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if not texts:
            return []
        odd = pc.match_substring_regex(whole, _RUNS_RE2).to_numpy(zero_copy_only=False)
        by_rule = pa.array([_SAFE_CUT.split(texts[k]) for k in np.flatnonzero(odd)], pa.large_list(pa.large_string()))
        cut = pa.concat_arrays([pc.split_pattern(pc.replace_substring(whole.filter(pa.array(~odd)), "\n", " \n"), " ").cast(by_rule.type), by_rule])
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        begins = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        stretches = cut.flatten()
        coded, first = stretches.dictionary_encode(), stretches.take(pa.array(begins[:-1])).dictionary_encode()
        distinct, heads = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (coded, first))
        self._remember(distinct, heads)
        found = [self.memory[x] for x in distinct] + [self.memory[(x,)] for x in heads]
        code = coded.indices.to_numpy().astype(np.int64)
        code[begins[:-1]] = first.indices.to_numpy() + len(distinct)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), self.kind)
        n = size[code]
        ends = np.cumsum(n)
        ids = pool[np.repeat(start[code] - ends + n, n) + np.arange(ends[-1])]
        ends = np.concatenate([[0], ends])[begins]
        out: list[bytes] = [b""] * len(texts)
        for k, a, b in zip(order.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = ids[a:b].tobytes()
        return out


def spans_of(texts: list[str], most: int = CHUNK) -> Iterator[slice]:
    """Cuts a list of texts into runs of about `most` characters; a longer text is a run of its own."""
    begin = held = 0
    for k, t in enumerate(texts):
        if k > begin and held + len(t) > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += len(t)
    if texts:
        yield slice(begin, len(texts))


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return common.kept(("encoder", path), lambda: Encoder(path))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards; returns one row per shard: part, seq, path, documents, ids."""
    spark = docs.sparkSession
    rows = common.texts_of(docs)
    rows = rows.repartitionByRange(common.parallelism(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], code.kind).tobytes()
        bits = max(code.bits, int(end_id).bit_length())
        held: list[tuple[object, bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(x for _, x in held), code.kind)
            known = np.array([not pd.isna(d) for d, _ in held], bool)
            data = pack(ids, np.array([int(d) if k else 0 for (d, _), k in zip(held, known)], np.int64), known, np.array([len(x) // code.kind.itemsize for _, x in held], np.int64), bits)
            path = f"{folder}/shard-{part:06d}-{seq:06d}.bwm"
            common.store_file(path, data)
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "documents": [len(held)], "ids": [len(ids)]})

        for pdf in batches:
            texts = pdf["text"].tolist()
            for span in spans_of(texts):
                for doc_id, ids in zip(pdf["doc_id"].iloc[span], code(texts[span])):
                    held.append((doc_id, ids + end))
                    size += len(ids) // code.kind.itemsize + 1
                    if size >= shard_ids:
                        yield flush()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return common.written(rows.mapInPandas(shards, "part int, seq int, path string, documents long, ids long"), f"{folder}/index")


def shard_at(path: str) -> WaveletMatrix:
    """A shard file, open for reading parts of it."""
    return WaveletMatrix(common.open_file(path))


def read(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files that the index lists."""
    spark = index.sparkSession
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    # first sums over parts (as many rows as tasks wrote), then over the shards of each
    parts = index.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = index.join(parts, "part").select("path", (F.col("base") + F.coalesce(F.sum("ids").over(within), F.lit(0))).alias("offset"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, offset in zip(pdf["path"], pdf["offset"]):
                shard = WaveletMatrix(common.load_file(path))
                ids = shard.ids()
                # the parts that random access uses must agree with the whole
                at = np.linspace(0, len(ids) - 1, 8).astype(np.int64)
                if (shard.access(at) != ids[at]).any() or shard.count(int(ids[-1])) != (ids == ids[-1]).sum():
                    raise ValueError(f"damaged shard: {path}")
                doc_ids, known, lengths = shard.documents()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths)]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": offset + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)})
                out.loc[~known, "doc_id"] = pd.NA
                yield out

    return placed.repartition(common.parallelism(spark), "path").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
