"""Language-model scoring by a probabilistic suffix tree over words.

States are contexts of 0 to DEPTH words (DEPTH is a parameter). The tree grows from its root: a context of d words
is looked at if the one of its last d - 1 words is a state. It becomes a state if it occurs at least MIN_COUNT times in
training and passes a divergence test against that suffix: the leave-one-out log-likelihood that its own
next-word distribution gains over the suffix's must exceed MIN_GAIN nats (an
estimate of count times divergence that a sparse context cannot pass by chance). A state's distribution is
smoothed by its suffix's, P(w|s) = (c(s,w) + ALPHA * P(w|suffix)) / (c(s) + ALPHA), down to the
root, (c(w) + 0.5) / (N + 0.5 * (V + 1)), which also holds the unknown word. Each word of a text is
scored by its longest state. A text begins in a start context and ends in an end token.

How it is distributed: one scan cuts the documents into chunks of about CHUNK_TOKENS tokens, stored as
compressed arrays in the shared folder. What a chunk needs to know about the corpus is asked for and answered in
rounds: counts of its words; then for each depth the counts of its contexts with their next words, and
whether its contexts pass the test. In a round each chunk sends, per distinct key, one partial sum; keys are dealt by
hash into ranges of bounded size (their number grows with the corpus), summed over chunks, and the
totals go back to just the chunks that asked. What a chunk has learned is stored beside it, so no answer moves twice. What is
known already is not asked: a longer n-gram occurs no more often than a shorter one, and what always follows a context
always follows a longer one. So a frequent word or n-gram costs one
entry a chunk, nothing grows with a group, and no model is broadcast or collected: it stays spread over the chunks.

Keys of n-grams are hashes of log2(training tokens) + KEY_SPARE bits, 40 to 64, so the chance that one is shared by
another n-gram is alike at every size (2 ** -KEY_SPARE).

Defined cases: null text is the empty text (one end token); a null doc_id hashes as ''; repeated rows are
documents each; with no training rows every word is unknown and the root is uniform over one word;
very long texts make a long chunk; equal gains on the threshold are no states; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, MIN_COUNT, MIN_GAIN, ALPHA = 4, 2, 2.0, 2.0
#: Tokens of a chunk; tokens of the corpus for each hash range; chunks a task may work through; spare bits of keys.
CHUNK_TOKENS, RANGE_TOKENS, TASK_CHUNKS, KEY_SPARE = 2_000_000, 4_000_000, 8, 20
#: Gains are counted in parts of a nat.
NAT = 4096
HELD_OUT_BY, HELD_OUT = 5, 1
_END, _START = (np.uint64(xxhash.xxh3_64_intdigest(x, seed=1)) for x in (b"end", b"start"))
_NEXT, _TEST = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_UNKNOWN = np.iinfo(np.int64).max
WORDS, COUNTS, GAINS = "words", "counts", "gains"


def rounds(depth: int) -> list[tuple[str, int]]:
    """What is asked, in order."""
    return [(WORDS, 0)] + [(what, d) for d in range(1, depth + 1) for what in (COUNTS, GAINS)]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, bytes of equal weight together, which is what a general compressor needs."""
    if x.dtype.kind in "iub":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(chr(raw[0]))
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and of each key which it is. Where a key and its place fit one number, those are sorted."""
    low = np.uint64(len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + int(low) <= 64:
        keys = np.sort(keys << low | np.arange(len(keys), dtype=np.uint64))
        order, keys = (keys & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), keys >> low
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return keys[new], of


def _gain(joint: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What leaving out the place itself shows that the longer context adds, in whole parts of a nat: their sums are exact in any order."""
    return np.rint(np.log((np.maximum(joint - 1, 0) + ALPHA * p) / (np.maximum(c - 1, 0) + ALPHA) / p) * NAT)


def _store(path: str, *arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, *[np.frombuffer(_pack(x), np.uint8) for x in arrays])
    common.store_file(path, out.getvalue())


def _load(path: str) -> list[np.ndarray]:
    with np.load(io.BytesIO(common.load_file(path))) as x:
        return [_unpack(x[f"arr_{k}"].tobytes()) for k in range(len(x.files))]


class Chunk:
    """Documents as local word numbers, and what the rounds tell about their places.

    `at`: the places whose longest state so far is as deep as the last finished depth; `joint`: how often that context
    is followed by the place's word; `p`: the probability so far of each place's word. `bound`: at most how often the n-gram
    that ends at a place and is one word longer than the depth occurs (exactly so where `exact`).
    """

    def __init__(self, path: str, n: int, v: int):
        self.path, self.n, self.v = path, n, v
        self.hashes, tokens, self.lengths, doc_ids, known, held = _load(f"{path}/texts")
        self.doc_ids, self.known, held = doc_ids.astype(np.uint64).view(np.int64), known.astype(bool), held.astype(bool)
        self.tokens, self.lengths = tokens.astype(np.int32), self.lengths.astype(np.int64)
        self.held, k = held, len(self.hashes)
        self.full = np.concatenate([self.hashes, [_END, _START]]).astype(np.uint64)
        self.start = k + 1
        self.first = (np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        self.place = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.first, self.lengths).astype(np.int32)
        self.train = np.repeat(~held, self.lengths)
        self.bits = min(64, max(40, int(n).bit_length() + KEY_SPARE))

    # -- keys ------------------------------------------------------------------------------------

    def _words_back(self, at: np.ndarray, j: int) -> np.ndarray:
        return np.where(self.place[at] >= j, self.tokens[at - j], self.start)

    def _contexts(self, at: np.ndarray, depth: int) -> np.ndarray:
        h = np.full(len(at), depth, np.uint64)
        for j in range(1, depth + 1):
            h = common.mix(h * common._MIX + self.full[self._words_back(at, j)])
        return h

    def _keys(self, what: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of every asked place, and the places."""
        if what == WORDS:
            return self.full, np.empty(0, np.int64)
        if what == GAINS:
            return common.mix(self._contexts(self.at, depth) ^ _TEST) >> np.uint64(64 - self.bits), self.at
        of_next, of_context = self.at[self.wanted], self.at[~self.sure]
        follow = common.mix(self._contexts(of_next, depth) * _NEXT + self.full[self.tokens[of_next]])
        keys = np.concatenate([follow, common.mix(self._contexts(of_context, depth) ^ _NEXT)]) >> np.uint64(64 - self.bits)
        return keys, np.concatenate([of_next, of_context])

    def ask(self, what: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and this chunk's partial sums."""
        keys, at = self._keys(what, depth)
        if what == WORDS:
            values = np.bincount(self.tokens[self.train], minlength=len(keys))
            values[self.start] = (~self.held).sum()
            order = np.argsort(keys)
            return keys[order], values[order]
        distinct, of = _distinct(keys)
        mine = self.train[at]
        if what == COUNTS:
            return distinct, np.bincount(of[mine], minlength=len(distinct))
        joint, c, p = (x[mine] for x in (self.joint, self.c, self.p[at]))
        gain = np.bincount(of[mine], _gain(joint, c, p), minlength=len(distinct)).astype(np.int64)
        return distinct, (gain << 1 ^ gain >> 63).view(np.uint64)  # signs in the lowest bit: small numbers stay small

    # -- what is learned -------------------------------------------------------------------------

    def answered(self, what: str, depth: int, totals: np.ndarray) -> np.ndarray:
        """The totals, asked in the order of `ask`, per asked place."""
        keys, _ = self._keys(what, depth)
        if what == WORDS:
            out = np.empty(len(keys), np.int64)
            out[np.argsort(keys)] = totals
            return out
        return totals[_distinct(keys)[1]]

    def learn(self, what: str, depth: int, told: np.ndarray) -> None:
        """Takes in what a round told about the asked places."""
        if what == WORDS:
            self.uni = told.astype(np.int64)
            self.p = (self.uni[self.tokens] + 0.5) / (self.n + 0.5 * (self.v + 1))
            self.root = self.p.copy()
            self.at, self.joint = np.arange(len(self.tokens)), self.uni[self.tokens]
            self.bound = self.joint.copy()
        elif what == COUNTS:
            k = int(self.wanted.sum())
            self.joint[self.wanted], self.c[~self.sure] = told[:k], told[k:]
            self.joint[self.fixed] = self.c[self.fixed]
            self.bound[self.at], self.exact = self.joint, np.zeros(len(self.tokens), bool)
            self.exact[self.at] = True
            self._only(self.c >= MIN_COUNT)
            # a context with one next word: its gain is plain here, and if it is too small nobody needs to ask
            alone = self.joint == self.c
            self._only(~alone | (_gain(self.joint, self.c, self.p[self.at]) * self.c > MIN_GAIN * NAT))
        else:
            self._only(told.astype(bool))
            self.p[self.at] = (self.joint + ALPHA * self.p[self.at]) / (self.c + ALPHA)
        if what != COUNTS:
            self._look(depth + 1)

    def _only(self, use: np.ndarray) -> None:
        self.at, self.joint, self.c = self.at[use], self.joint[use], self.c[use]

    def _look(self, depth: int) -> None:
        """The places that have a context of this depth, how often it occurs, and what is to be asked."""
        here = self.place[self.at] >= depth - 1
        fixed = (self.joint == self.c if depth > 1 else np.zeros(len(self.at), bool))[here]
        self.at, self.joint = self.at[here], self.joint[here]
        if depth == 1:
            self.c, self.sure = self.uni[self._words_back(self.at, 1)], np.ones(len(self.at), bool)
        else:
            self.c, self.sure = self.bound[self.at - 1], self.exact[self.at - 1]
        self.bound[self.at] = np.minimum(self.bound[self.at], self.c)
        use = self.c >= MIN_COUNT
        self.sure, self.fixed = self.sure[use], fixed[use]
        self._only(use)
        # as after the shorter context if that is never, or here alone; always, if always after the shorter context
        self.wanted = ~self.fixed & ((self.joint > 1) | ((self.joint == 1) & ~self.train[self.at]))
        self.joint = self.joint.copy()


_ASK = "r int, chunk string, n long, keys binary, sums binary"
_TOLD = "chunk string, r int, n long, totals binary"


def _asked(chunk: str, keys: np.ndarray, sums: np.ndarray, bits: int, ranges: int) -> pd.DataFrame:
    """One row for each hash range in which the chunk has keys."""
    top = keys >> np.uint64(bits - 32)  # keys have 40 bits at least
    r = (top * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    rows = [(int(r[a]), chunk, b - a, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(sums[a:b])) for a, b in zip(begin, np.append(begin[1:], len(r)))]
    return pd.DataFrame(rows, columns=["r", "chunk", "n", "keys", "sums"])


def _totals(what: str):
    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        """Totals over all chunks for every key of a range, in the order of each asking; chunk '' holds distinct words and all tokens."""
        pdf = pdf.sort_values("chunk", kind="stable")
        keys = np.concatenate([np.cumsum(_unpack(k), dtype=np.uint64) for k in pdf["keys"]])
        distinct, of = _distinct(keys)
        sums = np.concatenate([_unpack(v).astype(np.int64) for v in pdf["sums"]])
        sums = np.bincount(of, sums >> 1 ^ -(sums & 1) if what == GAINS else sums, minlength=len(distinct))  # doubles: exact to 2 ** 53
        word = (sums > 0) & (distinct != _START)
        told = (sums > MIN_GAIN * NAT if what == GAINS else sums.astype(np.int64))[of]
        r, at = int(pdf["r"].iloc[0]), 0
        rows = [("", r, 0, _pack(np.array([word.sum(), sums[word].sum()]).astype(np.int64)))] if what == WORDS else []
        for chunk, n in zip(pdf["chunk"], pdf["n"]):
            rows.append((chunk, r, n, _pack(told[at : at + n])))
            at += n
        return pd.DataFrame(rows, columns=["chunk", "r", "n", "totals"])

    return total


def _numbering() -> defaultdict[str, int]:
    """Word -> number, in the order in which they are asked for first."""
    return defaultdict(count().__next__)


def _cut(folder: str):
    """Documents to chunks: a row of (chunk, tokens) for each that is stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), 0
        ids = _numbering()
        tokens, lengths, doc_ids, held, size = [], [], [], [], 0

        def close() -> pd.DataFrame:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in ids), np.uint64, len(ids))
            flat = np.concatenate(tokens)
            flat[flat < 0] = len(ids)  # the end token
            known = np.array([not pd.isna(d) for d in doc_ids], bool)
            numbers = np.array([int(d) if k else 0 for d, k in zip(doc_ids, known)], np.int64)
            name = f"{task:06d}-{seq:05d}"
            _store(f"{folder}/chunks/{name}/texts", hashes, flat, np.array(lengths), numbers.view(np.uint64), known, np.array(held, bool))
            return pd.DataFrame({"chunk": [name], "tokens": [size]})

        for pdf in batches:
            for doc_id, text, out in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["held"]):
                ws = common.words(common.lower_ascii(text))
                tokens.append(np.fromiter(map(ids.__getitem__, ws), np.int32, len(ws)))
                tokens.append(np.array([-1], np.int32))
                lengths.append(len(ws) + 1)
                doc_ids.append(doc_id)
                held.append(out)
                size += len(ws) + 1
                if size >= CHUNK_TOKENS:
                    yield close()
                    ids, tokens, lengths, doc_ids, held, size, seq = _numbering(), [], [], [], [], 0, seq + 1
        if lengths:
            yield close()

    return run


def score(docs: DataFrame, held_out_by: int = HELD_OUT_BY, held_out: int = HELD_OUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, states (places scored by a context of a word or more) of each document."""
    spark = docs.sparkSession
    folder = common.run_dir(spark, "pst")
    rows = common.texts_of(docs).withColumn("held", common.fold(F.col("doc_id"), held_out_by) == held_out)
    chunks = common.written(rows.mapInPandas(_cut(folder), "chunk string, tokens long"), f"{folder}/index")
    number, size = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # both grow with the corpus; a group is a range or a chunk, so it is of bounded size
    ranges, tasks = max(common.parallelism(spark), -(-size // RANGE_TOKENS)), max(common.parallelism(spark), -(-number // TASK_CHUNKS))
    every = chunks.select("chunk", F.lit(-1).alias("r"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("totals"))
    plan, n, v = rounds(depth), 0, 0

    def per_chunk(told: DataFrame, run, schema: str) -> DataFrame:
        """One call a chunk, with the answers of the last round."""
        return told.unionByName(every).repartition(tasks, "chunk").groupBy("chunk").applyInPandas(run, schema)

    def learned(pdf: pd.DataFrame, done: int) -> tuple[str, Chunk]:
        """A chunk after `done` rounds: the last one's answers are stored beside it, those before are read from there."""
        name = pdf["chunk"].iloc[0]
        chunk = Chunk(f"{folder}/chunks/{name}", n, v)
        for k, (what, d) in enumerate(plan[:done]):
            if k + 1 < done:
                (told,) = _load(f"{chunk.path}/{k}")
            else:
                told = [_unpack(x) for x in pdf.sort_values("r")["totals"] if x]
                told = chunk.answered(what, d, np.concatenate(told) if told else np.empty(0, np.int64))
                _store(f"{chunk.path}/{k}", told)
            chunk.learn(what, d, told)
        return name, chunk

    def asking(done: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            name, chunk = learned(pdf, done)
            return _asked(name, *chunk.ask(*plan[done]), 64 if not done else chunk.bits, ranges)

        return run

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        _, c = learned(pdf, done)
        add = lambda x: np.add.reduceat(x, c.first)  # noqa: E731  every document has an end token
        out = pd.DataFrame({
            "doc_id": pd.array(c.doc_ids, dtype="Int64"), "held_out": c.held, "n_tokens": c.lengths, "n_known": add((c.uni[c.tokens] > 0).astype(np.int64)), "train_tokens": int(n),
            "base_score": add(np.log10(c.root)), "score": add(np.log10(c.p)), "states": add((c.p != c.root).astype(np.int64)),
        })
        out.loc[~c.known, "doc_id"] = pd.NA
        return out

    told, done = every.limit(0), 0
    for what, _ in plan if number else ():
        asked = per_chunk(told, asking(done), _ASK)
        told = common.written(asked.repartition(max(tasks, ranges // TASK_CHUNKS), "r").groupBy("r").applyInPandas(_totals(what), _TOLD), f"{folder}/answers{done}")
        if done:
            common.remove(f"{folder}/answers{done - 1}")  # stored beside the chunks by now
        done += 1
        if what == WORDS:
            v, n = (int(x) for x in np.sum([_unpack(r["totals"]).astype(np.int64) for r in told.where("chunk = ''").select("totals").toLocalIterator()], axis=0))  # two numbers per hash range
            told = told.where("chunk <> ''")
        if not told.limit(1).count():
            break  # no context is this deep
    return per_chunk(told, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, states long")
