"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers (in digits or words), units after a number, and capitalised words
become the typed slots <num>, <unit>, <name>; other words are lower-cased and lose outer
punctuation. Function words (PLAIN) are never names. What another capitalised word is can't be told from
its place, so both sides are read three times: capitalised words are names inside a sentence only, are names
everywhere, or are literal everywhere. Windows of WINDOW template tokens are hashed. Windows of the documents are
hash-joined with those of the benchmark, so a question with other numbers or names still matches.
Matched windows on one diagonal (the same shift between document and item) are one occurrence; it is judged by the windows
of each reading and by all of them. It counts if, in one of these ways, its slots are consistent (one value of the item always stands against one value of the document, and
the reverse, per type) and its windows cover at least MIN_COVER tokens, or the whole item if it is shorter.

Windows with fewer than half literal tokens are too general to match by their template. They match by their
very words and numbers instead, unless they repeat one or two of them. An item of which the other windows cover less
than an occurrence needs is also taken as one window of its whole length, so a copy with other values is found
if it is whole. Before the join, documents'
windows are thinned by the set of benchmark hashes, if that is within MOST_BROADCAST; a larger
benchmark is joined without that step.

Defined cases: null and empty texts, on either side, match nothing; repeated documents and items
are matched each; documents are told apart by doc_id and text, so a null doc_id is an id like any other; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, MIN_COVER, MOST_BROADCAST = 8, 13, 2_000_000
#: What the windows of an occurrence are judged by: one reading of both sides (bits of `readings`), or all windows.
INSIDE, NAMES, LITERAL, ALL = 1, 2, 4, 7
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Units that become a slot after a number.
UNITS = frozenset(
    "% kg g mg lb lbs oz t km m cm mm mi ft in inch inches mile miles meter meters metre metres kilometers kilometres "
    "l ml liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents mph kph kmh hz khz mhz ghz w kw v a kb mb gb tb".split()
)
#: Numbers in words ("one" is a pronoun too often).
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
#: Words that are no names although they often start a sentence or a line.
PLAIN = frozenset(
    "a an the this that these those i you he she it we they me him her us them my your his its our their mine yours ours theirs who whom whose "
    "what which when where why how if then else and or nor but so yet because since while although though unless until after before as at by for from in into of off on "
    "onto out over per to under up upon with within without about above across against along among around below beneath beside between beyond down during except inside "
    "near outside through toward towards is are was were be been being am do does did done has have had having can could might must shall should will would not no yes "
    "there here now once each every all any both either neither some many much more most few several other another such one "
    "also however therefore thus hence only just let find calculate compute determine solve suppose assume given consider show prove explain describe write list name choose "
    "select answer question".split()
)
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_NUMBER_UNIT = re.compile(r"([$€£]?\d[\d.,]*)([a-z]{1,7})")
_END = re.compile(r"[.!?:;|][\"')\]]*$")


class Templates:
    """Canonical tokens of whole texts. What a word says by itself is remembered per worker, up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.ids, self.hash, self.flags, self.slot = most, {}, np.zeros(1024, np.uint64), np.zeros(1024, np.uint8), []

    #: Flags of a word.
    IS_NUM, IS_UNIT, IS_TITLE, ENDS, EMPTY = 1, 2, 4, 8, 16

    def _learn(self, new: set[str]) -> None:
        for w in new:
            core = _OUTER.sub("", w)
            flags = 0
            if _NUMBER.fullmatch(w.strip("()[]\"'!?;,.&*#$")) or _NUMBER.fullmatch(core) or ((m := _NUMBER_UNIT.fullmatch(core.lower())) and m[2] in UNITS) or core.lower() in NUMBER_WORDS:
                flags |= self.IS_NUM
            elif not core:
                flags |= self.EMPTY
            elif core.lower() in UNITS:
                flags |= self.IS_UNIT
            elif core[0].isupper() and core[1:].islower() and core.isalpha() and core.lower() not in PLAIN:
                flags |= self.IS_TITLE
            if _END.search(w):
                flags |= self.ENDS
            at = len(self.slot)
            if at == len(self.hash):
                self.hash, self.flags = np.resize(self.hash, 2 * at), np.resize(self.flags, 2 * at)
            self.ids[w], self.hash[at], self.flags[at] = at, xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "replace")), flags
            self.slot.append(core.lower())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Over all texts on end: hash of the word, by reading is-slot kind (0 literal, 1 num, 2 unit, 3 name), word number, index of the text."""
        lines = [[common.words(x) for x in t.split("\n")] for t in texts]
        flat = [w for t in lines for x in t for w in x]
        new = set(flat).difference(self.ids)
        if len(self.ids) + len(new) > self.most:
            self.ids, self.slot = {}, []
            new = set(flat)
        self._learn(new)
        ids = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [sum(map(len, t)) for t in lines])
        heads = np.zeros(len(ids) + 1, bool)
        heads[np.cumsum([0] + [len(x) for t in lines for x in t])] = True  # first words of lines
        flags = self.flags[ids]
        ends = (flags & self.ENDS) > 0
        starts = heads[: len(ids)] | np.concatenate([[True], ends[:-1]])[: len(ids)]
        keep = (flags & self.EMPTY) == 0  # loose punctuation is no token
        # a word after loose punctuation starts a sentence if that ends one: ENDS of the last word before it, kept or not
        ids, text, flags, starts = ids[keep], text[keep], flags[keep], starts[keep]
        is_num = (flags & self.IS_NUM) > 0
        kind = np.zeros(len(ids), np.uint8)
        kind[((flags & self.IS_UNIT) > 0) & np.concatenate([[False], is_num[:-1]])[: len(ids)]] = 2
        kind[is_num] = 1
        title = (flags & self.IS_TITLE) > 0
        kinds = {INSIDE: np.where(title & ~starts, np.uint8(3), kind), NAMES: np.where(title, np.uint8(3), kind), LITERAL: kind}
        return self.hash[ids], kinds, ids, text


_SLOT = np.array([0] + [xxhash.xxh3_64_intdigest(x.encode()) for x in (NUM, UNIT, NAME)], np.uint64)


def _worker() -> Templates:
    return common.kept("templates", Templates)


class Sums:
    """Hashes of windows of any length, from sums over the whole sequence: the values of common.windows()."""

    def __init__(self, h: np.ndarray):
        self.powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(h), x)), dtype=np.uint64) for x in (_BASE, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * inverse[: len(h)], dtype=np.uint64)])

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the windows of n tokens that start at `at`, salted by n."""
        return common.mix((self.sums[at + n] - self.sums[at]) * self.powers[at + n - 1]) ^ np.uint64(n)


_BASE = np.uint64(common._MIX)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Sets hashes of very words apart from those of templates.
_VERY = np.uint64(0xA24BAED4963EE407)


def _starts(text: np.ndarray, n: int) -> np.ndarray:
    """Where the windows of n tokens inside one text start."""
    return np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.empty(0, np.int64)


def _literals(kind: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Number of literal tokens of the windows of n tokens."""
    sums = np.concatenate([[0], np.cumsum(kind == 0)])
    return sums[at + n] - sums[at]


def _general(h: np.ndarray, kind: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which windows match by their very words: mostly slots, but of more than two different tokens."""
    at = at[_literals(kind, at, n) * 2 < n]
    return at[[len(set(h[p : p + n].tolist())) > 2 for p in at]] if len(at) else at


_SCHEMA = "h long, id long, text_hash long, n int, pos int, tokens int, readings int, slots array<string>"
_COLUMNS = ["h", "id", "text_hash", "n", "pos", "tokens", "readings", "slots"]


def benchmark_windows(items: DataFrame, window: int = WINDOW, cover: int = MIN_COVER) -> DataFrame:
    """h, id, n, pos, tokens, slots: the windows by which the benchmark's items are found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code, out = _worker(), []
            for item, t in zip(pdf["id"], pdf["text"]):
                h, kinds, ids, text = code([t])
                if not len(h):
                    continue
                n, found = min(window, len(h)), []
                at = _starts(text, n)
                for reading, kind in kinds.items():
                    template = Sums(np.where(kind == 0, h, _SLOT[kind]))
                    fit = at[_literals(kind, at, n) * 2 >= n]
                    found.append((reading, n, fit, template(fit, n)))
                    # names alone would be found everywhere
                    whole = reading != NAMES or (kind == 0).sum() * 2 >= min(n, len(h))
                    if whole and len(np.unique(fit[:, None] + np.arange(n))) < min(cover, len(h)):
                        found.append((reading, len(h), at[:1], template(at[:1], len(h))))
                if len(h) > n:
                    very = _general(h, kinds[LITERAL], at, n)
                    found.append((ALL, n, very, Sums(h)(very, n) ^ _VERY))
                rows = {}
                for reading, n, at, w in found:
                    for x, p in zip(w.view(np.int64).tolist(), at.tolist()):
                        kind, bits = kinds.get(reading, kinds[LITERAL]), rows.get((x, n, p), (0, None))
                        rows[x, n, p] = (bits[0] | reading, bits[1] or _slots(code, kind, ids, p, n))
                out += [(x, item, 0, n, p, len(h), bits, slots) for (x, n, p), (bits, slots) in rows.items()]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return items.mapInPandas(run, _SCHEMA)


def _slots(code: Templates, kind: np.ndarray, ids: np.ndarray, p: int, n: int) -> list[str]:
    return [f"{kind[k]}{code.slot[ids[k]]}" for k in range(p, p + n) if kind[k]]


def document_windows(docs: DataFrame, lengths: list[int], wanted: np.ndarray | None, window: int = WINDOW) -> DataFrame:
    """The windows of the documents, of all the given lengths; only those with a wanted hash, if such are given."""
    shared = docs.sparkSession.sparkContext.broadcast(None if wanted is None else np.sort(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = shared.value
        if keys is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(keys >> np.uint64(42)).astype(np.int64)] = True

        def sift(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if keys is None:
                return w, at
            hit = np.flatnonzero(sieve[(w >> np.uint64(42)).astype(np.int64)])
            found = np.searchsorted(keys, w[hit])
            hit = hit[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == w[hit])] if len(keys) else hit[:0]
            return w[hit], at[hit]

        for pdf in batches:
            for k in range(0, len(pdf), 512):
                code, part = _worker(), pdf.iloc[k : k + 512]
                h, kinds, ids, text = code(part["text"].tolist())
                first = np.searchsorted(text, np.arange(len(part)))
                count = np.diff(np.append(first, len(text)))
                out, template = [], {r: Sums(np.where(kind == 0, h, _SLOT[kind])) for r, kind in kinds.items()}
                inside, title = (np.concatenate([[0], np.cumsum(kinds[r] == 3)]) for r in (INSIDE, NAMES))
                for n in lengths:
                    at = _starts(text, n)
                    i, t = inside[at + n] - inside[at], title[at + n] - title[at]
                    found = []
                    for r, same in ((INSIDE, (i == t) * NAMES + (i == 0) * LITERAL), (NAMES, None), (LITERAL, None)):  # a window that two readings share is given once
                        if r == INSIDE:
                            w, p = sift(template[r](at, n), at)
                            found.append((kinds[r], w, p, INSIDE + same[np.searchsorted(at, p)]))
                        else:
                            own = at[i < t] if r == NAMES else at[i > 0]
                            w, p = sift(template[r](own, n), own)
                            found.append((kinds[r], w, p, np.full(len(p), r)))
                    if n == window:
                        very = _general(h, kinds[LITERAL], at, n)
                        w, p = sift(Sums(h)(very, n) ^ _VERY, very)
                        found.append((kinds[LITERAL], w, p, np.full(len(p), ALL)))
                    for kind, w, at, bits in found:
                        t = text[at]
                        out += zip(w.view(np.int64), part["id"].astype("Int64").to_numpy(dtype=object)[t], part["text_hash"].to_numpy()[t], [n] * len(w), at - first[t], count[t], bits, (_slots(code, kind, ids, p, n) for p in at))
                yield pd.DataFrame(out, columns=_COLUMNS)

    return docs.mapInPandas(run, _SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = MIN_COVER) -> DataFrame:
    """doc_id, text_hash, item_id, windows, covered, item_tokens, changed_slots, occurrences of every contaminated (document, item)."""
    spark = docs.sparkSession
    texts = common.texts_of(docs).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    items = common.need(benchmark, item_id="long", text="string").select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    bench = common.stored(benchmark_windows(items, window, cover), spark)
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # at most `window` values, or lengths of items made mostly of slots
    number = bench.select("h").distinct().count()
    wanted = None
    if number <= MOST_BROADCAST:
        wanted = bench.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    found = document_windows(texts, lengths, wanted, window).alias("d").join(bench.alias("b"), (F.col("d.h") == F.col("b.h")) & (F.col("d.n") == F.col("b.n")))
    found = found.select(
        F.col("d.id").alias("doc_id"), "d.text_hash", F.col("b.id").alias("item_id"), (F.col("d.pos") - F.col("b.pos")).alias("shift"), F.col("b.tokens").alias("item_tokens"),
        F.filter(F.array(*[F.when(F.col("d.readings").bitwiseAND(F.col("b.readings")).bitwiseAND(F.lit(r)) > 0, r) for r in (INSIDE, NAMES, LITERAL)], F.lit(ALL)), lambda r: r.isNotNull()).alias("by"),
        F.struct("b.pos", "b.n").alias("place"), F.sequence("b.pos", F.col("b.pos") + F.col("b.n") - 1).alias("covers"), F.arrays_zip(F.col("b.slots").alias("item"), F.col("d.slots").alias("doc")).alias("pairs"),
    )
    # an occurrence has at most three times as many windows as the item
    key = ["doc_id", "text_hash", "item_id", "shift", "item_tokens"]
    each = found.withColumn("by", F.explode("by")).groupBy(*key, "by").agg(
        F.size(F.collect_set("place")).alias("windows"), F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    n = F.size("pairs")
    consistent = (n == F.size(F.array_distinct(F.col("pairs.item")))) & (n == F.size(F.array_distinct(F.col("pairs.doc"))))
    each = each.where(consistent & (F.col("covered") >= F.least(F.lit(cover), F.col("item_tokens"))))
    each = each.withColumn("changed", F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])))
    # of the ways that count, the one that covers most, with the fewest changes
    each = each.groupBy(*key).agg(F.max(F.struct("covered", (-F.col("changed")).alias("same"), "windows")).alias("best"))
    each = each.select(*key, "best.covered", (-F.col("best.same")).alias("changed"), "best.windows")
    return each.groupBy("doc_id", "text_hash", "item_id").agg(
        F.sum("windows").alias("windows"), F.max("covered").cast("long").alias("covered"), F.max("item_tokens").cast("long").alias("item_tokens"),
        F.min("changed").cast("long").alias("changed_slots"), F.count("*").alias("occurrences"),
    )


def clean_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which nothing was found, with their own columns, whatever their names.

    Repeated rows and null ids and texts are judged like any other; an empty table stays empty.
    """
    rows, doc_id, text_hash = common.keyed(docs)
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return rows.join(bad, (text_hash == F.col("bad_hash")) & doc_id.eqNullSafe(F.col("bad_id")), "left_anti").toDF(*docs.columns)
