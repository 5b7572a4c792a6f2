"""Toxicity scores by a subsequence string kernel with Nystroem landmarks and a linear SVM.

Fragments are a text's words without outer punctuation, lower-cased, and runs of single letters
written apart ("i d i o t", "i - d - i - o - t"); a mark stands for the start of each. A word with other characters inside is also read
without them ("i.d.i.o.t"). Two strings are compared by the gap-weighted subsequence kernel of order ORDER
(each shared subsequence counts DECAY to the power of the lengths it spans), normalised and squared; so a
landmark is also found with characters left out, put in, or set apart. Values under FLOOR are 0, in fitting and in scoring; a bound that
proves a value to be under it (Cauchy-Schwarz over the letters that both have) saves most of the work. A fragment's values at
the landmarks, times K^(-1/2) of the landmarks' own kernel matrix, are its Nystroem features. A sentence (up to a word that ends in
. ! or ?) has the highest margin of its fragments.

Fitting uses a bounded sample of labelled rows, in the order of a hash of doc_id: at most TOXIC_ROWS toxic and CLEAN_ROWS clean
ones. Landmarks are TELLING letter n-grams that tell the classes apart, chosen one after the other for the toxic documents that those before don't
explain (so a rare language or topic gets its own), CONTRAST strings of clean sentences that come nearest to them, and some
frequent words of clean texts. A squared-hinge SVM is trained by multiple-instance labels: the sentences of
clean documents are negative; a toxic document has at least one positive sentence, and its witnesses are
chosen anew after each round. Of each document at most WITNESSES sentences, those nearest to the landmarks, take part. Last, a logistic fit over
whole documents (highest margin, number and share of sentences above zero) turns margins into a probability, weighted to the labels' real frequencies.

Scoring needs no shuffle: a worker computes one margin per distinct fragment and remembers it, up to a bound,
while it reads every whole text.

Defined cases: null and empty texts have one empty sentence (score: that of no evidence); doc_ids labelled twice are toxic if
one label says so; null labels are left out; a null doc_id hashes as '' and is never labelled; without both
classes among the training rows every score is the share of toxic ones (0 if there is none); words of over FRAGMENT
characters are taken in overlapping windows, to their end; repeated rows are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
ORDER, DECAY, FRAGMENT, LONGEST, FLOOR = 3, 0.6, 13, 8, 0.15
TELLING, CONTRAST, COMMON_WORDS, CANDIDATES, WITNESSES, LEAST_Z = 32, 12, 4, 4000, 8, 4.0
FOLD_BY, HELD_OUT, CUT = 4, 2, 0.3
REMEMBERED = 500_000
START = "^"

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def readings(word: str) -> list[str]:
    """A word's strings of three letters and more: without outer punctuation, and without inner punctuation if it has some."""
    if word.isalnum():
        return [START + word] if len(word) > 2 else []
    core = _OUTER.sub("", word)
    bare = _INNER.sub("", core)
    return [START + x for x in dict.fromkeys((core, bare)) if len(x) > 2]


def sentences(text: str) -> list[list[str]]:
    """The fragments of each sentence; at least one sentence."""
    out, now, letters, ended = [], [], [], False

    def run() -> None:  # ends a run of letters
        if len(letters) > 2:
            now.append(START + "".join(letters))
        letters.clear()

    for w in common.words(text.lower()):
        core = w if w.isalnum() else _OUTER.sub("", w)
        if len(core) == 1:
            letters.append(core)
        elif core:
            run()
            now += readings(w)
        ended = w[-1] in ".!?" and len(core) != 1  # a dot after a single letter may be another separator
        if ended:
            run()
            out.append(now)
            now = []
    run()
    return out if ended else [*out, now]


def _codes(strings: list[str]) -> np.ndarray:
    """Code points, a row for each string, filled up with -1."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.full((len(strings), int(n.max())), -1, np.int32)
    codes[np.arange(codes.shape[1]) < n[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<i4")
    return codes


def _subsequences(x: np.ndarray, y: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of x[a] with y[a or 0, b], by the usual recursion, for all at once."""
    t, d = y.shape[2], np.float32(decay)
    shape = (len(x), y.shape[1])
    # tails[i, j]: weighted matches of i characters in the string so far and the first j of the other
    tails = np.zeros((order, t + 1, *shape), np.float32)
    tails[0] = 1
    same, total, run, part = np.empty((t, *shape), np.float32), np.zeros(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
    by_char = np.ascontiguousarray(np.moveaxis(y, 2, 0))
    for c in x.T:
        np.equal(np.where(c < 0, -2, c)[None, :, None], by_char, out=same, casting="unsafe")
        same *= d * d
        for j in range(t):
            total += np.multiply(same[j], tails[order - 1, j], out=part)
        for i in range(order - 1, 0, -1):
            run[:] = 0
            tails[i] *= d
            for j in range(t):
                run *= d
                run += np.multiply(same[j], tails[i - 1, j], out=part)
                tails[i, j + 1] += run
    return total


def kernel(strings: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Squared normalised kernel of every string with every landmark: 1 for equal strings, 0 for nothing shared."""
    if not strings or not marks:
        return np.zeros((len(strings), len(marks)), np.float32)
    x, y = _codes(strings), _codes(marks)
    own_x, own_y = _subsequences(x, x[:, None, :], order, decay)[:, 0], _subsequences(y, y[:, None, :], order, decay)[:, 0]
    scale = np.maximum(own_x, 1e-9)[:, None] * np.maximum(own_y, 1e-9)[None, :]
    return _subsequences(x, y[None], order, decay) ** 2 / scale


def windows(s: str) -> list[str]:
    """A fragment, or overlapping windows of a long one."""
    return [s] if len(s) <= FRAGMENT else [s[k : k + FRAGMENT] for k in range(0, len(s) - FRAGMENT // 2, FRAGMENT // 2)]


def _slots(codes: np.ndarray) -> np.ndarray:
    """The characters of each row as bits of 61; characters may share one, which only loosens a bound."""
    return np.bitwise_or.reduce(np.where(codes < 0, np.uint64(0), np.uint64(1) << (codes % 61).astype(np.uint64)), axis=1)


class Model:
    """Landmarks and what is fitted to them; small, and all that scoring needs."""

    def __init__(self, marks: list[str], merit: list[float], prior: float):
        self.landmarks, self.merit, self.prior = marks, np.array(merit), prior
        k = kernel(marks, marks).astype(np.float64)
        k = np.where(k < FLOOR, 0, (k + k.T) / 2)
        value, vector = np.linalg.eigh(k) if marks else (np.zeros(0), np.zeros((0, 0)))
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
        self.codes = _codes(marks) if marks else np.zeros((0, 1), np.int32)
        self.own = np.maximum(_subsequences(self.codes, self.codes[:, None, :], ORDER, DECAY)[:, 0], 1e-9) if marks else np.zeros(0)
        # eight slots at most; the start mark, and what is over, count as there
        self.chars = [sorted({ord(c) % 61 for c in z if c != START})[:8] for z in marks]
        self.bounds = [self._bounds(z, c) for z, c in zip(marks, self.chars)]
        self.weights, self.bias, self.logit = np.zeros(len(marks)), 0.0, np.zeros(4)
        self.fitted = False

    @staticmethod
    def _bounds(mark: str, chars: list[int]) -> np.ndarray:
        """By the set of the landmark's characters that a string has: at most its value, K(z restricted to them) / K(z)."""
        codes = np.repeat(_codes([mark]), 1 << len(chars), axis=0)
        for k, c in enumerate(mark):
            if c != START and ord(c) % 61 in chars:
                codes[np.arange(len(codes)) >> chars.index(ord(c) % 61) & 1 == 0, k] = -1
        own = _subsequences(codes, np.where(codes < 0, -3, codes)[:, None, :], ORDER, DECAY)[:, 0]
        return own / max(own[-1], 1e-9)

    def values(self, strings: list[str]) -> np.ndarray:
        """Kernel values of short strings at the landmarks, 0 if under FLOOR."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        if not strings:
            return out
        codes = _codes(strings)
        has, own = _slots(codes), np.empty(len(strings), np.float32)
        bit = {c: (has >> np.uint64(c) & np.uint64(1)).astype(np.uint8) for c in {c for x in self.chars for c in x}}
        near = np.empty((len(self.landmarks), len(strings)), bool)
        for k, (chars, bound) in enumerate(zip(self.chars, self.bounds)):
            shared = np.zeros(len(strings), np.uint8)
            for n, c in enumerate(chars):
                shared |= bit[c] << np.uint8(n)
            near[k] = (bound >= FLOOR * 0.999)[shared]
        size = (codes >= 0).sum(axis=1)
        order = np.argsort(size, kind="stable")  # like lengths together: less padding
        for k in range(0, len(order), 4096):
            a = order[k : k + 4096]
            x = codes[a, : size[a[-1]]]
            own[a] = _subsequences(x, x[:, None, :], ORDER, DECAY)[:, 0]
        i, j = np.nonzero(near[:, order].T)
        i = order[i]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            both = _subsequences(codes[a, : size[a[-1]]], self.codes[b][:, None, :], ORDER, DECAY)[:, 0]
            out[a, b] = both**2 / (np.maximum(own[a], 1e-9) * self.own[b])
        out[out < FLOOR] = 0
        return out

    def margins(self, strings: list[str]) -> list[float]:
        """SVM margins of fragments: of a long one, its highest window's."""
        if not strings:
            return []
        parts = [windows(s) for s in strings]
        m = self.values([x for p in parts for x in p]) @ (self.root @ self.weights) + self.bias
        return np.maximum.reduceat(m, np.cumsum([0] + [len(p) for p in parts[:-1]])).tolist()

    def features(self, margins: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per document: 1, highest margin of a sentence, number above zero, its share."""
        above = (margins > 0).astype(float)
        n, total = np.diff(np.append(starts, len(margins))), np.add.reduceat(above, starts)
        return np.stack([np.ones(len(starts)), np.clip(np.maximum.reduceat(margins, starts), -2, 2), np.log1p(total), total / np.sqrt(n)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.logit, -50, 50))) if self.fitted else np.full(len(x), self.prior)


class Reader:
    """Reads whole texts with a model; what a word says is remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.ids, self.cores = model, {}, {}
        self.margin, self.flags = np.zeros(1024, np.float32), np.zeros(1024, np.uint8)

    #: Flags of a word: one letter; the last of its sentence; nothing but punctuation.
    LETTER, LAST, EMPTY = 1, 2, 4

    def _margins(self, strings: list[str]) -> dict[str, float]:
        new = [c for c in dict.fromkeys(strings) if c not in self.cores]
        if len(self.cores) + len(new) > REMEMBERED:
            self.cores.clear()
            new = list(dict.fromkeys(strings))
        self.cores.update(zip(new, self.model.margins(new)))
        return self.cores

    def _learn(self, new: list[str]) -> None:
        read = [readings(w) for w in new]
        known = self._margins([c for r in read for c in r])
        at = len(self.ids)
        while at + len(new) > len(self.margin):
            self.margin, self.flags = np.resize(self.margin, 2 * len(self.margin)), np.resize(self.flags, 2 * len(self.flags))
        for w, r in zip(new, read):
            core = w if w.isalnum() else _OUTER.sub("", w)
            self.ids[w] = at
            self.margin[at] = max([known[c] for c in r], default=NOTHING)
            self.flags[at] = (self.LETTER if len(core) == 1 else self.EMPTY if not core else 0) | (self.LAST if w[-1] in ".!?" and len(core) != 1 else 0)
            at += 1

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Features of each text."""
        split = [common.words(t.lower()) for t in texts]
        new = set().union(*split).difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = set().union(*split)
        self._learn(sorted(new))
        n = np.array([len(w) for w in split], np.int64)
        ids = np.fromiter((i for w in split for i in map(self.ids.__getitem__, w)), np.int64, int(n.sum()))
        margin, flags = self.margin[ids], self.flags[ids]
        text = np.repeat(np.arange(len(texts)), n)
        # runs of letters written apart, inside one text, over loose punctuation that ends no sentence
        word = np.flatnonzero((flags & (self.EMPTY | self.LAST)) != self.EMPTY)
        letter = (flags[word] & self.LETTER) > 0
        if letter.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(letter, text[word] + 1, 0), [0]])))
            first = np.cumsum(n) - n
            for a, b in zip(edge[:-1], edge[1:]):
                if letter[a] and b - a > 2:
                    at, t = word[a], text[word[a]]
                    core = START + "".join(w if w.isalnum() else _OUTER.sub("", w) for w in (split[t][k - first[t]] for k in word[a:b]))
                    margin[at] = max(margin[at], self._margins([core])[core])
        # sentences: cut after their last words and between texts; a text without words has one empty sentence
        starts = np.ones(len(ids), bool)
        starts[1:] = ((flags[:-1] & self.LAST) > 0) | (text[1:] != text[:-1])
        at = np.flatnonzero(starts)
        high = np.maximum.reduceat(margin, at) if len(at) else np.empty(0, np.float32)
        per = np.bincount(text[at], minlength=len(texts))
        blank = np.flatnonzero(per == 0)
        high = np.insert(high, np.cumsum(per)[blank], NOTHING)
        per[blank] = 1
        return self.model.features(high.astype(np.float64), np.cumsum(per) - per)


#: The margin of a sentence with nothing to compare.
NOTHING = -2.0


def document_features(texts: list[str], model: Model, key: str) -> np.ndarray:
    """Features of whole texts; key names the model in what the worker remembers."""
    return common.kept(("toxicity", key), lambda: Reader(model))(texts)


def _grams(text: str) -> set[str]:
    return {f[k : k + n] for f in {f for s in sentences(text) for f in s} for n in range(4, LONGEST + 1) for k in range(len(f) - n + 1)}


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, toxic) of the bounded training sample, and the numbers of toxic and clean training rows there are."""
    rows = common.need(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null")
    own = common.texts_of(docs)
    rows = rows.where(common.fold(F.col("doc_id"), FOLD_BY) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.join(own.select("doc_id").distinct(), "doc_id")
    rows = common.stored(rows, docs.sparkSession)
    n1, n0 = rows.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
    order = F.xxhash64("doc_id", F.lit(4))
    picked = rows.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).union(rows.where("toxic <> 1").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    # at most TOXIC_ROWS + CLEAN_ROWS ids are broadcast; a doc_id that is repeated is trained on once
    texts = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return common.stored(texts.select("doc_id", "text", "toxic").repartition(common.parallelism(docs.sparkSession)), docs.sparkSession), n1, n0


def landmarks(texts: DataFrame) -> list[tuple[str, float]]:
    """Telling n-grams, unlike one another, with their z scores, and frequent clean words (0)."""

    def counted(find):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for pdf in batches:
                for t in pdf["text"]:
                    seen.update(find(t))
            yield pd.DataFrame(seen.items(), columns=["gram", "n"])

        return run

    toxic, clean = texts.where("toxic = 1"), texts.where("toxic <> 1")
    n1, n0 = toxic.count(), clean.count()
    if not n1 or not n0:
        return []
    own = toxic.mapInPandas(counted(_grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n1")).where(F.col("n1") >= max(2, n1 // 100))
    other = clean.mapInPandas(counted(_grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n0"))
    both = own.join(other, "gram", "left").na.fill(0)
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    p = (F.col("n1") + F.col("n0") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    ranked = both.withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.round("z", 1).desc(), F.length("gram").desc(), "gram").limit(CANDIDATES).collect()
    number = {r["gram"]: k for k, r in enumerate(ranked)}  # the best of all counted ones: at most CANDIDATES strings of LONGEST letters

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"grams": [sorted(number[g] for g in _grams(t) if g in number) for t in pdf["text"]]})

    # whose documents hold which candidates: at most TOXIC_ROWS rows
    held = sorted(tuple(r["grams"]) for r in toxic.mapInPandas(present, "grams array<int>").collect())
    there = np.zeros((len(held), len(ranked)), bool)
    for k, grams in enumerate(held):
        there[k, list(grams)] = True
    sure = np.array([(r["n1"] / n1) / (r["n1"] / n1 + r["n0"] / n0) for r in ranked])
    merit = np.maximum(2 * sure - 1, 0) ** 2
    weight, out, used, free = np.ones(len(held)), [], set(), np.ones(len(ranked), bool)
    while len(out) < TELLING and free.any():
        # each document that landmarks already explain counts half as much for the next one
        best = int(np.argmax(np.where(free, np.round((weight @ there) * merit, 9), -1)))
        gram = ranked[best]["gram"]
        free[best] = False
        parts = {gram[k : k + 4] for k in range(len(gram) - 3)}
        if parts & used:
            continue
        used |= parts
        out.append((gram, float(ranked[best]["z"])))
        weight = np.where(there[:, best], weight / 2, weight)
    usual = clean.mapInPandas(counted(lambda t: {f[:LONGEST] for s in sentences(t) for f in s if len(f) > 4}), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = [r["gram"] for r in usual.orderBy(F.col("n").desc(), "gram").limit(COMMON_WORDS).collect()]
    return out + [(w, 0.0) for w in frequent if w not in dict(out)]


def _contrasted(model: Model, windows_of_clean: pd.Series) -> Model:
    """The model with CONTRAST landmarks more: the strings that clean sentences hold most often of those near a landmark."""
    seen = windows_of_clean.map(lambda w: w[: LONGEST + 1]).value_counts()
    seen = seen[~seen.index.isin(model.landmarks)]
    names = sorted(seen.index, key=lambda w: (-seen[w], w))[: 50 * CONTRAST]
    near = model.values(names)[:, model.merit > 0].max(axis=1) if names else np.empty(0)
    order = sorted(range(len(names)), key=lambda k: (-round(float(near[k]) * np.sqrt(seen[names[k]]), 6), names[k]))
    added = []
    for k in order:
        if len(added) < CONTRAST and near[k] > 0 and (not added or kernel([names[k]], added).max() < 0.5):
            added.append(names[k])
    return Model([*model.landmarks, *added], [*model.merit, *[0.0] * len(added)], model.prior)


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM with balanced classes, by accelerated gradient steps."""
    w8 = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (2 * np.linalg.norm(a * np.sqrt(w8)[:, None], 2) ** 2 + reg)
    w = v = np.zeros(a.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (a @ v))
        grad = -2 * a.T @ (w8 * slack * y) + reg * np.append(v[:-1], 0)
        new = v - rate * grad
        w, v = new, new + k / (k + 3) * (new - w)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + reg * np.eye(x.shape[1])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - reg * b)
    return b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts, n1, n0 = sample(docs, labels)
    found = landmarks(texts)
    model = Model([z for z, _ in found], [m for _, m in found], n1 / max(1, n1 + n0))
    if not model.merit.any():
        return model

    def strongest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's sentences that come nearest to the telling landmarks, by their nearest window."""
        for pdf in batches:
            for doc, text, toxic in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                of = {}
                for k, s in enumerate(sentences(text)):
                    for w in {w for f in s for w in windows(f)}:
                        of.setdefault(w, k)
                if not of:
                    continue
                distinct = sorted(of)
                first = (model.values(distinct).astype(np.float64) * model.merit).max(axis=1)
                rows = pd.DataFrame({"toxic": int(toxic), "doc": doc, "sentence": [of[w] for w in distinct], "window": distinct, "first": first})
                yield rows.sort_values(["first", "window"], ascending=[False, True]).drop_duplicates("sentence").head(WITNESSES)

    # at most (TOXIC_ROWS + CLEAN_ROWS) * WITNESSES short rows
    rows = texts.mapInPandas(strongest, "toxic int, doc long, sentence int, window string, first double").toPandas().sort_values(["toxic", "doc", "sentence"]).reset_index(drop=True)
    toxic = rows["toxic"].to_numpy() == 1
    model = _contrasted(model, rows["window"][~toxic])
    x = model.values(rows["window"].tolist()).astype(np.float64) @ model.root
    clean = set(rows["window"][~toxic])
    new = ~rows["window"].isin(clean).to_numpy()  # what clean documents say as well is no witness
    score = np.where(new, rows["first"].to_numpy(), -np.inf)
    for again in range(3):
        place = pd.Series(-score).groupby(rows["doc"]).rank(method="min").to_numpy()
        use = ~toxic | (new & ((place <= (1 if again else 2)) | ((score > 0) & bool(again))))
        if not (use & toxic).any():
            return model
        model.weights, model.bias = _svm(x[use], np.where(toxic[use], 1.0, -1.0))
        score = np.where(new, x @ model.weights + model.bias, -np.inf)
    key = _key(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": document_features(pdf["text"].tolist(), model, key).tolist()})

    rows = texts.select("text", "toxic").mapInPandas(read, "toxic long, x array<double>").toPandas()  # four numbers per row of the sample
    rows = rows.assign(_key=rows["x"].map(tuple)).sort_values(["toxic", "_key"])
    y = (rows["toxic"].to_numpy() == 1).astype(float)
    weight = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
    model.logit = _logistic(np.stack(rows["x"].to_numpy()), y, weight * len(y) / weight.sum())
    model.fitted = True
    return model


def _key(model: Model) -> str:
    return f"{model.landmarks}{model.weights.tobytes().hex()}{model.bias}"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of each document."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)
    rows = common.texts_of(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), (common.fold(F.col("doc_id"), FOLD_BY) == HELD_OUT).alias("held_out"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.concatenate([shared.value.score(document_features(pdf["text"].iloc[k : k + 256].tolist(), shared.value, key)) for k in range(0, len(pdf), 256)] or [np.zeros(0)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"], "held_out": pdf["held_out"], "score": p, "predicted": (p >= CUT).astype(np.int32)})

    return rows.mapInPandas(run, "doc_id long, text_hash long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever their names: one pass, no join. Null and empty texts score as such, repeated rows alike."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    @F.pandas_udf("double")
    def p(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        parts = [shared.value.score(document_features(texts[k : k + 256], shared.value, key)) for k in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows, name = common.numbered(docs)
    return rows.where(p(F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))) < CUT).toDF(*docs.columns)
