"""The ten operators on small tables with awkward rows, against brute force or exact round trips."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from byteloom.llm import chat, common, decontaminate, mixing, ngramjoin, suffixtree, tokencount, topk, toxicity, warc, wavelet
from byteloom.llm.components import components

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


LONG = prose(4000)
BASE = prose(60)
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace(BASE.split()[30], "zzz", 1), "a"), (4, prose(80), "b"), (5, None, "b"), (6, "", None), (7, "  \t\n ", "c"), (8, "one two", "c"), (9, "one two", None),
    (10, LONG, "a"), (10, LONG, "a"), (11, LONG + " more words here", "b"), (None, prose(30), None), (None, prose(30), "d"), (12, "é \xa0 日本 😀\x1f x", "d"), (13, prose(200), "a"), (-5, prose(9), "e"),
] + [(100 + k, prose(RNG.randint(1, 50)), RNG.choice("abcd")) for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, id long"
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 0.5, 3) for i, t, s in ROWS], schema).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# 1 ------------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if level[s] > 2 * sizes[s]}
        if not full:
            return target | level
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
        if not free:
            return target


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_fill(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len(WORD.findall(t or "")), s) for i, t, s in ROWS)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        longest = max(len(WORD.findall(t or "")) for _, t, x in ROWS if x == s)
        assert abs(n - want[s]) <= longest / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    out = mixing.copies_of(docs, mixing.mix(docs))
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in ((i, sum(r["copies"] for r in got if r["doc_id"] == i)) for i in {r["doc_id"] for r in got}) if n})
    assert mixing.mix(none).count() == 0


def test_mixing_follows_pareto_order(spark):
    rows = [(k, " ".join(["w"] * RNG.randint(1, 40)), "s") for k in range(400)] + [(k, "w " * 2000, "t") for k in range(1000, 1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    own = [len(t.split()) for _, t, s in rows if s == "s"]
    total, squares = sum(own), sum(x * x for x in own)
    r = got[0]["target"] / total
    mean = squares / total
    room = min(2 - r, r / (max(own) / mean - 1))
    order, left = [], got[0]["target"]
    for k, t, s in rows:
        if s == "s":
            n = len(t.split())
            want = min(max(r + room * 0.5 * (1 - n / mean), 0), 2)
            u = (int(hashlib.md5(str(k).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = want - math.floor(want)
            left -= math.floor(want) * n
            order.append(((u / (1 - u)) * ((1 - p) / p), k, n, math.floor(want)))
    for _, k, n, sure in sorted(order):
        take = 1 if left > 0 and n / 2 <= left else 0
        if left > 0 and not take:
            left = 0
        left -= n * take
        assert got[k]["copies"] == sure + take


# 2 ------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = WORD.findall((t or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    near = [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            near[i].add(j)
            near[j].add(i)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        group[i] = min(seen, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    return [(r[0], rows[g][0], len(n), sum(x == s for x in sets) if s else 1) for r, g, n, s in zip(rows, group, near, sets)]


def near_copies():
    rng, rows = random.Random(5), []
    for g in range(6):
        base = [rng.choice(VOCAB) for _ in range(120)]
        for _ in range(rng.choice([2, 3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((1000 * g + len(rows), " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("limits", [None, (8, 16, 2000)])
def test_ngram_join(spark, docs, none, monkeypatch, limits):
    if limits:  # small buckets and blocks, so that splitting and block pairs are used
        for name, v in zip(("LEAF", "BLOCK", "BLOCK_SHINGLES", "SKETCH_BLOCK"), (*limits, 10)):
            monkeypatch.setattr(ngramjoin, name, v)
    rows = ROWS + near_copies()
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", s, 1, 2, 0.5, 3) for i, t, s in near_copies()], docs.schema))
    joined = ngramjoin.join(df)
    got = Counter((r["doc_id"], r["class_id"], r["links"], r["copies"]) for r in joined.collect())
    assert got == Counter(brute_join(rows))
    kept = ngramjoin.one_of_each(df, joined)
    groups = Counter((g, bool(shingle_set(t))) for (_, g, _, _), (_, t, _) in zip(brute_join(rows), rows) if shingle_set(t))
    blank = sum(not shingle_set(t) for _, t, _ in rows)
    nulls = sum(i is None for i, _, _ in rows)  # the two null ids are groups of their own
    assert kept.columns == df.columns and kept.count() == len(groups) + blank + nulls - 1
    assert ngramjoin.join(none).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_reach_the_recall():
    assert ngramjoin.runs_needed(0.8, 0.9999) >= 8 and ngramjoin.runs_needed(0.9, 0.99) < ngramjoin.runs_needed(0.8, 0.99)


def test_recall_at_the_threshold_and_full_depth():
    rng = random.Random(8)
    runs, least = ngramjoin.runs_needed(0.8, 0.9999), ngramjoin.least_equal(0.8, 0.9999)

    def together(equal, depth):
        return depth == ngramjoin.DEPTH or any(equal[rng.randrange(ngramjoin.SKETCH)] and together(equal, depth + 1) for _ in range(2 if rng.random() < 0.25 else 1))

    missed = 0
    for _ in range(20_000):
        equal = [rng.random() < 0.8 for _ in range(ngramjoin.SKETCH)]
        missed += sum(equal) < least or not any(rng.random() < 0.8 and together(equal, 1) for _ in range(runs))
    assert missed <= 8  # 2 are expected; eleven runs miss about 60


# 3 ------------------------------------------------------------------------------------------------


def test_token_counts(docs, none):
    pieces = tokencount.Pieces(PIECES)

    def best(word):  # plain search over segmentations
        memo = {len(word): (0, 0, 0)}
        for a in range(len(word) - 1, -1, -1):
            ways = [tuple(x + y for x, y in zip((pieces.score[word[a:b]], -1, 0), memo[b])) for b in range(a + 1, min(len(word), a + pieces.longest) + 1) if word[a:b] in pieces.score]
            if word[a] not in pieces.score:
                n = len(word[a].encode())
                ways.append(tuple(x + y for x, y in zip((n * pieces.byte, -n, -n), memo[a + 1])))
            memo[a] = max(ways)
        return -memo[0][1], -memo[0][2]

    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"], r["n_byte_tokens"]) for r in tokencount.token_counts(docs, PIECES).collect())
    want = Counter()
    for i, t, _ in ROWS:
        ws = WORD.findall(t or "")
        n = [best("▁" + w) for w in ws]
        want[i, len(ws), sum(x for x, _ in n), sum(x for _, x in n)] += 1
    assert got == want and tokencount.token_counts(none, PIECES).count() == 0

    rng = random.Random(3)
    some = sorted({"▁" + "".join(rng.choice("abeinst中😀") for _ in range(rng.randrange(40))) for _ in range(200)})
    for held in (tokencount.HELD, 5, 20):  # long words: the nodes past `held` are made anew
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokencount, "HELD", held)
            trie = tokencount.Trie(pieces)
            assert [trie.count(w) for w in some] == [best(w) for w in some]
            assert len(trie.path) <= held + 1



# 4 ------------------------------------------------------------------------------------------------


def test_kernel_is_the_subsequence_kernel():
    def brute(s, t, p=toxicity.ORDER, d=toxicity.DECAY):
        return sum(d ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in combinations(range(len(s)), p) for j in combinations(range(len(t)), p) if all(s[a] == t[b] for a, b in zip(i, j)))

    for s, t in [("idiot", "idiot"), ("id.i-ot", "idiot"), ("thth", "that"), ("abcabc", "cabcab"), ("xyz", "abc"), ("éàçé", "àçéé")]:
        assert toxicity.kernel([s], [t])[0, 0] == pytest.approx(brute(s, t) ** 2 / brute(s, s) / brute(t, t), rel=1e-4)


def test_values_are_the_kernel_or_zero_under_the_floor():
    marks = ["^idiot", "^баобабов", "aaaa", "^réeux", "日本日本", "hless"]
    model = toxicity.Model(marks, [1.0] * len(marks), 0.1)
    assert np.allclose(np.diag(model.values(marks)), 1, atol=1e-4)
    rng = random.Random(4)
    strings = marks + ["^" + "".join(rng.choice(x) for _ in range(rng.randint(3, 12))) for x in ("idots.", "баов", "a^é", "réeuxs", "日本a", "hlesworti") for _ in range(60)]
    whole = toxicity.kernel(strings, marks)
    want = np.where(whole < toxicity.FLOOR, 0, whole)
    close = np.abs(whole - toxicity.FLOOR) > 1e-5
    assert np.allclose(model.values(strings)[close], want[close], atol=1e-4) and (want > 0).sum() > 20


def test_reader_and_sentences_read_alike():
    model = toxicity.Model(["^idiot", "^worthle"], [1.0, 1.0], 0.1)
    model.weights, model.bias = np.linalg.inv(model.root) @ np.ones(2), -0.5  # the margin is the sum of the two values
    texts = ["you i.d.i.o.t there", "you i - d - i - o - t now. Fine", "w.o.r.t.h.l.e.s.s. w o r t h l e s s", "nothing", "", "a b. c d i d i o t. x", "so i.d.i.o.t.s? -- . Yes ... w-o-r-t-h-l-e-s-s! no"]
    got = toxicity.Reader(model)(texts)
    for t, x in zip(texts, got):
        per = [max([m for f in s for m in model.margins([f])], default=toxicity.NOTHING) for s in toxicity.sentences(t)]
        assert x == pytest.approx(model.features(np.array(per), np.array([0]))[0], abs=1e-5), t
    assert (got[[0, 1], 1] > 0.4).all() and (got[[2, 6], 1] > 0).all() and (got[[3, 4], 1] < 0).all()


def test_toxicity(spark, none):
    rng, bad = random.Random(3), ["wretchling", "foulmouth", "gronk"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = [rng.choice(VOCAB) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(2):
                b = rng.choice(bad)
                words.insert(rng.randrange(len(words)), rng.choice([b, b, b.upper(), b[:3] + "." + b[3:], b + "!"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "some words"), (9002, " ".join("gronk")), (9002, "x" * 5000), (9003, prose(30) + " g r o n k " + prose(30))]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, None), (None, 0, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] == 9003) and all(r["predicted"] == 0 for r in got if r["doc_id"] in (9000, 9001))
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(df, toxicity.fit(df, lab.limit(0))).count() == len(rows)


# 5 ------------------------------------------------------------------------------------------------


def brute_tree(rows, depth):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    a = suffixtree.ALPHA
    seqs = [(i, ["<s>", *WORD.findall((t or "").translate(low)), "</s>"]) for i, t, _ in rows]
    train = [w for i, w in seqs if not held(i)]
    gram, follow = Counter(), Counter()  # contexts, and contexts with their next word
    for w in train:
        for k in range(1, len(w)):
            for n in range(min(depth, k) + 1):
                gram[tuple(w[k - n : k])] += 1
                follow[tuple(w[k - n : k]), w[k]] += 1
    n, v = gram[()], sum(not s for s, _ in follow)
    states = set()

    def p(s, x):
        """Of the longest state that s ends in."""
        if not s:
            return (follow[(), x] + 0.5) / (n + 0.5 * (v + 1))
        return (follow[s, x] + a * p(s[1:], x)) / (gram[s] + a) if s in states else p(s[1:], x)

    for d in range(1, depth + 1):
        gains = Counter()
        for s, x in follow:
            if len(s) == d and gram[s] >= 2 and (d == 1 or s[1:] in states):
                q = p(s[1:], x)
                gains[s] += follow[s, x] * round(suffixtree.NAT * math.log((follow[s, x] - 1 + a * q) / (gram[s] - 1 + a) / q)) / suffixtree.NAT
        states |= {s for s, g in gains.items() if g > suffixtree.MIN_GAIN}

    def longest(s):
        while s and not all(s[k:] in states for k in range(len(s))):
            s = s[1:]
        return s

    out = []
    for i, w in seqs:
        at = [(longest(tuple(w[max(0, k - depth) : k])), w[k]) for k in range(1, len(w))]
        base = [p((), x) for _, x in at]
        out.append((i, held(i), len(w) - 1, sum(follow[(), x] > 0 for _, x in at), n, sum(map(math.log10, base)), sum(math.log10(p(s, x)) for s, x in at)))
    return out


@pytest.mark.parametrize("depth, chunk", [(1, 100), (2, 100), (3, 100), (4, 2_000_000), (4, 100), (6, 100)])
def test_suffix_tree(docs, none, monkeypatch, depth, chunk):
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", chunk)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:7] for r in suffixtree.score(docs, depth=depth).collect()), key=key), sorted(brute_tree(ROWS, depth), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_suffix_tree_without_rows(docs, none):
    assert suffixtree.score(none).count() == 0
    held = docs.where("doc_id = 13")  # nothing to learn from: one unknown word
    assert zlib.crc32(b"13") % 5 != 1 or suffixtree.score(held).first()["train_tokens"] == 0
    blank = suffixtree.score(docs.where("doc_id in (5, 6)")).collect()
    assert [(r["n_tokens"], r["base_score"] <= 0) for r in blank] == [(1, True)] * 2


def test_distinct_keys_and_lower_case():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 40), (1, 64), (1, 1), (5000, 6), (5000, 40), (5000, 60), (5000, 64)):
        keys = rng.integers(0, (1 << bits) - 1, n, np.uint64, endpoint=True)
        for got, want in zip(suffixtree._distinct(keys), np.unique(keys, return_inverse=True)):
            assert got.tolist() == want.tolist()
    for text in ("", "ABC xyz Z", "ÄÖ Éa İI ıi K ſ AZ@[`{ 日本 \U0001f600Q", "x\ud800Y"):
        assert common.lower_ascii(text) == "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# 6 ------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.25, 0.99]) for _ in range(4)]) for k in range(300)]
    rows += [(1000 + k, [0.25, 0.25, 0.25, 0.25]) for k in range(60)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf"), 0.0, 0.0, 0.0]), (404, []), (None, [1.0] * 4), (450, [0.5, 0.5]), (451, [1e30, 0.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, rank int")
    clean = [(i, [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in clean:
        if q % 50 == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i) for i, b in clean if i != q and len(a) == len(b))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_takes_repeated_ids_and_rows_as_rows_of_their_own(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    rows += rows[:60] + [(50, [0.9] * 4), (50, [0.9] * 4), (3, [0.5] * 4)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for m, (q, a) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(whole) if n != m)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# 7 ------------------------------------------------------------------------------------------------


def test_decontaminate(spark, docs, none):
    item = "A train leaves the big station at 45 km per hour and after 3 hours the driver Anna meets another train that has left 7 minutes before it on the same old track."
    other = item.replace("45", "62").replace("3 hours", "9 days").replace("Anna", "Boris").replace("7", "12")
    broken = item.replace("45", "3")  # two values of the item became one
    short = "What is the colour of an orange cat?"
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (5, "12 kg 13 kg 14 kg 15 kg 16"), (5, "12 kg 13 kg 14 kg 15 kg 16")], "item_id long, text string")
    extra = [(2000, f"{prose(30)} {item} {prose(5)}"), (2001, f"{prose(40)}\n{other}"), (2002, f"{prose(3)} {broken} {prose(2)}"), (2003, f"{prose(10)} {short.upper()} {prose(10)}"), (2004, " ".join(item.split()[:11]) + " " + prose(20)), (2005, f"« {item.replace(' ', ' ### ')} »"), (2006, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(df, bench).collect()}
    assert set(got) == {(2000, 1), (2001, 1), (2003, 2), (2005, 1)}
    assert got[2000, 1]["changed_slots"] == 0 and got[2001, 1]["changed_slots"] >= 4
    left = decontaminate.clean_of(df, decontaminate.find(df, bench))
    assert left.columns == df.columns and left.count() == df.count() - 4
    assert decontaminate.find(none, bench).count() == decontaminate.find(df, bench.limit(0)).count() == 0


def test_decontaminate_finds_items_made_mostly_of_slots(spark):
    item = "What is the sum of 3 4 5 6 7 8 9 10 11?"
    table = "Values measured in the old town were 12 17 13 19 24 31 8 55 61 72 29 18 44 23 91 37 62 85"
    bench = spark.createDataFrame([(1, item), (2, table)], "item_id long, text string")
    part = " ".join(table.split()[7:])
    rows = [(1, f"{prose(20)} {item} {prose(9)}"), (2, f"{prose(9)} what is the sum of 13 14 15 16 17 18 19 20 21 {prose(3)}"), (3, "what is the sum of 13 14"), (4, f"{prose(9)} {part} {prose(9)}"), (5, prose(5) + " 1 2" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()} == {(1, 1), (2, 1), (4, 2)}


def test_decontaminate_reads_capitals_the_same_everywhere(spark):
    short, sums, first = "Oranges keep well in which old cellar?", "John has 3 apples. John buys 4. How many apples does he have by now?", "Water boils in the pot"
    bench = spark.createDataFrame([(1, short), (2, sums), (3, "What is the colour of an orange cat?"), (4, first), (5, "Paris"), (6, "Berlin Rome")], "item_id long, text string")
    rows = [
        (1, f"{prose(9)} so {short} {prose(9)}"), (2, f"{prose(5)}.\n{sums.replace('John', 'Mary').replace('3', '5').replace('4', '7')}"), (3, "they ask What is the colour of an orange cat? again"),
        (4, "Which of Water Boils In The Pot do you like"), (5, "London Madrid and Oslo"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert got[2, 2]["changed_slots"] == 3


def test_decontaminate_reads_names_first_and_number_words(spark):
    item = "Natalia sold 48 clips to her friends in April"
    bench = spark.createDataFrame([(1, item), (2, "Take 12 red apples out of the 30 baskets and sort them by weight")], "item_id long, text string")
    rows = [
        (1, item), (2, item.replace("Natalia", "Marco")), (3, item.replace("Natalia", "Marco").replace("48", "31").replace("April", "May")), (4, f"{prose(12)}. {item.replace('Natalia', 'Ana')}. {prose(5)}"),
        (5, f"{prose(4)} take twelve red apples out of the thirty baskets and sort them by weight {prose(4)}"), (6, "She sold clips to her friends in April"), (7, "Natalia sold 48 clips to his friends in April"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}


def test_window_sums():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (1, 8, 300):
        at = np.arange(500 - n + 1)
        assert (decontaminate.Sums(h)(at, n) == common.windows(h, n) ^ np.uint64(n)).all()


def test_decontaminate_without_broadcast(spark, docs, monkeypatch):
    bench = docs.where("doc_id in (4, 13)").select(F.col("doc_id").alias("item_id"), "text")
    usual = {tuple(r) for r in decontaminate.find(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert {tuple(r) for r in decontaminate.find(docs, bench).collect()} == usual and {(r[0], r[2]) for r in usual} == {(4, 4), (13, 13)}


# 8 ------------------------------------------------------------------------------------------------


def plain_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_token_ids(spark, docs, none, tmp_path):
    index = wavelet.write(docs, f"file://{tmp_path}/ids", BPE, 2, shard_ids=500)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read(index).collect())
    t, at, want = plain_tokenizer(), 0, []
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter(g[1:] for g in got) == Counter(want)
    assert [g[1] for g in got] == [w[0] for w in want]
    for g in got:
        assert g[0] == at
        at += g[2]
    assert wavelet.read(wavelet.write(none, f"file://{tmp_path}/none", BPE, 2)).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(1)
    signs = list("ab'sS tTlL  \n\t\r\x0b,.!?1 2é\xa0 日😀_-</>|") + ["<|endoftext|>", "'ll", " '", " word", ", "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [LONG, "", " ", "a  b", "x\n \ny"]
    code = wavelet.Encoder(BPE, most=500)
    want = [e.ids for e in plain_tokenizer().encode_batch(texts, add_special_tokens=False)]
    got = [x for k in range(0, len(texts), 64) for x in code(texts[k : k + 64])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_wavelet_matrix_reads_parts(tmp_path):
    """One token, a count and a place are read from a large file without reading most of it."""
    n = 2_000_000
    ids = np.random.default_rng(3).integers(0, 50_000, n).astype("<u2")
    data = wavelet.pack(ids, np.array([1]), np.array([True]), np.array([n]), 16)
    (tmp_path / "one.bwm").write_bytes(data)

    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            out = super().read(size)
            self.taken += len(out)
            return out

    file = Counting(data)
    m = wavelet.WaveletMatrix(file)
    assert m.access([1_234_567])[0] == ids[1_234_567] and file.taken < len(data) * 0.4
    at = np.flatnonzero(ids == ids[5])
    assert wavelet.shard_at(f"file://{tmp_path}/one.bwm").occurrences(int(ids[5])).tolist() == at.tolist()
    some = np.random.default_rng(4).integers(0, n, 10_000)
    assert (m.access(some) == ids[some]).all()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, wavelet.PIECE * 8, wavelet.PIECE * 8 + 1])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype("<u2")
    m = wavelet.WaveletMatrix(wavelet.pack(ids, np.array([1]), np.array([True]), np.array([n]), 16))
    assert (m.ids() == ids).all() and (m.access(np.arange(n)) == ids).all()
    for s in (0, 7, 299, 40_000, 1 << 20):
        at = np.flatnonzero(ids == s)
        assert m.count(s) == len(at) and m.rank(s, n // 2) == (ids[: n // 2] == s).sum() and m.occurrences(s).tolist() == at.tolist()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"nothing")


# 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [warc.HOT, 1])
def test_warc(spark, tmp_path, hot):
    big, odd = "x" * 1500, "é" * 500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/ b\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", odd), (8, "u", odd), (8, "u", odd), (None, "u", big), (None, "u", "y" * 2000), (10, "u", "WARC-Type: revisit\r\n\r\n" * 90)]
    df = spark.createDataFrame([(i, u, h, "z", "clash") for i, u, h in rows], "page_id long, url string, html string, digest string, payload string")
    archive = warc.write(df, f"file://{tmp_path}/warc")
    records = warc.records_of(spark, archive, hot)
    got = Counter(tuple(r) for r in warc.facts_of(records).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x, _, y in rows if (y or "") == (h or "") and x is not None), default=None)
        again = len(raw) >= 1000 and top is not None and i != top
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    for r in records.collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\n") and bytes(r["record"]) == bytes(r["header"]) + (b"" if b"WARC-Type: revisit\r\n" in head else bytes(r["payload"])) + b"\r\n\r\n"
        assert b"\r\nX: y" not in head
    assert warc.payloads_of(spark, archive).count() == len({h or "" for _, _, h in rows})
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("warc_")]  # the archive is its folder
    again = warc.facts_of(warc.records_of(spark.newSession(), archive, hot))
    assert Counter(tuple(r) for r in again.collect()) == want
    empty = warc.write(df.limit(0), f"file://{tmp_path}/empty")
    assert warc.facts_of(warc.records_of(spark, empty)).count() == 0


# 10 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [65_536, 7])
def test_chat(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE_IDS", piece)
    tricky = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "user", "é 😀 \\ \\\\ <\\s>"), (1, 4, "assistant", "[IN[INST]ST] <<s>s> \\"), (2, 0, "user", None), (2, 0, "user", None), (2, None, "assistant", "last"), (2, 1, None, "odd"), (2, 2, "tool </s>", "x"), (3, 0, "assistant", ""), (None, 5, "assistant", "b"), (None, 4, "assistant", "a"), (4, 1, "assistant", LONG)]
    df = spark.createDataFrame([(c, t, r, x, 1, "id") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, piece int, ids string")
    pieces = chat.assemble(df, BPE)
    got = {r["conv_id"]: r for r in chat.digest(pieces, BPE).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for _, _, r, x in g if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(g) and r["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in g).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        marks = {"system": 11, "user": 13, "assistant": 9}
        assert r["formatted_chars"] == 3 + sum(len(chat.escape(x)) + (marks[r] if r in marks else 19 + len(chat.escape(r))) for _, _, r, x in g)
    assert chat.digest(chat.assemble(df.limit(0), BPE), BPE).count() == 0


def test_escape_is_reversible():
    rng = random.Random(4)
    signs = ["\\", "<", "s", ">", "/", "[", "INST", "]", "a", *chat.CONTROLS]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


# all ----------------------------------------------------------------------------------------------


def test_words_split_at_ascii_space_only():
    t = "a\x1fb c\xa0d e\x0bf\x85 "
    assert common.words(t) == WORD.findall(t)
