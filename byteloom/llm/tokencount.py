"""Token counts by dynamic programming shared over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. A text's token count is the sum over its
pre-tokens of the number of pieces in the best unigram segmentation. The pieces come from a public
SentencePiece file; it ranks its pieces, so a piece's score is the Zipf log-probability
of its rank, -ln(rank + 1), held as an integer so that sums are exact.

Each task puts the distinct pre-tokens of some million characters of text, but those it has counted before, into a trie and fills in the
forward (best-prefix) score of every node once, from its ancestors: words that start alike share that work. The trie is
filled in depth first, in the order of the words, so only one path of it is held. The count at the node where a word ends is
kept. No shuffle; a worker's memory of counts is emptied at a fixed number of words and doesn't keep words of over LONG characters.

Ties between segmentations of equal score go to the one with fewer tokens. A character that is no piece
becomes one byte token per UTF-8 byte. Defined cases: null and empty texts have 0 tokens;
repeated rows are counted each; a very long word is handled whole, in memory of HELD nodes; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
SCALE = 1 << 24
REMEMBERED, LONG = 500_000, 256
#: Characters of text whose new words are put into one trie, and of a word whose nodes are held for the next word.
CHARS, HELD = 4_000_000, 65_536


class Pieces:
    """The vocabulary: piece -> integer score, and the score of a byte token."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.score = {sp.id_to_piece(i): -round(math.log(rank + 2) * SCALE) for rank, i in enumerate(order)}
        self.byte = -round(math.log(len(order) + 2) * SCALE) * 2
        self.longest = max(map(len, self.score))


class Trie:
    """The trie of words that come in order, filled in depth first: only the nodes of the last word's path are held, HELD at most."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.last = pieces, ""
        self.path: list[tuple[int, int, int]] = [(0, 0, 0)]  # score, -tokens, -byte tokens of each prefix: the maximum is the best

    def forward(self, word: str, end: int, near, base: int) -> tuple[int, int, int]:
        """The node of word[:end]; near[x - base] is the node of word[:x] for the starts x of possible last pieces."""
        score, ch, best = self.pieces.score, word[end - 1], None
        for start in range(max(0, end - self.pieces.longest), end):
            s = score.get(word[start:end])
            if s is not None:
                f, t, b = near[start - base]
                if best is None or (f + s, t - 1, b) > best:
                    best = (f + s, t - 1, b)
        if ch not in score:
            f, t, b = near[end - 1 - base]
            n = len(ch.encode("utf-8", "replace"))
            if best is None or (f + n * self.pieces.byte, t - n, b - n) > best:
                best = (f + n * self.pieces.byte, t - n, b - n)
        return best

    def count(self, word: str) -> tuple[int, int]:
        """The tokens and byte tokens of a word's best segmentation; its nodes are made from where it leaves the word before."""
        path = self.path
        del path[len(os.path.commonprefix((self.last, word))) + 1 :]
        for end in range(len(path), min(len(word), HELD) + 1):
            path.append(self.forward(word, end, path, 0))
        self.last = word[:HELD]
        near = path
        if len(word) > HELD:
            near = deque(path[-self.pieces.longest :], self.pieces.longest)
            for end in range(HELD + 1, len(word) + 1):
                near.append(self.forward(word, end, near, end - len(near)))
        _, tokens, bytes_ = near[-1]
        return -tokens, -bytes_


def count_words(path: str, distinct: set[str]) -> dict[str, tuple[int, int]]:
    """The worker's memory of counts, with all the given words in it; the long ones leave it at the next call."""
    pieces, known, long = common.kept(("pieces", path), lambda: (Pieces(path), {}, []))
    while long:
        known.pop(long.pop(), None)
    new = [w for w in distinct if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(distinct)
    trie = Trie(pieces)
    for w in sorted(new):
        known[w] = trie.count(MARK + w)
        if len(w) > LONG:
            long.append(w)
    return known


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_byte_tokens of each document."""
    rows = common.texts_of(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            texts = pdf["text"].tolist()
            part = np.cumsum([len(t) for t in texts]) // CHARS
            for k in np.unique(part):
                split = [common.words(texts[i]) for i in np.flatnonzero(part == k)]
                known = count_words(vocabulary, set().union(*split))
                for ws in split:
                    got = np.array([known[w] for w in ws], np.int64).reshape(-1, 2).sum(axis=0)
                    out.append((len(ws), got[0], got[1]))
            n = np.array(out, np.int64).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_pretokens": n[:, 0], "n_tokens": n[:, 1], "n_byte_tokens": n[:, 2]})

    return rows.mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long, n_byte_tokens long")
