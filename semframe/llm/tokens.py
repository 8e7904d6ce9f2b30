"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: *speculate and verify*.  The distinct words of an Arrow batch are cut by greedy longest match.  A cut is the
true encoding if and only if every two neighbouring tokens are compatible, that is, if merging the pair's bytes from
scratch would leave the border between them; that test runs for all pairs of the batch at once in numpy.  Only words
with an incompatible pair are merged exactly, in rank order.

Why the test is right: merging proceeds by rank.  Undo the last merge on either side of the border, always the younger
one; a vocabulary entry that would join the two sides with a rank below the last undone merge would have been taken
first, so the border would not exist.  If both sides are down to single bytes, nothing joins them.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; a text
of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Folder of the public vocabularies; a parameter of every function here.
VOCAB_DIR = os.environ.get("SEMFRAME_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the public pre-tokenisation pattern of the 50k byte-level vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words remembered per Python worker; a cache only, it is emptied when full.
WORD_CACHE = 400_000


def _byte_letters() -> dict[str, int]:
    """The published byte alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class ByteBPE:
    """Vocabulary, merge table and undo table of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        specials = {s for s in model["vocab"] if any(c not in letters for c in s)}
        self.ids: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            if s not in specials and s != "<|endoftext|>":
                self.ids[raw(s)] = i
        size = max(self.ids.values()) + 2
        self.size = size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([model["vocab"][a] for a, _ in merges], dtype=np.int64)
        right = np.array([model["vocab"][b] for _, b in merges], dtype=np.int64)
        made = np.array([model["vocab"][a + b] for a, b in merges], dtype=np.int64)
        # age[t]: 0 for bytes, else 1 + rank of the merge that makes t; undo[t]: its two parts
        self.age = np.zeros(size, dtype=np.int64)
        self.age[made] = np.arange(1, len(merges) + 1)
        self.undo_l, self.undo_r = np.arange(size), np.arange(size)
        self.undo_l[made], self.undo_r[made] = left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.key_age = keys[order], self.age[made][order]
        self.rank = {(int(a), int(b)): (k, int(m)) for k, (a, b, m) in enumerate(zip(left, right, made))}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.longest: dict[int, int] = {}
        for t in self.ids:
            self.longest[t[0]] = max(self.longest.get(t[0], 1), len(t))
        self.words = regex.compile(WORD_PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    # --- speculate -------------------------------------------------------------------------------------------------
    def propose(self, word: bytes) -> list[int]:
        ids, longest = self.ids, self.longest
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + longest[word[at]])
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    # --- verify ----------------------------------------------------------------------------------------------------
    def joins_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Age of the merge that joins each pair; a huge number where none does."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.key_age[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each neighbouring pair, whether the border between the two tokens survives exact merging."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            joined = self.joins_at(a, b)
            bad = joined < limit
            ok[live[bad]] = False
            age_a, age_b = self.age[a], self.age[b]
            go = ~bad & ((age_a > 0) | (age_b > 0))
            live, a, b, age_a, age_b = live[go], a[go], b[go], age_a[go], age_b[go]
            # the younger side comes apart; of equals (the same token twice) the left one was made first
            from_left = age_a > age_b
            limit = np.where(from_left, age_a, age_b + 1)
            a, b = np.where(from_left, self.undo_r[a], a), np.where(from_left, b, self.undo_l[b])
        return ok

    # --- exact -----------------------------------------------------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """Exact merging in rank order, leftmost first, with a heap over a linked list: O(n log n)."""
        tok = [self.byte_id[c] for c in word]
        n = len(tok)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (r := self.rank.get((tok[i], tok[i + 1]))) is not None:
                heap.append((r[0], i, tok[i], tok[i + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or tok[i] != x or tok[j] != y:
                continue
            tok[i], alive[j] = made, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := self.rank.get((made, tok[nxt[i]]))) is not None:
                    heapq.heappush(heap, (r[0], i, made, tok[nxt[i]], r[1]))
            if prv[i] >= 0 and (r := self.rank.get((tok[prv[i]], made))) is not None:
                heapq.heappush(heap, (r[0], prv[i], tok[prv[i]], made, r[1]))
        return [tok[i] for i in range(n) if alive[i]]

    def learn(self, words: list[str]) -> None:
        """Put the encodings of ``words`` (distinct, not cached) into the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        cuts = [self.propose(w) for w in raw]
        sizes = np.fromiter((len(c) for c in cuts), dtype=np.int64, count=len(cuts))
        many = np.flatnonzero(sizes > 1)
        if len(many):
            flat = np.concatenate([np.asarray(cuts[i], dtype=np.int64) for i in many])
            owner = np.repeat(many, sizes[many])
            inner = owner[:-1] == owner[1:]
            ok = self.compatible(flat[:-1][inner], flat[1:][inner])
            for i in np.unique(owner[:-1][inner][~ok]):
                cuts[i] = self.merge(raw[i])
        for w, c in zip(words, cuts):
            self.cache[w] = tuple(c)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > WORD_CACHE:
            self.cache.clear()
        fresh = {w for p in pieces for w in p if w not in self.cache}
        if fresh:
            self.learn(list(fresh))
        get = self.cache.__getitem__
        out = []
        for p in pieces:
            ids: list[int] = []
            for w in p:
                ids += get(w)
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", folder: str = VOCAB_DIR) -> ByteBPE:
    return ByteBPE(os.path.join(folder, f"{name}.json"))


#: Rows encoded at once; bounds what a worker holds besides the Arrow batch.
BLOCK = 256


def token_ids(text: Column | str, name: str = "byte_bpe_50k", folder: str = VOCAB_DIR) -> Column:
    """``array<int>`` of token ids; empty for a null or empty text."""

    @pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        bpe, values = load(name, folder), [None if t is None or t is pd.NA or t != t else t for t in s]
        return pd.Series([np.asarray(x, dtype=np.int32) for k in range(0, len(values), BLOCK) for x in bpe.encode(values[k : k + BLOCK])], dtype=object)

    return ids(text)


def token_count(text: Column | str, name: str = "byte_bpe_50k", folder: str = VOCAB_DIR) -> Column:
    """Number of tokens; 0 for a null or empty text."""

    @pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        bpe, values = load(name, folder), [None if t is None or t is pd.NA or t != t else t for t in s]
        return pd.Series([len(x) for k in range(0, len(values), BLOCK) for x in bpe.encode(values[k : k + BLOCK])], dtype="int64")

    return count(text)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCAB_DIR) -> DataFrame:
    """``key, ids``: every row of ``docs`` with the token ids of its text; rows that repeat stay repeated."""
    return docs.select(F.col(key), token_ids(F.col(text), name, folder).alias("ids"))
