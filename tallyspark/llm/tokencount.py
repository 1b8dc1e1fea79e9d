"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, at each place of a word, the longest vocabulary entry that starts there. The
counts come from one walk over a trie of the vocabulary: where the trie has no way on, the node's failure link says
where to go on, and its precomputed count how many pieces that gives up for good. No piece is ever built, and each
symbol is looked at a constant number of times (amortised). Many words walk at once, one symbol a step, and equal
words of a batch walk once.

A word is a run of letters (ASCII letters and all non-ASCII code points), one digit, or a run of other characters;
ASCII white space and control characters separate. A-Z are lower-cased. The symbols of a word are its UTF-8 bytes,
the last one marked as an end, as the vocabulary marks its entries; the vocabulary has every byte in both kinds, so
each word can be tokenised.

Cases: null and empty texts have no words. Repeated rows get equal counts; other columns pass through, but those
named like a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, joined, span_hash, utf8

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def byte_letters() -> dict[str, int]:
    """The code points by which byte-level vocabularies write the 256 bytes: printable Latin-1 ones stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The entries as symbols: a byte, plus 256 if it ends a word."""
    letters = byte_letters()
    out = []
    with open(path, encoding="utf-8") as f:
        for entry in json.load(f)["model"]["vocab"]:
            ends = entry.endswith(END)
            word = entry[: -len(END)] if ends else entry
            if word and all(c in letters for c in word):
                s = [letters[c] for c in word]
                s[-1] += 256 * ends
                out.append(tuple(s))
    return out


class Automaton:
    """The trie as sorted (node, symbol) keys, with failure links and popped counts."""

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        nodes: list[dict[int, int]] = [{}]
        accepted: set[int] = set()
        for entry in vocabulary:
            at = 0
            for s in entry:
                if s not in nodes[at]:
                    nodes[at][s] = len(nodes)
                    nodes.append({})
                at = nodes[at][s]
            accepted.add(at)
        if len(nodes[0]) < 512:
            raise ValueError("the vocabulary lacks single bytes, so not every word can be tokenised")
        fail, pops, total = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
        level = [0]
        while level:
            below = []
            for u in level:
                for s, v in nodes[u].items():
                    below.append(v)
                    if v in accepted:
                        fail[v], pops[v] = 0, 1
                    else:
                        z, n = fail[u], pops[u]
                        while s not in nodes[z]:
                            n += pops[z]
                            z = fail[z]
                        fail[v], pops[v] = nodes[z][s], n
                    total[v] = pops[v] + total[fail[v]]
            level = below
        keys = np.array([u * 512 + s for u, n in enumerate(nodes) for s in n], np.int64)
        to = np.array([v for n in nodes for v in n.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.fail, self.pops, self.total = np.array(fail, np.int32), np.array(pops, np.int32), np.array(total, np.int32)
        # each node's own stretch of the keys
        self.first = np.searchsorted(self.keys, np.arange(len(nodes) + 1, dtype=np.int64) * 512).astype(np.int32)
        self.table()

    def table(self) -> None:
        """The keys again as an open hash table, whose probes are bounded by the longest seen."""
        bits = int(2 * len(self.keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.slots, self.values = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        left = np.arange(len(self.keys))
        home = self.home(self.keys)
        self.probes = 0
        while len(left):
            at = home[left] + self.probes
            free = self.slots[at] < 0
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            won = one[free[one]]
            self.slots[at[won]], self.values[at[won]] = self.keys[left[won]], self.to[left[won]]
            left = np.delete(left, won)
            self.probes += 1
        if self.probes > 64:
            raise ValueError("the hash table is too full")

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        keys = node.astype(np.int64) * 512 + symbol
        at = self.home(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.values[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for p in range(1, self.probes):
            if not len(open_):
                break
            a = at[open_] + p
            seen = self.slots[a]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[a[hit]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def count(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of pieces of each word symbols[start:end]."""
        order = np.argsort(start - end, kind="stable")  # longest first, so those still walking are a prefix
        at, size = start[order], (end - start)[order]
        node, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        live = len(at)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -k, "left"))
            to = self.step(node[:live], symbols[at[:live] + k])
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                n[stuck] += self.pops[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                to[stuck] = self.step(node[stuck], symbols[at[stuck] + k])
                stuck = stuck[to[stuck] < 0]
            node[:live] = to
        n += self.total[node]
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out


def kinds() -> np.ndarray:
    """Of each byte: 0 separates, 1 letter, 2 digit, 3 other."""
    k = np.full(256, 3, np.uint8)
    k[:0x21] = 0
    k[0x7F] = 0
    k[0x30:0x3A] = 2
    k[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    return k


def count_tokens(texts: list[bytes], automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each text."""
    raw, marks = joined(texts)
    kind = kinds()[raw]
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    a = lower[raw]
    new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(a))
    on = kind[starts] > 0
    starts, ends = starts[on], ends[on]
    symbols = a.astype(np.int64)
    symbols[ends - 1] += 256
    _, one, where = np.unique(span_hash(a, starts, ends), return_index=True, return_inverse=True)
    sums = np.append(0, np.cumsum(automaton.count(symbols, starts[one], ends[one])[where]))
    cut = np.searchsorted(starts, marks)
    return np.diff(cut), np.diff(sums[cut])


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_words and n_tokens, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))  # of the vocabulary's size
    return append_columns(docs, RESULT, text, lambda batch: [pa.array(x) for x in count_tokens(utf8(batch.column(text)), shared.value)])


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_words", "n_tokens")
