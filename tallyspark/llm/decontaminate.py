"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised words.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII code points. A benchmark item gives one pattern for
each run of ten words; an item of fewer words, but not none, gives one pattern. A text becomes its words joined
by single spaces, so a pattern occurs as bytes between separators or not at all.

Search: m is the least pattern length and B the block length. The shift table says, for the hash of a block, how
far the window may move without passing a pattern's first m bytes; only where it says 0 do the patterns of that
block's bucket get compared byte by byte. Many windows of one batch move at once, each over its own stretch.

Cases: null and empty texts and texts without words have no hits. Items without words give no pattern; a null
item_id is named "null"; items with equal windows are all listed, and a window of very many items is dealt to passes in chunks. An empty benchmark leaves every document clean.
Equal rows get equal results; other columns pass through, but those named like a result column are replaced. Very long texts are searched whole. A text
column of a result's name raises ValueError. The benchmark is read when the query is built.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, bounded, joined, slices, spill, utf8, word_table

WINDOW = 10
#: Bytes of windows, item names and tables that one pass over the documents searches with; what needs more takes several passes.
PASS_BYTES = 64 << 20
#: Bytes that a window takes beside its own and its items' names.
WINDOW_COST = 300
#: Names of items in one row of the windows' table; a window that more items have takes several rows.
NAMES = 10_000
STRETCH = 2048
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
STATE = T.StructType([T.StructField("_hit_words", T.ArrayType(T.IntegerType())), T.StructField("_hit_items", T.ArrayType(T.StringType()))])


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in one array: single spaces between words, 1 between texts; the places of the 1s."""
    raw, marks = joined(texts)
    a = word_table()[raw]
    a[marks] = 1
    gap = a <= 32
    keep = np.ones(len(a), bool)
    keep[1:] = ~((a[1:] == 32) & gap[:-1])
    return a[keep], (np.cumsum(keep) - 1)[marks]


class Patterns:
    """Shift table and suffix buckets of patterns that all have m bytes at least."""

    BITS = 20

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.zeros((len(patterns), m + 8), np.uint8)
        heads[:, :m] = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.BITS, m - b + 1, np.int64)
        for j in range(m - b + 1):
            word = np.ascontiguousarray(heads[:, j : j + 8]).view("<u8")[:, 0] & self.mask
            np.minimum.at(self.shift, self.slot(word), m - b - j)
        self.buckets: dict[int, list[int]] = {}
        for i, w in enumerate(word.tolist()):
            self.buckets.setdefault(w, []).append(i)
        self.last = np.unique(word)
        self.even = len(set(map(len, patterns))) == 1

    def slot(self, word: np.ndarray) -> np.ndarray:
        return ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, a: np.ndarray) -> list[tuple[int, int]]:
        """(place, pattern) of every occurrence between separators in a, which starts and ends with one."""
        n, m, b = len(a), self.m, self.block
        if n < m + 2:
            return []
        padded = np.concatenate((a, np.zeros(8, np.uint8)))
        words = np.ndarray((n,), "<u8", padded.data, 0, (1,))
        end = n - m
        at = np.arange(1, end, STRETCH, dtype=np.int64)
        stop = np.minimum(at + STRETCH, end)
        if m == b:  # no shift passes over a byte: the only places are where words start
            at = np.flatnonzero((a[: end - 1] <= 32) & (a[1:end] > 32)) + 1
            stop = at + 1
        found: list[np.ndarray] = []
        while len(at):
            word = words[at + (m - b)] & self.mask
            move = self.shift[self.slot(word)]
            zero = np.flatnonzero(move == 0)
            if len(zero):
                k = np.minimum(np.searchsorted(self.last, word[zero]), len(self.last) - 1)
                sure = zero[(self.last[k] == word[zero]) & (a[at[zero] - 1] <= 32)]
                if self.even:
                    sure = sure[a[at[sure] + m] <= 32]
                if len(sure):
                    found.append(at[sure])
            at = at + np.maximum(move, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        out = []
        text = a.tobytes() if found else b""
        for p in np.concatenate(found).tolist() if found else ():
            for i in self.buckets[int.from_bytes(text[p + m - b : p + m], "little")]:
                q = p + len(self.patterns[i])
                if text[p:q] == self.patterns[i] and text[q] <= 32:
                    out.append((p, i))
        return out


def windows(text: bytes, size: int) -> list[bytes]:
    """The distinct windows of an item."""
    words = normalised([text])[0].tobytes()[1:-1].split()
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1) if words else 0)))


def windows_table(benchmark: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """win, chunk, names: each distinct window and the items that have it, NAMES of them in a chunk or so."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                found = [windows(t, size) for t in utf8(batch.column("t"))]
                of = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.binary()), batch.column("i").take(of)], names=["win", "i"])

    pairs = items.mapInArrow(run, "win binary, i string").distinct()
    hot = pairs.groupBy("win").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NAMES)
    chunk = F.coalesce(F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / NAMES)), F.lit(0))
    return pairs.join(hot, "win", "left").groupBy("win", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("i")).alias("names"))


def searchers(found: list[tuple[bytes, list[str]]], size: int) -> list[tuple[Patterns, list[list[str]]]]:
    """Full windows and those of short items apart, and these by the power of two that their bytes reach, 16 at most, so
    that a short pattern neither shortens the shifts nor shares the buckets of longer ones."""
    kinds: dict[int, list] = {}
    for w, names in found:
        kinds.setdefault(0 if w.count(b" ") + 1 == size else min(len(w).bit_length(), 5), []).append((w, names))
    return [(Patterns([w for w, _ in part]), [names for _, names in part]) for _, part in sorted(kinds.items())]


def hits(texts: list[bytes], tables: list[tuple[Patterns, list[list[str]]]]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per text: its number of words, the numbers of its hit words, the items found in it."""
    a, marks = normalised(texts)
    starts = np.flatnonzero((a[1:] > 32) & (a[:-1] <= 32)) + 1
    bounds = np.searchsorted(starts, marks)
    edge = np.zeros(len(starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for table, names in tables:
        for p, i in table.search(a):
            w = int(np.searchsorted(starts, p))
            edge[w] += 1
            edge[w + table.patterns[i].count(b" ") + 1] -= 1
            items[int(np.searchsorted(marks, p)) - 1].update(names[i])
    on = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    cut = np.searchsorted(on, bounds)
    return np.diff(bounds), [(on[cut[k] : cut[k + 1]] - bounds[k]).tolist() for k in range(len(texts))], [sorted(x) for x in items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated. The distinct windows are made and grouped by Spark
    and dealt by hash to passes of about pass_bytes each, tables included: the driver holds one pass's windows. One
    pass is one narrow pass over docs, with nothing shuffled; of several, each writes what it found for the next."""
    spark = docs.sparkSession
    bounded(spark)
    with Scratch(spark) as scratch:
        table = scratch.spill(windows_table(benchmark, item_id, item_text, window))
        names = F.aggregate("names", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 60)
        cost = table.agg(F.sum(F.octet_length("win") + names + WINDOW_COST)).first()[0] or 0
        passes = max(1, math.ceil(cost / pass_bytes))
        out = docs
        for n in range(passes):
            part = table if passes == 1 else table.filter(F.pmod(F.xxhash64("win", "chunk"), F.lit(passes)) == n)
            found = [(bytes(r["win"]), list(r["names"])) for r in part.orderBy("win", "chunk").collect()]  # about pass_bytes
            shared = spark.sparkContext.broadcast(searchers(found, window))
            last = n == passes - 1
            out = _pass(out, text, shared, n == 0, last)
            if not last:
                out = spill(out)
                shared.unpersist()
    return out


def _pass(df: DataFrame, text: str, shared, first: bool, last: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        n_words, words, items = hits(utf8(batch.column(text)), shared.value)
        if not first:
            words = [sorted({*a, *b}) if b else a for a, b in zip(words, batch.column("_hit_words").to_pylist(), strict=True)]
            items = [sorted({*a, *b}) if b else a for a, b in zip(items, batch.column("_hit_items").to_pylist(), strict=True)]
        if not last:
            return [words, items]
        n_hit = [len(x) for x in words]
        return [n_words, n_hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [x > 0 for x in n_hit]]

    done = append_columns(df, RESULT if last else STATE, text, make)
    return done.drop("_hit_words", "_hit_items") if last else done


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM bw) AS s, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT r, i, bw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
wh AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) AS t(j) GROUP BY r),
ih AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wh USING (r) LEFT JOIN ih USING (r)
"""
