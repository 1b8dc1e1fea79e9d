"""Suffix-array dedup: finds every string of a given size that also starts elsewhere, and removes what it covers.

A Rule says what a string is: so many bytes, or so many words (runs of bytes that are no ASCII white space; how
much of it is between them doesn't matter). Both go the same way, at the same time. A string is dealt to the least
hash of its substrings of `gram` units. Equal strings have the same least hash, so each bucket can be searched alone,
and neighbouring starts mostly share their least hash, so a text falls into pieces of neighbouring starts (each piece
with the units its last string needs): about one row for 170 bytes, or for 22 words. Three cases follow from one
aggregation by bucket, with partial sums before the shuffle:

- one piece, which doesn't repeat itself: none of its strings is repeated;
- several equal pieces: all their strings are repeated, and no text needs to be fetched;
- different pieces, or one that may repeat itself: their texts are fetched, one of each, and a suffix array over the bucket's pieces is built.

The suffix array is built by two-stage sorting: suffixes smaller than their successors are sorted directly; the
others are induced by scanning the buckets of the first byte in order, a bucket's induced part coming before its
sorted part. Common prefixes of neighbours in it tell the repeated strings. Only starts that a piece owns are ordered.

A bucket of more than `hot` different pieces (a licence line in many documents, say) is dealt out anew: where the
least substring lies within a string, to a quarter of the possible places, and what then must stand beside it, are the
same in equal strings, so they make a new, much finer key, and the new buckets go the same way. Only where one of these
is still hot, as at the ends of a passage that very many documents share, its strings are counted by 128-bit hashes,
which gives the same rows. Joins on a bucket's key read both sides from plain shuffles, so that adaptive execution can
split a hot key's rows.

Cases: null and empty texts and texts of fewer units have nothing removed. Very long texts are many pieces; only the
last pass holds a whole one. Equal texts, repeated rows included, are repeats of each other, but rows of one doc_id
and text count as one document where a rule asks for other documents. Null doc_ids are kept. Ties don't matter: every
occurrence is covered. An empty table gives an empty result. Other columns pass through, but those named like a result
column are replaced. Jobs run when the query is built; tables between them are deleted at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, joined, mix, skewed_join, slices, span_hash, spaced, spill, utf8

REPEAT = 400
PASSAGE = 51
#: Starts of one piece at most, bytes that one suffix array should have, pieces of a bucket that it takes.
PIECE = 1024
CHUNK = 2 << 20
HOT = 500
#: A word of more bytes is compared by a 128-bit hash.
LONG_WORD = 64
#: Parts of the places at which the least substring may lie, when a hot bucket is dealt out anew.
PARTS = 4
RESULT = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)
TOLD = T.StructType([T.StructField("n_shared", T.LongType())])
RUNS = "array<struct<a:int,b:int>>"
RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def short(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\1" + xxhash.xxh3_128_hexdigest(word).encode()


@dataclass(frozen=True)
class Rule:
    """Strings of `size` bytes, or words, that start anywhere else, or (across) in another document."""

    size: int
    words: bool = False
    across: bool = False

    @property
    def gram(self) -> int:
        return 8 if self.words else 64

    @property
    def window(self) -> int:
        return self.size - self.gram + 1

    @property
    def least_bytes(self) -> int:
        return 2 * self.size - 1 if self.words else self.size

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview, int]:
        """A hash of every unit of all texts, each text's first unit and number of them, and bytes that tell units
        apart, with how many each has."""
        if not self.words:
            a, marks = joined(texts)
            return _TABLE[a], marks[:-1] + 1, np.diff(marks) - 1, memoryview(a), 1
        a, start, end, cut = spaced(texts)
        h = span_hash(a, start, end)
        return h, cut[:-1], np.diff(cut), memoryview(h).cast("B"), 8

    def cut(self, text: bytes, spots: list[tuple[int, int]]) -> list[bytes]:
        """The strings that start at n units from start on, as far as the last of them goes, for each (start, n)."""
        if not self.words:
            return [text[a : a + n + self.size - 1] for a, n in spots]
        words = text.split()
        return [b" ".join(map(short, words[a : a + n + self.size - 1])) + b" " for a, n in spots]

    def places(self, piece: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n strings of a piece start, and their bytes."""
        if not self.words:
            return np.arange(n), np.full(n, self.size)
        ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 32) + 1
        starts = np.append(0, ends[:-1])[:n]
        return starts, ends[self.size - 1 : self.size - 1 + n] - starts

    def bytes_of(self, text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of units as spans of bytes."""
        if not self.words or not spans:
            return spans
        _, start, end, _ = spaced([text])
        return [(int(start[a]) - 1, int(end[b - 1]) - 1) for a, b in spans]


def least_hashes(symbols: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the substring at each place, and the least one within the string there, by doubling."""
    h, size = symbols, 1
    while size < rule.gram:
        h = h[:-size] * (_STEP + np.uint64(2 * size)) + h[size:]
        size *= 2
    grams = h = mix(h)
    window, size = rule.window, 1
    while 2 * size <= window:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return grams, np.minimum(h[: len(h) - (window - size)], h[window - size :]) if window > size else h


def pieces(texts: list[bytes], rule: Rule) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, bucket, hash of the units, whether the bucket's substring is in it
    twice, so that it may repeat itself) of every piece."""
    empty = np.zeros(0, np.int64)
    symbols, first, count, view, width = rule.symbols(texts)
    if len(symbols) < rule.size:
        return (empty,) * 5 + (empty.astype(bool),)
    grams, least = least_hashes(symbols, rule)
    n = len(least)
    change = np.ones(n, bool)
    change[1:] = least[1:] != least[:-1]
    change[first[first < n]] = True
    # starts that are valid: those of each text of enough units
    stop = first + np.maximum(count - rule.size + 1, 0)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(first, n), 1)
    np.add.at(edge, np.minimum(stop, n), -1)
    valid = np.cumsum(edge[:-1]) > 0
    change[1:] |= valid[1:] != valid[:-1]
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, n))
    on = valid[start]
    start, size = start[on], size[on]
    text = np.searchsorted(first, start, "right") - 1
    # only a substring that is in the batch twice can be in a piece twice; a bitmap finds the places in question
    own, mask = least[start], np.uint64((1 << 22) - 1)
    near = np.zeros(1 << 22, bool)
    near[(own & mask).astype(np.int64)] = True
    seen = np.sort(grams[near[(grams & mask).astype(np.int64)]])
    twice = np.isin(own, seen[1:][seen[1:] == seen[:-1]])
    for i in np.flatnonzero(twice).tolist():
        twice[i] = np.count_nonzero(grams[start[i] : start[i] + size[i] + rule.window - 1] == own[i]) > 1
    cuts = -(-size // PIECE)
    if len(cuts) and cuts.max() > 1:
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, size = np.repeat(start, cuts) + k * PIECE, np.minimum(np.repeat(size, cuts) - k * PIECE, PIECE)
        text, twice = np.repeat(text, cuts), np.repeat(twice, cuts)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(view[p * width : (p + k + rule.size - 1) * width]) for p, k in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(start))
    bucket = least[start] ^ np.uint64(rule.words)
    return text, start - first[text], size, bucket.view(np.int64), hashes.view(np.int64), twice


def finer(piece: bytes, n: int, rule: Rule) -> list[tuple[int, int, int, int]]:
    """A piece of a hot bucket, dealt out anew: (first start, number of starts, bucket, hash of the units) of its parts."""
    symbols, first, _, view, width = rule.symbols([piece])
    base = int(first[0])
    grams, least = least_hashes(symbols, rule)
    step = -(-rule.window // PARTS)
    key = []
    for p in range(n):
        at = int(np.argmax(grams[base + p : base + p + rule.window] == least[base + p]))
        key.append((p + at, at // step))
    out, p = [], 0
    while p < n:
        q = p + 1
        while q < n and key[q] == key[p]:
            q += 1
        at, part = key[p]
        low, high = part * step, min(part * step + step, rule.window) - 1
        beside = xxhash.xxh3_64_intdigest(view[(base + at - low) * width : (base + at + rule.size - high) * width], seed=2 * part + rule.words)
        whole = xxhash.xxh3_64_intdigest(view[(base + p) * width : (base + q + rule.size - 1) * width])
        out.append((p, q - p, beside, whole))
        p = q
    return out


def two_stage_order(a: np.ndarray, owned: np.ndarray, depth: int) -> np.ndarray:
    """The places where owned is true, ordered by their first depth bytes; a ends with a 1 after depth zeros."""
    n = len(a)
    step = np.sign(a[1:].astype(np.int16) - a[:-1])
    step = np.append(step, 0)
    # an equal neighbour decides nothing: the next place that differs does
    differs = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(differs[::-1])[::-1]] >= 0
    # an induced place needs its successor, up to the next directly sorted one
    taken = owned.copy()
    open_ = np.flatnonzero(owned[:-1] & ~owned[1:] & ~smaller[:-1])
    while len(open_):
        open_ = open_ + 1
        taken[open_] = True
        open_ = open_[~smaller[open_] & ~taken[np.minimum(open_ + 1, n - 1)]]
    buf = a.tobytes()
    words = np.ndarray((n - 7,), ">u8", buf, 0, (1,))
    direct = np.flatnonzero(taken & smaller)
    direct = direct[direct < n - 7]
    keys = words[direct].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    direct, keys = direct[order], keys[order]
    cut = np.flatnonzero(np.append(True, np.append(keys[1:] != keys[:-1], True)))
    placed = direct.tolist()
    for i in np.flatnonzero(np.diff(cut) > 1).tolist():
        x, y = int(cut[i]), int(cut[i + 1])
        placed[x:y] = sorted(placed[x:y], key=lambda p: buf[p + 8 : p + depth])
    direct = np.array(placed, np.int64)
    bounds = np.searchsorted(a[direct], np.arange(257))
    # induce: a place before one just scanned goes to the end of its own bucket's induced part
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    inducible = taken & ~smaller
    out = []
    for c in range(256):
        part = waiting[c]
        last = np.concatenate(part) if part else np.zeros(0, np.int64)
        part = [last]
        while len(last):
            last = last[last > 0] - 1
            last = last[inducible[last] & (a[last] == c)]
            part.append(last)
        bucket = np.concatenate([*part, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[inducible[before]]
        first = a[before]
        on = first > c
        before, first = before[on], first[on]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        at = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
        for b, e in zip(at, np.append(at[1:], len(first)), strict=True) if len(first) else ():
            waiting[first[b]].append(before[b:e])
    whole = np.concatenate(out) if out else np.zeros(0, np.int64)
    return whole[owned[whole]]


def common_prefixes(a: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each a[p:] and a[q:] have in common, up to depth (a multiple of 8)."""
    words = np.ndarray((len(a) - 7,), ">u8", a.tobytes(), 0, (1,))
    out = np.full(len(p), depth, np.int64)
    on = np.arange(len(p))
    for k in range(0, depth, 8):
        x = words[p[on] + k] ^ words[q[on] + k]
        off = x != 0
        if off.any():
            bits = np.floor(np.log2(x[off].astype(np.float64))).astype(np.int64)
            out[on[off]] = k + np.minimum((63 - np.minimum(bits, 63)) // 8, 7)
            on = on[~off]
        if not len(on):
            break
    return out


def repeated(rows: list[tuple[bytes, int, int, int, int]], rule: Rule) -> list[np.ndarray]:
    """For pieces of one or more buckets (bytes, number of starts, how often, least and greatest document): the
    numbers of the starts whose string is repeated."""
    held = [rule.places(t, n) for t, n, *_ in rows]
    sizes = np.array([len(t) for t, *_ in rows])
    base = np.cumsum(sizes) - sizes
    places = np.concatenate([p + b for (p, _), b in zip(held, base.tolist(), strict=True)])
    need = np.concatenate([x for _, x in held])
    depth = -(-int(need.max()) // 8) * 8
    a = np.frombuffer(b"".join(t for t, *_ in rows) + b"\0" * (depth + 8) + b"\1", np.uint8)
    owned = np.zeros(len(a), bool)
    owned[places] = True
    order = two_stage_order(a, owned, depth)
    at = np.searchsorted(places, order)
    same = common_prefixes(a, order[:-1], order[1:], depth) >= need[at[:-1]]
    group = np.flatnonzero(np.append(True, ~same))
    owner = np.repeat(np.arange(len(rows)), [n for _, n, *_ in rows])[at]
    of = lambda i: np.array([r[i] for r in rows], np.int64)[owner]
    if rule.across:
        yes = np.minimum.reduceat(of(3), group) < np.maximum.reduceat(of(4), group)
    else:
        yes = np.add.reduceat(of(2), group) > 1
    hit = np.zeros(len(places), bool)
    hit[at] = np.repeat(yes, np.diff(np.append(group, len(order))))
    ends = np.cumsum([n for _, n, *_ in rows])
    return [np.flatnonzero(hit[e - n : e]) for e, (_, n, *_) in zip(ends.tolist(), rows, strict=True)]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of sorted places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + 1).tolist(), strict=True))


def _occurrences(keyed: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pieces of all texts: where (k1, k2: the document; start), how long, bucket h, hash sh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                texts = utf8(batch.column("t"))
                for number, rule in enumerate(rules):
                    i, start, n, h, sh, twice = pieces(texts, rule)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(take), batch.column("k2").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(i), number, np.int8)), pa.array(h), pa.array(sh), pa.array(twice)],
                        names=["k1", "k2", "start", "n", "rule", "h", "sh", "twice"],
                    )

    return keyed.filter(F.octet_length("t") >= min(r.least_bytes for r in rules)).mapInArrow(run, "k1 long, k2 long, start int, n int, rule byte, h long, sh long, twice boolean")


def _piece_texts(keyed: DataFrame, wanted: DataFrame, rules: list[Rule]) -> DataFrame:
    """wanted with piece, the bytes of each, from the text that `at` names."""
    names = ["rule", "h", "sh", "n", "m", "lo", "hi", "hot"]
    spots = wanted.select("at.k1", "at.k2", F.struct("at.start", *names).alias("s")).groupBy("k1", "k2").agg(F.collect_list("s").alias("s"))
    both = keyed.join(spots, ["k1", "k2"]).select("t", "s")
    schema = pa.schema([("rule", pa.int8()), ("h", pa.int64()), ("sh", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("hot", pa.bool_()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                rows, size = [], 0
                for t, spots_ in zip(utf8(batch.column("t")), batch.column("s").to_pylist(), strict=True):
                    for number, rule in enumerate(rules):
                        own = [x for x in spots_ if x["rule"] == number]
                        for x, piece in zip(own, rule.cut(t, [(x["start"], x["n"]) for x in own]) if own else (), strict=True):
                            rows.append({c: x[c] for c in names} | {"piece": piece})
                            size += len(piece)
                            if size >= CHUNK:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return both.mapInArrow(run, "rule byte, h long, sh long, n int, m long, lo long, hi long, hot boolean, piece binary")


def _sorted_runs(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """h, sh, r: the repeated starts of the pieces of each bucket, by suffix arrays over whole buckets."""
    names = ("rule", "h", "sh", "n", "m", "lo", "hi", "piece")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, (None, None)

        def flush() -> pa.RecordBatch:
            rule = rules[last[0]]
            found = repeated([(t, n, m, lo, hi) for _, _, _, n, m, lo, hi, t in held], rule)
            rows = [(h, sh, runs(x)) for (_, h, sh, *_), x in zip(held, found, strict=True) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], RUNS_ARROW)], names=["h", "sh", "r"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and row[:2] != last and (size >= CHUNK or row[0] != last[0]):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = row[:2]
        if held:
            yield flush()

    return texts.select(*names).repartition("h").sortWithinPartitions("rule", "h", "sh").mapInArrow(run, f"h long, sh long, r {RUNS}")


def _counted_runs(texts: DataFrame, rules: list[Rule], scratch: Scratch) -> DataFrame:
    """As _sorted_runs, for buckets that stay hot: strings are counted by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "piece", 1 << 18):
                rows = []
                for number, h, sh, n, m, lo, hi, t in zip(*(batch.column(c).to_pylist() for c in ("rule", "h", "sh", "n", "m", "lo", "hi", "piece")), strict=True):
                    for i, (p, x) in enumerate(zip(*(v.tolist() for v in rules[number].places(t, n)), strict=True)):
                        g = xxhash.xxh3_128_intdigest(t[p : p + x], seed=number)
                        rows.append((number, h, sh, m, lo, hi, i, (g >> 64) - (1 << 63), (g & ((1 << 64) - 1)) - (1 << 63)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int8(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["rule", "h", "sh", "m", "lo", "hi", "p", "g1", "g2"])

    rows = texts.mapInArrow(run, "rule byte, h long, sh long, m long, lo long, hi long, p int, g1 long, g2 long")
    twice = rows.groupBy("g1", "g2").agg(F.first("rule").alias("rule"), F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(_elsewhere(rules)).select("g1", "g2")
    hit = skewed_join(rows.select("h", "sh", "p", "g1", "g2"), scratch.spill(twice), ["g1", "g2"]).groupBy("h", "sh").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = [[{"a": a, "b": b} for a, b in runs(np.array(p))] for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("sh"), pa.array(r, RUNS_ARROW)], names=["h", "sh", "r"])

    return hit.mapInArrow(join, f"h long, sh long, r {RUNS}")


def _elsewhere(rules: list[Rule]):
    """Whether m occurrences in the documents lo to hi are repeats."""
    across = [i for i, r in enumerate(rules) if r.across]
    return F.when(F.col("rule").isin(across), F.col("lo") < F.col("hi")).otherwise(F.col("m") > 1)


def _finer(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pieces of hot buckets as texts of their own, with occurrences in finer buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, h, sh, n, m, lo, hi, t in zip(*(batch.column(c).to_pylist() for c in ("rule", "h", "sh", "n", "m", "lo", "hi", "piece")), strict=True):
                for start, k, bucket, own in finer(t, n, rules[number]):
                    rows.append((h, sh, start, k, number, bucket - (1 << 63), own - (1 << 63), m, lo, hi))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k1", "k2", "start", "n", "rule", "h", "sh", "m", "lo", "hi"])

    found = texts.mapInArrow(run, "k1 long, k2 long, start int, n int, rule byte, h long, sh long, m long, lo long, hi long")
    return found.withColumn("twice", F.lit(False))  # strings of one part differ in the place of the least substring


def search(keyed: DataFrame, occurs: DataFrame, rules: list[Rule], hot: int, scratch: Scratch, last: bool = False) -> DataFrame:
    """k1, k2, rule, start, r: the repeated starts, from start on. keyed: k1, k2, t; occurs: what _occurrences gives,
    with m, lo and hi, how often and in which documents each is."""
    occurs = scratch.spill(occurs)
    sums = [F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    buckets = occurs.groupBy("h").agg(*sums, F.first("rule").alias("rule"), F.min("sh").alias("x"), F.max("sh").alias("y"), F.max("twice").alias("twice"))
    alone = ~F.col("twice") | F.col("rule").isin([i for i, r in enumerate(rules) if r.across])
    buckets = buckets.filter(_elsewhere(rules) | ~alone).select("h", (F.col("twice") | (F.col("x") != F.col("y"))).alias("sort"))
    hits = scratch.spill(skewed_join(occurs.drop("twice"), scratch.spill(buckets), ["h"]))
    distinct = hits.filter("sort").groupBy("rule", "h", "sh", "n").agg(*sums, F.min(F.struct("k1", "k2", "start")).alias("at"))
    distinct = scratch.spill(distinct)
    large = scratch.spill(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot).select("h", F.lit(True).alias("hot")))
    any_hot = not large.isEmpty()
    marked = skewed_join(distinct, large, ["h"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else distinct.withColumn("hot", F.lit(False))
    texts = scratch.spill(_piece_texts(keyed, marked, rules))
    found = _sorted_runs(texts.filter("not hot"), rules)
    if any_hot and last:
        found = found.unionByName(_counted_runs(texts.filter("hot"), rules, scratch))
    elif any_hot:
        parts = texts.filter("hot")
        below = search(parts.select(F.col("h").alias("k1"), F.col("sh").alias("k2"), F.col("piece").alias("t")), _finer(parts, rules), rules, hot, scratch, True)
        shifted = F.transform("r", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
        found = found.unionByName(below.select(F.col("k1").alias("h"), F.col("k2").alias("sh"), shifted.cast(RUNS).alias("r")))
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(RUNS)
    whole = hits.filter("not sort").select("k1", "k2", "rule", "start", all_of.alias("r"))
    parts = skewed_join(hits.filter("sort"), scratch.spill(found), ["h", "sh"]).select("k1", "k2", "rule", "start", "r")
    return whole.unionByName(parts)


def _keys(doc_id: str, text: str) -> list:
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))]


def spans(docs: DataFrame, rules: list[Rule], doc_id: str, text: str, hot: int, scratch: Scratch) -> DataFrame:
    """k1, k2, s: the covered intervals of units, unmerged, of every document that has some."""
    k1, k2 = _keys(doc_id, text)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("t"))
    occurs = _occurrences(keyed, rules).select("*", F.lit(1).cast("long").alias("m"), F.col("k1").alias("lo"), F.col("k1").alias("hi"))
    found = search(keyed, occurs, rules, hot, scratch)
    size = F.element_at(F.array(*[F.lit(r.size) for r in rules]), F.col("rule") + 1)
    x = F.col("x")
    cover = found.select("k1", "k2", "rule", "start", F.explode("r").alias("x")).select("k1", "k2", "rule", (F.col("start") + x.a).alias("a"), (F.col("start") + x.b + size - 1).alias("b"))
    return cover.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("rule", "a", "b")).alias("s"))


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals as maximal runs."""
    out: list[list[int]] = []
    for x in sorted(found):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: Rule = Rule(REPEAT), tell: Rule | None = None, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 of what `cut` removes; with `tell` also n_shared, the bytes
    that its strings cover, which stay. With keep_text, the text column holds what is left (bytes of code points that a
    cut went through are left out with it; a null text becomes empty); without, it is dropped."""
    bounded(docs.sparkSession)
    rules = [cut, tell] if tell else [cut]
    fields_ = RESULT.fields + (TOLD.fields if tell else [])
    names = [c for c in docs.columns if c not in {f.name for f in fields_} and (keep_text or c != text)]
    with Scratch(docs.sparkSession) as scratch:
        found = spill(spans(docs, rules, doc_id, text, hot, scratch)).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "s": "_s"})
    both = docs.select(*dict.fromkeys([*names, text]), *[k.alias(f"_k{i}") for i, k in enumerate(_keys(doc_id, text), 1)]).join(found, ["_k1", "_k2"], "left").select(*dict.fromkeys([*names, text]), "_s")
    out = T.StructType([*[docs.schema[c] for c in names], *fields_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for whole in batches:
            for batch in slices(whole, text):
                made: list[list] = [[] for _ in fields_]
                left_over = []
                for t, s in zip(utf8(batch.column(text)), batch.column("_s").to_pylist(), strict=True):
                    covered = [merged(r.bytes_of(t, merged([(x["a"], x["b"]) for x in s or () if x["rule"] == i]))) for i, r in enumerate(rules)]
                    gone = covered[0]
                    if gone:
                        ends = [0, *[x for c in gone for x in c], len(t)]
                        left = b"".join(t[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                    else:
                        left = t
                    shared = sum(b - a for a, b in covered[-1])
                    for m, x in zip(made, (len(t), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), shared), strict=False):
                        m.append(x)
                    left_over.append(left.decode(errors="ignore") if keep_text else None)
                columns = [pa.array(left_over, schema.field(c).type) if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(m, schema.field(f.name).type) for m, f in zip(made, fields_, strict=True)]], names=schema.names)

    return both.mapInArrow(run, out)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, n_shared: the bytes in passages of over 50 words that other documents have too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs, cut=Rule(REPEAT), tell=Rule(PASSAGE, words=True, across=True))
