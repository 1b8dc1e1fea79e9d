"""Phrase collocation mining by contiguous pattern growth.

Texts are lower-cased (A-Z), cut into pieces at PIECE bytes and those into words at spaces and tabs. Within a language
(null: NO_LANGUAGE) a candidate is a phrase of 2 to LONGEST words that occurs LEAST times or more, overlaps counted.
Its score is floor(1000 * a * n / (l * r)) for its count a, all words n, and the counts l and r of its two parts, at
the cut that scores lowest (ties: the first). Candidates that lie in a longer one of the same count are dropped.

1. Words are counted, per task before any shuffle. Only words of LEAST occurrences can be part of a candidate.
2. Each occurrence of such a word is the pointer of a projection: the frequent words that follow it in its piece, four
   at most. A task sorts its pointers, adds equal ones up and gives them to the shuffle by their first word, the prefix;
   pointers of many prefixes travel in one compressed row.
3. A prefix is one task's work, which sorts its pointers once; the pointers that share a longer prefix are then a
   stretch of them, and the phrase is grown to the right depth-first, stretch within stretch, as long as its count
   allows. Where a task's prefixes would have over HOT pointers, these are dealt out anew by two words, then by three and
   four, so that no task holds a frequent word's whole projection; what several tasks count of one phrase is added up.
   (Pointers of the same four words differ in the last one only: as many as there are words.)
4. Counts of parts, longer phrases of equal count and words' names are equi-joins; scores are exact decimals. A
   language's best are found by rank first, and only those get their words' names.

Words are told by 64-bit hashes. Where there are DICTIONARY frequent words or fewer, pointers hold their numbers, from
a broadcast list of that size at most; beyond, they hold the hashes themselves and infrequent words are no longer
left out before the shuffle: more bytes, the same rows.

Cases: null and empty texts have no words; a null language is NO_LANGUAGE. Very long texts are taken whole. Rows that
repeat count each. Ties go by count, then by the phrase's bytes. Other columns are ignored. An empty table gives an
empty result, as does one where nothing is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, joined, mix, slices, span_hash, spill, utf8

LEAST = 100
LONGEST = 5
BEST = 2000
NO_LANGUAGE = "und"
#: Bytes that end a piece.
PIECE = b".,;:!?\n\x0b\x0c\r"
#: Frequent words that the numbers of a broadcast list may stand for.
DICTIONARY = 4_000_000
#: Pointers that a task sorts before it gives them to the shuffle, and distinct words that it counts.
HELD = 1_000_000
#: Pointers that one task's prefixes should have, and more than which are dealt out anew.
DEALT, HOT = 1_000_000, 3_000_000
#: Hot parts whose list may be broadcast; a longer one is joined by its key.
LISTED = 100_000


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; start and end of each word; its piece; and how many words come before each text."""
    raw, marks = joined(texts, b"\n")
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    a = lower[raw]
    kind = np.zeros(256, np.uint8)
    kind[[32, 9]] = 1
    kind[list(PIECE)] = 2
    k = kind[a]
    edge = np.diff((k == 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, start, end, np.cumsum(k == 2, dtype=np.int32)[start], np.searchsorted(start, marks)


def by_language(batch: pa.RecordBatch, text: str) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language, in cuts of bounded size."""
    for part in slices(batch, text):
        lang = part.column("lang").dictionary_encode()
        code = lang.indices.to_numpy()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            yield name, utf8(part.column(text).take(pa.array(np.flatnonzero(code == i))))


def hashes_of(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words' hashes; -1, which ends a pointer, is none."""
    h = span_hash(a, start, end).view(np.int64)
    h[h == -1] = -2
    return h


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """lang, h, word, n, summed over each task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)
                names = pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h), names, pa.array(n)], names=["lang", "h", "word", "n"])

        for batch in batches:
            for lang, texts in by_language(batch, text):
                a, start, end, _, _ = words_of(texts)
                h, first, n = np.unique(hashes_of(a, start, end), return_index=True, return_counts=True)
                if not len(h):
                    continue
                begin, length = start[first], end[first] - start[first]
                ends = np.cumsum(length)
                blob = a[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]))]
                names = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(blob)])
                held.setdefault(lang, []).append((h, n, names))
                size += len(h)
            if size > HELD:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    return docs.select("lang", text).mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def windows(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Each word that a frequent one follows, with up to four words after it; -1 where the piece or its frequent words end."""
    n = len(ids)
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (ids[1:] != -1) & (ids[:-1] != -1)
    at = np.flatnonzero(goes_on)
    out = np.full((LONGEST, len(at)), -1, ids.dtype)
    out[0] = ids[at]
    open_ = np.ones(len(at), bool)
    for k in range(1, LONGEST):
        there = np.minimum(at + k - 1, n - 1)
        open_ &= goes_on[there]
        out[k, open_] = ids[there[open_] + 1]
    return out


def added_up(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of rows in order, with their weights' sums."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))[: rows.shape[1]]
    at = np.flatnonzero(new)
    return rows[:, at], np.add.reduceat(weight[order], at) if len(at) else weight


POINTERS = "lang string, level int, part long, n long, rows binary"


def packed(lang: str, level: int, part: int, rows: np.ndarray, weight: np.ndarray, narrow: bool) -> dict:
    blob = rows.astype(np.int32 if narrow else np.int64).tobytes() + weight.astype(np.int64).tobytes()
    return {"lang": lang, "level": level, "part": part, "n": len(weight), "rows": pa.compress(blob, codec="zstd", asbytes=True)}


def unpacked(blob: bytes, n: int, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(np.int32 if narrow else np.int64)
    raw = pa.decompress(blob, n * (LONGEST * kind.itemsize + 8), codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind, LONGEST * n).reshape(LONGEST, n), np.frombuffer(raw, np.int64, n, LONGEST * n * kind.itemsize)


def deal(lang: str, level: int, parent: int, parts: int, rows: np.ndarray, weight: np.ndarray, narrow: bool) -> Iterator[dict]:
    """Sorted pointers by their first words, level of them, in so many parts; a prefix's pointers stay sorted."""
    if not rows.shape[1]:
        return
    h = np.full(rows.shape[1], parent, np.uint64)
    for c in rows[:level]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        at = order[p:q]
        yield packed(lang, level, (parent * 1_000_003 + int(part[at[0]])) % (1 << 62), rows[:, at], weight[at], narrow)


def batched(rows: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema() -> pa.Schema:
    return pa.schema({"lang": pa.string(), "level": pa.int32(), "part": pa.int64(), "n": pa.int64(), "rows": pa.binary()})


def project(docs: DataFrame, text: str, numbers, parts: int) -> DataFrame:
    """POINTERS by first words, a row per part and task. numbers: the broadcast list, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[dict]:
            for lang, found in held.items():
                rows = np.concatenate(found, axis=1)
                yield from deal(lang, 1, 0, parts, *added_up(rows, np.ones(rows.shape[1], np.int64)), numbers is not None)

        for batch in batches:
            for lang, texts in by_language(batch, text):
                a, start, end, piece, _ = words_of(texts)
                ids = hashes_of(a, start, end)
                if numbers is not None:
                    known = numbers.value.get(lang, np.zeros(0, np.int64))
                    at = np.searchsorted(known, ids)
                    ids = np.where(np.append(known, 0)[at] == ids, at, -1).astype(np.int32) if len(known) else np.full(len(ids), -1, np.int32)
                found = windows(ids, piece)
                held.setdefault(lang, []).append(found)
                size += found.shape[1]
            if size > HELD:
                yield from batched(flush(), _schema(), 100)
                held.clear()
                size = 0
        yield from batched(flush(), _schema(), 100)

    return docs.select("lang", text).mapInArrow(run, POINTERS)


def grow(rows: np.ndarray, weight: np.ndarray, prefix: tuple[int, ...], least: int, level: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The frequent phrases that begin with the prefix and are longer, depth-first, from its sorted pointers. Of phrases
    shorter than level other tasks have pointers too, so that any count of them may grow."""
    at = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    sums = np.add.reduceat(weight, at)
    ends = np.append(at[1:], rows.shape[1])
    wanted = rows[0, at] != -1
    if len(prefix) + 1 >= level:
        wanted &= sums >= least
    for i in np.flatnonzero(wanted).tolist():
        phrase = (*prefix, int(rows[0, at[i]]))
        if prefix:
            yield phrase, int(sums[i])
        if len(rows) > 1:
            yield from grow(rows[1:, at[i] : ends[i]], weight[at[i] : ends[i]], phrase, least, level)


def mine(pointers: DataFrame, numbers, least: int) -> DataFrame:
    """lang, phrase (words' hashes), f of the frequent phrases of two words and more."""
    narrow = numbers is not None

    def phrases(held: list[pa.RecordBatch]) -> Iterator[dict]:
        rows = pa.Table.from_batches(held)
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(rows.column("lang").to_pylist(), rows.column("level").to_pylist(), strict=True)):
            groups.setdefault(k, []).append(i)
        n, blob = rows.column("n").to_pylist(), rows.column("rows")
        for (lang, level), at in groups.items():
            name = numbers.value[lang] if narrow else None
            found = [unpacked(blob[i].as_py(), n[i], narrow) for i in at]
            whole = added_up(np.concatenate([p[0] for p in found], axis=1), np.concatenate([p[1] for p in found]))
            for phrase, f in grow(*whole, (), least, level):
                yield {"lang": lang, "phrase": [int(name[x]) for x in phrase] if narrow else list(phrase), "f": f, "whole": len(phrase) >= level}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"lang": pa.string(), "phrase": pa.list_(pa.int64()), "f": pa.int64(), "whole": pa.bool_()})

        def every() -> Iterator[dict]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:  # sorted, so that a part's rows follow each other
                k = batch.column("k").to_numpy()
                at = 0
                for cut in [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]:
                    if held and k[at] != last:
                        yield from phrases(held)
                        held = []
                    held.append(batch.slice(at, cut - at))
                    last, at = k[at], cut
            if held:
                yield from phrases(held)

        yield from batched(every(), schema, 20_000)

    keyed = pointers.withColumn("k", F.xxhash64("lang", "level", "part"))
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "lang string, phrase array<long>, f long, whole boolean")


def frequent_phrases(docs: DataFrame, words: DataFrame, text: str, least: int, scratch: Scratch) -> DataFrame:
    """lang, phrase (words' hashes), f of all phrases of two words and more."""
    spark, numbers = docs.sparkSession, None
    count, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= DICTIONARY:
        table = words.select("lang", "h").toArrow()
        lang, h = table.column("lang").combine_chunks().dictionary_encode(), table.column("h").to_numpy()
        code = lang.indices.to_numpy()
        numbers = spark.sparkContext.broadcast({name: np.sort(h[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())})
    narrow = numbers is not None

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from deal(r["lang"], r["level"] + 1, r["part"], -(-r["size"] // DEALT), *unpacked(r["rows"], r["n"], narrow), narrow)

        yield from batched(every(), _schema(), 100)

    key = ["lang", "level", "part"]
    pointers, found = scratch.spill(project(docs, text, numbers, max(1, total // DEALT))), []
    for _ in range(1, LONGEST - 1):
        hot = scratch.spill(pointers.groupBy(key).agg(F.sum("n").alias("size")).filter(F.col("size") > HOT))
        size = hot.count()
        if not size:
            break
        side = F.broadcast if size <= LISTED else lambda df: df.hint("merge")
        found.append(mine(pointers.join(side(hot.select(key)), key, "left_anti"), numbers, least))
        pointers = scratch.spill(pointers.join(side(hot), key).mapInArrow(again, POINTERS))
    found.append(mine(pointers, numbers, least))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = scratch.spill(every)
    shared = every.filter("not whole").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return every.filter("whole").drop("whole").unionByName(shared)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    bounded(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession, tidy=True) as scratch:
        counts = scratch.spill(count_words(docs, "text"))
        words = scratch.spill(counts.filter(F.col("n") >= least))
        total = scratch.spill(counts.groupBy("lang").agg(F.sum("n").alias("n")))
        phrases = frequent_phrases(docs, words, "text", least, scratch)
        every = scratch.spill(phrases.unionByName(words.select("lang", F.array("h").alias("phrase"), F.col("n").alias("f"))))
        m = F.size("phrase")
        inner = F.explode(F.array(F.slice("phrase", F.lit(1), m - 1), F.slice("phrase", F.lit(2), m - 1)))
        within = phrases.filter(m > 2).select("lang", inner.alias("phrase"), "f").distinct()
        kept = phrases.join(within, ["lang", "phrase", "f"], "left_anti")
        k = F.col("k")
        cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
        cuts = cuts.withColumn("first", F.slice("phrase", F.lit(1), k)).withColumn("rest", F.slice("phrase", k + 1, m - k))
        part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
        cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
        exact = lambda c: F.col(c).cast("decimal(20,0)")
        cuts = cuts.withColumn("num", exact("a") * exact("n") * F.lit(1000)).withColumn("den", exact("l") * exact("r")).withColumn("score", F.expr("num div den"))
        scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.l", "x.r", "x.score")
        order = [F.col("score").desc(), F.col("a").desc()]
        top = scratch.spill(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= best).drop("place"))
        named = top.select("lang", "phrase", F.posexplode("phrase").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
        spelt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
        named = named.groupBy("lang", "phrase").agg(spelt.alias("said"))  # five words at most
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "said"))
        out = top.join(named, ["lang", "phrase"]).withColumn("rank", rank).filter(F.col("rank") <= best)
        return spill(out.select("lang", F.col("rank").cast("long").alias("rank"), F.col("said").alias("phrase"), "a", "l", "r", "n", "score"))


def op13_phrase_collocation_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
