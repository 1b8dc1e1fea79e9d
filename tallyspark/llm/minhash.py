"""MinHash near-duplicate detection with sequential Bayesian verification.

Words are runs of bytes that are no ASCII white space, A-Z lower-cased; a document's set holds the 64-bit hashes of
its distinct shingles of SHINGLE words (a shorter document's whole sequence is its one shingle). Two documents are
linked if 100 * intersection >= SIMILAR * union; the result is the connected components.

1. One pass over the texts gives each document's set size, a 128-bit sum of its set and its MinHash bands' keys.
   Documents of equal sets become one class before anything else, so exact copies cost one row.
2. Classes meet in LSH bands of minima. A bucket of several classes links each member to its least one (a star,
   not all pairs). The pairs go through the sequential test: signature batches are compared one after another, and a
   pair is dropped as soon as the posterior chance that it is similar enough, given the matches so far, is below
   MISS. Survivors are verified on the full sets.
3. Only buckets that still hold several components after that are searched further: their members are dealt out in
   blocks, and every member outside the least one's component meets all others, block against block. Within two
   blocks a local union-find skips what is already joined, so only the links of a spanning forest leave the task.
4. Components come from alternating large-star and small-star rounds over the verified links.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing. Rows of one
doc_id count as one document with several texts. A row without doc_id is a document of its own text; its component is
the least doc_id of the linked ones, null if none has any, and it's kept only in that last case. Further columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, mix, skewed_join, slices, spaced, span_hash, spill, utf8

SHINGLE = 5
SIMILAR = 80
MINIMA = 256
#: The chance at which a pair of just the wanted similarity may share no band.
LOST = 1e-4
#: Signature values that one step of the sequential test compares, and the chance at which it gives a pair up.
STEP = 32
MISS = 1e-9
#: Members, and bytes of their sets, that one block of a large bucket should have.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
SIGNED = "doc_id long, th long, n_shingles long, s1 long, s2 long, keys array<long>"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, start, end, cut = spaced(texts)
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 32
    a = low[raw]
    words = span_hash(a, start, end)
    whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(whole)] + np.uint64(j))
    out = []
    for i in range(len(texts)):
        a_, b_ = cut[i], cut[i + 1]
        if b_ - a_ >= size:
            out.append(np.unique(whole[a_ : b_ - size + 1]))
        elif b_ > a_:
            h = np.zeros(1, np.uint64)
            for j, w in enumerate(words[a_:b_]):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(j + 1000))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@cache
def _lines() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20260101)
    return r.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, MINIMA, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of MINIMA multiply-shift hashes, 32 bits each."""
    a, b = _lines()
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1024):
        x = shingles[i : i + 1024, None]
        out = np.minimum(out, ((x * a + b) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of a signature; different bands never meet on purpose."""
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in minima[: bands * rows].reshape(bands, rows).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def sign(docs: DataFrame, doc_id: str, text: str, size: int, similar: int) -> DataFrame:
    """SIGNED of every row; signatures are worth their bytes only where bands meet, so of them just the bands' keys."""
    bands, rows = banding(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                sets = shingle_sets(utf8(batch.column(text)), size)
                sums = [[int(f(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for f in (mix, lambda s: mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc_id).cast(pa.int64()), batch.column("th"), pa.array(map(len, sets), pa.int64()), *[pa.array(s, pa.int64()) for s in sums], pa.array([band_keys(signature(s), bands, rows).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "keys"],
                )

    return docs.select(doc_id, text, F.xxhash64(text).alias("th")).mapInArrow(run, SIGNED)


def banding(similar: int) -> tuple[int, int]:
    """(bands, rows of each): the most rows at which a pair that is just similar enough is lost with LOST at most."""
    rows = max(r for r in range(1, 17) if (1 - (similar / 100) ** r) ** (MINIMA // r) <= LOST or r == 1)
    return MINIMA // rows, rows


def floors(similar: int) -> list[int]:
    """For each step: the least number of matches at which P(J >= similar / 100 | matches) is MISS or more, by a
    uniform prior on J, whose posterior is Beta(1 + matches, 1 + misses)."""
    t = similar / 100
    out = []
    for n in range(STEP, MINIMA + 1, STEP):
        logs = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(t) + (n + 1 - i) * math.log(1 - t) for i in range(n + 2)]
        below = np.cumsum(np.exp(logs))  # P(Beta(1 + m, 1 + n - m) > t) = P(Binomial(n + 1, t) <= m)
        out.append(int(np.searchsorted(below[: n + 1], MISS)))
    return out


def survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signature rows pass the sequential test; a row is compared only as long as it may pass."""
    on = np.arange(len(a))
    found = np.zeros(len(a), np.int64)
    for k, low in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        found = found + (a[on, part] == b[on, part]).sum(1)
        keep = found >= low
        on, found = on[keep], found[keep]
        if not len(on):
            break
    return on


def linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    """The exact test on two sorted sets."""
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    both = int((np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")).sum())
    return 100 * both >= similar * (len(a) + len(b) - both)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def star_links(pairs: DataFrame, similar: int) -> DataFrame:
    """u, v of the pairs that pass; pairs: u, v, gu, gv, and both full sets xu, xv."""
    least = floors(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "xv"):
                on = survive(_signatures(batch.column("gu")), _signatures(batch.column("gv")), least)
                xu, xv = _sets(batch.column("xu")), _sets(batch.column("xv"))
                yes = pa.array([i for i in on.tolist() if linked(xu[i], xv[i], similar)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(yes) for c in ("u", "v")], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def block_links(rows, similar: int, least: list[int]):
    """The links of a spanning forest between the others (own = 1) and all members of two blocks."""
    g, x = _signatures(rows.column("signature").combine_chunks()), _sets(rows.column("shingles"))
    ids, comp = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
    own = rows.column("own").to_numpy()
    up = {c: c for c in comp}

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    size = np.array([len(s) for s in x])
    rest = np.flatnonzero(own == 0)
    out = []
    for i in np.flatnonzero(own == 1).tolist():
        near = rest[(100 * np.minimum(size[rest], size[i]) >= similar * np.maximum(size[rest], size[i]))]
        near = near[survive(np.broadcast_to(g[i], (len(near), MINIMA)), g[near], least)]
        for j in near[np.argsort(-(g[near] == g[i]).sum(1), kind="stable")].tolist():
            a, b = root(comp[i]), root(comp[j])
            if a != b and linked(x[i], x[j], similar):
                up[a] = b
                out.append((ids[i], ids[j]))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: int = SIMILAR, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; keyed: also th, the text's hash, and node, the
    component's own key, which one without any doc_id has too (null for an empty set)."""
    bounded(docs.sparkSession)
    signed = spill(sign(docs, doc_id, text, size, similar))
    # a class: the documents of one set; its node: their least doc_id, or a hash where none has one
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("keys").alias("keys"))
    classes = spill(classes.withColumn("node", F.coalesce("first_id", F.xxhash64("s1", "s2"))))
    with Scratch(docs.sparkSession) as scratch:
        bands = classes.select("node", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("keys").alias("key"))
        buckets = bands.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").drop("last")
        members = scratch.spill(skewed_join(bands, scratch.spill(buckets), ["key"]))
        pairs = members.filter("node > lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct()
        wanted = members.select("node").distinct()
        sets = scratch.spill(_full_sets(docs, classes.join(wanted, "node", "left_semi"), doc_id, text, size))
        side = lambda n: sets.select(F.col("node").alias(n), F.col("signature").alias(f"g{n}"), F.col("shingles").alias(f"x{n}"))
        links = scratch.spill(star_links(pairs.join(side("v"), "v").join(side("u"), "u"), similar))
        comps = components(links, scratch)
        more = scratch.spill(_cross_links(members, comps, sets, similar, scratch))
        if not more.isEmpty():
            comps = components(links.unionByName(more), scratch)
        comps = spill(comps)
    rows = _result(signed, classes, comps)
    return rows if keyed else rows.drop("th", "node")


def _full_sets(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """node, signature, shingles of the classes, from the text of one document each."""
    row = lambda c, th: F.xxhash64(c, th).alias("row")
    nodes = classes.select(F.col("rep.th").alias("th"), row("rep.doc_id", "rep.th"), "node", "s1")
    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("th"), row(doc_id, F.xxhash64(text)), F.col(text).alias("text"))
    found = skewed_join(texts, nodes, ["th", "row"]).select("node", "s1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat meet here; one of them is enough
        for whole in batches:
            fresh = [i for i, n in enumerate(whole.column("node").to_pylist()) if not (n in done or done.add(n))]
            for batch in slices(whole if len(fresh) == whole.num_rows else whole.take(pa.array(fresh, pa.int64())), "text"):
                sets = shingle_sets(utf8(batch.column("text")), size)
                s1 = batch.column("s1").to_pylist()
                yes = [i for i, s in enumerate(sets) if int(mix(s).sum(dtype=np.uint64).astype(np.int64)) == s1[i]]
                take = pa.array(yes, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), pa.array([signature(sets[i]).tobytes() for i in yes], pa.binary()), pa.array([sets[i].tobytes() for i in yes], pa.binary())], names=["node", "signature", "shingles"])

    return found.mapInArrow(run, "node long, signature binary, shingles binary")


def _cross_links(members: DataFrame, comps: DataFrame, sets: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """Links between different components within the buckets that hold several."""
    least = floors(similar)
    now = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(F.struct("node", "comp"))["comp"].alias("main")).filter("a < b").drop("a", "b")
    rows = scratch.spill(skewed_join(now, scratch.spill(open_), ["key"]).select("key", "node", "comp", "n_shingles", (F.col("comp") != F.col("main")).alias("other")))
    weight = F.lit(1 / BLOCK) + F.col("n_shingles") * (8 / BLOCK_BYTES)
    blocks = rows.groupBy("key").agg(F.ceil(F.sum(weight)).cast("int").alias("na"), F.ceil(F.sum(F.when(F.col("other"), weight))).cast("int").alias("no"))
    rows = scratch.spill(skewed_join(rows, scratch.spill(blocks), ["key"]))
    at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = rows.filter("other").select("key", "node", "comp", at("no", 1).alias("i"), F.explode(span("na")).alias("j"), F.lit(1).alias("own"))
    gives = rows.select("key", "node", "comp", F.explode(span("no")).alias("i"), at("na", 2).alias("j"), F.lit(0).alias("own"))
    dealt = asks.unionByName(gives).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        found = block_links(table, similar, least)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (its component's least node) of all nodes with links, by large-star and small-star rounds."""
    edges = scratch.spill(links.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).filter("u < v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: a node's greater neighbours go to the least of its neighbourhood
        edges = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        # small star: so do its lesser neighbours and itself
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        edges = scratch.spill(edges.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("u < v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
        before = now


def _result(signed: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """A row per document: the least doc_id of its component."""
    joined_ = classes.select("s1", "s2", "n_shingles", "node", "first_id").join(comps, "node")
    least = joined_.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    placed = classes.select("s1", "s2", "n_shingles", "node", "first_id").join(comps, "node", "left").join(least, "comp", "left")
    placed = placed.select("s1", "s2", "n_shingles", F.coalesce("component_id", "first_id").alias("component"), F.coalesce("comp", "node").alias("node"))
    rows = signed.select("doc_id", "th", "n_shingles", "s1", "s2").join(placed, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", "node")


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, similar=85)
