"""Sharding by a k-d tree over document metadata.

A document is a point: its size (as a logarithm, scaled to the table's range), its source and its language. Of these
two, a value's place is the part of all bytes that heavier values have, so that a node is as wide in them as the bytes
between its values; values of about one weight (within 9 %) lie among each other by hash. A node that shall
make k shards is split at a weighted quantile (the weighted median for even k) of the dimension in which its points
spread widest, so that both sides get bytes in the ratio of their shares; a node of one share is a leaf, whose
bytes are then about the target bytes, total / shards. Quantiles come from distributed histograms: the bin that
holds the cut is refined until it weighs next to nothing, for all nodes of a level at once. The driver holds only
the tree and one histogram of a level.

A key is one long: the scaled value (22 bits), a hash of the text (20 bits), a hash of the row (20 bits). The
hashes only order points that share a value, so a hot source or language can be cut anywhere. Equal texts count with
the least source and language among them, so they are neighbours in every dimension; a cut leaves a group of them
whole up to GROUP of a shard's bytes, and only a larger group, which no balance could keep whole, is cut.

Cases: a null text has no bytes (size 16); a null source or language is a value of its own. Repeated rows are kept,
each with a slot of its own; a row number tells them apart, so that a group of them can be cut like any other. A very
long text is one row of its size, so a shard may exceed the target by it. Ties (equal keys) fall to either side of a
cut. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import skewed_join, spill

SHARDS = 40
#: Bins of one histogram pass, and the part of a leaf's bytes that a cut may be off by.
BINS = 4096
SLACK = 0.002
#: The same for a cut that would fall among equal texts; and the keys that equal texts of one value have.
GROUP, TEXT = 0.02, 1 << 20
#: Values of source or language up to which their places are broadcast (some 5 MB); more are joined by shuffle.
VALUES = 100_000
#: Rows that one task numbers.
BLOCK_ROWS = 200_000
DIMENSIONS = ("size", "source", "lang")
KEYS = tuple(f"k{i}" for i in range(len(DIMENSIONS)))


class Tree:
    """Nodes by number: the shares they make, their first leaf, the dimension and place of their cut, their sides."""

    def __init__(self, shards: int):
        self.shares, self.first, self.dimension, self.cut, self.left, self.right = ([x] for x in (shards, 0, -1, 0, -1, -1))

    def open(self) -> list[int]:
        return [n for n, k in enumerate(self.shares) if k > 1 and self.left[n] < 0]

    def split(self, n: int, dimension: int, cut: int) -> None:
        half = self.shares[n] // 2
        self.dimension[n], self.cut[n] = dimension, cut
        self.left[n], self.right[n] = len(self.shares), len(self.shares) + 1
        for shares, first in ((half, self.first[n]), (self.shares[n] - half, self.first[n] + half)):
            for column, x in zip((self.shares, self.first, self.dimension, self.cut, self.left, self.right), (shares, first, -1, 0, -1, -1), strict=True):
                column.append(x)

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(v, np.int64) for k, v in vars(self).items()}


def descend(tree: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The node that each point (a column of keys) comes to by the cuts so far."""
    at, every = np.zeros(keys.shape[1], np.int64), np.arange(keys.shape[1])
    while True:
        inner = tree["left"][at] >= 0
        if not inner.any():
            return at
        low = keys[np.maximum(tree["dimension"][at], 0), every] < tree["cut"][at]
        at = np.where(inner, np.where(low, tree["left"][at], tree["right"][at]), at)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in KEYS]).astype(np.int64)


def points(docs: DataFrame, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    """doc_id, size, crc and hashes of text, source and language; the texts are read once and go no further."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 16).alias("size"),
        F.crc32(whole.cast("binary")).alias("crc"),
        F.xxhash64(whole).alias("text"),
        *[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(to) for c, to in ((source, "source"), (lang, "lang"))],
        F.monotonically_increasing_id().alias("row"),  # tells rows apart that repeat; stored, so that it stays
    )
    return spill(rows)


def grouped(pts: DataFrame) -> DataFrame:
    """The points with rh, a hash of the row, of its own for each row that repeats, and equal texts with the least source and language among them."""
    own = F.struct("source", "lang")
    pts = pts.withColumn("rh", F.shiftrightunsigned(F.xxhash64("doc_id", "text", "source", "lang", "row"), 44)).drop("row")
    groups = pts.groupBy("text").agg(F.min(own).alias("least"), F.max(own).alias("most")).filter("least != most").select("text", "least")
    joined = skewed_join(pts, spill(groups), ["text"], "left")
    return joined.withColumns({c: F.coalesce(f"least.{c}", c) for c in ("source", "lang")}).drop("least")


def places(pts: DataFrame, column: str) -> DataFrame:
    """Each value of the column with its place between 0 and 1: after the bytes of all heavier classes of weight
    (eight to a doubling, so some hundreds at most), by its hash within the bytes of its own class."""
    values = pts.groupBy(column).agg(F.sum("size").alias("w")).withColumn("class", F.floor(8 * F.log2("w")))
    heavier = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    classes = values.groupBy("class").agg(F.sum("w").alias("own"))
    classes = classes.select("class", "own", F.coalesce(F.sum("own").over(heavier), F.lit(0)).alias("before"), F.sum("own").over(every).alias("all"))
    part = F.shiftrightunsigned(F.col(column), 11) / F.lit(float(1 << 53))
    return values.join(classes, "class").select(column, ((F.col("before") + F.col("own") * part) / F.col("all")).alias(f"{column}_place"))


def keyed(pts: DataFrame) -> DataFrame:
    """The points with k0, k1, ...: scaled value, text hash, row hash."""
    for c in DIMENSIONS[1:]:
        at = spill(places(pts, c))
        few = at.limit(VALUES + 1).count() <= VALUES
        pts = pts.join(F.broadcast(at), c) if few else skewed_join(pts, at, [c])
    pts = spill(pts)
    ends = pts.agg(F.log2(F.min("size")).alias("low"), F.log2(F.max("size")).alias("high")).first()
    low, high = ends["low"] or 0.0, ends["high"] or 0.0
    size = (F.log2("size") - F.lit(low)) / F.lit(max(high - low, 1e-9))
    rest = F.shiftleft(F.shiftrightunsigned("text", 44), 20) + F.col("rh")
    for k, place in zip(KEYS, (size, *[F.col(f"{c}_place") for c in DIMENSIONS[1:]]), strict=True):
        pts = pts.withColumn(k, F.shiftleft((place * F.lit((1 << 22) - 1)).cast("long"), 40) + rest)
    return pts


def spreads(pts: DataFrame, tree: Tree) -> dict[int, dict]:
    """Bytes, least and greatest keys of each open node; a task sends one row for each."""
    shared = pts.sparkSession.sparkContext.broadcast((tree.arrays(), tree.open()))
    names = ["node", "w", *[f"{a}{i}" for i in range(len(KEYS)) for a in "ab"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, open_ = shared.value
        weight, low, high = np.zeros(len(open_), np.int64), np.full((len(KEYS), len(open_)), 1 << 62), np.full((len(KEYS), len(open_)), -1)
        place = np.full(len(nodes["left"]), -1)
        place[open_] = np.arange(len(open_))
        for batch in batches:
            keys = _keys(batch)
            at = place[descend(nodes, keys)]
            on = at >= 0
            np.add.at(weight, at[on], batch.column("size").to_numpy(zero_copy_only=False)[on])
            for i, k in enumerate(keys):
                np.minimum.at(low[i], at[on], k[on])
                np.maximum.at(high[i], at[on], k[on])
        some = np.flatnonzero(high[0] >= 0)
        columns = [np.array(open_, np.int64)[some], weight[some], *[x[i][some] for i in range(len(KEYS)) for x in (low, high)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = pts.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("node")
    rows = rows.agg(F.sum("w").alias("w"), *[f(n).alias(n) for n in names[2:] for f in ((F.min if n[0] == "a" else F.max),)])
    return {r["node"]: r.asDict() for r in rows.collect()}


def histogram(pts: DataFrame, tree: Tree, ranges: dict[int, tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """(bin, bytes, count) of the points of each node in its range; ranges: node to dimension, start, end, width of a bin."""
    shared = pts.sparkSession.sparkContext.broadcast((tree.arrays(), list(ranges), np.array(list(ranges.values()), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, numbers, table = shared.value
        held, count = np.zeros((2, len(numbers) * BINS), np.int64)
        place = np.full(len(nodes["left"]), -1)
        place[numbers] = np.arange(len(numbers))
        for batch in batches:
            keys = _keys(batch)
            at = place[descend(nodes, keys)]
            on = np.flatnonzero(at >= 0)
            dimension, start, end, width = table[at[on]].T
            k = keys[dimension, on]
            inside = (k >= start) & (k < end)
            on, bins = on[inside], ((k - start) // width)[inside]
            np.add.at(held, at[on] * BINS + bins, batch.column("size").to_numpy(zero_copy_only=False)[on])
            np.add.at(count, at[on] * BINS + bins, 1)
        cell = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int64)[cell // BINS]), pa.array(cell % BINS), pa.array(held[cell]), pa.array(count[cell])], names=["node", "bin", "w", "n"])

    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in pts.mapInArrow(run, "node long, bin long, w long, n long").groupBy("node", "bin").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
        out.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
    return {n: sorted(x) for n, x in out.items()}


def grow(pts: DataFrame, shards: int, slack: float = SLACK, group: float = GROUP) -> Tree:
    """The tree. Each level takes one pass for the spreads and a few for the cuts."""
    tree = Tree(shards)
    while open_ := tree.open():
        found = spreads(pts, tree)
        cuts, ranges, goals = {n: (0, 0) for n in open_}, {}, {}
        for n, r in found.items():
            d = max(range(len(KEYS)), key=lambda i: ((r[f"b{i}"] >> 40) - (r[f"a{i}"] >> 40), -i))
            goals[n] = (r["w"] * (tree.shares[n] // 2) / tree.shares[n], r["w"] / tree.shares[n])
            ranges[n] = _binned(d, r[f"a{d}"] // TEXT * TEXT, r[f"b{d}"] + 1)
        while ranges:
            bins = histogram(pts, tree, ranges)
            for n, (d, start, end, width) in list(ranges.items()):
                goal, leaf = goals[n]
                done = 0
                for i, w, k in bins[n]:
                    if done + w >= goal:
                        break
                    done += w
                first = start + i * width
                if w <= leaf * (group if width == TEXT else slack) or width == 1 or k == 1:  # the nearer edge of the bin
                    cuts[n] = (d, first if goal - done < done + w - goal else first + width)
                    del ranges[n]
                else:
                    goals[n] = (goal - done, leaf)
                    ranges[n] = _binned(d, first, min(end, first + width))
        for n, (d, cut) in cuts.items():
            tree.split(n, d, cut)
    return tree


def _binned(dimension: int, start: int, end: int) -> tuple[int, int, int, int]:
    """The range with the width of a bin; bins wider than a text's keys hold those of whole texts."""
    width = max(1, -(-(end - start) // BINS))
    return dimension, start, end, width if width <= TEXT // BINS else -(-width // TEXT) * TEXT


def leaves(pts: DataFrame, tree: Tree) -> DataFrame:
    """pts with shard, the first leaf of the node that a point comes to."""
    shared = pts.sparkSession.sparkContext.broadcast(tree.arrays())
    fields = ", ".join(f"{n} {t}" for n, t in pts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shared.value["first"][descend(shared.value, _keys(batch))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    return pts.mapInArrow(run, f"{fields}, shard int")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    pts = keyed(grouped(points(docs, doc_id, text, source, lang)))
    n = pts.count()
    placed = leaves(pts, grow(pts.select("size", *KEYS), shards))
    blocks = max(1, -(-n // (shards * BLOCK_ROWS)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rh", "text", "doc_id"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "crc", "size", "rh")
    slots = placed.withColumn("r", F.row_number().over(inside)).join(sums, ["shard", "block"])
    return slots.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("r") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
