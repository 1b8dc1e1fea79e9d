"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sets.

Words are runs of bytes that are no ASCII white space, A-Z lower-cased; a document's set holds the 64-bit hashes of
its distinct shingles of SHINGLE words (a shorter document's whole sequence is its one shingle). Two documents are
linked if 100 * intersection >= SIMILAR * union. The join is exact: no pair is left to chance.

1. One pass over the texts gives each document's set size, a 128-bit sum of its set, its bitmap (bit h mod width of
   every hash h; the width follows the size) and its prefix: the size - ceil(SIMILAR % of size) + 1 lowest hashes. Two
   linked sets share a hash of their prefixes, in any one order of hashes. Documents of equal sets become one class.
2. A bucket is what shares a prefix hash; of buckets with the same members one is kept. Most hashes are one document's
   own: a bitmap of fixed size, of the hashes that several have, lets only rows pass that may meet others. A passage
   that many unlike documents hold would make large buckets, so hashes that more than COMMON documents have move to the
   end of the order, for all documents alike, and prefixes that held one are chosen again: such documents meet in what
   is their own. (Any set of hashes may be moved without losing a link; the bitmap that tells it is that set.)
3. A bucket's members are dealt to tiles by size band (a band's sizes differ by less than 100 / SIMILAR; a tile holds
   one band and, as guests, the next one: no others can be linked) and by blocks of BLOCK members. In a tile the bits
   set in one bitmap only bound the overlap from above: each is at least one hash that the other set lacks. Pairs that
   could pass are joined to a forest, each block's and its tile's first member's; only its edges leave the tile, and
   are verified on the full sets. That is linear in a bucket, however large. Near copies share many hashes, so their
   tiles have nearly the same members: tiles of one first member are dealt together, as units of about LOAD members,
   and a document's bitmap goes to a unit once, with the list of its tiles there.
4. Tiles that then still hold several components are gone through block against block, in units again. The pairs of
   different components that could still pass and that no earlier tile of the unit had are few, and are verified; where
   a tile has over FEW a member, its members get their full sets instead (once a unit), and a local union-find skips
   what is already joined.
5. Components come from alternating large-star and small-star rounds over the verified links.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing. Very long texts are
taken whole (their prefixes and bitmaps grow with them). Rows of one doc_id count as one document with several texts.
A row without doc_id is a document of its own text; its component is the least doc_id of the linked ones, null if none
has any. Rows that repeat, and ties, get the same component. Further columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, mix, skewed_join, slices, spill, utf8
from .minhash import _result, components, linked, shingle_sets

SHINGLE = 5
SIMILAR = 80
#: Documents that may share a prefix hash before it counts as common.
COMMON = 64
#: Members of one block of a tile.
BLOCK = 1024
#: Bits of the narrowest and widest bitmap; between them at least twice the set's size, a power of two.
NARROW, WIDE = 128, 1 << 17
#: Pairs a member that may leave a tile of several components for a check elsewhere; more are checked within.
FEW = 1
#: Members of the tiles, each counted in every one, that one unit should have, and rows of a unit whose pairs are remembered.
LOAD, MEMO = 1 << 15, 4096
#: Bits of the bitmaps that rows are sifted by before a shuffle; they may let too many pass, never too few.
SIEVE = 1 << 26
#: Lowest hashes that are kept beside the prefix, to choose it again from; where they don't do, the text is read again.
SPARE = 1.5
SIGNED = "doc_id long, th long, n_shingles long, s1 long, s2 long, lowest array<long>, bits binary"


def prefix_size(n: np.ndarray | int, similar: int):
    """How many lowest hashes two linked sets must share one of."""
    return n - (similar * n + 99) // 100 + 1


def width(n: int) -> int:
    return min(WIDE, max(NARROW, 1 << (2 * n - 1).bit_length()))


def bitmap(hashes: np.ndarray) -> bytes:
    on = np.zeros(width(len(hashes)), bool)
    on[(hashes % np.uint64(len(on))).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, wide ones folded to the narrowest one's width."""
    least = min(map(len, maps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, least), 0) for m in maps])


def may_link(bits: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, similar: int) -> np.ndarray:
    """Those of the others whose bitmaps allow a link with row i: at most size - (bits set here only) is shared."""
    both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
    ones = np.bitwise_count(bits[others]).sum(1, dtype=np.int64)
    mine = int(np.bitwise_count(bits[i]).sum(dtype=np.int64))
    most = np.minimum(size[i] - (mine - both), size[others] - (ones - both))
    return others[100 * most >= similar * (size[others] + size[i] - most)]


def band(n, similar: int):
    """The size band: its sizes differ by less than 100 / similar, so linked sets lie in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / similar))).cast("int")


def sign(docs: DataFrame, doc_id: str, text: str, size: int, similar: int) -> DataFrame:
    """SIGNED of every row; of rows with equal sets that one task meets, the first has the lowest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in slices(whole, text):
                sets = shingle_sets(utf8(batch.column(text)), size)
                s1, s2 = ([int(f(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for f in (mix, lambda s: mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                first = [len(s) > 0 and not (k in met or met.add(k)) for s, k in zip(sets, zip(s1, s2, strict=True), strict=True)]
                lowest = [s[: int(prefix_size(len(s), similar) * SPARE)].view(np.int64) if on else None for s, on in zip(sets, first, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc_id).cast(pa.int64()), batch.column("th"), pa.array(map(len, sets), pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(lowest, pa.list_(pa.int64())), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "lowest", "bits"],
                )

    return docs.select(doc_id, text, F.xxhash64(text).alias("th")).mapInArrow(run, SIGNED)


def sieve(hashes: DataFrame):
    """A broadcast bitmap of the low bits of a column of 64-bit hashes, of SIEVE bits whatever their number."""
    bit = F.col(hashes.columns[0]).bitwiseAND(SIEVE - 1) + 1  # bitmap buckets are counted from 1
    parts = hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(SIEVE // 8, np.uint8)
    for r in parts.collect():  # SIEVE / 8 bytes at most
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(whole)]
        whole[(r["at"] - 1) * 4096 :][: len(part)] = part
    return hashes.sparkSession.sparkContext.broadcast(whole)


def passes(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.int64(SIEVE - 1)
    return (whole[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def texts_of(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, sum, text of the classes' first documents; only texts that may be theirs are shuffled, and of rows that
    repeat one a task."""
    row = lambda c, th: F.xxhash64(c, th).alias("row")
    nodes = classes.select(row("rep.doc_id", "rep.th"), "node", F.col("s1").alias("sum"))
    wanted = sieve(nodes.select("row"))
    texts = docs.filter(F.col(text).isNotNull()).select(row(doc_id, F.xxhash64(text)), F.col(text).alias("text"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            at = [i for i in np.flatnonzero(passes(wanted.value, rows)).tolist() if not (rows[i] in met or met.add(rows[i]))]
            yield batch.take(pa.array(at, pa.int64()))

    return skewed_join(texts.mapInArrow(sift, "row long, text string"), nodes, ["row"]).select("node", "sum", "text")


def checked_sets(texts: list[bytes], sums: list[int], size: int) -> list[np.ndarray | None]:
    """The sets of the texts; None where another text had the wanted one's row hash."""
    return [s if int(mix(s).sum(dtype=np.uint64).astype(np.int64)) == n else None for s, n in zip(shingle_sets(texts, size), sums, strict=True)]


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """node, shingles of texts_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            fresh = [i for i, n in enumerate(whole.column("node").to_pylist()) if not (n in done or done.add(n))]
            for batch in slices(whole.take(pa.array(fresh, pa.int64())), "text"):
                sets = checked_sets(utf8(batch.column("text")), batch.column("sum").to_pylist(), size)
                yes = [i for i, s in enumerate(sets) if s is not None]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(yes, pa.int64())), pa.array([sets[i].view(np.int64) for i in yes], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def chosen(lowest: np.ndarray, n: int, late: np.ndarray | None, similar: int) -> np.ndarray | None:
    """The prefix of a set of n hashes from its lowest ones; None if those don't do. late: the bitmap of the hashes
    at the end of the order."""
    size = prefix_size(n, similar)
    if late is None:
        return lowest[:size]
    last = passes(late, lowest)
    if len(lowest) - last.sum() >= size:
        return lowest[~last][:size]
    return np.concatenate([lowest[~last], lowest[last]])[:size] if len(lowest) == n else None


def prefix_rows(signed: DataFrame, similar: int, late=None, take=None, short: bool = False) -> DataFrame:
    """key, s1, s2, n_shingles of the prefixes' hashes that take(lowest, prefix) says (all); short: instead a row for
    each set whose lowest hashes don't do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value if late else None
        for batch in batches:
            keys, count = [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            for i, (low, n) in enumerate(zip(lists(batch.column("lowest")), batch.column("n_shingles").to_pylist(), strict=True)):
                prefix = chosen(low.view(np.int64), n, last, similar)
                if short or prefix is None:
                    key = np.zeros(int(short and prefix is None), np.int64)
                else:
                    key = take(low.view(np.int64), prefix) if take else prefix
                keys.append(key)
                count[i] = len(key)
            row = pa.array(np.repeat(np.arange(batch.num_rows), count))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[batch.column(c).take(row) for c in ("s1", "s2", "n_shingles")]], names=["key", "s1", "s2", "n_shingles"])

    return signed.filter("lowest is not null").select("lowest", "s1", "s2", "n_shingles").mapInArrow(run, "key long, s1 long, s2 long, n_shingles long")


def meeting(signed: DataFrame, classes: DataFrame, sets_of, similar: int, scratch: Scratch) -> DataFrame:
    """node, key of the prefix hashes that several nodes have; some that one has may be among them."""
    # different sets differ in their sums, so a hash of two of them shows by its least and greatest one
    every = prefix_rows(signed, similar).groupBy("key").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = scratch.spill(every.filter("a < b").select("key", "n"))
    by_class = lambda rows: rows.join(classes.select("s1", "s2", "n_shingles", "node"), ["s1", "s2", "n_shingles"])
    within = lambda keys: (lambda wanted: lambda low, prefix: prefix[passes(wanted.value, prefix)])(sieve(keys))
    crowded = shared.filter(F.col("n") > COMMON).select("key")
    if crowded.isEmpty():
        return scratch.spill(by_class(prefix_rows(signed, similar, take=within(shared.select("key")))).select("node", "key").distinct())
    hot = sieve(crowded)
    told = prefix_rows(signed, similar, take=lambda low, prefix: low if passes(hot.value, prefix).any() else low[:0])
    late = sieve(told.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON).select("key"))
    added = prefix_rows(signed, similar, late, lambda low, prefix: prefix[~np.isin(prefix, low[: len(prefix)])])
    whole = scratch.spill(sets_of(by_class(prefix_rows(signed, similar, late, short=True)).select("node").distinct()))

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [chosen(s.view(np.int64), len(s), late.value, similar) for s in lists(batch.column("shingles"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["node", "prefix"])

    anew = scratch.spill(whole.mapInArrow(anew, "node long, prefix array<long>").select("node", F.explode("prefix").alias("key")))
    keys = shared.select("key").unionByName(added.select("key")).unionByName(anew.select("key"))
    rows = by_class(prefix_rows(signed, similar, late, within(keys))).select("node", "key").distinct()
    return scratch.spill(rows.unionByName(anew))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """key, members, lead of the prefix hashes of several nodes; of equal member sets (told by a 64-bit sum, their
    number and their least) the least key."""
    every = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("who"))
    return every.filter("members > 1").groupBy("members", "lead", "who").agg(F.min("key").alias("key")).select("key", "members", "lead")


def tiled(rows: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """rows in their tiles, once for their own and once as guests of the band below; tiles of one member go."""
    own = rows.withColumn("of", band(F.col("n"), similar))
    every = own.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("of") - F.col("guest")).drop("of")
    full = every.groupBy("key", "band").agg(F.count(F.lit(1)).alias("all"), F.min("guest").alias("g"), F.min("node").alias("head")).filter("all > 1 and g = 0")
    return every.drop("members", "lead").join(parted(scratch.spill(full.drop("g"))), ["key", "band"])


def parted(tiles: DataFrame) -> DataFrame:
    """tiles and the part that each is dealt to: those of one first member go to so many that a part has about LOAD members."""
    load = tiles.groupBy("head").agg(F.ceil(F.sum("all") / LOAD).cast("int").alias("parts"))
    return tiles.join(load, "head").withColumn("part", F.pmod(F.xxhash64("key", "band"), F.col("parts")).cast("int")).drop("parts")


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in columns)
        new[0] = last is not None and first != last
        last = tuple(int(c[-1]) for c in columns)
        at = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, dict[str, np.ndarray]]]]]:
    """The units of a stream of _dealt(), each with its tiles: the rows of a tile's members, and their marks in it."""
    for unit in by_key(batches, UNIT):
        held = unit.column("tiles").combine_chunks()
        row = np.repeat(np.arange(unit.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
        flat = held.flatten()
        marks = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
        order = np.lexsort((row, marks["band"], marks["key"]))
        row, marks = row[order], {c: x[order] for c, x in marks.items()}
        cuts = np.flatnonzero((marks["key"][1:] != marks["key"][:-1]) | (marks["band"][1:] != marks["band"][:-1])) + 1
        ends = [0, *cuts.tolist(), len(row)]
        yield unit, [(row[a:b], {c: x[a:b] for c, x in marks.items()}) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Settled:
    """Pairs of a unit's rows that need no second look; a unit of over MEMO rows remembers none."""

    def __init__(self, rows: int):
        self.pairs = np.zeros((rows, rows), bool) if rows <= MEMO else None

    def left(self, row: int, others: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of others, places in at, whose pairs with row aren't settled."""
        return others if self.pairs is None else others[~self.pairs[row, at[others]]]

    def settle(self, row: int, rows: np.ndarray) -> None:
        if self.pairs is not None:
            self.pairs[row, rows] = self.pairs[rows, row] = True


def forests(unit: pa.Table, tiles: list, similar: int) -> list[tuple[int, int]]:
    """Edges that join what the bitmaps allow to be linked in each tile, own members and guests alike."""
    nodes, sizes, maps = unit.column("node").to_numpy(), unit.column("n").to_numpy(), unit.column("bits").to_pylist()
    never, out = Settled(len(nodes)), set()
    for at, marks in tiles:
        guest = marks["guest"]
        if len(at) < 2 or guest.all():
            continue
        order = np.lexsort((nodes[at], guest))
        at, guest = at[order], guest[order]
        size, bits, label = sizes[at], folded([maps[k] for k in at.tolist()]), np.arange(len(at))
        for i in range(int((guest == 0).sum())):
            others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            others = others[100 * np.minimum(size[others], size[i]) >= similar * np.maximum(size[others], size[i])]
            others = never.left(at[i], others, at)
            if len(others):
                may = may_link(bits, size, i, others, similar)
                never.settle(at[i], at[np.setdiff1d(others, may, assume_unique=True)])
                met, first = np.unique(label[may], return_index=True)
                out.update((int(nodes[at[i]]), int(nodes[at[j]])) for j in may[first].tolist())
                label[np.isin(label, met)] = label[i]
    return [(min(p), max(p)) for p in out]


def verified(pairs: DataFrame, texts: DataFrame, size: int, similar: int) -> DataFrame:
    """u, v of the pairs whose full sets are similar enough. Texts travel, as they are smaller than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "tu"):
                xu, xv = (checked_sets(utf8(batch.column(f"t{c}")), batch.column(f"s{c}").to_pylist(), size) for c in "uv")
                yes = pa.array([i for i in range(batch.num_rows) if xu[i] is not None and xv[i] is not None and linked(xu[i], xv[i], similar)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(yes) for c in ("u", "v")], names=["u", "v"])

    side = lambda n: texts.select(F.col("node").alias(n), F.col("sum").alias(f"s{n}"), F.col("text").alias(f"t{n}"))
    return pairs.join(side("v"), "v").join(side("u"), "u").mapInArrow(run, "u long, v long")


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays of hashes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, cut = column.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    return [values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def open_pairs(unit: pa.Table, tiles: list, similar: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, dict[str, np.ndarray]]]:
    """What each tile has left of different components that the bitmaps allow to be linked, asks against gives, and no
    tile before it had: the pairs of nodes, or, where they are many, the members that have any, with their marks."""
    nodes, sizes, comps = (unit.column(c).to_numpy() for c in ("node", "n", "comp"))
    maps, seen = unit.column("bits").to_pylist(), Settled(len(nodes))
    for at, marks in tiles:
        asks, guest = marks["asks"], marks["guest"]
        mine, rest = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        if not len(mine) or not len(rest):
            continue
        size, comp, bits = sizes[at], comps[at], None
        pairs, members = [], set()
        for i in mine.tolist():
            others = rest[(comp[rest] != comp[i]) & ((guest[rest] == 0) | (guest[i] == 0))]
            others = others[100 * np.minimum(size[others], size[i]) >= similar * np.maximum(size[others], size[i])]
            others = seen.left(at[i], others, at)
            if len(others):
                bits = folded([maps[k] for k in at.tolist()]) if bits is None else bits
                seen.settle(at[i], at[others])
                others = may_link(bits, size, i, others, similar)
            if len(others):
                members.add(i)
                members.update(others.tolist())
                if len(pairs) <= FEW * len(asks):
                    pairs += [(int(min(nodes[at[i]], nodes[at[j]])), int(max(nodes[at[i]], nodes[at[j]]))) for j in others.tolist()]
        few = len(pairs) <= FEW * len(asks)
        take = np.array([] if few else sorted(members), np.int64)
        yield pairs if few else [], at[take], {c: x[take] for c, x in marks.items()}


def exact_links(unit: pa.Table, tiles: list, similar: int) -> list[tuple[int, int]]:
    """The links of a spanning forest between the components of a unit's tiles."""
    nodes, label, sets = unit.column("node").to_numpy(), unit.column("comp").to_numpy().copy(), lists(unit.column("shingles"))
    sizes, maps = np.array([len(s) for s in sets], np.int64), [bitmap(s) for s in sets]
    seen, out = Settled(len(nodes)), []
    for at, marks in tiles:
        asks, size, bits = marks["asks"], sizes[at], None
        rest = np.flatnonzero(asks == 0)
        for i in np.flatnonzero(asks == 1).tolist():
            others = rest[label[at[rest]] != label[at[i]]]
            others = others[100 * np.minimum(size[others], size[i]) >= similar * np.maximum(size[others], size[i])]
            others = seen.left(at[i], others, at)
            if not len(others):
                continue
            bits = folded([maps[k] for k in at.tolist()]) if bits is None else bits
            for j in may_link(bits, size, i, others, similar).tolist():
                a, b = at[i], at[j]
                if label[a] != label[b] and linked(sets[a], sets[b], similar):
                    out.append((int(nodes[a]), int(nodes[b])))
                    label[label == label[b]] = label[a]
            seen.settle(at[i], at[others])  # joined or too unlike
    return out


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    bounded(docs.sparkSession)
    signed = spill(sign(docs, doc_id, text, size, similar), tidy=True)
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bits").alias("bits"))
    classes = spill(classes.withColumn("node", F.coalesce("first_id", F.xxhash64("s1", "s2"))), tidy=True)
    with Scratch(docs.sparkSession, tidy=True) as scratch:
        texts_for = lambda nodes: texts_of(docs, classes.join(nodes, "node", "left_semi"), doc_id, text)
        sets_of = lambda nodes: full_sets(texts_for(nodes), size)
        ends = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        checked = lambda pairs: verified(pairs, texts_for(ends(pairs)), size, similar)
        rows = meeting(signed, classes, sets_of, similar, scratch)
        buckets = scratch.spill(shared_buckets(rows))
        rows = scratch.spill(skewed_join(rows, buckets, ["key"]).join(classes.select("node", F.col("n_shingles").alias("n")), "node"))
        rows = scratch.spill(tiled(rows, similar, scratch))
        bits = classes.select("node", "bits")
        links = scratch.spill(checked(scratch.spill(_forests(rows, bits, similar).distinct())))
        comps = components(links, scratch)
        more = scratch.spill(_cross_links(rows, bits, comps, checked, sets_of, similar, scratch))
        if not more.isEmpty():
            comps = components(links.unionByName(more), scratch)
        comps = spill(comps, tidy=True)
    return _result(signed, classes, comps).select("doc_id", "n_shingles", "component_id")


UNIT = ["head", "blocks", "part", "i", "j"]


def _dealt(rows: DataFrame, columns: list[str], marks: list[str], wide: DataFrame) -> DataFrame:
    """Units whole, one after another, in each partition: a row for each member, with its bits or set once, whatever the
    number of its tiles, and with its tiles and the marks it has in them."""
    members = rows.groupBy(*UNIT, "node", *columns).agg(F.collect_list(F.struct("key", "band", *marks)).alias("tiles"))
    return members.join(wide, "node").repartition(*UNIT).sortWithinPartitions(*UNIT)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _forests(rows: DataFrame, bits: DataFrame, similar: int) -> DataFrame:
    """u, v: the forest of each block of each tile, the tile's first member in it."""
    placed = rows.withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("i"))  # the head, in every block
    placed = placed.withColumn("i", F.explode(every)).withColumn("j", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, tiles in by_unit(batches):
            if found := forests(unit, tiles, similar):
                yield _edges(found)

    return _dealt(placed, ["n"], ["guest"], bits).mapInArrow(run, "u long, v long")


def _cross_links(rows: DataFrame, bits: DataFrame, comps: DataFrame, checked, sets_of, similar: int, scratch: Scratch) -> DataFrame:
    """Links between different components of a tile: members outside the first member's component ask all others."""
    now = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("all", "part")
    tiles = now.groupBy("key", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min_by("comp", "node").alias("main"), F.count(F.lit(1)).alias("all"), F.min("head").alias("head"))
    tiles = scratch.spill(parted(scratch.spill(tiles.filter("a < b").drop("a", "b"))))
    held = scratch.spill(skewed_join(now.drop("head"), tiles, ["key", "band"]).withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int")))
    at = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")
    span = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = held.filter("comp <> main").withColumn("i", at(1)).withColumn("j", F.explode(span)).withColumn("asks", F.lit(1))
    gives = held.withColumn("j", at(2)).withColumn("i", F.explode(span)).withColumn("asks", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of this task's units
        for unit, tiles in by_unit(batches):
            for pairs, members, marks in open_pairs(unit, tiles, similar):
                fresh = [p for p in pairs if not (p in seen or seen.add(p))]
                if len(seen) > 1_000_000:
                    seen.clear()
                if fresh:
                    none = pa.nulls(len(fresh), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[none.cast(t) for t in types], *_edges(fresh).columns], names=names)
                if len(members):
                    left = unit.select([*UNIT, "node", "comp"]).take(pa.array(members)).combine_chunks()
                    none = pa.nulls(len(members), pa.int64())
                    given = [*[left.column(c).chunk(0) for c in [*UNIT, "node", "comp"]], *[pa.array(marks[c]) for c in ("key", "band", "asks")]]
                    yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(given, types, strict=True)], none, none], names=names)

    names = [*UNIT, "node", "comp", "key", "band", "asks", "u", "v"]
    types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    left = "head long, blocks int, part int, i int, j int, node long, comp long, key long, band int, asks int, u long, v long"
    found = scratch.spill(_dealt(asks.unionByName(gives), ["n", "comp"], ["guest", "asks"], bits).mapInArrow(run, left))
    few = checked(scratch.spill(found.filter("u is not null").select("u", "v").distinct()))
    members = found.filter("u is null").drop("u", "v")
    if members.isEmpty():
        return few
    sets = scratch.spill(sets_of(members.select("node").distinct()))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, tiles in by_unit(batches):
            if found := exact_links(unit, tiles, similar):
                yield _edges(found)

    return few.unionByName(_dealt(members, ["comp"], ["asks"], sets).mapInArrow(link, "u long, v long"))


def op12_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
