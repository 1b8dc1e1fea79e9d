"""SentencePiece encoding and decoding by suffix-array matching.

A text is written as a space and its bytes (the space stands for the piece mark, which then can't be mistaken for the
same character in a text) and falls into segments, each with the spaces before a word. No piece has a space after
another byte, so segments are encoded apart, equal ones of a batch once (told by hashes; the ids' bytes are compared
with the batch's, and where two segments share a hash, each is encoded for itself). The distinct segments are concatenated and
their suffixes sorted, as deep as the longest piece; each piece is searched in that array, which gives the range of
its occurrences. These, sorted by position, are the edges of a lattice. How they are relaxed follows from the model's kind:

- merge-ranked (its scores are whole numbers, as those of the given model): a segment is its code points at first; of
  the edges over two neighbouring symbols the one of the best rank, the leftmost of equals, makes them one, all segments
  side by side, until no edge spans two. No shortest path has this result. Code points in no piece become byte pieces.
- unigram (scores are log probabilities): from left to right, all segments at once, to the cheapest path; ties go to
  the lesser piece id, and bytes that are in no one-byte piece have a dear edge of their byte piece.

The ids are those of the sentencepiece library, but for texts that hold the piece mark itself, which the library takes
for a space; here every text can be encoded, and decoding gives it back exactly.

Cases: null and empty texts have no ids and decode to the empty string. Repeated rows get equal ids; other columns
pass through, but those named like a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, bounded, slices, span_hash, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
STOP = 0xFF
#: Segments whose encoding a task remembers.
MEMO = 300_000
#: Sizes in code points of the segments that are merged side by side; longer ones are merged one by one.
WIDTHS = (4, 8, 16, 32, 64)
#: Symbols that are held at once when segments are merged side by side.
SLOTS = 1 << 20
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


class Pieces:
    """The model's pieces as bytes, with ranks and costs; bytes that need their byte piece."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in plain])
        self.merges = bool((scores == np.round(scores)).all())
        self.bytes_: list[bytes] = [b""] * n
        for i in plain:
            self.bytes_[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        self.costs, self.ranks = np.zeros(n), np.zeros(n, np.int64)
        self.costs[plain], self.ranks[plain] = -scores, np.unique(-scores, return_inverse=True)[1]
        costs = self.costs[plain]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[b], self.bytes_[i], self.costs[i] = i, bytes([b]), costs.max() + 10
        self.setup(plain)

    def setup(self, plain: list[int]) -> None:
        if any(b" " in self.bytes_[i].lstrip(b" ") for i in plain):
            raise ValueError("a piece has a space within; segments can't be encoded apart")
        self.single = np.ones(256, bool)  # bytes without a one-byte piece
        self.single[[self.bytes_[i][0] for i in plain if len(self.bytes_[i]) == 1]] = False
        ids = sorted(plain, key=lambda i: self.bytes_[i])
        self.ids = np.array(ids, np.int32)
        self.sizes = np.array([len(self.bytes_[i]) for i in ids])
        self.by_id = np.argsort(self.ids)
        self.depth = -(-int(self.sizes.max()) // 8) * 8
        heads = lambda fill: np.array([int.from_bytes(self.bytes_[i][:8].ljust(8, fill), "big") for i in ids], np.uint64)
        self.low, self.high = heads(b"\0"), heads(b"\xff")
        self.long = [k for k in range(len(ids)) if self.sizes[k] > 8]
        self.flat = np.frombuffer(b"".join(self.bytes_), np.uint8)
        self.at = np.append(0, np.cumsum([len(b) for b in self.bytes_]))


def suffix_array(a: np.ndarray, buf: bytes, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by the depth bytes there, and the first eight of these; eight bytes a round, and only
    places that are still equal go on."""
    words = np.ndarray((len(a) - 7,), ">u8", buf, 0, (1,))
    keys = words[places].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    sa, keys = places[order], keys[order]
    equal = keys[1:] == keys[:-1]
    for k in range(8, depth, 8):
        tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        if not len(tied):
            break
        group = np.cumsum(np.append(True, ~equal))[tied]
        more = words[np.minimum(sa[tied] + k, len(words) - 1)].astype(np.uint64)
        order = np.lexsort((more, group))
        sa[tied] = sa[tied[order]]
        more, group = more[order], group[order]
        equal = np.zeros(len(equal), bool)
        at = np.flatnonzero((group[1:] == group[:-1]) & (more[1:] == more[:-1]) & (tied[1:] == tied[:-1] + 1))
        equal[tied[at]] = True
    return sa, keys


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of starts[0], starts[0] + 1, ... for sizes[0] of them, then those of starts[1], ..."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys below 2^32, by two counting passes of 16 bits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]


def edges(a: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, piece id) of every occurrence of a piece in a, of one place by their ids."""
    buf = a.tobytes() + bytes([STOP]) * (pieces.depth + 8)
    padded = np.frombuffer(buf, np.uint8)
    places = np.flatnonzero(a != STOP)
    sa, keys = suffix_array(padded, buf, places, pieces.depth)
    low, high = np.searchsorted(keys, pieces.low, "left"), np.searchsorted(keys, pieces.high, "right")
    for k in pieces.long:
        x, y = low[k], high[k]
        if x < y:
            p, n = pieces.bytes_[pieces.ids[k]], int(pieces.sizes[k])
            view = sa[x:y]
            cut = lambda i, view=view, n=n: buf[view[i] : view[i] + n]
            low[k] = x + bisect_left(range(y - x), p, key=cut)
            high[k] = x + bisect_left(range(y - x), p + b"\0", key=cut)
    low, n = low[pieces.by_id], (high - low)[pieces.by_id]  # edges of one place then are in the order of their ids
    piece = np.repeat(pieces.by_id, n)
    left = sa[ragged(low, n)]
    return left, left + pieces.sizes[piece], pieces.ids[piece]


def encode_segments(a: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segments one after another, number of ids of each); a holds the segments with a STOP after each."""
    found = edges(a, pieces)
    return merged(a, start, end, *found, pieces) if pieces.merges else cheapest(a, start, end, *found, pieces)


class Edges:
    """Edges sorted by position, to be asked for by their ends."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray, depth: int):
        self.wide = depth + 1
        keys = left * self.wide + right - left
        order = np.argsort(keys)
        self.keys, self.ids = np.append(keys[order], np.iinfo(np.int64).max), np.append(ids[order], -1)

    def at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the edges from left to right, -1 where there is none."""
        size = right - left
        key = np.where(size < self.wide, left * self.wide + size, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], -1)


def merged(a: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Every segment begins as its code points; the edge over two neighbours that has the best rank, the leftmost of
    equals, makes them one, until no edge spans two."""
    known = Edges(left, right, ids, pieces.depth)
    heads = (a & 0xC0) != 0x80
    heads[a == STOP] = False
    heads[start[end > start]] = True
    at = np.flatnonzero(heads)  # the code points' places
    first = np.searchsorted(at, start)
    count = np.searchsorted(at, end) - first
    below = 1
    for width in WIDTHS:
        fit = np.flatnonzero((count > below) & (count <= width))
        for i in range(0, len(fit), SLOTS // width):
            rows = fit[i : i + SLOTS // width]
            heads[_merge_rows(at, first[rows], count[rows], end[rows], width, known, pieces, len(a))] = False
        below = width
    for k in np.flatnonzero(count > below).tolist():
        heads[_merge_long(np.append(at[first[k] : first[k] + count[k]], end[k]), known, pieces)] = False
    at = np.flatnonzero(heads)
    first = np.searchsorted(at, start)
    stop = np.append(at[1:], len(a))
    last = np.searchsorted(at, end) - 1
    stop[last[end > start]] = end[end > start]
    one = known.at(at, stop)
    sizes = np.where(one >= 0, 1, stop - at)  # a code point without a piece is its bytes
    to = np.append(0, np.cumsum(sizes))
    out = pieces.byte_ids[a[ragged(at, sizes)]]
    out[to[:-1][one >= 0]] = one[one >= 0]
    return out, to[np.append(first[1:], len(at))] - to[first]


def _merge_rows(at: np.ndarray, first: np.ndarray, count: np.ndarray, end: np.ndarray, width: int, known: Edges, pieces: Pieces, total: int) -> np.ndarray:
    """The places that stop being a symbol's start, of segments of at most width code points: a row each, one merge of
    every row a round. Slot 0 and the slots from the end on are no symbols."""
    n = len(first)
    slot = np.arange(width + 3)
    place = at[np.minimum(first[:, None] + slot - 1, len(at) - 1)]
    place = np.where(slot > count[:, None], end[:, None], place)
    after, before = np.tile(slot + 1, (n, 1)), np.tile(slot - 1, (n, 1))
    none = np.iinfo(np.int64).max

    def values(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of the pairs that begin in slots k: the rank, then the place."""
        mid = after[rows, k]
        ok = (k > 0) & (mid <= count[rows])
        found = np.full(len(rows), none)
        rows, k, mid = rows[ok], k[ok], mid[ok]
        begin = place[rows, k]
        got = known.at(begin, place[rows, after[rows, mid]])
        found[ok] = np.where(got >= 0, pieces.ranks[got] * total + begin, none)
        return found

    rows, k = np.nonzero((slot > 0) & (slot < count[:, None]))
    value = np.full((n, width + 3), none)
    value[rows, k] = values(rows, k)
    live, gone = np.arange(n), []
    while len(live):
        k = value[live].argmin(axis=1)
        more = value[live, k] < none
        live, k = live[more], k[more]
        mid = after[live, k]
        gone.append(place[live, mid])
        right = after[live, mid]
        after[live, k], before[live, right], value[live, mid] = right, k, none
        value[live, k] = values(live, k)
        k = before[live, k]
        value[live, k] = values(live, k)
    return np.concatenate(gone)


def _merge_long(place: np.ndarray, known: Edges, pieces: Pieces) -> list[int]:
    """The same of one segment with many code points, by a heap; place ends with the segment's end."""
    n = len(place) - 1
    lo, hi = np.searchsorted(known.keys, place[[0, -1]] * known.wide)
    keys, ranks = known.keys[lo:hi], pieces.ranks[known.ids[lo:hi]]
    at, after, before = (array("q", x.tobytes()) for x in (place.astype(np.int64), np.arange(1, n + 2), np.arange(-1, n)))
    now = array("q", [-1]) * n  # the rank of the pair that begins here
    heap: list[int] = []

    def offer(i: int) -> None:
        now[i], j = -1, after[i]
        if j < n:
            size = at[after[j]] - at[i]
            key = at[i] * known.wide + size
            k = int(keys.searchsorted(key)) if size < known.wide else len(keys)
            if k < len(keys) and keys[k] == key:
                now[i] = int(ranks[k])
                heappush(heap, now[i] * n + i)

    for i in range(n - 1):
        offer(i)
    gone = []
    while heap:
        rank, i = divmod(heappop(heap), n)
        if now[i] != rank:
            continue  # the pair has become another since
        j = after[i]
        now[j], after[i] = -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        gone.append(at[j])
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return gone


def cheapest(a: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest path over every segment, ties by the lesser id; bytes without a one-byte piece have an edge of
    their byte piece."""
    places = np.flatnonzero(a != STOP)
    odd = places[pieces.single[a[places]]]
    left, right, ids = np.append(left, odd), np.append(right, odd + 1), np.append(ids, pieces.byte_ids[a[odd]])
    # edges in the order in which they can be relaxed: by the distance of their end from the segment's start
    owner = np.repeat(np.arange(len(start)), end - start + 1)  # of every byte, stops included
    ahead = np.arange(len(a)) - start[owner]  # of every byte, from its segment's start
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(np.minimum(ahead, 0xFFFF).astype(np.uint16), kind="stable") if ahead.max() < 0xFFFF else np.argsort(ahead, kind="stable")] = np.arange(len(a))
    order = radix_order(rank[right])
    left, right, ids = left[order], right[order], ids[order]
    step = ahead[right]
    cost = pieces.costs[ids]
    best = np.full(len(a) + 1, np.inf)
    best[start] = 0
    came, by = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int32)
    group = np.flatnonzero(np.append(True, (right[1:] != right[:-1]) | (step[1:] != step[:-1]))) if len(left) else np.zeros(0, np.int64)
    rounds = np.flatnonzero(np.append(True, step[group][1:] != step[group][:-1])) if len(group) else group
    inf = len(left)
    # a place is the start of one segment and, one before it, the stop of another: ends are kept at right
    value = best
    for r, g0 in enumerate(rounds.tolist()):
        g1 = int(rounds[r + 1]) if r + 1 < len(rounds) else len(group)
        e0, e1 = int(group[g0]), int(group[g1]) if g1 < len(group) else inf
        heads = group[g0:g1] - e0
        total = value[left[e0:e1]] + cost[e0:e1]
        least = np.minimum.reduceat(total, heads)
        sizes = np.diff(np.append(heads, e1 - e0))
        first = np.minimum.reduceat(np.where(total == np.repeat(least, sizes), np.arange(e1 - e0), inf), heads) + e0
        to = right[e0:e1][heads]
        value[to], came[to], by[to] = least, left[first], ids[first]
    counts = np.zeros(len(start), np.int64)
    at, live, found = end.copy(), np.flatnonzero(end > start), []
    while len(live):
        p = at[live]
        found.append((live, by[p]))
        counts[live] += 1
        at[live] = came[p]
        live = live[at[live] > start[live]]
    out = np.zeros(int(counts.sum()), np.int32)
    last = np.cumsum(counts)
    for k, (rows, got) in enumerate(found):
        out[last[rows] - 1 - k] = got
    return out, counts


def laid_out(a: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the segments of a one after another, number of ids of each), by one index of all of them."""
    own = np.cumsum(size + 1) - size - 1
    index = np.full(int((size + 1).sum()), STOP, np.uint8)
    index[ragged(own, size)] = a[ragged(start, size)]
    return encode_segments(index, own, own + size, pieces)


class Encoder:
    """Encodes batches; segments that were met before, up to MEMO of them, aren't encoded again."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        full = [b" " + t if t else b"" for t in texts]
        a = np.frombuffer(b"".join(full), np.uint8)
        ends = np.cumsum([len(t) for t in full])
        if not len(a):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        new = (a == 32) & np.append(True, a[:-1] != 32)
        new[(ends - [len(t) for t in full])[[len(t) > 0 for t in full]]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(a))
        hashes, one, where = np.unique(span_hash(a, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > MEMO:
            self.clear()
        self.learn(a, start[one], end[one], hashes)
        at = np.searchsorted(self.hashes, hashes)[where]
        n = self.counts[at]
        sums = np.append(0, np.cumsum(n))
        cut = np.searchsorted(start, np.append(0, ends))
        ids = self.ids[ragged(self.first[at], n)]
        if not np.array_equal(spelled(ids, self.pieces), a):
            self.clear()
            ids, n = laid_out(a, start, end - start, self.pieces)
            sums = np.append(0, np.cumsum(n))
        return ids, np.diff(sums[cut])

    def learn(self, a: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        fresh = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        start, size, hashes = start[fresh], (end - start)[fresh], hashes[fresh]
        if not len(size):
            return
        ids, counts = laid_out(a, start, size, self.pieces)
        first = np.cumsum(counts) - counts + len(self.ids)
        to = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.counts = np.insert(self.hashes, to, hashes), np.insert(self.first, to, first), np.insert(self.counts, to, counts)
        self.ids = np.append(self.ids, ids)


def encode(texts: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of ids of each)."""
    return Encoder(pieces).encode(texts)


def spelled(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The bytes of the ids."""
    return pieces.flat[ragged(pieces.at[ids], np.diff(pieces.at)[ids])]


def decode(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> list[bytes]:
    sizes = np.diff(pieces.at)[ids]
    flat = spelled(ids, pieces).tobytes()
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
    return [flat[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _share(df: DataFrame, model: str):
    return df.sparkSession.sparkContext.broadcast(Pieces(model))  # of the vocabulary's size


def encode_column(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with ids, in one narrow pass."""
    shared = _share(docs, model)
    task: list[Encoder] = []

    def make(batch: pa.RecordBatch) -> list:
        if not task:
            task.append(Encoder(shared.value))
        ids, counts = task[0].encode(utf8(batch.column(text)))
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))]

    return append_columns(docs, IDS, text, make)


def decode_column(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with decoded, the text of their ids, in one narrow pass."""
    shared = _share(docs, model)
    out = T.StructType([f for f in docs.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                col = batch.column(ids)
                counts = np.array([len(x) if x is not None else 0 for x in col], np.int64) if col.null_count else np.diff(col.offsets.to_numpy())
                texts = decode(col.flatten().to_numpy(zero_copy_only=False), counts, shared.value)
                columns = [batch.column(f.name) for f in out.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t.decode(errors="replace") for t in texts], schema.field("decoded").type)], names=schema.names)

    return docs.mapInArrow(run, out)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256 (of the ids as 32-bit little-endian), decoded_sha256, same: each text is
    encoded and its ids are decoded, in one worker, so that the ids needn't travel; with keep_ids they are kept too."""
    bounded(docs.sparkSession)
    shared = _share(docs, model)

    def run(batches):
        encoder = Encoder(shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                texts = utf8(batch.column(text))
                ids, counts = encoder.encode(texts)
                back = decode(ids, counts, shared.value)
                cut = np.append(0, np.cumsum(counts))
                ends = cut.tolist()
                columns = {
                    "doc_id": batch.column(doc_id).cast(pa.int64()),
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    "same": pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids array<int>" * keep_ids)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
