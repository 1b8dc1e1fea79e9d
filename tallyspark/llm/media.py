"""Media columns: progressive JPEG, written and read in numpy.

Reading accumulates the scans of a file into coefficient arrays: DC and AC bands (spectral selection), first passes
and refinements (successive approximation). Each restart interval of each file of a batch is a lane; all lanes of a
scan are read together, one symbol a step. The coefficients are then inverse-transformed (fixed point, so results
don't depend on the batch), chroma is upsampled to full resolution, and the pixels are given as RGB tensors.

Writing stores a payload losslessly as quantised coefficients, the unit of the format: 64 bytes are one block in
zigzag order, and a byte b is the coefficient b - 108 from 110 up, b - 111 below it, so that none is -1, 0 or 1. The
blocks fill the Y, Cb and Cr grids of a 4:2:0 image one after another; what is left of a grid is zero. A comment
segment holds the payload's length. The scans are: DC of all components, AC 1-5 and 6-63 of Y, AC 1-63 of Cb and of
Cr, all without their last bit; then the last bits of DC, Y, Cb and Cr.

Cases: null is stored as the empty text, whose payload is 64 bytes 0. Repeated texts give equal files. Rows of any
other columns are passed by load_images and store_payloads; those named like a result column are replaced. An empty
table gives an empty result. Files that are no progressive JPEG of this decoder's kinds (1 or 3 components, 8 bits)
raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, slices, utf8

#: Blocks, or MCUs where components are interleaved, of one restart interval; MCUs that an image is high at most.
INTERVAL = 16
HIGH = 4095
ZERO_BYTE = 110
DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "payload_bytes")]
    + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def zigzag() -> np.ndarray:
    """The place in a block, row by row, of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8)))


# Huffman tables


def code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """The lengths of the codes of the DC and AC symbols that writing uses."""
    ac = {s: 11 for s in range(256) if s & 15 <= 10}
    ac |= {3: 2, 2: 3, 4: 3, 6: 3, 1: 4, 5: 4, 0: 5, 7: 6, 8: 7, 0xF0: 8}
    return dict.fromkeys(range(12), 4), ac


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), from the counts of the lengths 1 to 16 and the symbols in order."""
    out, code, i = {}, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            out[symbols[i]] = (code, size)
            code, i = code + 1, i + 1
        code *= 2
    return out


def table_bytes(lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order)


@cache
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits to come: length * 256 + symbol; 0 where no code begins so."""
    counts = list(table[:16])
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in canonical(counts, list(table[16:])).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + s
    return out


# Writing


@cache
def byte_tables() -> dict:
    """What writing looks up by byte: coefficient, AC code with its bits, last bit; and DC codes by difference."""
    dc_len, ac_len = code_lengths()
    dc, ac = (canonical(list(t[:16]), list(t[16:])) for t in (table_bytes(dc_len), table_bytes(ac_len)))
    coef = np.array([b - ZERO_BYTE + (2 if b >= ZERO_BYTE else -1) for b in range(256)])

    def bits(v: int, codes: dict, symbol: int) -> tuple[int, int]:
        size = abs(v).bit_length()
        code, n = codes[symbol or size]
        return code << size | (v if v >= 0 else v + (1 << size) - 1), n + size

    first = [bits(int(np.sign(c)) * (abs(int(c)) >> 1), ac, 0) for c in coef]
    diff = [bits(d, dc, 0) for d in range(-1024, 1025)]
    return {
        "coef": coef.astype(np.int16),
        "ac": np.array([v for v, _ in first], np.uint64),
        "ac_n": np.array([n for _, n in first]),
        "last": (np.abs(coef) & 1).astype(np.uint8),
        "dc": np.array([v for v, _ in diff], np.uint64),
        "dc_n": np.array([n for _, n in diff]),
        "eob": ac[0],
        "tables": (table_bytes(dc_len), table_bytes(ac_len)),
    }


def pack(value: np.ndarray, size: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all lanes, bytes of each lane); rows of bit items in order, each row with the number of its lane."""
    bits = size.sum(1)
    head = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
    lane_bits = np.add.reduceat(bits, head)
    n_bytes = (lane_bits + 7) // 8
    base = 8 * (np.cumsum(n_bytes) - n_bytes)
    row = np.cumsum(bits) - bits
    row += np.repeat(base - row[head], np.diff(np.append(head, len(lane))))
    at = (row[:, None] + np.cumsum(size, 1) - size).ravel()
    shifted = value.ravel() << (64 - (at & 31) - size.ravel()).clip(0, 63).astype(np.uint64)
    shifted[size.ravel() == 0] = 0
    total = int(n_bytes.sum())
    n = total // 4 + 2
    word = at >> 5
    sums = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n + 1)
    sums[1:] += np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:-1]
    out = sums.astype(np.uint64).astype(">u4").view(np.uint8)[:total].copy()
    out[np.cumsum(n_bytes) - 1] |= ((1 << (8 * n_bytes - lane_bits)) - 1).astype(np.uint8)
    return out, n_bytes


def stuffed(data: np.ndarray, n_bytes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes with a 0 after each FF and restart markers before lanes whose number in their file
    isn't 0; the place of each lane's begin, its marker included."""
    ff = data == 0xFF
    marked = np.cumsum(number > 0)
    at = np.arange(len(data)) + np.cumsum(ff) - ff + 2 * np.repeat(marked, n_bytes)
    out = np.zeros(len(data) + int(ff.sum()) + 2 * int(marked[-1]), np.uint8)
    out[at] = data
    first = at[np.cumsum(n_bytes) - n_bytes]
    on = number > 0
    out[first[on] - 2] = 0xFF
    out[first[on] - 1] = 0xD0 + ((number[on] - 1) & 7)
    return out, first - 2 * on


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan_header(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return segment(0xDA, bytes([len(components), *[x for c in components for x in (c, 0)], ss, se, ah << 4 | al]))


SCRIPT = (((1, 2, 3), 0, 0, 0, 1), ((1,), 1, 5, 0, 1), ((1,), 6, 63, 0, 1), ((2,), 1, 63, 0, 1), ((3,), 1, 63, 0, 1), ((1, 2, 3), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((3,), 1, 63, 1, 0))


def mcu_blocks(wide: int, high: int) -> np.ndarray:
    """The block numbers (Y grid, then Cb, then Cr) of each MCU in order: four of Y, one of each chroma."""
    r, c = np.divmod(np.arange(wide * high), wide)
    y = [(2 * r + a) * 2 * wide + 2 * c + b for a in (0, 1) for b in (0, 1)]
    n = wide * high
    return np.stack([*y, 4 * n + r * wide + c, 5 * n + r * wide + c], 1)


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a positive multiple of 64."""
    t = byte_tables()
    sizes = np.array([len(p) for p in payloads]) // 64
    mcus = -(-sizes // 6)
    wide = -(-mcus // HIGH)
    high = -(-mcus // wide)
    full = wide * high
    base = np.cumsum(6 * full) - 6 * full
    data = np.full((int(6 * full.sum()), 64), 0, np.uint8)
    used = np.zeros(len(data), bool)
    for b, n, p in zip(base.tolist(), sizes.tolist(), payloads, strict=True):
        data[b : b + n] = np.frombuffer(p, np.uint8).reshape(-1, 64)
        used[b : b + n] = True
    dc = np.where(used, t["coef"][data[:, 0]], 0).astype(np.int64)
    order = np.concatenate([b + mcu_blocks(w, h) for b, w, h in zip(base.tolist(), wide.tolist(), high.tolist(), strict=True)])
    doc_of_mcu = np.repeat(np.arange(len(full)), full)
    in_doc = np.arange(len(order)) - np.repeat(np.cumsum(full) - full, full)

    def lanes(in_file: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane of each row, number of each lane in its file, first lane of each file)."""
        new = in_file % INTERVAL == 0
        lane = np.cumsum(new) - 1
        return lane, (in_file // INTERVAL)[new], np.searchsorted(doc[new], np.arange(len(full)))

    def ac_rows(component: int) -> tuple[np.ndarray, tuple]:
        n = 4 * full if component == 1 else full
        start = base + (0, 0, 4, 5)[component] * full
        in_file = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(start, n) + in_file, lanes(in_file, np.repeat(np.arange(len(n)), n))

    parts: list[list[bytes]] = [[] for _ in payloads]
    rows = {c: ac_rows(c) for c in (1, 2, 3)}
    for components, ss, se, ah, al in SCRIPT:
        if len(components) > 1:
            lane, number, first = lanes(in_doc, doc_of_mcu)
            if ah:
                value, size = (dc[order] & 1).astype(np.uint64), np.ones(order.shape, np.int64)
            else:
                v = dc[order] >> 1
                # each component's difference to its last block in the interval
                before = np.zeros_like(v)
                before[:, 1:4] = v[:, 0:3]
                before[1:, 0], before[1:, 4:] = v[:-1, 3], v[:-1, 4:]
                restart = np.append(True, lane[1:] != lane[:-1])
                before[restart, 0] = before[restart, 4] = before[restart, 5] = 0
                d = v - before + 1024
                value, size = t["dc"][d], t["dc_n"][d]
        else:
            blocks, (lane, number, first) = rows[components[0]]
            code, n = t["eob"]
            on = used[blocks]
            if ah:
                last = np.zeros((len(blocks), 64), np.uint8)
                last[:, :63] = t["last"][data[blocks][:, 1:]]
                word = np.packbits(last, axis=1).view(">u4").astype(np.uint64)
                value = np.stack([np.full(len(blocks), code, np.uint64), word[:, 0], word[:, 1] >> np.uint64(1)], 1)
                size = np.tile(np.array([n, 32, 31]), (len(blocks), 1))
                size[~on, 1:] = 0
            else:
                band = data[blocks][:, ss : se + 1]
                value, size = t["ac"][band], t["ac_n"][band]
                value[~on, 0], size[~on, 0], size[~on, 1:] = code, n, 0
        coded, begin = stuffed(*pack(value, size, lane), number)
        raw = coded.tobytes()
        ends = np.append(begin[first], len(raw)).tolist()
        head = scan_header(list(components), ss, se, ah, al)
        for i, x in enumerate(parts):
            x += (head, raw[ends[i] : ends[i + 1]])
    dht = segment(0xC4, b"\x00" + t["tables"][0] + b"\x10" + t["tables"][1])
    rest = segment(0xDB, b"\0" + b"\1" * 64)
    out = []
    for p, w, h, x in zip(payloads, wide.tolist(), high.tolist(), parts, strict=True):
        frame = segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(p))), rest, frame, dht, segment(0xDD, struct.pack(">H", INTERVAL)), *x, b"\xff\xd9"]))
    return out


# Reading


class Image:
    """One file: its frame, tables and scans; blocks: where its coefficients are in the batch's array."""

    def __init__(self, raw: bytes):
        self.raw, self.comment, self.scans = raw, b"", []
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[int, bytes] = {}
        interval, at, frame = 0, 2, None
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        while True:
            at = raw.index(b"\xff", at)
            marker = raw[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            n = struct.unpack_from(">H", raw, at + 2)[0]
            body = raw[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:k]
                    body = body[k:]
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                frame = body
                self.frame(body)
            elif marker == 0xDA:
                if frame is None:
                    raise ValueError("a scan before the frame")
                k = body[0]
                ids = [body[1 + 2 * i] for i in range(k)]
                used = tuple((tables.get(body[2 + 2 * i] >> 4, b""), tables.get(16 + (body[2 + 2 * i] & 15), b"")) for i in range(k))
                ss, se, a = body[1 + 2 * k : 4 + 2 * k]
                end = at
                while True:
                    end = raw.index(b"\xff", end)
                    if raw[end + 1] and not 0xD0 <= raw[end + 1] <= 0xD7:
                        break
                    end += 2
                self.scans.append(((tuple(self.names.index(i) for i in ids), ss, se, a >> 4, a & 15, used), interval, at, end))
                at = end
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("no progressive Huffman JPEG")

    def frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("only 8 bits and 1 or 3 components are read")
        self.names = [body[6 + 3 * i] for i in range(n)]
        self.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
        self.quant_of = [body[8 + 3 * i] for i in range(n)]
        h, v = (max(x) for x in zip(*self.sampling, strict=True))
        self.mcus = (-(-self.width // (8 * h)), -(-self.height // (8 * v)))
        self.grid = [(self.mcus[0] * a, self.mcus[1] * b) for a, b in self.sampling]
        self.own = [(-(-(-(-self.width * a // h)) // 8), -(-(-(-self.height * b // v)) // 8)) for a, b in self.sampling]
        sizes = [a * b for a, b in self.grid]
        self.offset = [sum(sizes[:i]) for i in range(n)]
        self.n_blocks = sum(sizes)

    def order(self, components: tuple[int, ...]) -> np.ndarray:
        """Block numbers in the order of a scan: a row per MCU."""
        if len(components) == 1:
            c = components[0]
            w, h = self.own[c]
            r, x = np.divmod(np.arange(w * h), w)
            return (self.offset[c] + r * self.grid[c][0] + x)[:, None]
        r, x = np.divmod(np.arange(self.mcus[0] * self.mcus[1]), self.mcus[0])
        return np.stack([self.offset[c] + (r * v + b) * self.grid[c][0] + x * h + a for c in components for h, v in [self.sampling[c]] for b in range(v) for a in range(h)], 1)


class Lanes:
    """The restart intervals of one scan of several files, ready to be read bit by bit."""

    def __init__(self, images: list[tuple[Image, int, int, int]], base: list[int], components: tuple[int, ...]):
        raw = [im.raw[a:b] for im, _, a, b in images]
        data = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
        size = np.array([len(x) for x in raw])
        file_at = np.cumsum(size) - size
        ff = data[:-2] == 0xFF
        after = data[1:-1]
        restart = np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
        drop = np.zeros(len(data), bool)
        drop[1:-1] = ff & (after == 0)
        drop[restart] = drop[restart + 1] = True
        drop[-2:] = True
        kept = np.cumsum(~drop) - ~drop
        begin = np.sort(np.concatenate([file_at, restart + 2]))
        self.file = np.searchsorted(file_at, begin, "right") - 1
        self.at = kept[begin].astype(np.int64) * 8
        clean = np.concatenate((data[~drop], np.zeros(16, np.uint8)))
        self.words = np.ndarray((len(clean) - 7,), ">u8", clean.tobytes(), 0, (1,))
        self.limit = 8 * (len(clean) - 8)
        number = np.arange(len(begin)) - np.searchsorted(self.file, self.file)
        rows, first, count = [], [], []
        total = 0
        orders = {}
        for i, (im, interval, _, _) in enumerate(images):
            key = (im.width, im.height, tuple(im.sampling))
            if key not in orders:
                orders[key] = im.order(components)
            order = orders[key] + base[i]
            k = int((self.file == i).sum()) if len(images) == 1 else None
            rows.append(order)
            first.append(total)
            count.append((len(order), interval or len(order), k))
            total += len(order)
        self.rows = np.concatenate(rows)
        n = np.array([c[0] for c in count])[self.file]
        step = np.array([c[1] for c in count])[self.file]
        self.first = np.array(first)[self.file] + number * step
        self.n = np.clip(n - number * step, 0, step)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place on, at the top of a word."""
        at = np.minimum(at, self.limit)
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


def bits_of(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The top n bits, n from 0 to 16."""
    return ((word >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The signed value that n extra bits say."""
    return np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)


def symbols(lanes: Lanes, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, the word after it, the place after it)."""
    word = lanes.peek(at)
    hit = table[(word >> np.uint64(48)).astype(np.int64)]
    if not hit.all():
        raise ValueError("a code that no table has")
    n = hit >> 8
    return hit & 255, word << n.astype(np.uint64), at + n


def dc_first(coefs: np.ndarray, lanes: Lanes, scan: tuple, sampling: list) -> None:
    components, _, _, _, al, tables = scan
    which = [i for i, c in enumerate(components) for _ in range(sampling[c][0] * sampling[c][1] if len(components) > 1 else 1)]
    tabs = [lookup(t[0]) for t in tables]
    last = np.zeros((len(components), len(lanes.at)), np.int64)
    at, live = lanes.at.copy(), np.flatnonzero(lanes.n > 0)
    for m in range(int(lanes.n.max(initial=0))):
        live = live[lanes.n[live] > m]
        blocks = lanes.rows[lanes.first[live] + m]
        for j, c in enumerate(which):
            size, word, place = symbols(lanes, at[live], tabs[c])
            last[c, live] += extend(bits_of(word, size), size)
            coefs[blocks[:, j], 0] = last[c, live] << al
            at[live] = place + size


def dc_refine(coefs: np.ndarray, lanes: Lanes, scan: tuple) -> None:
    k = lanes.rows.shape[1]
    n = lanes.n * k
    lane = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
    bit = (lanes.peek(lanes.at[lane] + i) >> np.uint64(63)).astype(np.int16)
    coefs[lanes.rows[lanes.first[lane] + i // k, i % k], 0] |= bit << scan[4]


def ac_first(coefs: np.ndarray, lanes: Lanes, scan: tuple) -> None:
    _, ss, se, _, al, tables = scan
    table = lookup(tables[0][1])
    flat, rows = coefs.reshape(-1), lanes.rows[:, 0]
    live = lanes.n > 0
    at, block, stop = lanes.at[live], lanes.first[live], (lanes.first + lanes.n)[live]
    k = np.full(len(at), ss)
    while len(at):
        symbol, word, at = symbols(lanes, at, table)
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        n = np.where(end, run, size)
        extra = bits_of(word, n)
        at = at + n
        k = k + run
        put = size > 0
        if put.all():
            flat[rows[block] * 64 + k] = extend(extra, size) << al
        else:
            flat[rows[block[put]] * 64 + k[put]] = extend(extra[put], size[put]) << al
        k = k + 1
        done = end | (k > se)
        block = block + np.where(end, (1 << run) + extra, done)
        k = np.where(done, ss, k)
        on = block < stop
        if not on.all():
            at, block, stop, k = at[on], block[on], stop[on], k[on]


def ac_refine(coefs: np.ndarray, lanes: Lanes, scan: tuple) -> None:
    """Symbols are read one a step; the correction bits that each passes are noted and applied in bulk."""
    _, ss, se, _, al, tables = scan
    table = lookup(tables[0][1])
    rows = lanes.rows[:, 0]
    width = se - ss + 1
    old = coefs[rows, ss : se + 1] != 0
    ones = np.zeros((len(rows), width + 1), np.int16)
    np.cumsum(old, axis=1, out=ones[:, 1:])
    zeros = np.arange(width + 1, dtype=np.int16) - ones
    # the place of each block's i-th zero, width where there is none
    place = np.full((len(rows), width + 1), width, np.int16)
    r, c = np.nonzero(~old)
    place[r, zeros[r, c]] = c
    live = np.flatnonzero(lanes.n > 0)
    at, block, stop = lanes.at[live], lanes.first[live], (lanes.first + lanes.n)[live]
    k, runs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    noted: list[tuple] = []
    fresh: list[tuple] = []
    while len(at):
        read = runs == 0
        to = np.full(len(at), width)
        if read.any():
            symbol, word, after = symbols(lanes, at[read], table)
            run, size = symbol >> 4, symbol & 15
            end = (size == 0) & (run < 15)
            n = np.where(end, run, size)
            extra = bits_of(word, n)
            at[read] = after + n
            index = np.minimum(zeros[block[read], k[read]] + run, width)
            to[read] = np.where(end, width, place[block[read], index])
            runs[read] = np.where(end, (1 << run) + extra, 0)
            new = np.zeros(len(at), bool)
            new[np.flatnonzero(read)[size == 1]] = True
            if new.any():
                sign = np.zeros(len(at), np.int64)
                sign[np.flatnonzero(read)] = extra
                fresh.append((block[new], to[new], sign[new]))
        passed = ones[block, to] - ones[block, k]
        some = passed > 0
        if some.any():
            noted.append((block[some], ones[block[some], k[some]].astype(np.int64), passed[some].astype(np.int64), at[some]))
        at = at + passed
        ended = runs > 0
        runs = runs - ended
        k = np.minimum(to + 1, width)
        done = ended | (k >= width)
        block = block + done
        k = np.where(done, 0, k)
        on = block < stop
        if not on.all():
            at, block, stop, k, runs = at[on], block[on], stop[on], k[on], runs[on]
    if noted:
        b, skip, n, start = (np.concatenate(x) for x in zip(*noted, strict=True))
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        bit = (lanes.peek(np.repeat(start, n) + i) >> np.uint64(63)).astype(bool)
        b, nth = np.repeat(b, n)[bit], (np.repeat(skip, n) + i)[bit]
        flat = np.flatnonzero(old)
        before = np.cumsum(old.sum(1)) - old.sum(1)
        col = flat[before[b] + nth] % width + ss
        v = coefs[rows[b], col]
        coefs[rows[b], col] = v + np.where(v > 0, 1 << al, -(1 << al)).astype(np.int16)
    for b, c, sign in fresh:
        coefs[rows[b], c + ss] = np.where(sign > 0, 1 << al, -(1 << al))


def coefficients(images: list[Image]) -> tuple[np.ndarray, list[int]]:
    """All blocks of all images, coefficients in zigzag order, and where each image's begin."""
    sizes = [im.n_blocks for im in images]
    base = (np.cumsum(sizes) - sizes).tolist()
    coefs = np.zeros((sum(sizes), 64), np.int16)
    for i in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for j, im in enumerate(images):
            if i < len(im.scans):
                groups.setdefault((im.scans[i][0], tuple(im.sampling)), []).append(j)
        for (scan, sampling), own in groups.items():
            lanes = Lanes([(images[j], *images[j].scans[i][1:]) for j in own], [base[j] for j in own], scan[0])
            if scan[1] == 0:
                dc_refine(coefs, lanes, scan) if scan[3] else dc_first(coefs, lanes, scan, list(sampling))
            else:
                ac_refine(coefs, lanes, scan) if scan[3] else ac_first(coefs, lanes, scan)
    return coefs, base


@cache
def transform() -> np.ndarray:
    """The 64 x 64 inverse transform from zigzag order, times 2^13, in whole numbers: products and sums stay exact
    in doubles, in whatever order they are made."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.round(np.kron(c, c)[zigzag()] * 8192)


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """The samples of blocks, 0 to 255, 8 x 8 each."""
    x = (coefs.astype(np.float64) * quant) @ transform()
    return np.clip(np.floor(x / 8192 + 0.5) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb(im: Image, planes: list[np.ndarray]) -> np.ndarray:
    """The pixels at full resolution; chroma samples are repeated."""
    h, v = (max(x) for x in zip(*im.sampling, strict=True))
    full = []
    for (w_, h_), (a, b), p in zip(im.grid, im.sampling, planes, strict=True):
        plane = p.reshape(h_, w_, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h_, 8 * w_)
        if (a, b) != (h, v):
            plane = plane.repeat(v // b, 0).repeat(h // a, 1)
        full.append(plane[: im.height, : im.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = (x.astype(np.int32) for x in full)
    cb, cr = cb - 128, cr - 128
    y = (y << 16) + 32768
    return np.clip(np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2) >> 16, 0, 255).astype(np.uint8)


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray, list[int], list[np.ndarray]]:
    """The images, their coefficients, where each one's begin, and their RGB tensors."""
    images = [Image(f) for f in files]
    coefs, base = coefficients(images)
    out = []
    same = len({im.quant[q].tobytes() for im in images for q in im.quant_of}) == 1 and len(images) > 0
    if same:
        whole = samples(coefs, images[0].quant[images[0].quant_of[0]])
    for im, b in zip(images, base, strict=True):
        planes = []
        for c in range(len(im.names)):
            x, n = b + im.offset[c], im.grid[c][0] * im.grid[c][1]
            planes.append(whole[x : x + n] if same else samples(coefs[x : x + n], im.quant[im.quant_of[c]]))
        out.append(rgb(im, planes))
    return images, coefs, base, out


def payload_of(im: Image, coefs: np.ndarray) -> bytes:
    """The payload that write() stored, from the coefficients read."""
    n = struct.unpack(">Q", im.comment)[0]
    c = coefs.reshape(-1)[:n]
    return (c + np.where(c > 0, ZERO_BYTE - 2, ZERO_BYTE + 1)).astype(np.uint8).tobytes()


# Columns


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (64 if not text else 0))


def store_payloads(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media, the JPEG file that holds the text."""
    return append_columns(docs, T.StructType([T.StructField("media", T.BinaryType())]), text, lambda batch: [write([padded(x) for x in utf8(batch.column(text))])])


def load_images(files: DataFrame, media: str = "media") -> DataFrame:
    """files with width, height and rgb, the tensor's bytes row by row."""
    fields = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType())])

    def make(batch: pa.RecordBatch) -> list:
        images, _, _, pixels = read(batch.column(media).to_pylist())
        return [[im.width for im in images], [im.height for im in images], [x.tobytes() for x in pixels]]

    return append_columns(files, fields, media, make)


def feature(pixels: np.ndarray) -> str:
    """Width, height and the sum of each channel."""
    return f"{pixels.shape[1]}x{pixels.shape[0]}:" + ",".join(str(int(x)) for x in pixels.reshape(-1, 3).sum(0, dtype=np.int64))


def digest(stored: DataFrame) -> DataFrame:
    """What reading the stored files back gives, a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(DIGEST)
        for whole in batches:
            for batch in slices(whole, "media", 2 << 20):
                files = batch.column("media").to_pylist()
                images, coefs, base, pixels = read(files)
                rows = []
                for i, n, f, im, b, x in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), files, images, base, pixels, strict=True):
                    p = payload_of(im, coefs[b : b + im.n_blocks])
                    rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(x)))
                yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return digest(store_payloads(docs))
