"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Each text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B, which adds
that space itself); special tokens' strings are plain text. A's and B's tokens are the two sides of a graph whose links
are all pairs of tokens that overlap; its connected components, found by union-find, are the minimal groups of tokens
that cover the same bytes. Tokens of many texts are one graph in a worker, as no link leaves a text.

1. One narrow pass encodes, aligns and stores per text its counts, the digest of its groups and its links. These are
   numbers into the distinct id pairs of their chunk (about CHUNK_BYTES of text), the most frequent first, sorted and
   stored as gaps.
2. The chunks' pairs are summed over the corpus: a pair is one row per chunk before any shuffle, however frequent. The
   best pair of each B id is a row per id, bounded by the vocabulary, the only thing that is broadcast.
3. Sums go back to the chunks that hold the pair, and each chunk's texts add up their links' counts. A chunk's pairs
   and texts are bounded, so no key and no document makes a task that grows with the corpus (a text longer than a
   chunk is a chunk of its own).

Cases: null and empty texts, and texts whose joined token bytes on either side are not the space and the text (the
piece mark itself in a text, say), have no tokens: zeros and an empty digest. Very long texts are encoded and aligned
whole. Rows that repeat count once each, corpus-wide counts included; a pair that ties with the best is a best one. Null
ids stay, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, slices, spill, utf8
from .tokencount import byte_letters

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose pairs are one chunk.
CHUNK_BYTES = 8 << 20
#: How byte-level vocabularies of this family cut a text before merging (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


class Side:
    """A vocabulary's token bytes as one array, with where each token's lie."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        # decimal digits, right-aligned in a row per id
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(d.rjust(7, b"\0") for d in digits), np.uint8).reshape(-1, 7)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.blob[at]


class ByteSide(Side):
    """The byte-level vocabulary of a tokenizer file. Where ids follow the merges' order, as in this family, a rank
    encoder gives the same ids as the file's own model, and faster; else the file's model encodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"]
        tokens = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for entry, i in vocabulary.items():
            if i not in special:
                tokens[i] = bytes(letters[c] for c in entry)
        super().__init__(tokens)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merged = [vocabulary[a + b] for a, b in pairs]
        first = min(merged, default=0)
        ranked = merged == list(range(first, first + len(merged))) and all(len(t) == 1 for i, t in enumerate(tokens[:first]) if i not in special)
        if ranked and _plain_words(spec):
            import tiktoken

            coder = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
            self.encode = lambda texts: [coder.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda texts: [np.array(e.ids, np.int64) for e in model.encode_batch(texts, add_special_tokens=False)]


def _plain_words(spec: dict) -> bool:
    """Whether the file cuts texts by WORDS, with nothing else before or after."""
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", False)
    return plain and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")


class PieceSide(Side):
    """The pieces of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i):
                tokens.append(b"")
            elif model.is_byte(i):
                tokens.append(bytes([int(re.fullmatch(r"<0x([0-9A-F]{2})>", piece)[1], 16)]))
            else:
                tokens.append(piece.replace("▁", " ").encode())
        super().__init__(tokens)
        self.encode = lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]


@cache
def sides(byte_vocabulary: str, piece_model: str) -> tuple[ByteSide, PieceSide]:
    """Both vocabularies, once a worker."""
    return ByteSide(byte_vocabulary), PieceSide(piece_model)


def find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over arrays: the least node of each node's component. Every round hooks the greater root of each
    link below the lesser one and then compresses all paths by halving."""
    up = np.arange(n, dtype=np.int32)
    while len(u):
        ru, rv = up[u], up[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(up, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
    return up


class Aligned:
    """The tokens, links and groups of some texts."""

    def __init__(self, texts: list[bytes], a: ByteSide, b: PieceSide):
        n = len(texts)
        self.ids, count = [], []
        decoded = [t.decode("utf-8") for t in texts]
        ids_a, ids_b = a.encode([" " + t for t in decoded]), b.encode(decoded)
        fits = np.array([len(t) > 0 for t in texts])
        for side, ids in ((a, ids_a), (b, ids_b)):
            each = np.array([len(x) for x in ids], np.int64)
            every = np.concatenate([*ids, np.zeros(0, np.int64)])
            said = np.append(0, np.cumsum(side.size[every]))[np.append(0, np.cumsum(each))]
            made = memoryview(side.bytes_of(every))
            empty = np.append(0, np.cumsum(side.size[every] == 0))[np.append(0, np.cumsum(each))]
            fits &= np.array([made[p:q] == b" " + t and not e for p, q, t, e in zip(said[:-1].tolist(), said[1:].tolist(), texts, np.diff(empty).tolist(), strict=True)], bool)
        for side, ids in ((a, ids_a), (b, ids_b)):
            self.ids.append(np.concatenate([*[x for x, on in zip(ids, fits.tolist(), strict=True) if on], np.zeros(0, np.int64)]))
            count.append(np.array([len(x) if on else 0 for x, on in zip(ids, fits.tolist(), strict=True)], np.int64))
        self.n_a, self.n_b = count
        # every text's tokens end where it ends, on both sides, so that all texts lie on one line
        ends = [np.cumsum(side.size[i]) for side, i in zip((a, b), self.ids, strict=True)]
        marks = [np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, bool) for _ in ends]
        for mark, end in zip(marks, ends, strict=True):
            mark[end] = True
        # between two neighbouring ends lies one link
        at = np.flatnonzero(marks[0] | marks[1])
        self.link_a, self.link_b = (np.cumsum(m, dtype=np.int32)[at] - m[at] for m in marks)
        na, nb = len(self.ids[0]), len(self.ids[1])
        root = find(na + nb, self.link_a, self.link_b + np.int32(na))
        # a component's least node is an A token, so groups are numbered in the order of the text
        first = root[:na] == np.arange(na)
        number = np.cumsum(first, dtype=np.int64) - 1
        self.group_a, self.group_b = number, number[root[na:]]
        self.cut_a, self.cut_b = np.append(0, np.cumsum(self.n_a)), np.append(0, np.cumsum(self.n_b))
        self.n_groups = np.diff(np.append(0, np.cumsum(first))[self.cut_a])
        self.cut_links = np.searchsorted(self.link_a, self.cut_a)
        self.n_links = np.diff(self.cut_links)
        self.sides, self.texts = (a, b), n

    def groups(self) -> list[bytes]:
        """The groups of each text, as `a1,a2|b1;a3|b2,b3` in decimal ids."""
        (a, b), (ids_a, ids_b) = self.sides, self.ids
        na, nb = len(ids_a), len(ids_b)
        k = int(self.group_a[-1]) + 1 if na else 0
        in_a, in_b = np.bincount(self.group_a, minlength=k), np.bincount(self.group_b, minlength=k)
        place_a = np.arange(na) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(nb) + np.cumsum(in_a)[self.group_b]
        rows = np.zeros((na + nb, 8), np.uint8)
        rows[place_a, :7], rows[place_b, :7] = a.digits[ids_a], b.digits[ids_b]
        rows[:, 7] = ord(",")
        last_a, last_b = np.append(self.group_a[1:] != self.group_a[:-1], True)[:na], np.append(self.group_b[1:] != self.group_b[:-1], True)[:nb]
        rows[place_a[last_a], 7], rows[place_b[last_b], 7] = ord("|"), ord(";")
        size = np.append(0, np.cumsum((rows > 0).sum(1, dtype=np.int64)))
        flat = rows.ravel()
        view = memoryview(flat[flat > 0])
        cut = size[self.cut_a + self.cut_b].tolist()
        return [bytes(view[p : q - 1]) if q > p else b"" for p, q in zip(cut[:-1], cut[1:], strict=True)]

    def pairs(self) -> np.ndarray:
        """The id pair of each link, A's in the upper half."""
        return (self.ids[0][self.link_a] << np.int64(32)) | self.ids[1][self.link_b]


def encode_and_align(docs: DataFrame, doc_id: str, text: str, paths: tuple[str, str], keep_groups: bool) -> DataFrame:
    """A row per text, and one per chunk with its pairs and how often each is linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*paths)
        schema = pa.schema({"chunk": pa.int64(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string(), "links": pa.binary(), "pair": pa.list_(pa.int64()), "times": pa.list_(pa.int64())})
        chunk, held, kept = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            pair, where, times = np.unique(np.concatenate([x[-1] for x in kept]), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            place, at = rank[where], 0
            for ids, counts, digests, said, cut, links in kept:
                each = place[at : at + len(links)]
                at += len(links)
                gaps = [np.diff(np.sort(each[p:q]), prepend=np.uint32(0)).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)]
                n = len(gaps)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(said, pa.string()), pa.array(gaps, pa.binary()), pa.nulls(n, schema.field("pair").type), pa.nulls(n, schema.field("times").type)], schema=schema)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "pair": pair[order], "times": times[order]}], schema=schema)

        for whole in batches:
            for batch in slices(whole, text):
                texts = utf8(batch.column(text))
                x = Aligned(texts, a, b)
                said = x.groups()
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in said]
                said = [g.decode() for g in said] if keep_groups else [None] * len(said)
                kept.append((batch.column(doc_id).cast(pa.int64()), (x.n_a, x.n_b, x.n_groups, x.n_links), digests, said, x.cut_links.tolist(), x.pairs()))
                held += sum(map(len, texts))
                if held >= CHUNK_BYTES:
                    yield from flush()
                    chunk, held = chunk + 1, 0
                    kept.clear()
        yield from flush()

    stored = f"chunk long, id long, {TEXT_FIELDS}, links binary, pair array<long>, times array<long>"
    return docs.select(doc_id, text).mapInArrow(run, stored)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_vocabulary: str = BYTE_VOCABULARY, piece_model: str = PIECE_MODEL, keep_groups: bool = False) -> DataFrame:
    """A row per document: the numbers of tokens, groups and links, n_best (links whose pair is its B id's most
    frequent one), count_sum (the pairs' counts added up over the links), the digest of the groups and, on request, the groups."""
    bounded(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        made = scratch.spill(encode_and_align(docs, doc_id, text, (byte_vocabulary, piece_model), keep_groups))
        chunks = made.filter("pair is not null")
        pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pair", "times")).alias("at", "e")).select("chunk", "at", "e.pair", "e.times")
        counts = scratch.spill(pairs.groupBy("pair").agg(F.sum("times").alias("n")))
        b_id = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
        best = counts.groupBy(b_id).agg(F.max("n").alias("most"))  # a row per piece of the vocabulary at most
        judged = counts.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        back = pairs.select("chunk", "at", "pair").join(judged.hint("merge"), "pair").select(F.col("chunk").alias("home"), "at", "n", "best")
        texts = made.filter("pair is null").drop("pair", "times")
        if not keep_groups:
            texts = texts.drop("groups")
        fields = TEXT_FIELDS if keep_groups else TEXT_FIELDS.rpartition(",")[0]
        out = spill(texts.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(_add_up, f"id long, {fields}, n_best long, count_sum long"))
    return out.withColumnRenamed("id", doc_id)


def _add_up(texts: pa.Table, back: pa.Table) -> pa.Table:
    """The links' counts of a chunk's texts."""
    size = back.num_rows
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = back.column("at").to_numpy()
    n[at], best[at] = back.column("n").to_numpy(), back.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for links in texts.column("links").to_pylist():
        place = np.cumsum(np.frombuffer(links, np.uint32), dtype=np.int64)
        sums.append(int(n[place].sum()))
        bests.append(int(best[place].sum()))
    return texts.drop_columns(["chunk", "links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def op11_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
