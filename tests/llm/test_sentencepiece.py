import hashlib
import random
import re

import numpy as np
import sentencepiece

from tallyspark.llm.sentencepiece import MARK, MODEL, Encoder, Pieces, decode, decode_column, encode_column, op8_sentencepiece

from .common import TABLES, documents, prose, table

ODD = ["", " ", "  two  spaces ", "▁mark", "日本語 text", "\t\n\r", "a" * 300, "é" * 50, "\u0000x", "x" * 20000, prose(3000, 1)]


def cheapest(text, pieces, known, longest):
    """The cheapest path over a segment, ties by the lesser id, place by place."""
    t = text
    best, by = [0.0] + [np.inf] * len(t), [0] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        options = [(best[a] + pieces.costs[known[t[a:end]]], known[t[a:end]]) for a in range(max(0, end - longest), end) if t[a:end] in known]
        b = t[end - 1]
        if pieces.single[b]:
            options.append((best[end - 1] + pieces.costs[pieces.byte_ids[b]], int(pieces.byte_ids[b])))
        best[end], by[end] = min(options, key=lambda x: (x[0], x[1]))
    out, at = [], len(t)
    while at:
        out.append(by[at])
        at -= len(pieces.bytes_[by[at]])
    return out[::-1]


def unigram():
    """The given pieces with costs that fall with the rank, as a unigram model's."""
    pieces = Pieces()
    pieces.merges = False
    pieces.costs = np.log(2 + pieces.costs)
    return pieces


def ids_of(texts, pieces):
    ids, counts = Encoder(pieces).encode([t.encode() for t in texts])
    ends = np.append(0, np.cumsum(counts)).tolist()
    return [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)]


def library(texts):
    return sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)


def junk(n):
    rng = random.Random(5)
    return ["".join(rng.choice("ab cdetionéü日本\n\t  .0") for _ in range(rng.randint(1, 400))) for _ in range(n)]


def test_ids_are_the_librarys(spark, monkeypatch):
    pieces = Pieces()
    assert pieces.merges
    texts = [r["text"] or "" for r in table(spark, "documents").collect()] + [t for t in ODD if MARK not in t] + junk(300)
    wanted = library(texts)
    assert ids_of(texts, pieces) == wanted
    some = texts[-400:]
    for widths, slots in (((), 64), ((64,), 64), ((2, 3), 5)):  # by heaps alone, a row a time, both
        monkeypatch.setattr("tallyspark.llm.sentencepiece.WIDTHS", widths)
        monkeypatch.setattr("tallyspark.llm.sentencepiece.SLOTS", slots)
        assert ids_of(some, pieces) == wanted[-400:]


def test_the_mark_itself_stays():
    (ids,) = ids_of(["a▁b"], Pieces())
    assert ids != library(["a▁b"])[0] and decode(np.array(ids), np.array([len(ids)]), Pieces()) == ["a▁b".encode()]


def test_paths_are_cheapest(spark):
    pieces = unigram()
    known = {pieces.bytes_[i]: int(i) for i in pieces.ids}
    longest = int(pieces.sizes.max())
    texts = [r["text"] or "" for r in table(spark, "documents").orderBy("doc_id").limit(60).collect()] + ODD
    seen = {}
    for t, ids in zip(texts, ids_of(texts, pieces), strict=True):
        t = t.encode()
        segments = re.findall(rb" *[^ ]+| +$", b" " + t) if t else []
        for s in segments:
            if s not in seen:
                seen[s] = cheapest(s, pieces, known, longest)
        assert ids == [i for s in segments for i in seen[s]]
        assert b"".join(pieces.bytes_[i] for i in ids) == (b" " + t if t else b"")


def test_ties_go_to_the_lesser_piece():
    pieces = unigram()
    pieces.costs[:] = 1.0
    known = {pieces.bytes_[i]: int(i) for i in pieces.ids}
    for t in ("tionable nesting", "aaaa bbbb"):
        assert ids_of([t], pieces) == [[i for s in re.findall(rb" *[^ ]+", b" " + t.encode()) for i in cheapest(s, pieces, known, int(pieces.sizes.max()))]]


def test_round_trip(spark):
    pieces = Pieces()
    texts = [t.encode() for t in ODD]
    encoder = Encoder(pieces)
    first, again = encoder.encode(texts), encoder.encode(texts[::-1])
    assert decode(*first, pieces) == texts and decode(*again, pieces) == texts[::-1]


def test_columns(spark):
    docs = documents(spark, [None, *ODD, "same", "same"]).selectExpr("*", "'x' as ids", "1 as decoded")
    rows = decode_column(encode_column(docs)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == ["", *ODD, "same", "same"] and rows[0]["ids"] == [] and rows[-1]["ids"] == rows[-2]["ids"]
    assert encode_column(documents(spark, [])).count() == 0


def test_whole_table(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, "documents").collect()}
    rows = op8_sentencepiece(spark, TABLES).collect()
    ids = dict(zip(texts, library([t.decode() for t in texts.values()]), strict=True))
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<i4").tobytes()).hexdigest() for r in rows)
    assert len(rows) == len(texts) and all(r["same"] for r in rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest() and r["n_bytes"] == len(texts[r["doc_id"]]) for r in rows)
    assert all((r["n_tokens"] > 0) == (r["n_bytes"] > 0) for r in rows)


def test_segments_of_one_hash(monkeypatch):
    pieces = Pieces()
    texts = [t.encode() for t in ODD]
    wanted = Encoder(pieces).encode(texts)
    for few in (1, 3):
        monkeypatch.setattr("tallyspark.llm.sentencepiece.span_hash", lambda a, start, end, few=few: ((end - start) % few).astype(np.uint64))
        encoder = Encoder(pieces)
        for _ in range(2):
            assert all((x == y).all() for x, y in zip(encoder.encode(texts), wanted, strict=True))
