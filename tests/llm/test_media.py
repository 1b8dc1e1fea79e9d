import hashlib
import zlib

import numpy as np

from tallyspark.llm.media import load_images, op9_media_columns, padded, samples, store_payloads, transform

from .common import TABLES, documents, prose, saved, table


def check(rows, texts):
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        p = padded(t)
        assert len(p) % 64 == 0 and len(p) >= 64
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    rows = op9_media_columns(spark, TABLES).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(x) == 1 for x in by.values())


def test_odd_rows(spark, tmp_path):
    texts = [None, "", "a", "b" * 64, "c" * 65, "é" * 333, "\x00\x01\x7f" * 90, prose(30000, 1), "same", "same"]
    rows = op9_media_columns(spark, saved(documents(spark, texts).selectExpr("*", "1 as media", "2 as feature"), tmp_path)).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))
    empty = tmp_path / "none"
    assert op9_media_columns(spark, saved(documents(spark, []), empty)).count() == 0


def test_tensors(spark):
    rows = load_images(store_payloads(documents(spark, ["hello", prose(200, 2)]))).collect()
    assert all(len(r["rgb"]) == 3 * r["width"] * r["height"] for r in rows)
    assert all(bytes(r["media"][:2]) == b"\xff\xd8" and bytes(r["media"][-2:]) == b"\xff\xd9" and b"\xff\xc2" in bytes(r["media"]) for r in rows)


def test_inverse_transform():
    assert transform().shape == (64, 64)
    flat = samples(np.array([[8] + [0] * 63], np.int16), np.ones(64))
    assert (flat == 129).all()
