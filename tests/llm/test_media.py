import hashlib
import zlib

import numpy as np
import pytest

import tesserae.llm.media as media
from tesserae.llm.media import cosine_hash, from_png, media_column, media_features, payload, png_decode, png_encode, unfilter


def refilter(image, kind):
    """A row filter as the format defines it, pixel by pixel."""
    h, w = image.shape
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (int(image[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
    return out


@pytest.mark.parametrize("kind", range(5))
def test_unfilter(kind):
    image = np.random.default_rng(kind).integers(0, 256, (7, 11), dtype=np.uint8)
    assert (unfilter(np.full(7, kind, np.uint8), refilter(image, kind)) == image).all()


@pytest.mark.parametrize("text", ["", "a", "é" * 288, "x" * 576, "words " * 50_000])
def test_round_trip(text):
    data = payload(text.encode())
    assert len(data) % 576 == 0 and len(data) > 0
    assert png_decode(png_encode(data)).tobytes() == data


def test_checksums_are_tested():
    good = png_encode(payload(b"hello"))
    for at in (3, 20, len(good) // 2, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(Exception):
            png_decode(bytes(bad))
    with pytest.raises(ValueError):
        png_decode(good[:-12])


def test_features(edge, nothing):
    texts = {(r["doc_id"], r["text"]) for r in edge.collect()}
    got = media_features(edge).collect()
    assert len(got) == edge.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], r)
    for i, t in texts:
        if i is None:
            continue
        data, r = payload((t or "").encode()), by_id[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert len(r["feature"]) == 16
    assert by_id[1]["feature"] == by_id[2]["feature"] and by_id[1]["media_sha256"] == by_id[2]["media_sha256"]
    assert by_id[5]["payload_sha256"] == by_id[6]["payload_sha256"]
    assert media_features(nothing).count() == 0


def test_column_holds_the_text(edge):
    from pyspark.sql import functions as F

    back = media_column(edge.where("text IS NOT NULL")).withColumn("back", from_png("media", F.octet_length("text")))
    assert back.where("back <> text").count() == 0


def direct_hash(image):
    """Area means by oversampling, then the cosine sums of each coefficient, one by one."""
    h, w = image.shape
    fine = np.repeat(np.repeat(image.astype(float), 32, axis=0), 32, axis=1)
    small = fine.reshape(32, h, 32, w).mean(axis=(1, 3))
    low = [[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    low = np.round(np.array(low).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


@pytest.mark.parametrize("height", [3, 6, 33, 70])
@pytest.mark.parametrize("rows", [1 << 12, 5])
def test_hash_is_the_direct_transform(monkeypatch, height, rows):
    monkeypatch.setattr(media, "ROWS", rows)
    image = np.random.default_rng(height).integers(0, 256, (height, 192), dtype=np.uint8)
    assert cosine_hash(image) == direct_hash(image)
    assert png_decode(png_encode(image.tobytes())).tobytes() == image.tobytes()


def test_feature_comes_from_what_is_stored(edge):
    rows = {r["doc_id"]: r for r in media_features(edge.where("doc_id IN (1, 8)")).collect()}
    for r in edge.where("doc_id IN (1, 8)").collect():
        data = payload(r["text"].encode())
        png = png_encode(data)
        assert rows[r["doc_id"]]["feature"] == direct_hash(np.frombuffer(data, np.uint8).reshape(-1, 192)).hex()
        assert rows[r["doc_id"]]["media_sha256"] == hashlib.sha256(png).hexdigest() and rows[r["doc_id"]]["media_bytes"] == len(png)


def test_a_column_of_that_name_is_not_overwritten(edge):
    with pytest.raises(ValueError):
        media_column(edge, "score")
