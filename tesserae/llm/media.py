"""Media columns: texts as PNG images in a binary column, read back and hashed.

The encoder writes signature, IHDR, IDAT chunks and IEND; the decoder tests every chunk's checksum, joins and
inflates the data and undoes all five row filters with numpy. The feature of an image is a perceptual hash:
the image averaged to 32 x 32, its low-frequency cosine coefficients compared with their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.shared import documents, durable, text_batches, whole

#: A payload is a positive multiple of UNIT bytes; a row of the image is WIDTH of them.
UNIT, WIDTH = 576, 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
#: Rows of an image that are worked on together.
ROWS = 1 << 12


def payload(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(samples: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """An 8-bit greyscale PNG. Each row has the filter (none, left or above) with the least sum of magnitudes. Rows are filtered
    and compressed some at a time, so a large image needs little memory besides itself."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    press, body = zlib.compressobj(level), []
    above = np.zeros((1, width), np.uint8)
    for at in range(0, len(image), ROWS):
        some = image[at : at + ROWS]
        tried = np.zeros((3, *some.shape), np.uint8)
        tried[0] = some
        tried[1, :, 0], tried[1, :, 1:] = some[:, 0], some[:, 1:] - some[:, :-1]
        tried[2] = some - np.concatenate([above, some[:-1]])
        above = some[-1:]
        cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
        kind = cost.argmin(axis=0).astype(np.uint8)
        rows = np.concatenate([kind[:, None], tried[kind, np.arange(len(some))]], axis=1)
        body.append(press.compress(rows.tobytes()))
    body = b"".join([*body, press.flush()])
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters for one byte a pixel."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), np.uint8)  # row 0 stands above the image
    plain = kinds == 0
    out[1:][plain] = rows[plain]
    left = kinds == 1
    out[1:][left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    for i in np.flatnonzero(kinds > 1):
        row, above = rows[i], out[i]
        if kinds[i] == 2:
            out[i + 1] = row + above
        elif kinds[i] in (3, 4):
            now, up = np.zeros(len(row) + 1, np.int32), np.concatenate([[0], above]).astype(np.int32)
            for x, v in enumerate(row.tolist(), 1):
                a, b, c = int(now[x - 1]), int(up[x]), int(up[x - 1])
                if kinds[i] == 3:
                    guess = (a + b) // 2
                else:
                    near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = (a, b, c)[near.index(min(near))]
                now[x] = (v + guess) & 255
            out[i + 1] = now[1:]
        else:
            raise ValueError(f"unknown row filter {kinds[i]}")
    return out[1:]


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, height x width. Wrong signature, checksum, order or length: ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, height, body, ended = 8, 0, 0, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if at + 12 + n > len(data) or zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        content = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", content)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit greyscale without interlace")
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if not ended or not width or len(rows) != height * (width + 1):
        raise ValueError("image data of the wrong length")
    rows = rows.reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _averages(n: int, to: int) -> np.ndarray:
    """to x n: the mean over each of ``to`` equal parts of n samples."""
    edges = np.arange(to + 1) * (n / to)
    i = np.arange(n)
    share = np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i)
    return np.maximum(share, 0) * (to / n)


_k, _x = np.arange(8)[:, None], np.arange(32)
COSINES = np.cos(np.pi * (2 * _x + 1) * _k / 64)
_across = _averages(WIDTH, 32).T @ COSINES.T


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 low-frequency coefficients of the 32 x 32 image exceed their median.

    Rows are transformed some at a time; the means over 32 bands of rows follow from running sums of what is left, 8
    numbers a row."""
    height, width = image.shape
    across = _across if width == WIDTH else _averages(width, 32).T @ COSINES.T
    rows = np.concatenate([image[i : i + ROWS].astype(np.float64) @ across for i in range(0, height, ROWS)])
    total = np.concatenate([np.zeros((1, 8)), np.cumsum(rows, axis=0)])
    edges = np.arange(33) * (height / 32)
    down = np.minimum(edges.astype(np.int64), height - 1)
    bands = np.diff(total[down] + (edges - down)[:, None] * rows[down], axis=0) * (32 / height)
    low = np.round(COSINES @ bands, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


FACTS = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("hash", T.BinaryType()))]
)


@F.pandas_udf(T.BinaryType())
def to_png(text: pd.Series) -> pd.Series:
    """A text's payload as PNG; null counts as empty."""
    return text.map(lambda t: png_encode(payload((t or "").encode())))


@F.pandas_udf(FACTS)
def png_facts(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes hold, read back from them."""

    def of(data: bytes) -> tuple:
        image = png_decode(data)
        back = image.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

    return pd.DataFrame([of(bytes(x)) for x in media], columns=FACTS.names)


@F.pandas_udf(T.StringType())
def from_png(media: pd.Series, n_bytes: pd.Series) -> pd.Series:
    """The text of a media column, given its unpadded length."""
    return pd.Series([png_decode(bytes(x)).tobytes()[:n].decode() for x, n in zip(media, n_bytes)], dtype=object)


def media_column(docs: DataFrame, name: str = "media") -> DataFrame:
    """docs with a binary column of PNG images of its texts; docs must not have a column of that name."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name} already")
    return docs.withColumn(name, to_png("text"))


def media_features(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (the cosine hash in hex).

    The images are stored as a binary column in a table; everything but n_bytes comes from what that table gives back. A
    null or empty text is one unit of bytes 255. Rows of equal texts have equal values; rows are
    independent of each other, so repeated rows, null ids and an empty table need no rule.
    """
    text_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", F.octet_length(whole("text")).cast("long").alias("n_bytes"))
    stored = durable(media_column(texts).drop("text"), "media")
    rows = stored.select("doc_id", "n_bytes", png_facts("media").alias("f"))
    return rows.select("doc_id", "n_bytes", *(f"f.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")), F.lower(F.hex("f.hash")).alias("feature"))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
