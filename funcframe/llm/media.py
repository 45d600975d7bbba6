"""Media columns: Netpbm and BMP images decoded to arrays, resized by area with integral images, kept as NPY tiles.

Defined cases. A null or broken image decodes to null columns (a header that promises more than the bytes can hold and a
sample above the maximum count as broken), and so does a valid BMP of a kind left out: run lengths, embedded files and
headers of less than 40 bytes. In the query a null text counts as empty and gives the one
block of padding; equal texts give equal values; an empty table gives an empty result. Only the id and the text or image
column are read. Memory grows with the longest single text.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from funcframe.llm.common import map_texts, table

BLOCK = 576
TILE = 32
FORMATS = ("P5", "P6", "BMP")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """(height, width) as a grey map, (height, width, 3) as a colour map, both binary with 8-bit samples."""
    magic = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (magic, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(height, width, 3) as 24 bits a pixel without compression, lowest row first, rows filled up to four bytes."""
    height, width = pixels.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    n_fields = 2 if data[:2] in (b"P1", b"P4") else 3
    while len(fields) < n_fields:
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end - at > 9:
                raise ValueError("size")
            fields.append(int(data[at:end]))
            at = end
    width, height, most = *fields[:2], fields[2] if n_fields == 3 else 1
    kind, depth = int(data[1:2]), 3 if data[1:2] in (b"3", b"6") else 1
    count = width * height * depth
    if not (0 < width and 0 < height and 0 < most < 65536 and count <= 8 * (len(data) - at)):
        raise ValueError("size")
    if kind == 1:
        body = b"".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        got = 1 - (np.frombuffer(bytes(c for c in body if c in b"01"), dtype=np.uint8)[:count] - 48)
    elif kind == 4:
        rows = np.frombuffer(data, dtype=np.uint8, offset=at + 1, count=(width + 7) // 8 * height).reshape(height, -1)
        got = 1 - np.unpackbits(rows, axis=1)[:, :width]
    elif kind < 4:
        got = np.array(data[at:].split()[:count], dtype=np.int64)
    else:
        got = np.frombuffer(data, dtype=">u2" if most > 255 else np.uint8, offset=at + 1, count=count)
    if got.size and not 0 <= got.min() <= got.max() <= most:
        raise ValueError("sample out of range")
    got = got.reshape((height, width, 3) if depth == 3 else (height, width))
    return got.astype(np.uint8) if most == 255 else np.rint(got * (255.0 / most)).astype(np.uint8)


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of ``mask`` as samples from 0 to 255."""
    if not mask:
        return np.zeros(pixels.shape, dtype=np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    if most & (most + 1):
        raise ValueError("mask with gaps")
    return np.rint(((pixels & np.uint32(mask)) >> np.uint32(low)) * (255.0 / most)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    fields = packed in (3, 6) and bits in (16, 32)
    if header < 40 or not (fields or packed == 0) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        raise ValueError("kind of BMP")
    stride = (width * bits + 31) // 32 * 4
    if start + stride * abs(height) > len(data):
        raise ValueError("size")
    rows = np.frombuffer(data, dtype=np.uint8, offset=start, count=stride * abs(height)).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, dtype=np.uint8, offset=14 + header, count=4 * used).reshape(-1, 4)
        if bits < 8:
            each = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
            rows = np.packbits(each, axis=2)[:, :, 0] >> (8 - bits)
        return palette[rows[:, :width]][:, :, 2::-1]
    if fields or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if fields else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(rows).view(f"<u{bits // 8}")[:, :width].astype(np.uint32)
        return np.stack([_channel(pixels, m) for m in masks], axis=2)
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """An 8-bit array (height, width) or (height, width, 3); raises ValueError for anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, ValueError, OverflowError, MemoryError) as e:
        raise ValueError(f"broken image: {e}") from None
    raise ValueError("neither Netpbm nor BMP")


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area of each target cell, cut pixels counted in part, by differences of an integral image."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)

    def at(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), len(v) - 2)
        part = (edges - low).reshape(-1, *[1] * (v.ndim - 1))
        return v[low] * (1 - part) + v[low + 1] * part

    rows = at(np.linspace(0, grey.shape[0], height + 1), total)
    cells = at(np.linspace(0, grey.shape[1], width + 1), rows.T).T
    area = grey.shape[0] / height * (grey.shape[1] / width)
    return np.diff(np.diff(cells, axis=0), axis=1) / area


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hexadecimal digits: whether each of 8 x 9 means is above its left neighbour."""
    small = resize(image, 8, 9).round(6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, array, allow_pickle=False)
    return held.getvalue()


TILES = "height int, width int, channels int, tile binary, dhash string"


def tiles(images: DataFrame, keep: list[str], image: str = "image") -> DataFrame:
    """``keep`` and ``TILES`` of a binary column: the size, a grey TILE x TILE tile as NPY bytes, the difference hash."""
    from pyspark.sql import functions as F

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in TILES.split(", ")}
        for text in raw:
            try:
                p = decode(bytes.fromhex((text or b"").decode()))
                g = grey(p)
                row = (p.shape[0], p.shape[1], 1 if p.ndim == 2 else 3, npy(np.rint(resize(g, TILE, TILE)).astype(np.uint8)), difference_hash(g))
            except ValueError:
                row = (None,) * 5
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return out

    return map_texts(images, F.hex(F.col(f"`{image}`")), keep, work, TILES)


def store(text: bytes) -> tuple[bytes, bytes]:
    """The text padded to whole blocks, and an image with these samples; the format follows from the payload."""
    payload = text + b"\xff" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))
    samples = np.frombuffer(payload, dtype=np.uint8)
    kind = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    if kind == "P5":
        return payload, encode_netpbm(samples.reshape(-1, 48))
    pixels = samples.reshape(-1, 16, 3)
    return payload, encode_netpbm(pixels) if kind == "P6" else encode_bmp(pixels)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def text_media(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``DIGEST`` of every text stored as an image and read back; ``tile`` is a grey tile as NPY bytes."""

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in DIGEST.split(", ")}
        for t in raw:
            _, media = store(t or b"")
            pixels = decode(media)
            back = np.ascontiguousarray(pixels).tobytes()
            g = grey(pixels)
            tile = npy(np.rint(resize(g, TILE, TILE)).astype(np.uint8))
            row = (len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(g)}:{zlib.crc32(tile):08x}", tile)
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return out

    return map_texts(documents, text, keep, work, DIGEST)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"), ["doc_id"])
