"""Media columns: Netpbm and BMP to arrays, area resize by integral images, NPY tiles, difference hashes.

Decoders take whole files as bytes and give uint8 or uint16 arrays of shape (height, width) or
(height, width, 3); malformed input raises ``ValueError``, and ``image_tiles`` gives it null columns
with the reason in ``error``.  Rows are taken one by one: equal input gives equal output, repeated rows stay
repeated, null ids stay null, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

SIDE = 24
UNIT = SIDE * SIDE
TILE = 64
BAND = 8192


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, and where the raster starts."""
    out, at = [], 2
    while len(out) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6.  Bitmaps give 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm magic")
    bitmap, colour = kind in (b"P1", b"P4"), kind in (b"P3", b"P6")
    head, at = _header(data, 2 if bitmap else 3)
    width, height = head[:2]
    top = 1 if bitmap else head[2]
    if not width or not height or not 0 < top < 65536:
        raise ValueError("Netpbm sizes")
    shape = (height, width, 3) if colour else (height, width)
    n = int(np.prod(shape))
    if kind == b"P4":
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * height, at) if len(data) - at >= row * height else None
        if raw is None:
            raise ValueError("Netpbm raster is short")
        bits = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(data) - at < n * wide.itemsize:
            raise ValueError("Netpbm raster is short")
        raw = np.frombuffer(data, wide, n, at)
        return raw.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)
    body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
    if kind == b"P1":
        digits = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:n]
        if len(digits) < n:
            raise ValueError("Netpbm raster is short")
        return ((49 - digits) * 255).astype(np.uint8).reshape(shape)
    numbers = np.array(body.split()[:n], dtype=np.int64)
    if len(numbers) < n or numbers.max(initial=0) > top:
        raise ValueError("Netpbm raster")
    return numbers.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6, 8 or 16 bits."""
    top = 255 if image.dtype == np.uint8 else 65535
    raw = image if top == 255 else image.astype(">u2")
    return b"P%d\n%d %d\n%d\n" % (6 if image.ndim == 3 else 5, image.shape[1], image.shape[0], top) + raw.tobytes()


def _masked(pixels: np.ndarray, masks) -> np.ndarray:
    """Channels of bit-field pixels, spread to 8 bits."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        low = (mask & -mask).bit_length() - 1
        top = mask >> low if mask else 0
        if top & (top + 1):
            raise ValueError("BMP masks")
        if top:
            out[..., k] = (((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 + top // 2) // top
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with bit fields for 16 and 32, either row order; always RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP magic")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or packing and bits not in (16, 32) or width <= 0 or height == 0 or head < 40:
        raise ValueError("BMP kind")
    rows, row = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * row:
        raise ValueError("BMP raster is short")
    raw = np.frombuffer(data, np.uint8, rows * row, start).reshape(rows, row)
    if packing or bits == 16:
        if packing and len(data) < 66:
            raise ValueError("BMP masks")
        masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x3E0, 0x1F)
        image = _masked(raw[:, : width * bits // 8].copy().view(f"<u{bits // 8}").astype(np.uint32), masks)
    elif bits >= 24:
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        if used > 256 or len(data) < 14 + head + used * 4:
            raise ValueError("BMP palette")
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = raw[:, :width]
        else:
            index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
            index = index[:, :width]
        if index.max(initial=0) >= used:
            raise ValueError("BMP palette")
        image = palette[index]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first."""
    height, width = image.shape[:2]
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)
    row = (width * 3 + 3) // 4 * 4
    raw = np.zeros((height, row), np.uint8)
    raw[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + raw.size, 0, 0, 54, 40, width, height, 1, 24, 0, raw.size, 0, 0, 0, 0) + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(n: int, parts: int):
    cuts = np.arange(parts + 1) * (n / parts)
    whole = np.minimum(cuts.astype(np.int64), n)
    return whole, cuts - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact source area under each target pixel, from integral images of ``BAND`` rows at a time.

    Of the integral image only the rows around the target's edges are kept, so memory does not grow with the source.
    """
    rows, columns = image.shape[:2]
    whole, part = _edges(rows, height)
    need = np.unique(np.concatenate([whole, np.minimum(whole + 1, rows)]))
    kept = np.zeros((len(need), columns + 1, *image.shape[2:]))
    carry = np.zeros(kept.shape[1:])
    for y in range(0, rows, BAND):
        table = np.zeros((min(BAND, rows - y), *kept.shape[1:]))
        np.cumsum(image[y : y + BAND].astype(np.float64), axis=0, out=table[:, 1:])
        np.cumsum(table[:, 1:], axis=1, out=table[:, 1:])
        table += carry
        here = (need > y) & (need <= y + len(table))
        kept[here] = table[need[here] - y - 1]
        carry = table[-1]

    def at(axis, low, high, part):
        part = part.reshape([-1 if a == axis else 1 for a in range(low.ndim)])
        return np.diff(low + (high - low) * part, axis=axis)

    down = at(0, kept[np.searchsorted(need, whole)], kept[np.searchsorted(need, np.minimum(whole + 1, rows))], part)
    whole, part = _edges(columns, width)
    sums = at(1, down[:, whole], down[:, np.minimum(whole + 1, columns)], part)
    return sums * (height * width / (rows * columns))


def grey(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of an 8 x 9 area reduction brighter than its right neighbour?"""
    small = np.round(grey(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array))
    return out.getvalue()


def tiles(image: np.ndarray, side: int = TILE):
    """(row, column, NPY bytes) of the tiles of an image; edge tiles are smaller."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, npy(image[y : y + side, x : x + side])


def image_tiles(df: DataFrame, id_col: str, data_col: str, resize: tuple[int, int] | None = None, side: int = TILE) -> DataFrame:
    """One row per tile: ``id_col``, row, col, npy, dhash, error.  Undecodable or null data gives one row with error."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, data in zip(pdf["id"], pdf["data"]):
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(bytes(data))
                except ValueError as e:
                    out.append((i, None, None, None, None, str(e)))
                    continue
                mark = difference_hash(image)
                if resize:
                    image = np.clip(np.round(area_resize(image, *resize)), 0, 255 if image.dtype == np.uint8 else 65535).astype(image.dtype)
                out += [(i, y, x, t, mark, None) for y, x, t in tiles(image, side)]
            yield pd.DataFrame(out, columns=["id", "row", "col", "npy", "dhash", "error"]).astype({"row": "Int32", "col": "Int32"})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"))
    return rows.mapInPandas(run, f"id {kind}, row int, col int, npy binary, dhash string, error string").withColumnRenamed("id", id_col)


def to_media(payload: bytes) -> bytes:
    """Store bytes as the samples of a grey image ``SIDE`` wide."""
    return encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, SIDE))


def to_bitmap(payload: bytes) -> bytes:
    """Store bytes as the samples of a BMP whose rows are as long."""
    return encode_bmp(np.frombuffer(payload, np.uint8).reshape(-1, SIDE // 3, 3))


_TEXT_MEDIA = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bmp_sha256 string, bmp_payload_crc32 long"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a Netpbm image and back: sizes, hashes of what was read back, and its feature.

    The feature is the difference hash, a colon, the number of NPY tiles, a colon, and the CRC-32 of all of them
    in order.  The payload also goes through a BMP: bmp_sha256 is of the file, bmp_payload_crc32 of what was read back.
    Null text is empty.
    """

    def one(text: bytes):
        room = max(UNIT, -(-len(text) // UNIT) * UNIT)
        media = to_media(text.ljust(room, b"\xff"))
        image = decode(media)
        back = image.tobytes()
        count, digest = 0, 0
        for _, _, tile in tiles(image):
            count, digest = count + 1, zlib.crc32(tile, digest)
        bitmap = to_bitmap(back)
        read = zlib.crc32(decode(bitmap).tobytes())
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}:{count}:{digest:08x}", hashlib.sha256(bitmap).hexdigest(), read

    def run(batches):
        for piece in slices(batches):
            columns = list(zip(*(one(piece.bytes(i)) for i in range(piece.n))))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bmp_sha256", "bmp_payload_crc32"]
            yield pa.RecordBatch.from_arrays(
                [piece.batch.column("id"), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns)], names=["id", *names]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, _TEXT_MEDIA).withColumnRenamed("id", id_col)
