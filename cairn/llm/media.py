"""Media columns: Netpbm and BMP bytes, numpy arrays, NPY tiles and difference hashes.

Decoders check sizes before they allocate. Resizing is by area, from one integral image: any target
pixel is the mean of the source over its own rectangle, fractions of pixels included.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import staged, text_rows

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 of a 2-D array, P6 of rows x columns x 3; 8 bits a sample."""
    height, width = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, rows x columns, or x 3 for P3 and P6. Bitmaps are 1 where black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)) or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = (*head, 1)[:3]
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm maximum")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    kind_of = np.uint8 if most < 256 else np.uint16
    if kind == b"P1":
        flat = np.array([c - 48 for c in re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:n]], np.uint8)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:n], dtype=np.int64).astype(kind_of)
    elif kind == b"P4":
        row = -(-width // 8)
        flat = np.frombuffer(data, np.uint8, min(row * height, len(data) - at - 1), at + 1)
        if len(flat) < row * height:
            raise ValueError("Netpbm data ends early")
        return np.unpackbits(flat.reshape(height, row), axis=1)[:, :width]
    else:
        size = 1 if most < 256 else 2
        if len(data) - at - 1 < n * size:
            raise ValueError("Netpbm data ends early")
        flat = np.frombuffer(data, ">u2" if size == 2 else np.uint8, n, at + 1).astype(kind_of)
    if len(flat) < n:
        raise ValueError("Netpbm data ends early")
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette for a 2-D array, 24 bits for rows x columns x 3."""
    height, width = pixels.shape[:2]
    bits = 8 if pixels.ndim == 2 else 24
    row = -(-width * bits // 32) * 4
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 else b""
    body = np.zeros((height, row), np.uint8)
    body[:, : width * bits // 8] = (pixels if bits == 8 else pixels[:, :, ::-1].reshape(height, -1))[::-1]
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, body.size, 2835, 2835, 256 if bits == 8 else 0, 0)
    return head + palette + body.tobytes()


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as 0 to 255; a mask without bits is 0."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = mask & -mask
    most = mask // low
    if most & (most + 1):
        raise ValueError("BMP mask has gaps")
    return (((values & mask) // low * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, either row order, 16 and 32 with masks or without: rows x columns for a grey palette, else x 3 (RGB)."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("not BMP")
    (at,) = struct.unpack_from("<I", data, 10)
    size, width, high, planes, bits, packed, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
    height, row = abs(high), -(-width * bits // 32) * 4
    if size < 40 or planes != 1 or packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or packed and bits not in (16, 32):
        raise ValueError("this BMP is not of a supported kind")
    if len(data) - at < row * height:
        raise ValueError("BMP data ends early")
    body = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
    body = body[::-1] if high > 0 else body
    if packed or bits == 16:
        masks = struct.unpack_from("<3I", data, 54) if packed else (0x7C00, 0x03E0, 0x001F)
        values = np.ascontiguousarray(body[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        return np.stack([_channel(values, m) for m in masks], axis=2)
    if bits >= 24:
        return np.ascontiguousarray(body[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1])
    if bits < 8:
        spread = np.unpackbits(body, axis=1).reshape(height, -1, bits)
        body = (spread * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2).astype(np.uint8)
    body = body[:, :width]
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if body.size and int(body.max()) >= len(palette):
        raise ValueError("BMP palette is too short")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][body] if grey else palette[body]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over each target pixel's rectangle of a 2-D array, from its integral image; float64."""
    rows, columns = pixels.shape
    if not rows or not columns:
        return np.zeros((height, width))

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    # Of the integral image only the rows around edges are kept: bands of rows are summed one after the other.
    low, part = edges(rows, height)
    wanted = np.unique(np.concatenate([low, low + 1]))
    total, held, begin = np.zeros(columns), np.zeros((len(wanted), columns)), 0
    band = max(1, (1 << 18) // columns)
    while begin < rows:
        end = min(rows, begin + band)
        mine = np.flatnonzero((wanted > begin) & (wanted <= end))
        sums = np.cumsum(pixels[begin:end], axis=0, dtype=np.float64)
        held[mine] = total + sums[wanted[mine] - begin - 1]
        total, begin = total + sums[-1], end
    table = np.concatenate([np.zeros((len(wanted), 1)), np.cumsum(held, axis=1)], axis=1)
    first = table[np.searchsorted(wanted, low)]
    table = (first + part[:, None] * (table[np.searchsorted(wanted, low + 1)] - first)).T
    low, part = edges(columns, width)
    cut = (table[low] + part[:, None] * (table[low + 1] - table[low])).T
    return np.diff(np.diff(cut, axis=0), axis=1) * (height * width / (rows * columns))


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel; colours by the usual integer weights 299, 587 and 114."""
    return pixels if pixels.ndim == 2 else (pixels[..., :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def npy(tile: np.ndarray) -> bytes:
    """The bytes of a NPY file, version 1.0."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: whether each pixel of the 8 x 9 area-resized image is less than its right neighbour."""
    small = np.round(area_resized(grey(pixels), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tiles(pixels: np.ndarray, size: int = 64) -> list[np.ndarray]:
    """The image cut into size x size tiles, the last of a row or column smaller."""
    return [pixels[y : y + size, x : x + size] for y in range(0, pixels.shape[0], size) for x in range(0, pixels.shape[1], size)]


def untiled(parts: list[bytes], columns: int) -> np.ndarray:
    """The image of `columns` columns whose `tiles` these are, as NPY bytes."""
    cut = [np.lib.format.read_array(io.BytesIO(x), allow_pickle=False) for x in parts]
    across = -(-columns // cut[0].shape[1])
    return np.concatenate([np.concatenate(cut[k : k + across], axis=1) for k in range(0, len(cut), across)])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, tile: int | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, zeros up to a positive multiple of `width`, as a grey P5 image `width` wide.

    Where `tile` is given, npy_tiles besides: NPY bytes of each `tile` x `tile` cut of the image.
    Null and empty texts are one row of zeros. Equal texts give equal images, whatever their ids. Rows
    come out one for one, repeated and null ids included; an empty table gives an empty result.
    Columns of other names are not read.
    """

    def encode(batches):
        for batch in batches:
            n, media, cut = [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                n.append(len(raw))
                raw += bytes(width - len(raw)) if not raw else bytes(-len(raw) % width)
                pixels = np.frombuffer(raw, np.uint8).reshape(-1, width)
                media.append(encode_netpbm(pixels))
                if tile:
                    cut.append([npy(x) for x in tiles(pixels, tile)])
            more = [pa.array(cut, pa.list_(pa.binary()))] if tile else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), *more], names=["doc_id", "n_bytes", "media", "npy_tiles"][: 3 + len(more)])

    return text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary" + (", npy_tiles array<binary>" if tile else ""))


def media_features(rows: DataFrame, media_col: str = "media", tile: int | None = None, tiles_col: str | None = None) -> DataFrame:
    """rows without the media, and of each: payload_bytes, payload_sha256, tail_crc32 (last 64 bytes) of the decoded samples, media_bytes, media_sha256, feature, tiles.

    feature: the difference hash, then the first 16 hex digits of the SHA-256 of the 32 x 32
    area-resized NPY tile. tiles: NPY bytes of each `tile` x `tile` cut, or null where none is asked
    for. Where `tiles_col` is given, the feature is that of the image read from its stored NPY tiles,
    and it is not in the result. Null or damaged media or tiles give nulls and do not stop the job. Rows are independent; no shuffle.
    Columns of rows that have one of these names are replaced.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tiles"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary())]
    others = [c for c in rows.columns if c not in (media_col, tiles_col, *names)]
    # Names of one's own on the way through Python: any others may have dots.
    quoted = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    held = [f"c{k}" for k in range(len(others))]

    def features(batches):
        for batch in batches:
            out = []
            for k, value in enumerate(batch.column(len(others))):
                media = value.as_py()
                try:
                    pixels = decode(media)
                    seen = untiled(batch.column(len(others) + 1)[k].as_py(), pixels.shape[1]) if tiles_col else pixels
                except (ValueError, TypeError, IndexError, struct.error):
                    out.append((None,) * 7)
                    continue
                payload = np.ascontiguousarray(pixels).tobytes()
                small = np.round(area_resized(grey(seen), 32, 32)).astype(np.uint8)
                feature = difference_hash(seen) + hashlib.sha256(npy(small)).hexdigest()[:16]
                cut = [npy(x) for x in tiles(pixels, tile)] if tile else None
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, cut))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*held, *names])

    kinds = StructType([*rows.select(*quoted).schema, *StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<binary>")])
    return rows.select(*quoted, F.col(f"`{media_col}`"), *([F.col(f"`{tiles_col}`")] if tiles_col else [])).mapInArrow(features, kinds).toDF(*others, *names)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int | None = None) -> DataFrame:
    """`text_media`, written to a table and read back."""
    return staged(text_media(docs, id_col, text_col, tile=tile), "media")
