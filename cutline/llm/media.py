"""Media columns: Netpbm and BMP decoded to numpy, area-resized by integral images, kept as NPY tiles with difference hashes.

A media column is a binary column holding one whole image file a row. ``decode`` reads

* Netpbm P1 to P6 (plain and raw bit maps, grey maps, pixel maps) with up to 16 bits a sample; samples under another maximum than 255 or 65535 are scaled
  to the full range (halves up), and
* BMP with 1, 4, 8, 16, 24 or 32 bits a pixel, uncompressed or with channel masks, bottom-up or top-down,

into ``uint8``/``uint16`` arrays of shape (height, width) or (height, width, 3), of at least one sample. Every row is handled on its own in a
``mapInArrow`` pass: no shuffle, memory bounded by one Arrow batch.

Null media gives null features; whatever bytes are no such image, cut off, of no samples or of more than their bytes can hold, or with a sample above its maximum, give null features and a text in
``media_error``. Texts of any length are stored whole. Empty tables give empty results, repeated rows give repeated results, and columns of the input are kept (a clash with an
output name is resolved in favour of the output).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Bytes of a text are laid out in rows of SIDE samples, padded with PAD up to whole SIDE x SIDE squares.
SIDE, PAD = 24, 255
#: Height and width of the stored tile, and of the grid whose neighbours the difference hash compares.
TILE, HASH_GRID = (16, 16), (8, 9)

_HEADER = re.compile(rb"\s*(?:#[^\r\n]*[\r\n]\s*)*(\d+)")


def _netpbm_numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    found = []
    for _ in range(count):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def _checked(width: int, height: int, data: bytes) -> int:
    """Samples of a plane, if the file can hold them: a header can claim any number, but each takes a bit at least."""
    if not 0 < width * height <= 8 * len(data):
        raise ValueError("no samples, or more than the file can hold")
    return width * height


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bitmap, planes = kind in b"14", 3 if kind in b"36" else 1
    numbers, at = _netpbm_numbers(data, 2, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maximum")
    n = _checked(width, height, data) * planes
    if kind in b"123":
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = re.findall(rb"[01]" if kind == b"1" else rb"\d+", body)[:n]
        samples = np.array(values, dtype=np.int64)
    elif kind == b"4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        samples = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if samples.size != n:
        raise ValueError("short Netpbm body")
    if bitmap:
        samples = (1 - samples.astype(np.uint8)) * np.uint8(255)  # 1 is black
    elif samples.size and int(samples.max()) > top:
        raise ValueError("Netpbm sample above its maximum")
    elif top not in (255, 65535):
        full = 255 if top < 256 else 65535
        samples = (samples.astype(np.int64) * full + top // 2) // top
    samples = samples.astype(np.uint8 if top < 256 else np.uint16)
    return samples.reshape((height, width, 3) if planes == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head < 40:
        raise ValueError("old BMP header")
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or (packing == 3 and bits not in (16, 32)) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    _checked(width, rows, data)
    body = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if packing == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        words = np.ascontiguousarray(body[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        planes = []
        for mask in masks:
            shift = (mask & -mask).bit_length() - 1
            top = mask >> shift if mask else 0
            if mask == 0 or top & (top + 1):
                raise ValueError("bad BMP channel mask")
            planes.append((((words & mask) >> shift) * 255 + top // 2) // top)
        image = np.stack(planes, axis=2).astype(np.uint8)
    elif bits >= 24:
        image = body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = body[:, :width]
        else:
            per, cells = 8 // bits, np.arange(8 // bits)[::-1] * bits
            index = (body[:, :, None] >> cells.astype(np.uint8) & ((1 << bits) - 1)).reshape(rows, stride * per)[:, :width]
        image = palette[index]
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
            image = image[:, :, 0]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    """An image file's samples."""
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_netpbm(image: np.ndarray) -> bytes:
    """Raw grey map or pixel map of 8-bit samples."""
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, width, height) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits a pixel with a grey palette, or 24 bits."""
    height, width = image.shape[:2]
    bits = 24 if image.ndim == 3 else 8
    stride = (width * bits + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * bits // 8] = (image[:, :, ::-1] if bits == 24 else image).reshape(height, -1)
    palette = b"" if bits == 24 else np.repeat(np.arange(256, dtype=np.uint32) * 0x010101, 1).astype("<u4").tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, bits, 0, rows.size, 2835, 2835, 0, 0)
    return head + palette + rows[::-1].tobytes()


ENCODERS = {"pgm": encode_netpbm, "bmp": encode_bmp}


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target cell, from an integral image read at fractional corners."""

    def at_edges(sums: np.ndarray, cells: int) -> np.ndarray:
        sums = np.concatenate([np.zeros_like(sums[:1]), sums])
        edge = np.linspace(0, len(sums) - 1, cells + 1)
        low = np.minimum(edge.astype(np.int64), len(sums) - 2)
        part = (edge - low).reshape((-1,) + (1,) * (sums.ndim - 1))
        return np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0)

    down = at_edges(np.cumsum(image, axis=0, dtype=np.float64), height)
    across = at_edges(np.cumsum(down.swapaxes(0, 1), axis=0), width).swapaxes(0, 1)
    return across * (height * width / (image.shape[0] * image.shape[1]))


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image (weights of ITU-R BT.601)."""
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of an 8 x 9 reduction darker than its right neighbour."""
    cells = area_resize(grey(image), *HASH_GRID).round(6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def _tile(image: np.ndarray) -> bytes:
    top = 255 if image.dtype == np.uint8 else 65535
    return npy(np.clip(area_resize(image, *TILE).round(), 0, top).astype(image.dtype))


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in new and k not in drop}
    return pa.RecordBatch.from_pydict(kept | new)


def _schema(df: DataFrame, new: str, drop: tuple[str, ...] = ()) -> T.StructType:
    added = T.StructType.fromDDL(new)
    return T.StructType([f for f in df.schema if f.name not in {*added.names, *drop}] + list(added))


def store_text(df: DataFrame, text: str = "text", form: str = "pgm", out: str = "media") -> DataFrame:
    """Replace a text column by a media column: UTF-8 bytes, padded, as samples of an image SIDE wide.

    Adds ``n_bytes`` (before padding). Null is stored as the empty text, which is one square of padding.
    """
    encode, square = ENCODERS[form], SIDE * SIDE

    def store(batches):
        for batch in batches:
            n, files = [], []
            for value in batch.column(text).cast(pa.binary()).to_pylist():
                value = value or b""
                payload = value.ljust(max(1, -(-len(value) // square)) * square, bytes([PAD]))
                n.append(len(value))
                files.append(encode(np.frombuffer(payload, np.uint8).reshape(-1, SIDE)))
            yield _with(batch, {"n_bytes": pa.array(n, pa.int64()), out: pa.array(files, pa.binary())}, (text,))

    common.small_batches(df.sparkSession)
    return df.mapInArrow(store, _schema(df, f"n_bytes long, {out} binary", (text,)))


FEATURES = "height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary, media_error string"


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Decode a media column and replace it by facts about its samples.

    ``payload_*`` and ``tail_crc32`` (of the last 32 bytes) are of the decoded samples in row order, ``feature`` is the
    difference hash, ``tile_npy`` the area-resized tile as an NPY file.
    """
    schema = _schema(df, FEATURES, (media,))
    fields = [f.name for f in T.StructType.fromDDL(FEATURES)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(fields)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            image = decode(data)
            hashed, tile = difference_hash(image), _tile(image)
        except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:  # whatever bytes a column holds, its other rows go on
            return (None,) * 5 + stored + (None, None, str(e) or type(e).__name__)
        payload = image.tobytes()
        return (*image.shape[:2], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, hashed, tile, None)

    def features(batches):
        for batch in batches:
            rows = [row(x) for x in batch.column(media).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield _with(batch, {f: pa.array(list(c), k) for f, c, k in zip(fields, columns, kinds, strict=True)}, (media,))

    return df.mapInArrow(features, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a grey map, read back and described."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "tile_npy"]
    return media_features(store_text(docs)).select(*names)
