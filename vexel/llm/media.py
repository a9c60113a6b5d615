"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, tiled and hashed."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, need

by_value(__name__)

TILE = 32
#: An image of more pixels than this is refused; a row must fit in a task.
PIXELS = 1 << 26
_FIELD = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\r\n]*[\r\n])*([0-9]+)")


def _check(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain or raw (P1 to P6): height x width or height x width x 3, of 8 bits a sample."""
    _check(len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456", "not Netpbm")
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        _check(m is not None and len(m[1]) < 10, "bad header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = 1 if kind in (1, 4) else head[2]
    _check(0 < width and 0 < height and width * height <= PIXELS, "bad size")
    _check(0 < most < 65536, "bad maximum")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind >= 4:
        _check(data[at : at + 1].isspace(), "bad header")
        at += 1
    if kind == 4:
        row = (width + 7) // 8
        _check(len(data) - at >= row * height, "too few bytes")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind > 4:
        kindof = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
        _check(len(data) - at >= n * kindof.itemsize, "too few bytes")
        v = np.frombuffer(data, kindof, n, at).astype(np.int64)
    elif kind == 1:
        text = re.sub(rb"#[^\r\n]*", b"", data[at:])
        v = np.frombuffer(text, np.uint8)
        v = v[(v == 48) | (v == 49)][:n].astype(np.int64) - 48
        _check(len(v) == n, "too few samples")
        v = 1 - v
    else:
        v = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
        _check(len(v) == n, "too few samples")
    _check(int(v.max()) <= most and int(v.min()) >= 0, "sample above the maximum")
    out = ((v * 510 + most) // (2 * most)).astype(np.uint8)
    return out.reshape(height, width, 3) if channels == 3 else out.reshape(height, width)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, bottom-up or top-down: height x width x 3."""
    _check(len(data) >= 54 and data[:2] == b"BM", "not BMP")
    offset = struct.unpack_from("<I", data, 10)[0]
    size, width, height, planes, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    _check(size >= 40 and planes == 1, "header not supported")
    _check(bits in (1, 4, 8, 24, 32) and packed == 0, "encoding not supported")
    down, height = height < 0, abs(height)
    _check(0 < width and 0 < height and width * height <= PIXELS, "bad size")
    row = (width * bits + 31) // 32 * 4
    _check(len(data) >= offset + row * height, "too few bytes")
    raw = np.frombuffer(data, np.uint8, row * height, offset).reshape(height, row)
    if bits >= 24:
        k = bits // 8
        out = raw[:, : width * k].reshape(height, width, k)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        _check(colours <= 1 << bits and 14 + size + 4 * colours <= len(data), "bad palette")
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(height, -1)
        index = index[:, :width]
        _check(int(index.max()) < colours, "colour not in the palette")
        out = palette[index]
    return np.ascontiguousarray(out if down else out[::-1])


def decode(data: bytes) -> tuple[str, np.ndarray]:
    if data[:2] == b"BM":
        return "bmp", decode_bmp(data)
    return {49: "pbm", 50: "pgm", 51: "ppm", 52: "pbm", 53: "pgm", 54: "ppm"}.get(data[1] if len(data) > 1 else 0, "?"), decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target pixel's area, in floating point, from an integral image read between its grid points."""
    x = image.astype(np.float64)
    sums = np.zeros((x.shape[0] + 1, x.shape[1] + 1, *x.shape[2:]))
    sums[1:, 1:] = x.cumsum(axis=0).cumsum(axis=1)

    def cuts(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(m + 1) * n / m
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (r, fr), (c, fc) = cuts(x.shape[0], height), cuts(x.shape[1], width)
    shape = (-1, 1) + (1,) * (x.ndim - 2)
    fr, fc = fr.reshape(-1, 1, *shape[2:]), fc.reshape(1, -1, *shape[2:])
    rows = sums[r] * (1 - fr) + sums[r + 1] * fr
    both = rows[:, c] * (1 - fc) + rows[:, c + 1] * fc
    area = x.shape[0] / height * (x.shape[1] / width)
    return (both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) / area


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> int:
    """64 bits, as a signed number: is each of 8 x 9 area means less than the one to its right."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return int(np.packbits(small[:, :-1] < small[:, 1:]).view(">i8")[0])


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def encode_netpbm(image: np.ndarray, plain: bool = False) -> bytes:
    kind = (2 if plain else 5) + (image.ndim == 3)
    head = f"P{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode()
    return head + ("\n".join(" ".join(map(str, r.ravel())) for r in image) + "\n").encode() if plain else head + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray, down: bool = False) -> bytes:
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    h, w, _ = rgb.shape
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = (rgb if down else rgb[::-1])[:, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, -h if down else h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def media_tiles(media: DataFrame, data: str = "media", media_id: str = "media_id", tile: int = TILE) -> DataFrame:
    """(media_id, format, height, width, channels, tile, dhash, error): one row for each image.

    ``tile`` is an NPY file, format 1.0, of tile x tile 8-bit samples (x 3 for colour). A value that can't be decoded has
    a reason in ``error`` and nulls; so have null and empty values ("no data"). A large image is decoded whole, up to
    2**26 pixels. Null ids are passed on, repeated rows are decoded each, an empty table gives an empty one; extra
    columns are not read.
    """
    need(media, data, media_id)
    rows = media.select(F.col(media_id).alias("media_id"), F.col(data).cast("binary").alias("data"))
    schema = T.StructType([rows.schema["media_id"], *(T.StructField(n, t) for n, t in (("format", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("tile", T.BinaryType()), ("dhash", T.LongType()), ("error", T.StringType())))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
        for batch in stream:
            out = []
            for raw in batch.column("data"):
                value = raw.as_py()
                try:
                    _check(bool(value), "no data")
                    kind, image = decode(value)
                    small = np.clip(np.floor(area_resize(image, tile, tile) + 0.5), 0, 255).astype(np.uint8)
                    out.append((kind, image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy(small), difference_hash(image), None))
                except (ValueError, struct.error, OverflowError) as e:
                    out.append((None, None, None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=schema.names)

    return rows.mapInArrow(run, schema)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Writes the tiles to ``path`` as a table of NPY files, one a row with its id and hash, partitioned by format; any executor can write its part.

    Rows without a tile are left out, null ids and repeated rows are written as they are, and an empty table writes none.
    ``path`` must not be there yet. Extra columns are not written.
    """
    tiles.filter("tile is not null").select("media_id", "dhash", "format", "tile").write.partitionBy("format").parquet(path)


def embedding_images(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(media_id, media): each vector as an image, its values scaled to 0 to 255 in rows of 8, in turn as PGM, plain PGM, PPM, plain PPM, BMP and top-down BMP.

    Null vectors, empty ones and those without a finite value have a null image; other values that are null or not finite
    are left out of theirs. A null id counts as 0 for the format. A long vector has more rows of 8, equal ones give equal
    images, repeated rows are drawn each. An empty table gives an empty one; extra columns are not read.
    """
    need(embeddings, vec_id, embedding)
    rows = embeddings.select(F.col(vec_id).alias("media_id"), F.col(embedding).alias("v"))
    schema = T.StructType([rows.schema["media_id"], T.StructField("media", T.BinaryType())])

    def picture(k: int, values: list | None) -> bytes | None:
        v = np.array([x for x in values or [] if x is not None and np.isfinite(x)], dtype=np.float64)
        if not len(v):
            return None
        width = min(8, len(v))
        v = np.resize(v, (-(-len(v) // width), width))
        span = float(v.max() - v.min()) or 1.0
        image = np.floor((v - v.min()) / span * 255 + 0.5).astype(np.uint8)
        colour = np.stack([image, 255 - image, image[:, ::-1]], axis=2)
        return (encode_netpbm(image), encode_netpbm(image, True), encode_netpbm(colour), encode_netpbm(colour, True), encode_bmp(colour), encode_bmp(colour, True))[k % 6]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [picture(i or 0, v) for i, v in zip(batch.column("media_id").to_pylist(), batch.column("v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(made, pa.binary())], names=["media_id", "media"])

    return rows.mapInArrow(run, schema)
