"""Contents of PNG images: pixels, statistics of their channels and a hash that near copies share.

A task inflates one image at a time; what it gives is a row of numbers, not the pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type, and the bits that each type allows.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
BITS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Columns and rows at which the seven passes of an interlaced image begin, and their steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Unpacked bytes of an image at most; a larger one is an error.
MAX_BYTES = 256 << 20


class ImageError(ValueError):
    pass


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk, checked by its CRC."""
    if data[:8] != SIGNATURE:
        raise ImageError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ImageError(f"a damaged chunk {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ImageError("the file ends early")


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without the filter that each row's first byte names."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for y in range(raw.shape[0]):
        kind, row = int(raw[y, 0]), raw[y, 1:].copy()
        if kind == 1:  # each byte adds the one a pixel to its left: sums along the row, modulo 256
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left, corner, values, up = [0] * step, [0] * step, row.tolist(), above.tolist()
            for i, value in enumerate(values):
                a, b, c = left[i % step], up[i], corner[i % step]
                if kind == 3:
                    near = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if p <= q and p <= r else b if q <= r else c
                values[i] = left[i % step] = (value + near) & 255
                corner[i % step] = b
            row = np.array(values, np.uint8)
        elif kind:
            raise ImageError(f"no filter {kind}")
        out[y] = above = row
    return out


def samples(rows: np.ndarray, width: int, bits: int, per_pixel: int) -> np.ndarray:
    """(height, width, samples) of rows of bytes."""
    if bits == 16:
        values = rows.reshape(len(rows), -1, 2).astype(np.uint16)
        found = values[..., 0] << 8 | values[..., 1]
    elif bits == 8:
        found = rows
    else:
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        found = (rows[:, :, None] >> shifts & np.uint8((1 << bits) - 1)).reshape(len(rows), -1)[:, : width * per_pixel]
    return found.reshape(len(rows), width, per_pixel)


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) as the samples of 8 or 16 bits: grey, grey and alpha, colours, or colours and alpha; palettes are resolved."""
    head, palette, packed = None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ImageError("no header")
    width, height, bits, colour, _, _, interlaced = head
    if bits not in BITS.get(colour, ()) or not width or not height or interlaced > 1:
        raise ImageError("an impossible header")
    per_pixel = SAMPLES[colour]
    line = lambda w: (w * per_pixel * bits + 7) // 8 + 1
    parts = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),))]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    size = sum(line(w) * h for *_, w, h in parts)
    if size > MAX_BYTES:
        raise ImageError(f"the image has over {MAX_BYTES} bytes")
    raw = zlib.decompressobj().decompress(b"".join(packed), size)
    if len(raw) < size:
        raise ImageError("the image's data end early")
    out = np.zeros((height, width, per_pixel), np.uint16 if bits == 16 else np.uint8)
    at = 0
    for x, y, dx, dy, w, h in parts:
        n = line(w) * h
        rows = unfiltered(np.frombuffer(raw, np.uint8, n, at).reshape(h, -1), max(1, per_pixel * bits // 8))
        out[y::dy, x::dx] = samples(rows, w, bits, per_pixel)
        at += n
    if colour == 3:
        if palette is None or int(out.max()) >= len(palette):
            raise ImageError("a pixel's colour isn't in the palette")
        return palette[out[..., 0]]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    return out


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness from 0 to 255: the mean of the colours, whatever the alpha."""
    colours = pixels[..., : 3 if pixels.shape[2] >= 3 else 1].astype(np.float64)
    return colours.mean(axis=2) / (257 if pixels.dtype == np.uint16 else 1)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: in a grid of 8 rows of 9 cells, whether a cell is brighter than the next; a signed number.

    Cells are means of the pixels under them, so size and small changes matter little.  An image smaller than the grid repeats pixels.
    """
    image = grey(pixels)
    rows, columns = (np.arange(n + 1) * size // n for n, size in ((8, image.shape[0]), (9, image.shape[1])))
    sums = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, c0 = rows[:-1], columns[:-1]
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(columns[1:], c0 + 1)
    cells = (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    bits = np.round(cells[:, :-1], 6) > np.round(cells[:, 1:], 6)
    return int(np.packbits(bits.ravel()).view(">i8")[0])


ROWS = pa.schema([
    ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("means", pa.list_(pa.float64())), ("least", pa.list_(pa.int32())),
    ("greatest", pa.list_(pa.int32())), ("hash", pa.int64()), ("error", pa.string()),
])
ROWS_SQL = "path string, width int, height int, channels int, depth int, means array<double>, least array<int>, greatest array<int>, hash long, error string"


def described(data: bytes) -> tuple:
    try:
        p = png_pixels(data)
        flat = p.reshape(-1, p.shape[2])
        return (p.shape[1], p.shape[0], p.shape[2], 8 * p.itemsize, flat.mean(0).tolist(), flat.min(0).tolist(), flat.max(0).tolist(), difference_hash(p), None)
    except Exception as e:  # noqa: BLE001  whatever a damaged image leads to is its own row
        return (*[None] * 8, f"{type(e).__name__}: {e}"[:200])


def image_contents(files: DataFrame) -> DataFrame:
    """Rows (path, content) of PNG files: size, channels, bits of a sample, mean, least and greatest of each channel, and ``difference_hash``; or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b.column("path")[i].as_py(), *described(b.column("content")[i].as_py() or b"")) for i in range(b.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    return files.select("path", "content").mapInArrow(run, ROWS_SQL)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The same of all PNG files below a folder."""
    return image_contents(spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.{png,PNG}").load(path))

