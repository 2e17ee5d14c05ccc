"""Georeferenced TIFF files of heights: blocks of pixels in a window from files that Spark lists and reads, and files' bytes from tiles.

Files are one row each of Spark's binaryFile source, so any store that Spark reads will do. Of a file only the directory is
looked at unless its bounds meet the window, and then only the strips or tiles of pixels in it are decompressed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCKS = "path string, west double, south double, east double, north double, step double, z array<array<double>>"
#: Types of a directory's entries, by their number; numbers of the entries; forms of samples.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, NO_DATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and entries of a file's first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    large = version == 43
    at = struct.unpack_from(f"{order}{'Q' if large else 'I'}", data, 8 if large else 4)[0]
    head, entry, inline = ("Q", 20, 8) if large else ("H", 12, 4)
    n = struct.unpack_from(f"{order}{head}", data, at)[0]
    at += struct.calcsize(head)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if large else 'I'}", data, at + k * entry)
        if kind not in TYPES:
            continue
        form = f"{order}{count}s" if kind == 2 else f"{order}{count * len(TYPES[kind])}{TYPES[kind][0]}"
        place = at + k * entry + entry - inline
        if struct.calcsize(form) > inline:
            place = struct.unpack_from(f"{order}{'Q' if large else 'I'}", data, place)[0]
        out[tag] = struct.unpack_from(form, data, place)
    return order, out


def _unlzw(data: bytes) -> bytes:
    """LZW codes of 9 to 12 bits, highest bit first: 256 starts a new table, 257 ends."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [], 9, b""
            continue
        word = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        # the reader's table is one behind the writer's, who widens a code early
        width = 9 if len(table) < 253 else 10 if len(table) < 765 else 11 if len(table) < 1789 else 12
    return bytes(out)


def _pixels(data: bytes, compression: int, predictor: int, height: int, width: int, kind: np.dtype) -> np.ndarray:
    """A strip or tile, decompressed, its differences summed."""
    if compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression == LZW:
        data = _unlzw(data)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} of a TIFF file")
    if predictor == 3:  # bytes of a row's values in planes, highest first, as differences
        planes = np.cumsum(np.frombuffer(data, np.uint8, height * width * kind.itemsize).reshape(height, -1), axis=1, dtype=np.uint8)
        return planes.reshape(height, kind.itemsize, width).transpose(0, 2, 1).copy().view(kind.newbyteorder(">")).reshape(height, width)
    z = np.frombuffer(data, kind, height * width).reshape(height, width)
    return np.cumsum(z, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else z


def blocks_in(data: bytes, west: float, south: float, east: float, north: float) -> Iterator[tuple[float, float, float, float, float, np.ndarray]]:
    """west, south, east, north, step and pixels (rows from the north; voids are NaN) of the file's strips or tiles that meet a box; nothing else is decompressed."""
    order, tags = directory(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height = one(WIDTH), one(HEIGHT)
    if one(SAMPLES, 1) != 1 or SCALE not in tags or TIEPOINT not in tags:
        raise ValueError("a TIFF file of more than one band, or without a place")
    step, (col, row, _, x, y, _) = tags[SCALE][0], tags[TIEPOINT][:6]
    x, y = x - col * step, y + row * step
    if x > east or y < south or x + width * step < west or y - height * step > north:
        return
    kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across = -(-width // w)
    void = float(one(NO_DATA).split(b"\0")[0]) if one(NO_DATA) else None
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        c, r = k % across * w, k // across * h
        wide, high = min(w, width - c), min(h, height - r)
        box = (x + c * step, y - (r + high) * step, x + (c + wide) * step, y - r * step)
        if box[0] > east or box[2] < west or box[1] > north or box[3] < south:
            continue
        z = _pixels(data[at : at + size], one(COMPRESSION, PLAIN), one(PREDICTOR, 1), h if tiled else high, w, kind)[:high, :wide].astype(float)
        yield *box, step, z if void is None else np.where(z == void, np.nan, z)


def read_rasters(spark: SparkSession, paths: str | Sequence[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """raster_blocks() of files, folders or patterns of names."""
    return raster_blocks(spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)), west, south, east, north)


def raster_blocks(files: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """BLOCKS of files (path, content) that meet a box in the files' own units: tiles of heights as dem_window() takes them, one for each strip or tile of a file. Other files than TIFF fail."""
    kind = pa.schema([("path", pa.string()), *((c, pa.float64()) for c in ("west", "south", "east", "north", "step")), ("z", pa.list_(pa.list_(pa.float64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for *bounds, z in blocks_in(content.as_py(), west, south, east, north):
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    whole = pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), rows)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), *(pa.array([float(b)]) for b in bounds), whole], schema=kind)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def tiff_bytes(z: np.ndarray, west: float, north: float, step: float, rows: int = 64, void: float = -9999.0) -> bytes:
    """A file of 32-bit floats in deflated strips of some rows; NaN is void."""
    height, width = z.shape
    values = np.where(np.isnan(z), void, z).astype("<f4")
    strips = [zlib.compress(values[r : r + rows].tobytes()) for r in range(0, height, rows)]
    at = 8 + np.concatenate([[0], np.cumsum([len(s) for s in strips])]).astype(int)
    numbers = lambda form, *x: struct.pack(f"<{len(x)}{form}", *x)
    text = f"{void}".encode() + b"\0"
    entries = [(WIDTH, 4, numbers("I", width)), (HEIGHT, 4, numbers("I", height)), (BITS, 3, numbers("H", 32)), (COMPRESSION, 3, numbers("H", DEFLATE)), (STRIPS, 4, numbers("I", *at[:-1])), (SAMPLES, 3, numbers("H", 1)), (ROWS_PER_STRIP, 4, numbers("I", rows)), (STRIP_BYTES, 4, numbers("I", *map(len, strips))), (FORMAT, 3, numbers("H", 3)), (SCALE, 12, numbers("d", step, step, 0.0)), (TIEPOINT, 12, numbers("d", 0.0, 0.0, 0.0, west, north, 0.0)), (NO_DATA, 2, text)]
    start = int(at[-1])
    extra, listed = b"", b""
    for tag, kind, data in entries:
        count = len(data) // struct.calcsize(TYPES[kind])
        if len(data) <= 4:
            value = data.ljust(4, b"\0")
        else:
            value = struct.pack("<I", start + 2 + 12 * len(entries) + 4 + len(extra))
            extra += data
        listed += struct.pack("<HHI", tag, kind, count) + value
    return b"II*\0" + struct.pack("<I", start) + b"".join(strips) + struct.pack("<H", len(entries)) + listed + bytes(4) + extra


def raster_files(tiles: DataFrame) -> DataFrame:
    """path and content of a file for each of tiles (path, west, north, step, z: rows of pixels from the north), a table that a store's writer takes. Tiles without pixels have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, west, north, step, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z and z[0]:
                    pixels = np.array([[np.nan if v is None else v for v in row] for row in z], float)
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [tiff_bytes(pixels, west, north, step)]})

    return tiles.select("path", "west", "north", "step", "z").mapInArrow(run, "path string, content binary")
