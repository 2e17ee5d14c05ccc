"""Raster files: windows of files in folders, how much of them is decompressed, and forms of files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from hillspan.operators.terrain import dem_window
from hillspan.sources import rasters as B


def heights(i, height=200, width=150):
    z = np.add.outer(np.arange(height) * 3.0, np.arange(width) * 0.5) + i * 1000
    z[5, 7] = np.nan
    return z


def test_windows_of_files(spark, tmp_path):
    for i, (west, north) in enumerate([(0.0, 2.0), (1.5, 2.0), (0.0, 0.0), (40.0, 2.0)]):
        (tmp_path / f"tile{i}.tif").write_bytes(B.tiff_bytes(heights(i), west, north, 0.01))
    box = (1.4, 1.2, 1.7, 1.5)
    blocks = B.read_rasters(spark, str(tmp_path / "*.tif"), *box)
    # two files meet the box, one of the four strips of each does
    assert sorted((r.path[-5], len(r.z), round(r.north, 6)) for r in blocks.collect()) == [("0", 64, 1.36), ("0", 64, 2.0), ("1", 64, 1.36), ("1", 64, 2.0)]
    got = {(r.col, r.row): r.z for r in dem_window(blocks, *box, 0.0).collect()}
    want = {}
    for i, west in ((0, 0), (1, 150)):
        for r, c in np.ndindex(200, 150):
            x, y = (west + c + 0.5) * 0.01, 2.0 - (r + 0.5) * 0.01
            if box[0] <= x <= box[2] and box[1] <= y <= box[3]:
                want[west + c, r - 200] = heights(i)[r, c]
    assert got == want
    assert np.isnan(next(B.blocks_in(B.tiff_bytes(heights(0), 0.0, 2.0, 0.01), 0, 1.9, 1, 2))[5][5, 7])
    assert B.read_rasters(spark, str(tmp_path / "*.tif"), 10.0, 10.0, 11.0, 11.0).collect() == []


def packed(z, kind, compression, predictor, tile=None, order="<"):
    """A file of another form: tiles, differences, 64-bit or whole samples, either byte order."""
    height, width = z.shape
    kind = np.dtype(kind).newbyteorder(order)
    h, w = tile or (height, width)
    pieces = []
    for r in range(0, height, h):
        for c in range(0, width, w):
            p = np.zeros((h, w), kind)
            part = z[r : r + h, c : c + w]
            p[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                p[:, 1:] = np.diff(p, axis=1)
            data = p.tobytes()
            if predictor == 3:
                planes = p.astype(kind.newbyteorder(">")).view(np.uint8).reshape(h, w, kind.itemsize).transpose(0, 2, 1).reshape(h, -1)
                data = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
            pieces.append(zlib.compress(data) if compression == B.DEFLATE else lzw(data) if compression == B.LZW else data)
    at = np.cumsum([8, *map(len, pieces)])
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    rows = [(B.WIDTH, "I", [width]), (B.HEIGHT, "I", [height]), (B.BITS, "H", [kind.itemsize * 8]), (B.COMPRESSION, "H", [compression]), (B.PREDICTOR, "H", [predictor]), (B.FORMAT, "H", [form]), (B.SCALE, "d", [1.0, 1.0, 0.0]), (B.TIEPOINT, "d", [0.0, 0.0, 0.0, 0.0, float(height), 0.0])]
    rows += [(B.TILE_WIDTH, "I", [w]), (B.TILE_HEIGHT, "I", [h]), (B.TILES, "I", at[:-1]), (B.TILE_BYTES, "I", [*map(len, pieces)])] if tile else [(B.STRIPS, "I", at[:-1]), (B.STRIP_BYTES, "I", [*map(len, pieces)])]
    rows.sort(key=lambda x: x[0])
    start = int(at[-1])
    listed, extra = b"", b""
    for tag, c, values in rows:
        data = struct.pack(f"{order}{len(values)}{c}", *values)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", start + 2 + 12 * len(rows) + 4 + len(extra))
        extra += data if len(data) > 4 else b""
        listed += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12}[c], len(values)) + place
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", start) + b"".join(pieces) + struct.pack(f"{order}H", len(rows)) + listed + bytes(4) + extra


def lzw(data):
    """Codes of growing width: wider as soon as the table has the last number of a width."""
    table, codes, word = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    width, n = 9, 258
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            codes.append((256, width))
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([byte])
    codes.append((table[word], width))
    n += 1
    codes.append((257, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind, compression, predictor, tile", [("f4", B.PLAIN, 1, None), ("f4", B.DEFLATE, 3, (16, 32)), ("f8", B.DEFLATE, 3, None), ("i2", B.DEFLATE, 2, (16, 16)), ("i2", B.LZW, 2, None), ("u1", B.LZW, 1, (32, 16)), ("f4", B.LZW, 3, (64, 64))])
def test_forms_of_files(order, kind, compression, predictor, tile):
    r = np.random.default_rng(1)
    z = r.integers(0, 200, (50, 70)).astype(float) if kind[0] in "iu" else r.normal(size=(50, 70)).astype("f4").astype(float)
    got = np.full((50, 70), np.nan)
    for west, south, east, north, step, block in B.blocks_in(packed(z, kind, compression, predictor, tile, order), 0, 0, 100, 100):
        got[50 - int(north) : 50 - int(south), int(west) : int(east)] = block
    assert (got == z).all()


def test_other_files_fail():
    with pytest.raises(ValueError):
        B.directory(b"GIF89a......")
