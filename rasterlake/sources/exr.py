"""OpenEXR images, scan lines or tiles of one level: uncompressed, RLE and ZIP; HALF, FLOAT and UINT channels, also sub-sampled ones."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the published file format.
MAGIC, VERSION = 20000630, 2
NONE, RLE, ZIPS, ZIP = 0, 1, 2, 3
LINES = {NONE: 1, RLE: 1, ZIPS: 1, ZIP: 16}
KINDS = {0: "<u4", 1: "<f2", 2: "<f4"}
TILED = 0x200


def _runs_undone(data: bytes) -> bytes:
    """Counts below 0 are followed by so many bytes as they are, others by one byte that occurs once more than that."""
    out, at = [], 0
    while at < len(data):
        n = data[at] - 256 if data[at] > 127 else data[at]
        out.append(data[at + 1 : at + 1 - n] if n < 0 else data[at + 1 : at + 2] * (n + 1))
        at += 1 - n if n < 0 else 2
    return b"".join(out)


def _runs_made(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        if n >= 3:
            out.append(bytes([n - 1]) + data[at : at + 1])
            at += n
            continue
        end = at + 1
        while end < len(data) and end - at < 127 and not (data[end : end + 1] == data[end + 1 : end + 2] == data[end + 2 : end + 3]):
            end += 1
        out.append(bytes([256 - (end - at)]) + data[at:end])
        at = end
    return b"".join(out)


def _unpacked(data: bytes, size: int, compression: int = ZIP) -> bytes:
    """Undo deflate or runs, byte deltas and the split of even and odd bytes; blocks that did not shrink are stored plain."""
    if len(data) == size:
        return data
    d = np.frombuffer(_runs_undone(data) if compression == RLE else zlib.decompress(data), np.uint8).astype(np.int64)
    d[1:] -= 128
    t = np.cumsum(d).astype(np.uint8)
    out, half = np.empty(size, np.uint8), (size + 1) // 2
    out[::2], out[1::2] = t[:half], t[half:]
    return out.tobytes()


def _packed(data: bytes, compression: int = ZIP) -> bytes:
    b = np.frombuffer(data, np.uint8)
    t = np.concatenate([b[::2], b[1::2]]).astype(np.int64)
    t[1:] = np.diff(t) + 128
    plain = t.astype(np.uint8).tobytes()
    out = _runs_made(plain) if compression == RLE else zlib.compress(plain)
    return out if len(out) < len(data) else data


def _string(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.index(b"\0", at)
    return raw[at:end].decode("latin-1"), end + 1


def read_exr(raw: bytes) -> np.ndarray:
    """(3, height, width) float32: R, G, B, or one channel three times; alpha is dropped."""
    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != MAGIC:
        raise ValueError("not an EXR file")
    at, head = 8, {}
    while raw[at]:
        name, at = _string(raw, at)
        _, at = _string(raw, at)
        (n,) = struct.unpack_from("<i", raw, at)
        head[name], at = raw[at + 4 : at + 4 + n], at + 4 + n
    compression = head["compression"][0]
    if compression not in LINES:
        raise ValueError(f"compression {compression} is not supported")
    x0, y0, x1, y1 = struct.unpack("<4i", head["dataWindow"])
    w, h, channels, c = x1 - x0 + 1, y1 - y0 + 1, [], 0
    while head["channels"][c]:
        name, c = _string(head["channels"], c)
        kind, _, sx, sy = struct.unpack_from("<iiii", head["channels"], c)
        if kind not in KINDS:
            raise ValueError(f"pixel type {kind} is not supported")
        channels.append((name, np.dtype(KINDS[kind]), sx, sy))
        c += 16
    out = {name: np.zeros((h, w), np.float32) for name, *_ in channels}

    def place(block: bytes, left: int, top: int, width: int, lines: int) -> None:
        """Put the rows of a block at (left, top), in the image's coordinates; a sub-sampled value fills its cell."""
        sizes = [(name, kind, sx, sy, len(range(-(-left // sx) * sx, left + width, sx))) for name, kind, sx, sy in channels]
        total = sum(n * kind.itemsize for y in range(top, top + lines) for _, kind, _, sy, n in sizes if y % sy == 0)
        block, at = _unpacked(block, total, compression), 0
        for y in range(top, top + lines):
            for name, kind, sx, sy, n in sizes:
                if y % sy:
                    continue
                row = np.repeat(np.frombuffer(block, kind, n, at).astype(np.float32), sx)
                first = -(-left // sx) * sx - x0
                out[name][y - y0 : y - y0 + sy, first : first + len(row)] = row[: w - first]
                at += n * kind.itemsize

    if struct.unpack_from("<I", raw, 4)[0] & TILED:
        tw, th, mode = struct.unpack_from("<IIB", head["tiles"])
        if mode & 15:
            raise ValueError("several levels of tiles are not supported")
        for offset in struct.unpack_from(f"<{-(-w // tw) * -(-h // th)}Q", raw, at + 1):
            tx, ty, _, _, size = struct.unpack_from("<5i", raw, offset)
            place(raw[offset + 20 : offset + 20 + size], x0 + tx * tw, y0 + ty * th, min(tw, w - tx * tw), min(th, h - ty * th))
    else:
        for offset in struct.unpack_from(f"<{-(-h // LINES[compression])}Q", raw, at + 1):
            y, size = struct.unpack_from("<ii", raw, offset)
            place(raw[offset + 8 : offset + 8 + size], x0, y, w, min(LINES[compression], h - (y - y0)))
    names = ["R", "G", "B"] if all(k in out for k in "RGB") else [next(iter(out))] * 3
    return np.stack([out[k] for k in names])


def write_exr(rgb: np.ndarray, compression: int = ZIP, tile: int = 0) -> bytes:
    """HALF channels, stored in the order B, G, R; a single plane is written as grey. ``tile``: the side of tiles instead of scan lines."""
    rgb = np.asarray(rgb, np.float32)
    rgb = np.repeat(rgb, 3, 0) if len(rgb) == 1 else rgb
    _, h, w = rgb.shape
    item = lambda name, kind, value: name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value
    window = struct.pack("<4i", 0, 0, w - 1, h - 1)
    listed = b"".join(k + b"\0" + struct.pack("<iiii", 1, 0, 1, 1) for k in (b"B", b"G", b"R")) + b"\0"
    tiles = (("tiles", "tiledesc", struct.pack("<IIB", tile, tile, 0)),) if tile else ()
    head = struct.pack("<II", MAGIC, VERSION | (TILED if tile else 0)) + b"".join(
        item(*x)
        for x in (
            ("channels", "chlist", listed), ("compression", "compression", bytes([compression])), ("dataWindow", "box2i", window), ("displayWindow", "box2i", window),
            ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1)), *tiles,
        )
    ) + b"\0"
    with np.errstate(over="ignore"):
        half = rgb[::-1].astype("<f2").transpose(1, 0, 2)
    if tile:
        parts = [(struct.pack("<iiii", x // tile, y // tile, 0, 0), half[y : y + tile, :, x : x + tile]) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [(struct.pack("<i", y), half[y : y + LINES[compression]]) for y in range(0, h, LINES[compression])]
    blocks, offsets, at = [], [], len(head) + 8 * len(parts)
    for where, cells in parts:
        data = cells.tobytes()
        data = data if compression == NONE else _packed(data, compression)
        blocks.append(where + struct.pack("<i", len(data)) + data)
        offsets.append(at)
        at += len(blocks[-1])
    return head + struct.pack(f"<{len(offsets)}Q", *offsets) + b"".join(blocks)


def load_exr(spark: SparkSession, path: str, square: bool = False) -> DataFrame:
    """path, width, height, pixels (three planes), error of all EXR files under ``path`` (not below its folders)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, raw in batch[["path", "content"]].itertuples(index=False):
                try:
                    rgb = read_exr(bytes(raw))
                    if square and rgb.shape[1] != rgb.shape[2]:
                        raise ValueError("image is not square")
                    out.append((name, rgb.shape[2], rgb.shape[1], rgb.astype(float).ravel(), None))
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    out.append((name, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.exr").option("recursiveFileLookup", "false").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, pixels array<double>, error string")


def encode_exr(images: DataFrame) -> DataFrame:
    """image_id, content of (image_id, side, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [write_exr(np.asarray(p).reshape(3, s, s)) for s, p in zip(batch["side"], batch["pixels"], strict=True)]
            yield pd.DataFrame({"image_id": batch["image_id"], "content": made})

    return images.mapInPandas(run, "image_id bigint, content binary")


def save_files(rows: DataFrame, folder: str, name: str = "image_id", suffix: str = ".exr") -> None:
    """One file per row (name, content) in a folder that all executors share; each appears whole or not at all."""

    def run(part) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in part:
            target = os.path.join(folder, f"{row[name]}{suffix}")
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "wb") as f:
                f.write(bytes(row["content"]))
            os.replace(partial, target)

    rows.select(F.col(name), "content").foreachPartition(run)
