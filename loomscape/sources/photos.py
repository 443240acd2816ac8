"""Photo folders: detection, natural order and decoding of PPM and plain PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscape.functions import features_np as N
from loomscape.operators.frames import IMAGE_EXTENSIONS, natural_key, source_kind


class SourceError(ValueError):
    pass


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content and frame_id of the photos of a folder (not of its subfolders),
    hidden ones left out, numbered in natural order of names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise SourceError(f"not found: {folder}")
    if not fs.getFileStatus(at).isDirectory():
        raise SourceError(f"not supported: {folder}")
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    photos = files.where((source_kind(F.col("name")) == "photo") | F.lower("name").endswith(".ppm")).where("name NOT LIKE '.%'")
    # names alone are sorted; a folder's listing is what the driver has read anyway
    order = photos.select("name").withColumn("frame_id", F.row_number().over(Window.orderBy(natural_key(F.col("name")), "name")) - 1)
    out = photos.join(order, "name").select("frame_id", "path", "name", "content")
    if out.isEmpty():
        raise SourceError(f"no photos ({', '.join(IMAGE_EXTENSIONS)}) in {folder}")
    return out


def decode(data: bytes) -> np.ndarray | None:
    """(height, width, 3) of a binary PPM, or an 8-bit PNG without interlacing; else none."""
    if data[:2] == b"P6":
        parts = data.split(maxsplit=4)
        w, h = int(parts[1]), int(parts[2])
        return np.frombuffer(data, np.uint8, w * h * 3, len(data) - w * h * 3).reshape(h, w, 3)
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, w, h, channels = 8, b"", 0, 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
            if depth != 8 or lace or not channels:
                return None
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind in (0, 2):
            row = line + (above if kind == 2 else 0)
        else:
            row = line.copy()
            for x in range(w * channels):
                a = row[x - channels] & 255 if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                p = a + b - c
                best = min((a, b, c), key=lambda v: (abs(p - v), 0 if v == a else 1 if v == b else 2))
                row[x] += a if kind == 1 else (a + b) // 2 if kind == 3 else best
        above = row & 255
        out[y] = above
    out = out.reshape(h, w, channels)
    return out[..., :3] if channels >= 3 else np.repeat(out[..., :1], 3, axis=2)


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG of values from 0 to 1 (cut to that, then truncated)."""
    v = (np.clip(rgb, 0, 1) * 255).astype(np.uint8)
    rows = np.concatenate([np.zeros((len(v), 1), np.uint8), v.reshape(len(v), -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def score(frames: DataFrame) -> DataFrame:
    """frame_id, blur and signature of photos; those that can't be decoded are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, data in zip(part["frame_id"], part["content"], strict=True):
                image = decode(bytes(data))
                if image is not None:
                    v = N.luma(image)
                    rows.append((i, N.blur_score(v), N.signature(v)))
            yield pd.DataFrame(rows, columns=["frame_id", "blur", "signature"])

    return frames.select("frame_id", "content").mapInPandas(run, "frame_id long, blur double, signature array<double>")


def features(frames: DataFrame, most: int = 1500, kind: str = "brief") -> DataFrame:
    """Keypoints and descriptors of photos."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, data in zip(part["frame_id"], part["content"], strict=True):
                image = decode(bytes(data))
                rows = N.extract(N.luma(image), most, kind) if image is not None else []
                yield pd.DataFrame([{"frame_id": i, "kp_id": k, **r, "descriptor": r["descriptor"].astype(np.int16)} for k, r in enumerate(rows)], columns=["frame_id", "kp_id", "x", "y", "response", "angle", "octave", "descriptor"])

    return frames.select("frame_id", "content").mapInPandas(run, "frame_id long, kp_id long, x double, y double, response double, angle double, octave int, descriptor array<smallint>")
