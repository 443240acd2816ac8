"""Frames of any supported source as one table: turned upright, scaled, in BGRA, with errors
as rows and a summary of what was read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscape.operators.frames import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension, natural_key
from loomscape.sources.photos import SourceError, decode, scan

LONGEST = 1 << 16  # of an edge, where no bound is given
FRAME = "frame_id long, path string, width int, height int, bgra binary, error string"


def detect(spark: SparkSession, path: str) -> str:
    """photos or video; an error that tells what is wrong for all else: nothing there, a
    folder without photos, or a file of another kind (a single photo among them)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise SourceError(f"not found: {path}")
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.getFileStatus(at).isDirectory() else None
    kind = lambda name: name.rpartition(".")[2].lower() if "." in name else ""
    if names is None:
        if kind(at.getName()) in VIDEO_EXTENSIONS:
            return "video"
        raise SourceError(f"not supported: {path}")
    if not any(kind(n) in (*IMAGE_EXTENSIONS, "ppm") and not n.startswith(".") for n in names):
        raise SourceError(f"no photos ({', '.join(IMAGE_EXTENSIONS)}) in {path}")
    return "photos"


def orientation(data: bytes) -> int:
    """1 to 8 by a PNG's eXIf chunk; 1 where it has none, or one that can't be read."""
    at = 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"eXIf":
            return _orientation_of(data[at + 8 : at + 8 + n])
        at += 12 + n
    return 1


def _orientation_of(tiff: bytes) -> int:
    end = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    try:
        first = struct.unpack_from(f"{end}I", tiff, 4)[0]
        for k in range(struct.unpack_from(f"{end}H", tiff, first)[0]):
            tag, kind, _, value = struct.unpack_from(f"{end}HHIH", tiff, first + 2 + 12 * k)
            if tag == 0x0112 and kind == 3 and 1 <= value <= 8:
                return value
    except struct.error:
        pass
    return 1


def upright(pixels: np.ndarray, how: int) -> np.ndarray:
    """Pixels as the camera saw them: 5 to 8 exchange rows and columns first; then 3, 4, 7
    and 8 turn rows around, and 2, 3, 6 and 7 columns."""
    if how >= 5:
        pixels = pixels.swapaxes(0, 1)
    if how in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels[:, ::-1] if how in (2, 3, 6, 7) else pixels


def _shares(old: int, new: int) -> np.ndarray:
    """How much of each old pixel lies in each new one, rows adding up to 1."""
    edges = np.arange(new + 1) * old / new
    at = np.arange(old)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * new / old


def within(pixels: np.ndarray, longest: int) -> np.ndarray:
    """Pixels averaged by area so that no edge is longer; smaller ones stay as they are."""
    h, w = pixels.shape[:2]
    if max(h, w) <= longest:
        return pixels
    new_h, new_w = (max(1, round(x * longest / max(h, w))) for x in (h, w))
    mean = np.einsum("ab,bcd,ec->aed", _shares(h, new_h), pixels.astype(float), _shares(w, new_w), optimize=True)
    return np.floor(mean + 0.5).astype(np.uint8)


def bgra(pixels: np.ndarray) -> bytes:
    """Four bytes for each pixel, row by row: blue, green, red, and a full alpha."""
    out = np.full((*pixels.shape[:2], 4), 255, np.uint8)
    out[..., :3] = pixels[..., ::-1]
    return out.tobytes()


def _reader(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a photo a batch: the pixels of one are large enough
                path, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                row: list = [batch.column("frame_id")[i].as_py(), path, None, None, None, None]
                try:
                    pixels = decode(data)
                    if pixels is None:
                        raise ValueError("no decoder")
                    pixels = within(upright(pixels, orientation(data)), longest)
                    row[2:5] = pixels.shape[1], pixels.shape[0], bgra(pixels)
                except Exception as e:  # whatever is wrong with a file is told in its row
                    row[5] = f"cannot decode {path.rpartition('/')[2]}: {e}"
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FRAME.split(", ")])

    return run


def ingest(spark: SparkSession, path: str, most: int | None = None, longest: int | None = None) -> DataFrame:
    """FRAME rows of a source: of a folder's photos, numbered from 0 in natural order of names,
    at most most of them, turned by their orientation and with no edge over longest.

    Files are packed into tasks by their bytes, and only those that are asked for are read.
    A photo that can't be decoded is a row with an error and no pixels; it has its number.
    """
    if detect(spark, path) == "video":
        raise SourceError(f"not supported: {path} (no video decoder is installed)")
    if most is None:
        files = scan(spark, path).select("frame_id", "path", "content")
    else:
        listed = spark.read.format("binaryFile").load(path).select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))
        photos = listed.where(extension(F.col("name")).isin(*IMAGE_EXTENSIONS, "ppm") & ~F.col("name").startswith("."))
        first = [r["path"] for r in photos.orderBy(natural_key(F.col("name")), "name").limit(most).collect()]  # most at the most
        if not first:
            return spark.createDataFrame([], FRAME)
        order = spark.createDataFrame([(p, k) for k, p in enumerate(first)], "path string, frame_id long")
        files = spark.read.format("binaryFile").load(first).join(F.broadcast(order), "path").select("frame_id", "path", "content")
    return files.mapInArrow(_reader(LONGEST if longest is None else longest), FRAME)


def summary(frames: DataFrame) -> DataFrame:
    """One row: frames delivered, decoded and failed, and the first decoded one's size (null
    where there is none)."""
    ok = F.col("error").isNull()
    first = F.min_by(F.struct("width", "height"), F.when(ok, F.col("frame_id")))
    out = frames.agg(F.count("*").alias("delivered"), F.count_if(ok).alias("decoded"), F.count_if(~ok).alias("failed"), first.alias("_first"))
    some = F.col("decoded") > 0
    return out.select("delivered", "decoded", "failed", F.when(some, F.col("_first.width")).alias("width"), F.when(some, F.col("_first.height")).alias("height"))
