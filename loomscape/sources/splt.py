"""Checkpoints of Gaussian primitives: a small header and 14 floats for each."""

from __future__ import annotations

import os
import struct

import numpy as np

# The file's mark and version.
MAGIC, VERSION = 0x53504C54, 1
_HEAD = struct.Struct("<IIII")


class CheckpointError(ValueError):
    pass


def encode(cloud: np.ndarray, iteration: int) -> bytes:
    return _HEAD.pack(MAGIC, VERSION, len(cloud), iteration) + np.ascontiguousarray(cloud, "<f4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, int]:
    if len(data) < _HEAD.size:
        raise CheckpointError("too short")
    magic, version, count, iteration = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise CheckpointError("not a checkpoint")
    if version != VERSION:
        raise CheckpointError(f"version {version} is not supported")
    if len(data) < _HEAD.size + 56 * count:
        raise CheckpointError("truncated")
    return np.frombuffer(data, "<f4", 14 * count, _HEAD.size).reshape(count, 14).copy(), iteration


def write(cloud: np.ndarray, iteration: int, path: str) -> None:
    """Into a file beside it first, then renamed: a reader never meets half a file."""
    with open(f"{path}.part", "wb") as f:
        f.write(encode(cloud, iteration))
    os.replace(f"{path}.part", path)


def read(path: str) -> tuple[np.ndarray, int]:
    with open(path, "rb") as f:
        return decode(f.read())


def register(spark) -> None:
    """spark.read.format("splt").load(path): one row for each primitive."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    from loomscape.functions.splat_np import FIELDS

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def read(self, partition):
            cloud, iteration = read(self.path)
            for i, row in enumerate(cloud.tolist()):
                yield (i, iteration, *row)

    class Splt(DataSource):
        @classmethod
        def name(cls) -> str:
            return "splt"

        def schema(self) -> str:
            return "splat_id bigint, iteration int, " + ", ".join(f"{f} float" for f in FIELDS)

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

    spark.dataSource.register(Splt)
