"""Token ids in binary shards: one wavelet matrix per block of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import work_path
from loomscape.llm.tokens import Encoder
from loomscape.llm.wavelet import WaveletMatrix, encode

SHARD_SCHEMA = "part int, block int, base long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
BLOCK_TOKENS = 1 << 18


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes docs (doc_id, text) and writes them in ascending doc_id order to path.

    Documents are range-partitioned by doc_id, so that parts ascend, and each part is
    one file: blocks of about block_tokens ids, each a compressed wavelet matrix with
    its documents' ids and lengths. A document is never cut. A null text is empty and
    gives the end id alone; equal doc_ids stand by text; an empty table gives no block.
    Files come through Spark's own writer, so that any file system serves and a task
    that is run again leaves one copy.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = base = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, base, block
            every = np.concatenate(ids)
            sizes = np.concatenate(lengths)
            row = {"part": part, "block": block, "base": base, "n_docs": len(sizes), "n_tokens": len(every), "doc_ids": [x for a in names for x in a.to_pylist()], "lengths": sizes.tolist(), "data": encode(every)}
            base, block, held = base + len(every), block + 1, 0
            for x in (ids, lengths, names):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for b in encoder.blocks(batch.column("text")):
                n = len(b.at) - 1
                # the end id after every text
                out = np.empty(len(b.ids) + n, dtype=np.uint16)
                ends = b.at[1:] + np.arange(n)
                keep = np.ones(len(out), dtype=bool)
                keep[ends] = False
                out[ends] = end_id
                out[keep] = b.ids
                upto, i = ends + 1, 0
                while i < n:
                    start = int(upto[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(upto, start + block_tokens - held, side="right")))
                    j = min(j, n)
                    ids.append(out[start : upto[j - 1]])
                    lengths.append(np.diff(upto[i:j], prepend=start))
                    names.append(batch.column("doc_id").slice(b.first + i, j - i))
                    held += int(upto[j - 1]) - start
                    i = j
                    if held >= block_tokens or i < n:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document, from the files."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", lambda ids: ids)


def shard_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of its ids as little-endian 32-bit integers, from the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", None)


def _read(spark, path: str, schema: str, whole) -> DataFrame:
    blocks = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row for each part; the driver adds them up
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    begin = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)])[:-1].tolist(), strict=True))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row].as_py() for c in ("part", "base", "lengths", "data", "doc_ids")}
                ids = WaveletMatrix(get["data"]).to_numpy()
                at = np.concatenate([[0], np.cumsum(np.array(get["lengths"], dtype=np.int64))])
                out = [pa.array(get["doc_ids"], pa.int64()), pa.array(begin[get["part"]] + get["base"] + at[:-1], pa.int64())]
                if whole:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "ids"])
                else:
                    wide = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    out += [pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "base", "lengths", "data", "doc_ids").mapInArrow(documents, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes docs as shards and returns their digests as read back."""
    path = path or work_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, end_id)
    return shard_digests(docs.sparkSession, path)
