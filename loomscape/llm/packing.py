"""Best-fit packing of token sequences by bulk-synchronous sweeps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import materialize
from loomscape.llm.tokens import Encoder

CAPACITY = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids of every document (doc_id, text), the end id last.

    Only documents of more ids are cut, and all their pieces but the last are full. A
    null text is empty: one piece with the end id alone. with_ids adds the ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            names = batch.column("doc_id")
            for b in encoder.blocks(batch.column("text")):
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for k, (s, e) in enumerate(zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True)):
                    ids = np.append(b.ids[s:e], np.uint16(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        row.append(b.first + k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            own.append(part.astype(np.int32))
                columns = [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


_LEFT, _GAP, _MATCH, _STATE = range(4)
_RUNS = "kind int, size long, first long, n long, length long, copies long, rank long"


def _match_runs(batches: Iterator[pa.RecordBatch], floor: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """One sweep over runs of pieces (size, first rank, n) and of sequences of equal room
    (size, first sequence, n) that stand by size, pieces before gaps of their size.

    Each gap takes the longest pieces that wait below it, so that every piece has the
    smallest gap that no longer piece needs more: conflicts go by rank. A sequence takes
    as many copies as it holds. Pieces of at most floor wait for a later sweep. Rows:
    matches, the runs that are left, the gaps at their new size, and a last one with the
    number of longer pieces that are left (n) and how many empty sequences those need
    that no gap holds (first): at least as many as their tokens fill, and one for each
    that is longer than half of one.
    """
    waiting: list[list[int]] = []
    out: list[tuple[int, ...]] = []

    def put(gap: int, first: int, many: int) -> None:
        if gap and many:
            out.append((_GAP, gap, first, many, 0, 0, 0))

    for batch in batches:
        for kind, size, first, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True):
            if kind == _LEFT:
                if size > floor:
                    waiting.append([size, first, n])
                else:
                    out.append((_LEFT, size, first, n, 0, 0, 0))
                continue
            while n and waiting:
                length, rank, pieces = waiting[-1]
                k = size // length
                for many, copies in ((min(n, pieces // k), k), (1, pieces % k)):  # the last pieces share a sequence
                    if many and copies and n and (copies == k or pieces < k):
                        out.append((_MATCH, size, first, many, length, copies, rank))
                        put(size - copies * length, first, many)
                        first, n, rank, pieces = first + many, n - many, rank + many * copies, pieces - many * copies
                if pieces:
                    waiting[-1] = [length, rank, pieces]
                else:
                    waiting.pop()
            put(size, first, n)
    out += [(_LEFT, length, rank, n, 0, 0, 0) for length, rank, n in waiting]
    widest = max((x[1] for x in out if x[0] == _GAP), default=0)
    homeless = [(length, n) for length, _, n in waiting if length > widest]
    new = max(-(-sum(length * n for length, n in homeless) // capacity), sum(n for length, n in homeless if 2 * length > capacity))
    out.append((_STATE, 0, new, sum(n for _, _, n in waiting), 0, 0, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["kind", "size", "first", "n", "length", "copies", "rank"])


def sweep(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best-fit placement by bulk-synchronous sweeps: for each match its gap (size), length,
    rank of the first piece, n sequences from first on, and copies in each. Piece r of a
    length stands in sequence first + q % n at offset capacity - gap + q // n * length,
    where q = r - rank.

    counts has how many pieces there are of each length. Pieces of one length are alike,
    and so are sequences of equal room: the tables of a sweep have a row for each run of
    them, a few for each length at any size of input, and are sorted and matched in one
    task; see _match_runs(). Pieces of more than half a sequence go first, then those of
    more than an eighth, and so on, so that short ones are left to fill what is open.
    Sweeps go on until no piece is left; before each, the empty sequences are opened that
    the last one asked for.
    """
    spark = counts.sparkSession
    zero = F.lit(0).cast("long")
    runs = counts.select(F.lit(_LEFT).alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"))
    opened, done = 0, spark.createDataFrame([], _RUNS)
    floor, new = capacity, 0
    while True:
        if new:
            runs = runs.unionByName(spark.createDataFrame([(_GAP, capacity, opened, new)], "kind int, size long, first long, n long"))
            opened += new
        ordered = runs.coalesce(1).sortWithinPartitions("size", "kind", "first")
        swept = materialize(ordered.mapInArrow(lambda batches, floor=floor: _match_runs(batches, floor, capacity), _RUNS), "sweep")
        done = done.unionByName(swept.where(F.col("kind") == _MATCH))
        runs = swept.where(F.col("kind") <= _GAP).select("kind", "size", "first", "n")
        state = swept.where(F.col("kind") == _STATE).first()
        if state is None:  # an empty table
            break
        new = state["first"]
        if not state["n"]:  # nothing longer is left
            longest = runs.where(F.col("kind") == _LEFT).agg(F.max("size")).first()[0]
            if not longest:
                break
            while floor >= longest:
                floor //= 4 if floor < capacity else 2
    return done


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces are range-sorted by length and id over all executors, so that a common length
    spreads over many tasks; the place in its part gives a piece its rank among those of
    its length once the parts' counts are summed. Only counts by length and part, and the
    matches of sweep(), reach the driver: a few for each part and each length up to
    capacity. Lengths stand from 1 to capacity; equal pieces are told apart by their place
    in the sort; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    # written first: the range sort samples its input, which would be tokenised twice
    pieces = materialize(pieces, "pieces")
    ordered = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("part")
    runs = ordered.groupBy(part, "length").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()
    runs = sorted((r["length"], r["part"], r["first"], r["n"]) for r in runs)
    base: list[int] = []
    held: dict[int, int] = {}
    for length, _, _, n in runs:
        base.append(held.get(length, 0))
        held[length] = base[-1] + n
    matches = sweep(ordered.groupBy("length").agg(F.count("*").alias("n")), capacity).collect()
    rows = np.array([(r["length"], r["rank"], r["n"], r["copies"], r["first"], capacity - r["size"]) for r in matches], dtype=np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first_at = np.array([r[2] for r in runs], dtype=np.int64)
    by_at = np.argsort(first_at)
    plan = spark.sparkContext.broadcast((first_at[by_at], np.array(base, dtype=np.int64)[by_at], rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ranks, rows = plan.value
        key = rows[:, 0] * (1 << 40) + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at").to_numpy()
            length = batch.column("length").to_numpy()
            run = np.searchsorted(first, at, side="right") - 1
            rank = ranks[run] + at - first[run]
            row = rows[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
            q = rank - row[:, 1]
            seq = row[:, 4] + q % row[:, 2]
            offset = row[:, 5] + q // row[:, 2] * length
            out = batch.drop_columns(["_at"])
            yield out.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ordered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place; see token_pieces and pack."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, with_ids), capacity)
