"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import components, connect, materialize, prefix_pairs, shared_keys
from loomscape.llm.words import LANES, NON_SPACE, U, mix, shingle_set, word_blocks

BANDS, ROWS = 28, 4
_ROUND = mix(np.arange(1, 4 * BANDS * ROWS, dtype=np.uint64))
_LOW48 = U((1 << 48) - 1)
_SLOTS = 1 << 18  # counters for the order of shingles
_FILTER_BITS = 1 << 26  # of the prefilter on candidates, at most: 8 MB
_ID_BITS = 64  # of it for each candidate


def sketch(shingles: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit values, t coordinates.

    In round i < t every value goes to a hashed bin with the value i + hash; in round
    t + j every value goes to bin j. A bin keeps its least entry, so that each is filled
    after 2 t rounds at the latest, and mostly after few. Later rounds can't change a
    filled bin; rounds are thus done in blocks until none is empty.
    """
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    i, n = 0, len(shingles)
    while n and i < 2 * t:
        many = min(2 * t - i, max(1, 3 * t // n))
        hashed = mix(shingles[None, :] ^ _ROUND[i : i + many, None])
        rounds = np.arange(i, i + many, dtype=np.uint64)[:, None]
        bins = ((hashed >> U(32)) * U(t) >> U(32)).astype(np.int64)
        if i + many > t:
            late = np.arange(max(i, t), i + many)
            bins[late - i] = (late - t)[:, None]
        np.minimum.at(out, bins.ravel(), (rounds << U(48) | hashed & _LOW48).ravel())
        i += many
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(-1, rows)
    return mix((parts * LANES[:rows]).sum(axis=1, dtype=np.uint64) + mix(np.arange(len(parts), dtype=np.uint64)))


def _sketcher(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in word_blocks(batch.column("text"), NON_SPACE):
                n = len(b.at) - 1
                counts, one, two, keys = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), []
                for k in range(n):
                    own = shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size)
                    counts[k] = len(own)
                    if len(own):
                        one[k] = mix(own ^ LANES[40]).sum(dtype=np.uint64)
                        two[k] = mix(own ^ LANES[41]).sum(dtype=np.uint64)
                        keys.append(band_keys(sketch(own, bands * rows), rows).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                columns = [batch.column("doc_id").slice(b.first, n), pa.array(counts), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_1", "set_2", "keys"])

    return run


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for b in word_blocks(column, NON_SPACE):
                for k in range(len(b.at) - 1):
                    yield shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size)

        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(0, batch.num_rows, 256):  # few pairs of texts at once
                part = batch.slice(i, 256)
                for k, (x, y) in enumerate(zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True)):
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    if 100 * len(small) < percent * len(large) or not len(small):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    keep[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _shingle_slots(size: int):
    """How often shingles of each slot stand in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, dtype=np.int64)
        for batch in batches:
            for b in word_blocks(batch.column("text"), NON_SPACE):
                for k in range(len(b.at) - 1):
                    np.add.at(total, (shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size) % U(_SLOTS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    return run


def _prefixes(size: int, percent: int, often):
    """The rarest shingles of each set, as many as any alike set must share one of.

    Any fixed order of all shingles serves for that; rare ones first make sets that have
    but a common passage in common meet nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, sizes, mosts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in word_blocks(batch.column("text"), NON_SPACE):
                for k in range(len(b.at) - 1):
                    own = shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size)
                    n = len(own)
                    many = n + 1 - -(-percent * n // 100)
                    order = np.lexsort((own, often.value[(own % U(_SLOTS)).astype(np.int64)]))[:many]
                    keys.append(own[order])
                    rows.append(np.full(len(order), b.first + k))
                    sizes.append(np.full(len(order), n))
                    # the largest set that can be alike if this is the first shingle shared
                    mosts.append((n - np.arange(len(order))) * (100 + percent) // percent - n)
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc_id").take(at), batch.column("part").take(at), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(mosts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "part", "n", "most"])

    return run


def _may_be_in(ids: DataFrame, size: int):
    """A filter of size bits that lets through every id of ids and few others."""
    slot = F.pmod(F.xxhash64("id"), F.lit(size))
    maps = ids.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for bucket, own in zip(maps["bucket"], maps["bits"], strict=True):
        at = (bucket.as_py() - 1) * 4096
        own = np.frombuffer(own.as_py(), dtype=np.uint8)
        bits[at : at + len(own)] = own[: len(bits) - at]
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            keep = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            yield batch.drop_columns(["slot"]).filter(pa.array(keep.astype(bool)))

    return run


def texts_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows of source whose doc_id is among ids (id), written."""
    bits = min(_FILTER_BITS, max(1 << 15, _ID_BITS << ids.count().bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    likely = source.where("doc_id IS NOT NULL").withColumn("slot", slot).mapInArrow(_may_be_in(ids, bits), "doc_id long, text string")
    return materialize(likely.join(ids, likely.doc_id == ids.id, "left_semi"), "texts")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Sets are the distinct runs of size words ([^\\x20\\x09-\\x0D]+, A-Z lowered) of whole
    texts; a shorter text is one run; without words the set is empty and linked with
    nothing. Documents are linked where 100 * intersection >= percent * union, which is
    confirmed on full sets for every pair of different sets that shares a band (at the
    threshold a pair is missed with a chance of (1 - 0.75 ** rows) ** bands, 2e-5). The
    component is the smallest doc_id that can be reached; kept marks that document.
    Rows with one doc_id count as one linked document; a null doc_id has a component of
    its own kind and is kept as others are. An empty table gives an empty one.

    Equal sets are one node from the start; see connect() for the pairs within a band.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(source.mapInArrow(_sketcher(size, bands, rows), "doc_id long, n_shingles long, set_1 long, set_2 long, keys array<long>"), "sketches")
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = materialize(known.groupBy("set_1", "set_2", "n_shingles").agg(F.min("doc_id").alias("id")), "sets")
    links = _links(source, known, sets, size, percent)
    found = components(links)
    of_set = sets.join(found, "id", "left").select("set_1", "set_2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = sketched.drop("keys").join(of_set, ["set_1", "set_2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _links(source: DataFrame, known: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect what is connected."""
    again = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = known.join(again, "doc_id").join(sets, ["set_1", "set_2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    heads = known.join(sets.select(F.col("id").alias("doc_id"), "set_1", "set_2"), ["doc_id", "set_1", "set_2"], "left_semi")
    members = shared_keys(heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id")))
    wanted = materialize(members.select("id").distinct(), "ids")
    texts = texts_of(source, wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), "a long, b long"), "links")

    def settle(apart: DataFrame) -> DataFrame:
        """Links between the parts of ids by a positional prefix join; shingles are
        ordered by rarity."""
        ids = apart.groupBy("id").agg(F.min("part").alias("part"))
        own = texts.join(ids, texts.doc_id == ids.id).select("doc_id", "text", "part")
        counts = own.select("text").mapInArrow(_shingle_slots(size), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        often = np.zeros(_SLOTS, dtype=np.int64)
        often[counts["slot"].to_numpy()] = counts["n"].to_numpy()
        shared = own.sparkSession.sparkContext.broadcast(often)
        return verified(prefix_pairs(own.mapInArrow(_prefixes(size, percent, shared), "key long, id long, part long, n int, most int")))

    return connect(members, verified, settle).unionByName(same)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id stays
    (of rows that share it one), and so does every row without words or doc_id."""
    from pyspark.sql import Window

    kept = near_duplicates(docs, size, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    own = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.length("text"))
    first = named.withColumn("_row", F.row_number().over(own)).where("_row = 1").drop("_row")
    return first.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
