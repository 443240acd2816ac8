"""Benchmark decontamination by a prefix-filtered join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import materialize
from loomscape.llm.tokens import _Table
from loomscape.llm.words import ALNUM, windows, word_blocks

SHINGLE = 3
MAX_WINDOWS = 400_000  # windows that are broadcast at once, some 100 MB


@dataclass
class WindowIndex:
    """Item windows by their rarest shingle, for one block of windows."""

    words: np.ndarray  # (windows, size) word hashes, zeros behind the end
    sizes: np.ndarray
    items_at: np.ndarray  # window w belongs to items items[items_at[w]:items_at[w + 1]]
    items: np.ndarray  # of strings
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by shingle size: tokens, at, window, offset


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of size consecutive words (an item of fewer, but not none, is
    one window) as (words array<long>, items array<string>)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_id").to_pylist()
            out_items, out_words = [], []
            for b in word_blocks(batch.column("text"), ALNUM):
                for k in range(len(b.at) - 1):
                    h = b.hashes[b.at[k] : b.at[k + 1]].view(np.int64)
                    for s in range(max(1, len(h) - size + 1)) if len(h) else ():
                        out_items.append(names[b.first + k])
                        out_words.append(h[s : s + size])
            yield pa.RecordBatch.from_arrays([pa.array(out_items, pa.string()), pa.array(out_words, pa.list_(pa.int64()))], names=["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item string, words array<long>")
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _shingle_list(words: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle size: token, window and offset of every shingle of every window."""
    out: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for m in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == m)
        g = min(SHINGLE, m)
        for offset in range(m - g + 1):
            tokens = np.concatenate([windows(words[w, offset : offset + g], g) for w in own])
            out.setdefault(g, []).append((tokens, own, np.full(len(own), offset)))
    return {g: tuple(np.concatenate(x) for x in zip(*rows, strict=True)) for g, rows in out.items()}


def shingle_counts(docs: DataFrame, tokens: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each of the given shingles stands in all documents; at most one row
    for each given shingle comes back."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, totals = {}, {}
        for g, keys in wanted.value.items():
            tables[g] = _Table(max(8, int(len(keys) * 2).bit_length() + 1))
            tables[g].add(keys, 0)
            totals[g] = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for b in word_blocks(batch.column("text"), ALNUM):
                for g, t in tables.items():
                    rows = t.find(windows(b.hashes, g))
                    totals[g] += np.bincount(rows[rows >= 0], minlength=len(totals[g]))
        for g, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(wanted.value[g][some].view(np.int64)), pa.array(n[some])], names=["g", "token", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "g int, token long, n long").groupBy("g", "token").agg(F.sum("n").alias("n")).collect()
    return {(r["g"], r["token"]): r["n"] for r in rows}


def build_index(rows: list, docs: DataFrame) -> WindowIndex:
    """The index of one block of windows: each stands under its rarest shingle.

    A window occurs where all its shingles do, so that at containment 1 a prefix of one
    shingle, the rarest over all documents, is necessary.
    """
    sizes = np.array([len(r["words"]) for r in rows], dtype=np.int64)
    words = np.zeros((len(rows), int(sizes.max())), dtype=np.uint64)
    for k, r in enumerate(rows):
        words[k, : sizes[k]] = np.array(r["words"], dtype=np.int64).view(np.uint64)
    items = [i for r in rows for i in r["items"]]
    items_at = np.cumsum([0, *(len(r["items"]) for r in rows)])
    shingles = _shingle_list(words, sizes)
    counts = shingle_counts(docs, {g: np.unique(t) for g, (t, _, _) in shingles.items()})
    prefix = {}
    for g, (token, window, offset) in shingles.items():
        n = np.array([counts.get((g, t), 0) for t in token.view(np.int64).tolist()], dtype=np.int64)
        order = np.lexsort((offset, token, n, window))
        first = order[np.unique(window[order], return_index=True)[1]]
        token, window, offset = token[first], window[first], offset[first]
        order = np.argsort(token, kind="stable")
        tokens, at = np.unique(token[order], return_index=True)
        prefix[g] = (tokens, np.append(at, len(order)), window[order], offset[order])
    return WindowIndex(words, sizes, items_at, np.array(items, dtype=object), prefix)


def _matches(index: WindowIndex, tables: dict[int, _Table], hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all occurrences in the texts whose words begin at at."""
    starts, found = [], []
    for g, (_, row_at, window, offset) in index.prefix.items():
        rows = tables[g].find(windows(hashes, g))
        place = np.flatnonzero(rows >= 0)
        rows = rows[place]
        n = row_at[rows + 1] - row_at[rows]
        each = np.repeat(row_at[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        w, place = window[each], np.repeat(place, n)
        s = place - offset[each]
        # positions: the whole window lies in the text of its shingle
        text = np.searchsorted(at, place, side="right") - 1
        ok = (s >= at[text]) & (s + index.sizes[w] <= at[text + 1])
        s, w = s[ok], w[ok]
        for k in range(index.words.shape[1]):
            if not len(s):
                break
            ok = (k >= index.sizes[w]) | (hashes[np.minimum(s + k, len(hashes) - 1)] == index.words[w, k])
            s, w = s[ok], w[ok]
        starts.append(s)
        found.append(w)
    return np.concatenate(starts), np.concatenate(found)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Adds to docs (text and any other columns) n_words, hits (array of begin, end, ...:
    word ranges, disjoint and ascending) and items (ids whose windows occur, as sorted strings).

    Words are lower-case runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; a window is size
    consecutive words of an item. Null, empty and wordless texts have no words and
    match nothing; items with a null id mark words but name no item; repeated items and
    windows count once; an empty benchmark marks nothing. Windows are handled in blocks
    of max_windows, so that what is broadcast is bounded whatever the benchmark holds.
    Columns named n_words, hits or items are replaced.
    """
    spark = docs.sparkSession
    rest = docs.drop("n_words", "hits", "items")
    rest = rest.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    found = materialize(item_windows(benchmark, size), "windows")
    total = found.count()
    blocks = max(1, -(-total // max_windows))
    for k in range(blocks):
        rows = (found if blocks == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)).collect()
        index = spark.sparkContext.broadcast(build_index(rows, docs) if rows else None)
        if k:
            rest = materialize(rest, "hits")
        rest = rest.mapInArrow(_marker(index), rest.schema)
    return rest


def _marker(shared):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        tables: dict[int, _Table] = {}
        if index:
            for g, (tokens, *_) in index.prefix.items():
                tables[g] = _Table(max(8, int(len(tokens) * 2).bit_length() + 1))
                tables[g].add(tokens, 0)
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, dtype=np.int64)
            hits: list = [None] * n
            items: list = [None] * n
            old_hits, old_items = batch.column("hits"), batch.column("items")
            for b in word_blocks(batch.column("text").cast(pa.string()), ALNUM):
                k = len(b.at) - 1
                n_words[b.first : b.first + k] = np.diff(b.at)
                if not index or not len(b.hashes):
                    continue
                s, w = _matches(index, tables, b.hashes, b.at)
                if not len(s):
                    continue
                text = np.searchsorted(b.at, s, side="right") - 1
                ends = s + index.sizes[w]
                order = np.lexsort((ends, s, text))
                for t in np.unique(text).tolist():
                    own = order[np.searchsorted(text[order], t) : np.searchsorted(text[order], t, side="right")]
                    row = b.first + t
                    ranges = np.stack([s[own], ends[own]], axis=1) - b.at[t]
                    if len(old_hits[row]):
                        ranges = np.concatenate([ranges, np.array(old_hits[row].as_py()).reshape(-1, 2)])
                        ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
                    hits[row] = _joined(ranges)
                    names = {i for v in np.unique(w[own]).tolist() for i in index.items[index.items_at[v] : index.items_at[v + 1]]}
                    items[row] = sorted(names.union(old_items[row].as_py()))
            for row in range(n):
                if hits[row] is None:
                    hits[row], items[row] = (old_hits[row].as_py(), old_items[row].as_py()) if len(old_hits[row]) else ([], [])
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            out |= {"n_words": pa.array(n_words), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return mark


def _joined(ranges: np.ndarray) -> list[int]:
    """Overlapping and touching ranges (sorted by begin) as one."""
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), dtype=bool)
    new[1:] = ranges[1:, 0] > reach[:-1]
    begin = ranges[new, 0]
    last = np.append(np.flatnonzero(new)[1:], len(ranges)) - 1
    return np.stack([begin, reach[last]], axis=1).reshape(-1).tolist()


def digests(found: DataFrame) -> DataFrame:
    """One row for each document of contamination(): counts and a digest of its items."""
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the documents in which a window of the benchmark occurs."""
    found = contamination(docs, benchmark, size)
    return found.where(F.size("hits") == 0).select(*docs.columns)
