"""Ranked lexical search: compressed postings in shards, merged document by document."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscape.llm.common import discard, materialize, small
from loomscape.llm.words import ALNUM, U, word_blocks

SHARD = 1 << 20  # words of a shard; a longer text is a shard of its own
MAX_TERMS = 1_000_000  # terms of items that are broadcast at once, some 50 MB
_INDEX = "doc_ids array<long>, lengths array<int>, terms array<long>, counts array<int>, ends array<long>, postings binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in bytes of seven bits each, the last of each with its high bit clear,
    and where each number's bytes end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= U(1) << U(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        more = (size[own] > k + 1).astype(np.uint8) << 7
        out[ends[own] - size[own] + k] = (values[own] >> U(7 * k) & U(127)).astype(np.uint8) | more
    return out, ends


def decode(data: np.ndarray) -> np.ndarray:
    """The numbers of encode()."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) if len(ends) else 0):
        own = ends - starts > k
        out[own] |= (data[starts[own] + k] & 127).astype(np.uint64) << U(7 * k)
    return out.astype(np.int64)


def _shard(doc_ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms, term = np.unique(hashes.view(np.int64), return_inverse=True)
    both, often = np.unique(term * len(order) + np.repeat(place, lengths), return_counts=True)
    term, doc = both // len(order), both % len(order)
    first = np.append(True, term[1:] != term[:-1])
    gap = np.where(first, doc, np.diff(doc, prepend=0))
    data, ends = encode(np.stack([gap, often], axis=1).ravel())
    last = np.append(np.flatnonzero(first)[1:], len(term)) * 2 - 1
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    columns = [one(doc_ids[order], pa.int64()), one(lengths[order].astype(np.int32), pa.int32()), one(terms, pa.int64()), one(np.diff(np.append(np.flatnonzero(first), len(term))).astype(np.int32), pa.int32()), one(ends[last], pa.int64()), pa.array([data.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _INDEX.split(", ")])


def build_index(docs: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """Shards of docs (doc_id, text): the documents with a term in ascending doc_id, their
    lengths, the terms (64-bit hashes) in ascending order, in how many documents each
    stands, and per term its postings, gaps of places and counts in encode()d bytes that
    end at ends.

    Terms are the words [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of whole texts, A-Z
    lowered. Each task cuts its rows into shards of about shard_words words; nothing is
    shuffled. Texts that are null or have no term, and rows without doc_id, are left out;
    rows with one doc_id are documents of their own; an empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        words: list[np.ndarray] = []
        held = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            for b in word_blocks(batch.column("text"), ALNUM):
                n = np.diff(b.at)
                own = n > 0
                ids.append(doc_ids[b.first : b.first + len(n)][own])
                sizes.append(n[own])
                words.append(b.hashes)
                held += len(b.hashes)
                if held >= shard_words:
                    yield _shard(np.concatenate(ids), np.concatenate(sizes), np.concatenate(words))
                    ids, sizes, words, held = [], [], [], 0
        if held:
            yield _shard(np.concatenate(ids), np.concatenate(sizes), np.concatenate(words))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(run, _INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, and terms, array of (term, often), of items (item_id, text); rows of one
    item_id are one item of all their different texts; items without terms have no row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in word_blocks(batch.column("text"), ALNUM):
                row = pa.array(np.repeat(np.arange(len(b.at) - 1), np.diff(b.at)) + b.first)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(row), pa.array(b.hashes.view(np.int64))], names=["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"item_id {kind}, term long").groupBy("item_id", "term").agg(F.count("*").alias("often"))
    return found.groupBy("item_id").agg(F.collect_list(F.struct("term", "often")).alias("terms")).withColumn("item", F.monotonically_increasing_id())


@dataclass
class Query:
    """A block of items: their terms with weights, and the corpus's counts."""

    terms: np.ndarray  # ascending
    weights: np.ndarray
    items: list[tuple[int, list[tuple[int, int]]]]  # item, and (place in terms, how often)
    n_docs: int
    n_terms: int


def _counter(shared):
    """In how many documents of each shard the terms of shared stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms, counts = batch.column("terms")[k].values.to_numpy(), batch.column("counts")[k].values.to_numpy()
                at = np.minimum(np.searchsorted(terms, shared.value), len(terms) - 1)
                total += np.where(terms[at] == shared.value, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[some]), pa.array(total[some])], names=["term", "df"])

    return run


@dataclass
class Cursor:
    """One term's documents in a shard, ascending, what each adds to a score, and the most
    that any adds."""

    docs: list[int]
    adds: list[int]
    most: int
    at: int = 0


def merge(lists: list[Cursor], doc_ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Puts a shard's documents into best, a heap of at most k (score, -doc_id).

    A heap of cursors gives the next document; all cursors on it are moved on and their
    parts added up. Lists whose most together lie under the least score of a full heap
    (first of them) can't bring a document in by themselves: they leave the heap, and are
    looked at for documents that others bring, as long as these can still get in.
    """
    lists.sort(key=lambda c: c.most)
    reach = list(accumulate(c.most for c in lists))
    bar = best[0][0] if len(best) == k else 1
    first = bisect_left(reach, bar)
    heads = [(c.docs[0], i) for i, c in enumerate(lists) if i >= first]
    heapq.heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            c = lists[i]
            score += c.adds[c.at]
            c.at += 1
            if c.at < len(c.docs):
                heapq.heapreplace(heads, (c.docs[c.at], i))
            else:
                heapq.heappop(heads)
        i = first
        while i and score + reach[i - 1] >= bar:
            i -= 1
            c = lists[i]
            c.at = bisect_left(c.docs, doc, c.at)
            if c.at < len(c.docs) and c.docs[c.at] == doc:
                score += c.adds[c.at]
        if i or score < bar:
            continue
        entry = (score, -doc_ids[doc])
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] > bar:
            bar = best[0][0]
            if (now := bisect_left(reach, bar)) > first:
                first = now
                heads = [x for x in heads if x[1] >= first]
                heapq.heapify(heads)


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in q.items]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(name)[r].values.to_numpy()  # noqa: B023, E731
                terms, ends = get("terms"), get("ends")
                data = np.frombuffer(batch.column("postings")[r].as_buffer(), np.uint8)
                m = 8 * (25 + 75 * get("lengths").astype(np.int64) * q.n_docs // q.n_terms)
                doc_ids = get("doc_ids").tolist()
                at = np.minimum(np.searchsorted(terms, q.terms), len(terms) - 1)
                found: dict[int, tuple[list[int], np.ndarray]] = {}
                for t in np.flatnonzero((terms[at] == q.terms) & (q.weights > 0)).tolist():
                    pairs = decode(data[ends[at[t] - 1] if at[t] else 0 : ends[at[t]]]).reshape(-1, 2)
                    docs, often = np.cumsum(pairs[:, 0]), pairs[:, 1]
                    found[t] = docs.tolist(), q.weights[t] * (1_000_000_000 * often // (1000 * often + m[docs]))
                scaled: dict[tuple[int, int], tuple[list[int], int]] = {}
                for heap, (_, own) in zip(best, q.items, strict=True):
                    lists = []
                    for t, n in own:
                        if t in found:
                            if (t, n) not in scaled:
                                adds = found[t][1] * n
                                scaled[t, n] = adds.tolist(), int(adds.max())
                            lists.append(Cursor(found[t][0], *scaled[t, n]))
                    merge(lists, doc_ids, heap, k)
        rows = [(item, -doc, score) for heap, (item, _) in zip(best, q.items, strict=True) for score, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of an index of build_index()
    for each of items (item_id, text): those with a score above 0, equal scores by doc_id.

    With N documents and L terms in all, a term of df documents weighs
    floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms, tf of them this one,
    gets weight * (10**9 tf div (1000 tf + 8 (25 + 75 n N div L))) for each time that the
    item has it.

    Items are handled in blocks of about max_terms different terms, so that what is
    broadcast is bounded. Every task merges its shards' postings document by document and
    keeps k for each item, of which the best are then ranked by item; tasks keep only
    their k best, so no item's documents are gathered. Items without terms, or of none
    that occurs, have no row, as is so for an empty index.
    """
    spark = index.sparkSession
    found = materialize(item_terms(items), "items")
    totals = index.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("words")).agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    size = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // max_terms))
    out = None
    for b in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect() if totals["n"] else []
        terms = np.unique(np.array([t["term"] for r in rows for t in r["terms"]], np.int64))
        df = np.zeros(len(terms), np.int64)
        wanted = spark.sparkContext.broadcast(terms)
        for r in index.select("terms", "counts").mapInArrow(_counter(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect() if len(terms) else ():
            df[np.searchsorted(terms, r["term"])] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        place = {t: i for i, t in enumerate(terms.tolist())}
        asked = [(r["item"], [(place[t["term"]], t["often"]) for t in r["terms"]]) for r in rows]
        shared = spark.sparkContext.broadcast(Query(terms, weights, asked, totals["n"] or 0, totals["words"] or 1))
        own = index.mapInArrow(_searcher(shared, k), "item long, doc_id long, score long")
        out = own if out is None else out.unionByName(own)
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(small(found.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of docs, which is written to the shared folder for it."""
    index = materialize(build_index(docs), "index")
    out = materialize(search(index, items, k), "found")
    discard(index)
    return out
