"""Documents linked by the Jaccard similarity of word shingles: an exact prefix join whose
prefixes hold combinations of frequent tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import components, connect, discard, materialize, prefix_pairs, shared_keys
from loomscape.llm.near_duplicates import _verifier, texts_of
from loomscape.llm.words import LANES, NON_SPACE, U, mix, shingle_set, word_blocks

#: Tokens in more documents than these bounds are indexed by two and by three at a time.
CLASSES = (32, 1024)
_GROUP = 16  # sizes up from this have a group of frequent tokens for each so many tokens


def _spare(n: int, percent: int) -> int:
    """How many of a set's n tokens an alike set may lack."""
    return n + (-percent * n // 100)


def _least(n: int) -> int:
    return max(1, -(-n // 10))


def _low_tokens(size: int, percent: int):
    """For each text the size and two sums of its set, and its tokens of least hash: an alike
    set has at least need of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in word_blocks(batch.column("text"), NON_SPACE):
                n = len(b.at) - 1
                counts, one, two, low = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), [np.zeros(0, np.uint64)]
                for k in range(n):
                    own = shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size)
                    counts[k] = len(own)
                    one[k], two[k] = set_sums(own)
                    low.append(own[: _spare(len(own), percent) + _least(len(own))])
                at = pa.array(np.cumsum([0, *map(len, low[1:])]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(low).view(np.int64)))
                need = pa.array([_least(x) for x in counts.tolist()], pa.int32())
                columns = [batch.column("doc_id").slice(b.first, n), pa.array(counts), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), need, lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_1", "set_2", "need", "low"])

    return run


def set_sums(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(own ^ LANES[40]).sum(dtype=np.uint64), mix(own ^ LANES[41]).sum(dtype=np.uint64)


def _all_tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in word_blocks(batch.column("text"), NON_SPACE):
                sets = [shingle_set(b.hashes[b.at[k] : b.at[k + 1]], size) for k in range(len(b.at) - 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                sums = pa.array(np.array([set_sums(s)[0] for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, len(sets)), sums, pa.array([len(s) for s in sets], pa.int32()), lists], names=["id", "set_1", "n", "tokens"])

    return run


def group_counts(n: int, percent: int) -> list[int]:
    """Numbers of groups into which frequent tokens are dealt for sets that may be alike to
    one of n: by powers of two of the larger set's size, so that both sets of a pair have
    the pair's number among theirs."""
    top = n * 100 // percent
    return sorted({(1 << level) // _GROUP for level in range(n.bit_length() - 1, top.bit_length())})


def signatures(n: int, often: np.ndarray, tokens: np.ndarray, percent: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of n tokens, and for each the largest set that can be alike if it is
    the first key that both have; often and tokens are those that other sets have too.

    Tokens stand in one order for all sets, rare ones first. Frequent ones are dealt by hash
    into groups, and i of a group make a key, as many as its class says; of each rare token
    alone is one made. An alike set lacks at most _spare(n) tokens. A group of which a set
    has c tokens has a key in common with an alike one unless that lacks c - i + 1 of them,
    so the prefix goes on until these numbers sum up to more than _spare(n): then one of
    them all is shared. Before the first shared key is complete, at most i - 1 tokens of
    each group are shared, which bounds the overlap.
    """
    order = np.lexsort((tokens, often))
    often, tokens = often[order], tokens[order]
    many = 1 + np.searchsorted(CLASSES, often, side="left") if groups else np.ones(len(often), np.int64)
    group = np.where(many > 1, mix(tokens ^ LANES[44]) % U(max(1, groups)) + U(1), U(0)).astype(np.int64) * 4 + many
    by = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1])) if len(by) else np.zeros(0, np.int64)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))
    full = (many == 1) | (rank >= many - 1)
    counted = n - len(tokens) + np.cumsum(full)
    end = int(np.searchsorted(counted, _spare(n, percent) + 1, side="left")) + 1
    before = counted - full
    most = (n - before) * (100 + percent) // percent - n
    # one token alone
    own = np.flatnonzero(full[:end] & (many[:end] == 1))
    keys, mosts = [mix(tokens[own] * LANES[45])], [most[own]]
    # by two and more: the token that completes a key, and those of its group before it
    inside: dict[int, list[int]] = {}
    rows: dict[int, list[tuple[int, ...]]] = {}
    for at in np.flatnonzero(many[:end] > 1).tolist():
        earlier, i = inside.setdefault(int(group[at]), []), int(many[at])
        rows.setdefault(i, []).extend((*x, at) for x in combinations(earlier, i - 1))
        earlier.append(at)
    for i, places in rows.items():
        if places:
            p = np.array(places)
            keys.append(mix((tokens[p] * LANES[46 : 46 + i]).sum(axis=1, dtype=np.uint64) + U(groups * 4 + i)))
            mosts.append(most[p[:, -1]])
    return np.concatenate(keys), np.concatenate(mosts)


def _signer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            held = batch.column("held")
            at, inner = held.offsets.to_numpy(), held.values
            often, tokens = inner.field("often").to_numpy(), inner.field("key").to_numpy().view(np.uint64)
            keys, mosts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, n in enumerate(sizes):
                for groups in group_counts(n, percent):
                    key, most = signatures(n, often[at[k] : at[k + 1]], tokens[at[k] : at[k + 1]], percent, groups)
                    keys.append(key)
                    mosts.append(most)
                    rows.append(np.full(len(key), k))
            row = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("id").take(row), batch.column("n").take(row), pa.array(np.concatenate(mosts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "most"])

    return run


def _live(heads: DataFrame) -> DataFrame:
    """Ids of sets of which as many low tokens stand in other sets as an alike one must have.
    Rows that are there twice count as two sets, which at worst keeps an id too many."""
    member = heads.select(F.explode("low").alias("key"), F.col("doc_id").alias("id"), "need")
    shared = materialize(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    live = member.join(shared, "key").groupBy("id").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("id")
    out = materialize(live, "live")
    discard(shared)
    return out


def _signed(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """key, id, n and most of the signatures of all texts."""
    tokens = texts.select(F.col("doc_id"), "text").mapInArrow(_all_tokens(size), "id long, set_1 long, n int, tokens array<long>")
    rows = tokens.select("id", "set_1", "n", F.explode("tokens").alias("key"))
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "counts")
    held = rows.join(counts, "key").groupBy("id", "set_1", "n").agg(F.collect_list(F.struct("often", "key")).alias("held"))
    held = held.where(F.size("held") >= F.ceil(F.col("n") * percent / 100))
    out = materialize(held.select("id", "n", "held").mapInArrow(_signer(percent), "key long, id long, n int, most int"), "signatures")
    discard(counts)
    return out


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text).

    Sets are the distinct runs of size words ([^\\x20\\x09-\\x0D]+, A-Z lowered) of whole texts;
    a shorter text is one run; without words the set is empty and linked with nothing. Two
    documents are linked where 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links reach. No link between different texts is missed, save by
    equal 64-bit hashes.

    Equal sets are one node. Sets that too few others share tokens with leave after a look
    at a quarter of their tokens; the tokens of the others are counted, and their
    signatures() tell who meets whom: first each with the one that meets most others under
    a key, then those that are still apart by size and position. Every pair is verified on
    full sets. Rows with one doc_id count as one linked document; a null doc_id is linked
    with nothing and has no component. Other columns of docs are not looked at; empty and
    null texts have size 0; a very long text is one set as others are; an empty table gives
    an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(source.mapInArrow(_low_tokens(size, percent), "doc_id long, n_shingles long, set_1 long, set_2 long, need int, low array<long>"), "low")
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["set_1", "set_2", "n_shingles"]
    sets = materialize(known.groupBy(*key).agg(F.min("doc_id").alias("id")), "sets")
    again = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = known.select("doc_id", *key).join(again, "doc_id").join(sets, key).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    heads = known.join(sets.select(F.col("id").alias("doc_id"), *key), ["doc_id", *key], "left_semi")
    live = _live(heads)
    texts = texts_of(source, live)
    signed = _signed(texts, size, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), "a long, b long"), "links")

    def settle(apart: DataFrame) -> DataFrame:
        return verified(prefix_pairs(signed.join(apart, ["key", "id"]).select("key", "id", "part", "n", "most")))

    found = components(connect(shared_keys(signed.select("key", "id").distinct()), verified, settle).unionByName(same))
    of_set = sets.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    out = materialize(sketched.drop("low", "need").join(of_set, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    discard(sketched, sets, live, texts, signed)
    return out
