"""URL rules by a cascade of Bloom filters that is exact on the corpus's own keys."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscape.llm.common import discard, materialize
from loomscape.llm.words import U, mix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); a rule holds for its host and all subdomains where the path starts with its path
Rule = tuple[str, str, str]


class Cascade:
    """Levels of Bloom filters: even ones encode listed keys, odd ones other keys of the
    universe that all levels before let through. A key of the universe is listed if the
    first level that lets it fail is odd, or if all let it through and their number is odd."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]], clashes: frozenset[str] = frozenset()):
        self.levels = levels  # (bits, hashes, bytes)
        self.clashes = clashes  # other keys of the universe whose hash a listed key has

    @staticmethod
    def places(keys: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
        a = mix(keys ^ mix(np.uint64([2 * level + 1])))
        b = mix(a) | U(1)
        return ((a[None, :] + np.arange(hashes, dtype=np.uint64)[:, None] * b[None, :]) % U(bits)).astype(np.int64)

    def passes(self, level: int, keys: np.ndarray) -> np.ndarray:
        bits, hashes, data = self.levels[level]
        at = self.places(keys, level, bits, hashes)
        return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(left):
                break
            ok = self.passes(level, keys[left])
            out[left[~ok]] = level % 2 == 1
            left = left[ok]
        out[left] = len(self.levels) % 2 == 1
        return out


def _add_level(levels: list, keys: DataFrame, count: int, rate: float) -> None:
    """A level that encodes keys (h long); its bits are set by all executors and come
    back as whole bytes, bounded by the level's size."""
    bits = max(64, math.ceil(1.4427 * count * math.log2(1 / rate)))
    hashes = max(1, round(math.log2(1 / rate)))
    level = len(levels)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Cascade.places(h, level, bits, hashes)) + 1)], names=["slot"])

    found = keys.mapInArrow(slots, "slot long")
    maps = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    data = np.zeros((bits >> 3) + 1, dtype=np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * 4096
        own = np.frombuffer(r["bits"], dtype=np.uint8)
        data[at : at + len(own)] = own[: max(0, len(data) - at)]
    levels.append((bits, hashes, data))


def _through(spark: SparkSession, levels: list, keys: DataFrame) -> DataFrame:
    shared = spark.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(shared.value)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(cascade.passes(len(cascade.levels) - 1, h)))

    return materialize(keys.mapInArrow(run, keys.schema), "passed")


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade for listed keys over universe (each: key string, h long of that key).

    The first level's rate is about the ratio of listed to other keys, those after it
    halve; so that all levels together take some bits for each listed key. Only the
    first level reads the universe. No level can tell keys of one hash apart: those that
    aren't listed are kept by name (with 64 bits, none is to be expected).
    """
    spark = universe.sparkSession
    n, total = listed.count(), universe.count()
    levels: list[tuple[int, int, np.ndarray]] = []
    if not n:
        return Cascade(levels)
    _add_level(levels, listed.select("h"), n, min(0.5, max(1e-6, math.sqrt(0.5) * n / max(total, 1))))
    own, other = listed.select("key", "h"), materialize(_through(spark, levels, universe).join(listed.select("key"), "key", "left_anti"), "false")
    clashes = frozenset(r["key"] for r in other.join(listed.select("h"), "h", "left_semi").collect())
    if clashes:
        other = other.where(~F.col("key").isin(*clashes))
    while True:
        count = other.count()
        if not count:
            return Cascade(levels, clashes)
        _add_level(levels, other.select("h"), count, 0.5)
        passed = _through(spark, levels, own)  # of the other kind, let through wrongly
        own, other = other, passed


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where :// is missing."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _candidates(host: Column, path: Column, lengths: Sequence[int], labels: int) -> Column:
    """Keys that could be listed: host endings at dots, of as many labels as a listed host
    has at most, with the path's beginnings of the rules' lengths; then host endings alone."""
    ends = F.array_distinct(F.array(*(F.substring_index(host, ".", -i) for i in range(labels, 0, -1))))
    starts = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True))))
    rules = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda p: F.concat(F.lit("r"), e, p))))
    hosts = F.transform(ends, lambda e: F.concat(F.lit("h"), e))
    return F.when(host != "", F.concat(rules, hosts)).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], blocked_hosts: Sequence[str] = (), url: str = "url") -> DataFrame:
    """Adds host, path, rule (the longest rule that fits, as host and path, or null) and
    verdict to every row of pages.

    The verdict is the rule's; else block for blocked_hosts and their subdomains; else
    allow. Null urls, such without :// and empty hosts fit nothing. Rules of one host
    and path have the last one's verdict; of two that are as long, the longer host wins.
    Columns of those names are replaced; an empty table gives an empty one.

    The keys that urls offer are the universe; one cascade tells listed keys from all
    others of it, a second one, whose universe are the listed keys, blocked from
    allowed. Rows are then judged by filters alone, without a join.
    """
    spark = pages.sparkSession
    verdicts = {f"r{h}{p}": v for h, p, v in rules} | {f"h{h}": "block" for h in blocked_hosts}
    host, path = url_parts(F.col(url))
    rest = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keyed = rest.withColumn("_keys", _candidates(F.col("host"), F.col("path"), sorted({len(p) for _, p, _ in rules}) or [0], max(h.count(".") + 1 for h in (*(r[0] for r in rules), *blocked_hosts, ""))))
    if verdicts:
        listed = materialize(spark.createDataFrame(list(verdicts.items()), "key string, verdict string").withColumn("h", F.xxhash64("key")), "listed")
        universe = materialize(keyed.select(F.explode("_keys").alias("key")).distinct().withColumn("h", F.xxhash64("key")), "keys")
        member = build_cascade(universe, listed)
        blocked = build_cascade(listed.select("key", "h"), listed.where("verdict = 'block'"))
        discard(universe)
    else:
        member = blocked = Cascade([])
    shared = spark.sparkContext.broadcast((member, blocked))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, blocked = shared.value
        for batch in batches:
            lists, hashes = batch.column("_keys"), batch.column("_h")
            keys = lists.flatten()
            h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found = np.flatnonzero(member.listed(h))
            row = np.searchsorted(at, found, side="right") - 1
            names = keys.take(pa.array(found)).to_pylist()
            block = blocked.listed(h[found]).tolist()
            rule: list[str | None] = [None] * batch.num_rows
            verdict = ["allow"] * batch.num_rows
            best: dict[int, tuple[int, int]] = {}
            for r, name, no in zip(row.tolist(), names, block, strict=True):
                if name in member.clashes:
                    continue
                no = no and name not in blocked.clashes
                rank = (len(name), len(name.split("/", 1)[0])) if name[0] == "r" else (0, 0)
                if r not in best or rank > best[r]:
                    best[r] = rank
                    rule[r] = name[1:] if name[0] == "r" else None
                    verdict[r] = "block" if no else "allow"
            out = batch.drop_columns(["_keys", "_h"])
            yield out.append_column("rule", pa.array(rule, pa.string())).append_column("verdict", pa.array(verdict, pa.string()))

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rest.dtypes), "rule string, verdict string"])
    return keyed.withColumn("_h", F.transform("_keys", lambda k: F.xxhash64(k))).mapInArrow(judge, schema)
