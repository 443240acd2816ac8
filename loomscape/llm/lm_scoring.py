"""Documents scored by the masked pseudo-likelihood of a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import materialize
from loomscape.llm.words import NON_SPACE, U, mix, word_blocks

WORDS, BUCKETS = 960, 64  # classes: the most frequent words at least, and hashed buckets of all others
GROWTH = 2.0  # words that stand this often the root of all words' number have classes of their own too
REACH = 2  # words seen on either side
WIDTH = 24
BATCH = 8192
ROUNDS = 2
RATE = 0.15
_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
_NEVER = np.float32(-60.0)  # the bias of numbers that fill the last group up


def _ordered(numbers: np.ndarray) -> np.ndarray:
    """A stable order of small numbers; of 16 bits they are sorted by radix."""
    return np.argsort(numbers.astype(np.int16) if numbers.max(initial=0) < 1 << 15 else numbers, kind="stable")


def _exponents(logits: np.ndarray) -> np.ndarray:
    """In place. Logits are sums of few bounded terms; the bound is far from any of them."""
    return np.exp(np.minimum(logits, np.float32(80), out=logits), out=logits)


@dataclass
class Network:
    """tanh of a sum of one vector for each neighbour, then a softmax over classes in two
    levels: over groups of classes, and over the classes of the group. Class k is number
    k % size of group k // size."""

    vocabulary: np.ndarray  # sorted word hashes of the frequent words
    classes: int  # the vocabulary's, and buckets
    seen: np.ndarray  # (neighbours, classes + 1, width); the last class stands for beyond the text
    shift: np.ndarray  # (width)
    top: np.ndarray  # (width, groups)
    top_bias: np.ndarray  # (groups)
    low: np.ndarray  # (groups, width, size)
    low_bias: np.ndarray  # (groups, size)

    @property
    def size(self) -> int:
        return self.low_bias.shape[1]

    def parameters(self) -> list[np.ndarray]:
        return [self.seen, self.shift, self.top, self.top_bias, self.low, self.low_bias]

    def copy(self) -> Network:
        return Network(self.vocabulary, self.classes, *(p.copy() for p in self.parameters()))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def word_classes(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.vocabulary)
        out = (n + (mix(hashes) % U(self.classes - n)).astype(np.int64)).astype(np.int64)
        if n:
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), n - 1)
            known = self.vocabulary[at] == hashes
            out[known] = at[known]
        return out

    def hidden(self, neighbours: np.ndarray) -> np.ndarray:
        total = self.seen[0].take(neighbours[0], axis=0)
        total += self.shift
        for k in range(1, len(_OFFSETS)):
            total += self.seen[k].take(neighbours[k], axis=0)
        return np.tanh(total, out=total)

    def grouped(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of targets by group, and (group, first, end) of each that is met."""
        own = target // self.size
        order = _ordered(own)
        at = np.searchsorted(own[order], np.arange(len(self.top_bias) + 1))
        return order, [(g, a, z) for g, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if z > a]

    def lower(self, hidden: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits within their groups of targets that stand by group."""
        out = np.empty((len(hidden), self.size), dtype=hidden.dtype)
        for g, a, z in runs:
            np.matmul(hidden[a:z], self.low[g], out=out[a:z])
            out[a:z] += self.low_bias[g]
        return out

    def log_probabilities(self, neighbours: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for i in range(0, len(target), BATCH):
            own = target[i : i + BATCH]
            order, runs = self.grouped(own)
            own, every = own[order], np.arange(len(own))
            hidden = self.hidden(neighbours[:, i : i + BATCH].take(order, axis=1))
            total = np.zeros(len(own))
            for logits, k in ((hidden @ self.top + self.top_bias, own // self.size), (self.lower(hidden, runs), own % self.size)):
                chosen = logits[every, k]
                total += chosen - np.log(_exponents(logits) @ np.ones(logits.shape[1], np.float32))
            out[i + order] = total
        return out


@dataclass
class Model:
    """A network of classes, and each word's part of its class."""

    network: Network
    shares: DataFrame  # word, share: the log of its part of its bucket's words; none of the vocabulary
    every: int  # words that it was trained on


def new_network(vocabulary: np.ndarray, counts: np.ndarray, width: int = WIDTH, seed: int = 1) -> Network:
    """Untrained; its biases are the classes' own frequencies."""
    rng = np.random.default_rng(seed)
    classes = len(counts)
    size = max(1, int(np.ceil(np.sqrt(classes))))
    groups = -(-classes // size)
    seen = rng.normal(0, 0.1, (len(_OFFSETS), classes + 1, width)).astype(np.float32)
    top = rng.normal(0, 0.1, (width, groups)).astype(np.float32)
    low = rng.normal(0, 0.1, (groups, width, size)).astype(np.float32)
    often = np.zeros(groups * size)
    often[:classes] = counts + 1.0
    often = often.reshape(groups, size)
    of_group = often.sum(axis=1, keepdims=True)
    low_bias = np.where(often > 0, np.log(np.maximum(often, 1e-9) / of_group), _NEVER).astype(np.float32)
    top_bias = np.log(of_group[:, 0] / of_group.sum()).astype(np.float32)
    return Network(vocabulary, classes, seen, np.zeros(width, np.float32), top, top_bias, low, low_bias)


def contexts(classes: np.ndarray, at: np.ndarray, beyond: int) -> np.ndarray:
    """The classes of the neighbours of every word of texts that begin at at."""
    texts = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(classes)) + REACH * (texts + 1)
    line = np.full(len(classes) + REACH * len(at), beyond, dtype=np.int64)
    line[place] = classes
    return np.stack([line[place + o] for o in _OFFSETS])


def train(net: Network, blocks: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
    """One pass of minibatch gradient steps with per-parameter rates over blocks of
    (neighbours, targets); the number of words seen."""
    sums = [np.full(p.shape, 1e-3, dtype=np.float32) for p in net.parameters()]
    words = 0

    def wrongs(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
        every = np.float32(len(right))
        _exponents(logits)
        logits *= (1 / (every * (logits @ np.ones(logits.shape[1], np.float32))))[:, None]
        logits[np.arange(len(right)), right] -= 1 / every
        return logits

    ones = np.ones(BATCH, np.float32)

    def down(values: np.ndarray) -> np.ndarray:
        return ones[: len(values)] @ values

    for neighbours, target in blocks:
        for i in range(0, len(target), BATCH):
            near, own = neighbours[:, i : i + BATCH], target[i : i + BATCH]
            order, runs = net.grouped(own)
            near, own = near.take(order, axis=1), own[order]
            hidden = net.hidden(near)
            above = wrongs(hidden @ net.top + net.top_bias, own // net.size)
            below = wrongs(net.lower(hidden, runs), own % net.size)
            back = above @ net.top.T
            low, low_bias = np.zeros_like(net.low), np.zeros_like(net.low_bias)
            for g, a, z in runs:
                back[a:z] += below[a:z] @ net.low[g].T
                np.matmul(hidden[a:z].T, below[a:z], out=low[g])
                low_bias[g] = down(below[a:z])
            slopes = [None, None, hidden.T @ above, down(above), low, low_bias]
            hidden *= hidden
            back *= 1 - hidden
            slopes[1] = down(back)
            for k in range(len(_OFFSETS)):  # of the vectors of classes that were seen
                place = _ordered(near[k])
                which = near[k][place]
                first = np.flatnonzero(np.diff(which, prepend=-1))
                which, g = which[first], np.add.reduceat(back.take(place, axis=0), first, axis=0)
                s = sums[0][k].take(which, axis=0)
                s += g * g
                sums[0][k][which] = s
                g *= rate
                g /= np.sqrt(s, out=s)
                net.seen[k][which] -= g
            for p, s, g in list(zip(net.parameters(), sums, slopes, strict=True))[1:]:
                s += g * g
                p -= rate * g / np.sqrt(s)
            words += len(own)
    return words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in word_blocks(batch.column("text"), NON_SPACE):
            word, n = np.unique(b.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words = None, 0
    for batch in batches:
        for n, own in zip(batch.column("words").to_pylist(), batch.column("sums"), strict=True):
            own = own.values.to_numpy()
            total, words = own.copy() if total is None else total + own, words + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([total], pa.list_(pa.float64()))], names=["words", "sums"])


def fit(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, rounds: int = ROUNDS) -> Model:
    """A model trained on every word of docs (text).

    Words are counted over all documents. The most frequent ones are classes of their
    own: words of them, or all that stand GROWTH * sqrt(number of all words) times or more
    where those are more, so that they grow with the corpus. The others share buckets,
    each with its part of the bucket's count. In each round every
    partition trains from the shared parameters on all its words; the results are
    averaged by words in a tree of sums, so that the driver gets a bounded number of
    parameter vectors at any size.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = materialize(text.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    every = counts.agg(F.sum("n")).first()[0] or 0
    words = max(words, counts.where(F.col("n") >= GROWTH * every**0.5).count() if every else 0)
    top = counts.orderBy(F.desc("n"), "word").limit(words).collect()
    vocabulary = np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))
    net = new_network(vocabulary, np.zeros(words + buckets))
    often = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in top}
    rare = _classed(counts, net).where(F.col("class") >= len(vocabulary))
    held = rare.groupBy("class").agg(F.sum("n").alias("held"))
    share = np.zeros(words + buckets)
    share[: len(vocabulary)] = [often[int(w)] for w in vocabulary]
    for r in held.collect():
        share[r["class"]] = r["held"]
    shares = rare.join(F.broadcast(held), "class").select("word", F.log(F.col("n") / F.col("held")).alias("share"))
    net = new_network(vocabulary, share)
    for _ in range(rounds if every else 0):
        shared = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for b in word_blocks(batch.column("text"), NON_SPACE):
                        c = own.word_classes(b.hashes)
                        yield contexts(c, b.at, own.classes), c

            n = train(own, blocks())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.flat().astype(np.float64) * n], pa.list_(pa.float64()))], names=["words", "sums"])

        schema = "words long, sums array<double>"
        sums = text.mapInArrow(learn, schema)
        parts = text.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // 8)
            sums = sums.repartition(parts).mapInArrow(_added, schema)
        rows = sums.collect()
        net = new_network(vocabulary, share)
        net.load(sum(np.array(r["sums"]) for r in rows) / sum(r["words"] for r in rows))
    return Model(net, shares, every)


def _classed(counts: DataFrame, net: Network) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("class", pa.array(net.word_classes(batch.column("word").to_numpy().view(np.uint64))))

    return counts.mapInArrow(run, "word long, n long, class long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum of the words' conditional log-probabilities,
    each given the words on both sides) and mean_log_likelihood (null without words).

    A word's probability is that of its class times its part of the class. A batch of texts
    gives each of its words outside the vocabulary once, with the texts that hold it; those
    meet the words' shares in a join, and shares are added up by text before they are
    shuffled. A word that the model has not seen counts as one among all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.network)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_row")[0].as_py()
            names = batch.column("doc_id")
            words, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for b in word_blocks(batch.column("text"), NON_SPACE):
                c = net.word_classes(b.hashes)
                total = np.zeros(len(c) + 1)
                if len(c):
                    np.cumsum(net.log_probabilities(contexts(c, b.at, net.classes), c), out=total[1:])
                n, sums = np.diff(b.at), total[b.at[1:]] - total[b.at[:-1]]
                pos = np.arange(b.first, b.first + len(n), dtype=np.int32)
                yield rows(block, pos=pa.array(pos), doc_id=names.slice(b.first, len(n)), n_words=pa.array(n), own=pa.array(sums))
                rare = c >= len(net.vocabulary)
                words.append(b.hashes[rare])
                texts.append(np.repeat(pos, n)[rare])
            every, held = np.concatenate(words), np.concatenate(texts)
            order = np.argsort(every, kind="stable")
            every, held = every[order], held[order]
            for i in range(0, len(every), 1 << 20):  # a word may go on in the next part
                word, first = np.unique(every[i : i + (1 << 20)], return_index=True)
                own = held[i : i + (1 << 20)]
                at = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.array(own))
                yield rows(block, doc_id=pa.nulls(len(word), names.type), word=pa.array(word.view(np.int64)), at=at)

    def rows(block: int, **given: pa.Array) -> pa.RecordBatch:
        n = len(given["doc_id"])
        kinds = {"block": pa.int64(), "pos": pa.int32(), "doc_id": None, "n_words": pa.int64(), "own": pa.float64(), "word": pa.int64(), "at": pa.list_(pa.int32())}
        given["block"] = pa.array(np.full(n, block))
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    named = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    found = materialize(named.mapInArrow(run, f"block long, pos int, doc_id {kind}, n_words long, own double, word long, at array<int>"), "scored")
    share = F.coalesce("share", F.lit(-float(np.log(model.every + 1)))).alias("share")
    parts = found.where("word IS NOT NULL").select("word", "block", "at").join(model.shares, "word", "left").select("block", F.explode("at").alias("pos"), share)
    rest = parts.groupBy("block", "pos").agg(F.sum("share").alias("rest"))
    out = found.where("pos IS NOT NULL").select("block", "pos", "doc_id", "n_words", "own").join(rest, ["block", "pos"], "left")
    total = (F.col("own") + F.coalesce("rest", F.lit(0.0))).alias("log_likelihood")
    out = out.select("doc_id", "n_words", total)
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame, **options) -> DataFrame:
    """Scores of every row of docs (doc_id, text) by a model that is trained on docs.

    Words are runs of [^\\x20\\x09-\\x0D] of whole texts, A-Z lowered. Null, empty and
    wordless texts score 0 over 0 words; repeated rows are scored (and learnt) each; an
    empty table gives an empty one.
    """
    return score(docs, fit(docs, **options))
