"""N-gram joins, conversation tries and lexical search against brute force, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from loomscape.llm import queries as Q

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_ngram_jaccard", "op12_conversation_trie", "op13_lexical_search"])
def test_same_as_sql(spark, name):
    from oracle import compare

    assert compare(spark, SF, name) == ""


# ---- joins


def shingles(text, size=4):
    w = SPACED.findall(low(text))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked(rows, percent=85):
    """Smallest doc_id that links reach, for rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def edited_copies(seed, originals=6, copies=40):
    """Copies of a few texts with 0 to 6 in 100 words changed, some with a common passage."""
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for o in range(originals):
        base = [f"o{o}w{k}" for k in range(int(rng.integers(1, 150)))]
        for _ in range(copies):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 16))).tolist():
                w[at] = f"x{rng.integers(1 << 40)}"
            if rng.random() < 0.3:
                w += common
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_edited_copies(spark, seed):
    from loomscape.llm.ngram_join import jaccard_components

    rows = edited_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


def test_signatures_of_alike_sets_meet():
    """Frequent tokens by two and three: no alike pair is without a common key that fits."""
    from loomscape.llm.ngram_join import group_counts, signatures

    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        universe = rng.integers(1, 2**63, n + 80, dtype=np.uint64)
        often = rng.choice([2, 20, 40, 900, 1500, 9000], n + 80)
        x = np.arange(n)
        y = np.append(np.setdiff1d(x, rng.choice(n, min(n - 1, int(rng.integers(0, 1 + n // 9))), replace=False)), np.arange(n, n + int(rng.integers(0, 1 + n // 12))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both):
            continue
        met = False
        mine, other = ({}, {})
        for own, held in ((x, mine), (y, other)):
            for groups in group_counts(len(own), 85):
                key, most = signatures(len(own), often[own], universe[own], 85, groups)
                for k, m in zip(key.tolist(), most.tolist(), strict=True):
                    held[k] = max(m, held.get(k, m))
        for k in mine.keys() & other.keys():
            met = met or (mine[k] >= len(y) and other[k] >= len(x))
        assert met, (n, len(y), both)


def test_components_awkward(spark):
    from loomscape.llm.ngram_join import jaccard_components

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, words, "a"), (4, words, "a"), (5, words + " end", None), (6, words.upper(), "a"), (7, ("long " * 30 + "\n") * 20000, "a"), (8, "one", "a"), (9, "ONE", "a"), (10, "other " * 3, "a"), (10, words, "a"), (None, words, "a"), (11, "two words", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 37, 4), (4, 37, 4), (5, 38, 4), (6, 37, 4), (7, 1, 7), (8, 1, 8), (9, 1, 8), (10, 1, 4), (10, 37, 4), (11, 1, 11), (None, 37, 4)]
    assert [x for x in got if x[0]] == sorted((x for x in want if x[0]), key=repr)
    assert jaccard_components(df.where("false")).count() == 0


@pytest.mark.parametrize("ids", [(-5, -9, 7), (1 << 40, 3, -(1 << 62))])
def test_components_look_up_texts_of_any_ids(spark, ids):
    """Near copies, so that their texts are read again behind the filter on ids."""
    from loomscape.llm.ngram_join import jaccard_components

    words = [f"w{i}" for i in range(60)]
    rows = [(ids[0], " ".join(words)), (ids[1], " ".join(words[:-2])), (ids[2], " ".join(words[::-1])), (None, " ".join(words[:-1]))]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == linked(rows[:3])


# ---- tries


def rebuilt(rows, digest):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    return out


def trie(turns):
    """Rows of the trie of conversations, by brute force."""
    members = collections.defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: sorted(c for c in m if len(turns[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def md5_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_trie_over_any_number_of_partitions(spark, partitions):
    from loomscape.llm.conversation_trie import prefix_trie, share_openings, turn_arrays

    rng = np.random.default_rng(partitions)
    rows = []
    for c in range(-120, 400):
        many = int(rng.integers(1, 7))
        hot = c % 3 == 0  # a third is one conversation
        for t in range(3 if hot else many):
            rows.append((c, t, "user" if t % 2 else None, f"hot{t}" if hot else f"t{rng.integers(3)}"))
    rows += [(7, None, None, None), (7, None, None, None), (8, 0, "user", "tie"), (8, 0, "user", "other"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = prefix_trie(share_openings(turn_arrays(df)), partitions).select(*NODE).collect()
    assert sorted(tuple(r) for r in found) == trie(rebuilt(rows, md5_key))


def test_trie_edges(spark):
    from loomscape.llm.conversation_trie import prefix_trie, share_openings, turn_arrays

    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(share_openings(turn_arrays(empty))).collect() == []
    # conversation 101 has fewer turns than it would share and no conversation 100: it has none
    c = next(x for x in range(101, 200) if zlib.crc32(str(x).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "é" * 50_000), *[(300, t, "user", f"deep {t}") for t in range(700)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' AS path", "1 AS turns", "2 AS chars")
    found = prefix_trie(share_openings(turn_arrays(df)), 3).select(*NODE).collect()
    assert sorted(tuple(r) for r in found) == trie(rebuilt(rows, md5_key))
    assert max(r.depth for r in found) == 700 and min(r.conv_id for r in found) == c


# ---- search


def ranked(docs, items, k=10):
    n = {i: TERM.findall(low(t)) for i, t in docs if TERM.search(t or "")}
    held = {i: collections.Counter(w) for i, w in n.items()}
    total, words = len(n), sum(map(len, n.values()))
    df = collections.Counter(t for c in held.values() for t in c)
    out = []
    for item, text in items:
        score = collections.Counter()
        for t in TERM.findall(low(text)):
            w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
            for i, c in held.items():
                if c[t]:
                    score[i] += w * (1000000000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * len(n[i]) * total // words)))
        best = sorted(((-s, i) for i, s in score.items() if s > 0))[:k]
        out += [(item, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def word_salad(seed, docs=400, items=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"Wört{k}" if k % 3 else f"w{k}" for k in range(300)]
    weight = 1 / np.arange(1, 301)
    pick = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    texts = [pick(int(rng.integers(0, 60))) for _ in range(docs)]
    return [(i, t) for i, t in enumerate(texts[: docs // 2] + texts[: docs // 2])], [(k, pick(int(rng.integers(0, 15)))) for k in range(items)]


@pytest.mark.parametrize("shard_words,max_terms", [(1 << 20, 1_000_000), (300, 40), (1, 1_000_000)])
def test_search_brute_force(spark, shard_words, max_terms):
    from loomscape.llm.lexical_search import build_index, search

    docs, items = word_salad(shard_words)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = build_index(rows, shard_words)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in search(index, asked, max_terms=max_terms).collect())
    assert got == ranked(docs, items)


def test_search_awkward(spark):
    from loomscape.llm.lexical_search import search_documents

    docs = [(1, None, 0), (2, "", 0), (3, " -- ", 0), (4, "alpha beta", 0), (5, "ALPHA, beta!", 0), (6, "gamma " * 200_000 + "delta", 0), (None, "alpha", 0), (-7, "alpha beta", 0), (8, "éa É", 0)]
    items = [("a", "alpha", 0), ("a", "alpha", 0), ("b", None, 0), ("c", "--", 0), ("d", "nowhere", 0), (None, "delta delta gamma", 0), ("e", "É", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    asked = spark.createDataFrame(items, "item_id string, text string, rank int")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search_documents(df, asked).collect()), key=repr)
    want = ranked([x[:2] for x in docs if x[0] is not None], [("a", "alpha"), ("0", "delta delta gamma"), ("e", "É")])
    assert got == sorted(((None if i == "0" else i, *x) for i, *x in want), key=repr)
    assert search_documents(df.where("false"), asked).count() == 0
    assert search_documents(df, asked.where("false")).count() == 0


def test_coded_numbers():
    from loomscape.llm.lexical_search import decode, encode

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**62], np.int64)
    data, ends = encode(values)
    assert decode(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert len(encode(np.zeros(0, np.int64))[0]) == 0 and len(decode(np.zeros(0, np.uint8))) == 0
