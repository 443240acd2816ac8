"""Fuzzy line deduplication by MinHash of character shingles.

DataFrame functions only.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import NARROW, components, connect, discard, materialize, prefix_pairs, small
from loomscape.llm.quality import let

SHINGLE = 7  # characters
PERCENT = 75
SIDE = 4  # a signature has SIDE ** 2 least hashes, a band SIDE of them; 2, 4 or 8
BANDS = 12  # at most SIDE * (SIDE + 1)
BLOCK_RUNS = 4  # of a line in a row
AGREE = 7  # least hashes of 16 that a pair must have in common to be compared
FEW = 32  # members of a band that are paired; more meet in a prefix join
SLOTS = 1 << 17  # counters for the order of runs
_SPACES = " \t\n\x0b\f\r"
_LAST = (1 << 63) - 1


def affine_bands(side: int) -> list[list[int]]:
    """The lines of the affine plane over the field of side = 2, 4 or 8 elements, each as
    numbers of points: side * (side + 1) bands of side points, any two points of which
    share exactly one."""
    over = {2: 0b111, 4: 0b111, 8: 0b1011}[side]

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            a ^= over if a & side else 0
        return out

    sloped = [[x * side + (times(m, x) ^ c) for x in range(side)] for m in range(side) for c in range(side)]
    return sloped + [[x * side + y for y in range(side)] for x in range(side)]


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, pos and line, trimmed and in lower case, of all lines that hold
    something, and 96 bits of hashes of the line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.lower(F.btrim("line", F.lit(_SPACES)))).where("line <> ''")
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "pos", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))  # of another kind: xxhash64 of the line and a number would follow from h1


def _run_list(line: str, size: int) -> Column:
    """Hashes of all runs of size characters. The line's UTF-32 bytes are bound first: a
    row would hand out a copy of them for every run."""

    def of(c: Column) -> Column:
        last = F.greatest(F.lit(0), F.octet_length(c) - 4 * size)
        return F.transform(F.sequence(F.lit(0), last, F.lit(4)), lambda i: F.xxhash64(F.substring(c, i + 1, F.lit(4 * size))))

    return let(F.encode(line, "UTF-32"), of)


def _signed(lines: DataFrame, size: int, side: int) -> DataFrame:
    """Each distinct line with the first of its rows as id, how often it stands, and its least hashes.

    Runs are worked on in blocks that are rows of their own only inside one stage: they
    are cut, hashed and combined to least values before anything is shuffled. A least
    value is the run whose hash is nearest to a fixed random number by exclusive or, and
    so a uniform one of the set. A block beyond a line's end holds its last run again.
    """
    chars = lines.select("h1", "h2", "row", F.encode("line", "UTF-32").alias("chars"))
    chars = chars.withColumn("last", F.greatest(F.lit(0), F.octet_length("chars") - 4 * size))
    blocks = chars.select("h1", "h2", "row", "chars", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4 * BLOCK_RUNS))).alias("i"))
    run = lambda j: F.xxhash64(F.substring(F.col("chars"), F.least(F.col("i") + 4 * j, F.col("last")) + 1, F.lit(4 * size)))
    runs = [run(j).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(f"r{j}") for j in range(BLOCK_RUNS)]
    blocks = blocks.select("h1", "h2", F.when(F.col("i") == 0, F.col("row")).alias("row"), *runs)
    draw = random.Random(1)
    near = [F.lit(draw.getrandbits(31)) for _ in range(side * side)]
    least = [F.min(F.least(*(F.col(f"r{j}").bitwiseXOR(x) for j in range(BLOCK_RUNS)))).alias(f"m{k}") for k, x in enumerate(near)]
    return blocks.groupBy("h1", "h2").agg(F.min("row").alias("id"), F.count("row").alias("n"), *least)


def _sketch(side: int) -> Column:
    """The low bytes of the least hashes, eight to a long."""
    byte = [F.shiftleft(F.col(f"m{k}").cast("long").bitwiseAND(F.lit(255)), 8 * (k % 8)) for k in range(side * side)]
    return F.array(*(reduce(Column.bitwiseOR, byte[k : k + 8]) for k in range(0, len(byte), 8)))


def _members(classes: DataFrame, bands: list[list[int]]) -> DataFrame:
    """key, id and m (how many ids the key has) of band keys that several classes have. Keys
    are worked out twice from the least hashes, so that only counts of keys are shuffled;
    a class has a key once."""
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{k}" for k in band)) for b, band in enumerate(bands)))
    dealt = classes.select(F.explode(keys).alias("key"), "id")
    shared = materialize(dealt.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    out = materialize(dealt.join(small(shared, NARROW), "key"), "members")
    discard(shared)
    return out


def _agreeing(x: Column, y: Column, side: int) -> Column:
    """How many least hashes two sketches have in common, by their low bytes."""

    def unlike(k: int) -> Column:
        bits = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        for n in (1, 2, 4):  # a byte's lowest bit tells then whether any was set
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    longs = -(-side * side // 8)
    return F.lit(side * side) - reduce(Column.__add__, (unlike(k) for k in range(longs)))


def dropped_lines(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, side: int = SIDE, bands: int = BANDS) -> DataFrame:
    """doc_id and dropped (ascending numbers of lines from 0) for every document of docs
    (doc_id, text) that loses lines.

    Lines are compared trimmed and lower-cased; blank ones are left alone. Equal lines
    are one class. Classes are linked where their sets of runs of size characters have
    100 * intersection >= percent * union (a shorter line is one run), and of each
    component of links the first line by doc_id and place stays, wherever it stands.

    A signature has side ** 2 least hashes of a line's runs; bands are lines of the affine
    plane on them, so that any two least hashes share one band at most. With 16 and 12 a
    pair at the threshold is found with a chance of 0.947, at 80 percent of 0.979, at 85
    of 0.994. Chance pairs of unlike lines fall with the side-th power of their
    similarity. Pairs that bands suggest are confirmed on full sets of runs, but for such
    as are in one component already or have fewer than AGREE of 16 least hashes in common
    (at the threshold 1 pair in 10,000 that bands find). Members of bands of at most FEW are
    all paired. In larger ones each is held against the band's centre; what is apart then
    meets in a prefix join; see connect(). Of these pairs each line's likeliest are compared
    first, and others only where those leave them apart.

    Rows that share a doc_id share its places; a null doc_id comes last. Null and empty
    texts have no lines; a line of any length is one line (an executor holds a few
    copies of it); an empty table gives an empty one; other columns of docs play no part.
    """
    lines = materialize(_lines(docs), "lines")
    planned = affine_bands(side)[:bands]
    classes = materialize(_signed(lines, size, side), "classes")
    members = _members(classes, planned)
    ids = materialize(members.select("id").distinct(), "ids")
    runs = F.size(F.array_distinct(_run_list("line", size)))
    own = lines.select(F.col("row").alias("id"), "line").join(small(ids, NARROW), "id", "left_semi")
    texts = materialize(own.select("id", "line", runs.alias("n")), "texts")
    sketches = classes.select("id", _sketch(side).alias("sketch")).join(small(ids, NARROW), "id", "left_semi")
    sketches = materialize(sketches.join(texts.select("id", "n"), "id"), "sketches")
    agree = -(-AGREE * side * side // 16)
    agreeing = _agreeing(F.col("sa"), F.col("sb"), side).alias("agree")
    both_sizes = (F.col("na") + F.col("nb")).alias("n")

    def near(x: str, y: str) -> Column:
        """Whether sizes and sketches of two lines let them be alike."""
        sized = 100 * F.least(f"n{x}", f"n{y}") >= percent * F.greatest(f"n{x}", f"n{y}")
        return sized & (_agreeing(F.col(f"s{x}"), F.col(f"s{y}"), side) >= agree)

    def sketch(x: str) -> DataFrame:
        return sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def compared(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
        both = F.size(F.array_intersect(_run_list("line_a", size), _run_list("line_b", size)))
        # written before it is filtered, so that no filter works the sets out again
        pairs = materialize(pairs, "pairs")
        a, b = (x.join(small(pairs.select(k).distinct(), NARROW), k, "left_semi") for x, k in ((a, "a"), (b, "b")))
        counted = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), "n"), "links")
        return counted.where(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b")

    def in_turn(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Links of pairs (a, b, n, agree), n being the sum of their sizes, that connect what
        all links of theirs would, together with those that are known. Each id is compared
        with the one that it agrees with most first; pairs that are in one component then
        are not compared."""
        pairs = materialize(pairs, "pairs")
        best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "n"), F.struct("agree", "b")).alias("best")).select("a", "best.*")
        other = pairs.groupBy("b").agg(F.max_by(F.struct("a", "n"), F.struct("agree", "a")).alias("best")).select("best.a", "b", "best.n")
        first = compared(best.unionByName(other).distinct())
        now = materialize(components(first if known is None else first.unionByName(known)), "found")
        side_of = lambda x: now.select(F.col("id").alias(x), F.col("component").alias(f"p{x}"))
        others = pairs.join(side_of("a"), "a", "left").join(side_of("b"), "b", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b"))
        return first.unionByName(compared(others.select("a", "b", "n")))

    def verified(pairs: DataFrame) -> DataFrame:
        return compared(pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(near("a", "b")).select("a", "b", both_sizes))

    def paired(rows: DataFrame) -> DataFrame:
        """Links between members of one key, of which each has FEW at most."""
        rows = materialize(rows.select("key", "id").join(sketch("id"), "id"), "some")
        side_of = lambda x: rows.select("key", F.col("id").alias(x), F.col("nid").alias(f"n{x}"), F.col("sid").alias(f"s{x}"))
        pairs = side_of("a").join(side_of("b"), "key").where((F.col("a") < F.col("b")) & near("a", "b"))
        return in_turn(pairs.select("a", "b", both_sizes, agreeing).distinct())

    def settle(apart: DataFrame) -> DataFrame:
        """Links between the parts of ids by a positional prefix join."""
        ids = materialize(apart.groupBy("id").agg(F.min("part").alias("part")), "ids")
        return in_turn(joined(ids), ids.select(F.col("id").alias("a"), F.col("part").alias("b")))

    def joined(ids: DataFrame) -> DataFrame:
        """Pairs of different parts of ids that a positional prefix join finds; runs are ordered by
        the power of two of how often their slot of a table of counters is met. The table
        has a fixed size: a letter for each slot goes back to the tasks as one string."""
        known = materialize(sketches.join(small(ids), "id").select("id", "part", "sketch"), "known")
        own = texts.select("id", "line").join(small(known), "id").select("id", "part", "sketch", F.array_distinct(_run_list("line", size)).alias("runs"))
        slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
        counts = own.select(F.explode("runs").alias("h")).select(slot(F.col("h")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
        letters = ["A"] * SLOTS
        found = counts.toArrow()  # rows of Python objects would take the driver tens of MB
        for at, n in zip(found["slot"].to_numpy().tolist(), found["n"].to_numpy().tolist(), strict=True):
            letters[at] = chr(ord("A") + min(n.bit_length(), 25))
        often = F.split(F.lit("".join(letters)), "")
        keyed = let(often, lambda c: F.transform("runs", lambda h: F.shiftleft(F.ascii(F.get(c, slot(h))).cast("long"), 44).bitwiseOR(h.bitwiseAND(F.lit((1 << 44) - 1)))))
        ordered = own.select("id", "part", "sketch", keyed.alias("runs")).select("id", "part", "sketch", F.sort_array(F.array_distinct("runs")).alias("runs"))
        n = F.size("runs")
        many = n + 1 - F.ceil(n * percent / 100 - 1e-9).cast("int")
        rows = ordered.select("id", "part", "sketch", n.alias("n"), F.posexplode(F.slice("runs", F.lit(1), many)).alias("pos", "key"))
        most = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent + 1e-9).cast("int") - F.col("n")
        return prefix_pairs(rows.select("key", "id", "part", "sketch", "n", most.alias("most")), near, [both_sizes, agreeing])

    links = paired(members.where(F.col("m") <= FEW))
    large = materialize(members.where(F.col("m") > FEW).select("key", "id"), "large")
    if not large.isEmpty():
        links = connect(large, verified, settle, centres=1, known=links)
    found = materialize(components(links), "found")
    rule = classes.select("h1", "h2", "n", "id").join(small(found), "id", "left").where("n > 1 OR component IS NOT NULL")
    rule = materialize(rule.select("h1", "h2", F.coalesce("component", "id").alias("part")), "rule")
    place = F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("decimal(38,0)") * F.lit(1 << 31) + F.col("pos")
    again = lines.select("doc_id", "pos", "h1", "h2").join(small(rule), ["h1", "h2"]).select("doc_id", "pos", "part", place.cast("decimal(38,0)").alias("place"))
    again = materialize(again, "again")
    first = materialize(again.groupBy("part").agg(F.min("place").alias("first")), "first")
    discard(members, large, ids, sketches, texts, classes, found, rule, lines)
    gone = again.join(small(first), "part").where("place <> first")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines (lines that hold something), n_dropped and dropped for every row of
    docs; see dropped_lines(). Null and empty texts have no lines; rows that share a
    doc_id have one list of dropped lines; an empty table gives an empty one."""
    lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"))
    gone = dropped_lines(docs, **options).select(F.col("doc_id").alias("_id"), "dropped")
    out = rows.join(gone, rows.doc_id.eqNullSafe(F.col("_id")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts without dropped lines, and n_chars anew where they have it;
    see dropped_lines(). No row is dropped: one that loses all its lines has an empty
    text, a null text stays null, and so does every column of docs, whatever its name."""
    gone = dropped_lines(docs, **options).select(F.col("doc_id").alias("_gone_id"), F.col("dropped").alias("_gone"))
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_own_id"))
    out = own.join(gone, F.col("_own_id").eqNullSafe(F.col("_gone_id")), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("_doc.text")).otherwise(let(F.split("_doc.text", "\n"), rest))
    out = out.select("_doc", "_gone", text.alias("_text"))
    columns = [F.col(f"_doc.{c}").alias(c) for c in docs.columns]
    columns[docs.columns.index("text")] = F.col("_text").alias("text")
    if "n_chars" in docs.columns:
        counted = F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text"))
        columns[docs.columns.index("n_chars")] = counted.cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")
    return out.select(*columns)
