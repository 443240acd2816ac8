"""Quality rules: counted base rules, then robust multivariate outliers.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import materialize, small

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

CUT = 45.79  # of the squared Mahalanobis distance: the quantile of 1 - 1e-8 in 5 dimensions
MOST_STEPS = 30  # a determinant that still falls then is near enough
MOST_GROUPS = 20_000  # whose models are broadcast, some 250 bytes each; more are joined by key
SHRINK = 50  # documents that the estimate of a wider group counts as


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more, hashes being those of a text's
    windows in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def words(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return let(let(ordered, places), words)


def _repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > WINDOW, some).otherwise(0).cast("long").alias("n_repeat_words"))

    return let(words, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _m, a struct of the counts of each whole text (null: empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    counted = docs.withColumn("_w", _repeat_words(words)).withColumn("_l", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice"))))
    left = lambda chars: F.length(F.translate(t, chars, ""))
    fields = {
        "n_words": F.col("_w.n_words"),
        "word_chars": left(_SPACES).cast("long"),
        "n_symbols": (F.length(t) - left(_SYMBOLS)).cast("long"),
        "n_dup_lines": F.col("_l.twice"),
        "n_repeat_words": F.col("_w.n_repeat_words"),
        "n_lines": F.col("_l.n"),
        "n_capitals": (F.length(t) - left(_CAPITALS)).cast("long"),
    }
    return counted.withColumn("_m", F.struct(*(c.alias(n) for n, c in fields.items()))).drop("_w", "_l")


def _features() -> list[tuple[str, Column, float]]:
    m = lambda n: F.col(f"_m.{n}").cast("double")
    words, lines = F.greatest(m("n_words"), F.lit(1.0)), F.greatest(m("n_lines"), F.lit(1.0))
    return [
        ("x0", F.log1p(m("word_chars") / words), 0.08),
        ("x1", m("n_symbols") / words, 0.05),
        ("x2", m("n_repeat_words") / words, 0.05),
        ("x3", m("n_dup_lines") / lines, 0.10),
        ("x4", m("n_capitals") / F.greatest(m("word_chars"), F.lit(1.0)), 0.04),
    ]


def judge(measured: DataFrame, cut: float = CUT, most_steps: int = MOST_STEPS) -> DataFrame:
    """Adds base_failed, distance (null where base_failed) and kept to the rows of
    measure(), which hold lang and source.

    Base: fewer than 20 words, or more than 30 in 100 of them in repeated windows. The
    others are outliers where their statistics' squared Mahalanobis distance from their
    language and source exceeds cut. Centre and scatter minimise the covariance
    determinant over half of the group, (n + p + 1) / 2 of n: from medians, with quartiles
    and with the least scales, each step takes the half that is nearest and its mean and
    covariance. A group's start is done, and its rows take no further step, as soon as its
    determinant falls no more; the least one of all steps and both starts counts.
    Scatter is scaled by the median
    distance, and no direction is narrower than the statistics' least scales, so that
    groups of equal documents reject nothing for trifles. Estimates are made for each
    language and source, for each language and for all documents; a group of n documents
    counts with n parts and the wider group's estimate with SHRINK, all the way up, so
    that groups of any size are handled alike. A null language or source counts as empty.
    All sums and quantiles are combined before they are shuffled; only groups' estimates
    are joined to the rows, and broadcast while they are few. An empty table gives an
    empty one; null and wordless texts fail the base rules.
    """
    p = 5
    names = [f"x{i}" for i in range(p)]
    found = _features()
    least = [f for _, _, f in found]
    n_words, repeats = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    lang, source = F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")
    table = materialize(measured.withColumn("base_failed", failed).withColumns({n: c for n, c, _ in found}), "measured")
    keyed = table.where(~F.col("base_failed")).select(lang, source, *names)
    level = [F.to_json(F.array("_lang", "_source")), F.to_json(F.array("_lang")), F.lit("*")]
    rows = materialize(keyed.select(F.explode(F.array(*level)).alias("_group"), *names), "vectors")

    quart = materialize(rows.groupBy("_group").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in names)), "quartiles")
    few = quart.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS  # models and bounds have two rows for each group
    hint = F.broadcast if few else (lambda df: df)
    zero = F.lit(0.0)
    centre = {f"m{i}": F.col(f"x{i}")[1] for i in range(p)}
    spread = {f"c{i}{j}": F.greatest((F.col(f"x{i}")[2] - F.col(f"x{i}")[0]) / 1.349, F.lit(least[i])) ** 2 if i == j else zero for i in range(p) for j in range(i + 1)}
    narrow = {f"c{i}{j}": F.lit(least[i] ** 2 if i == j else 0.0) for i in range(p) for j in range(i + 1)}
    starts = [quart.select("_group", F.lit(k).alias("_start"), *(c.alias(n) for n, c in (centre | own).items())) for k, own in enumerate((spread, narrow))]
    model = materialize(starts[0].unionByName(starts[1]), "model")
    key = ["_group", "_start"]
    cells = [*(f"m{i}" for i in range(p)), *(f"c{i}{j}" for i in range(p) for j in range(i + 1))]
    shares = [k / 100 for k in range(50, 101)]
    model, steps = model.withColumn("det", F.lit(None).cast("double")), []
    for _ in range(most_steps):
        far = _with_distance(rows, hint(_factored(model.withColumnRenamed("det", "was"))), "_group", extra=["_start"])
        bound = far.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("distance", shares, 1000).alias("b"))
        share = F.ceil(100 * F.least((F.col("n") + p + 1) / (2 * F.col("n")), F.lit(1.0)) - 1e-9).cast("int")
        bound = materialize(bound.select(*key, F.get("b", share - 50).alias("bound")), "bounds")
        near = far.join(hint(bound), key).where("distance <= bound")
        means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(names)]
        # sums of products about the former centre keep their digits
        about = [F.avg((F.col(f"x{i}") - F.col(f"o{i}")) * (F.col(f"x{j}") - F.col(f"o{j}"))).alias(f"p{i}{j}") for i in range(p) for j in range(i + 1)]
        shift = [F.avg(F.col(f"x{i}") - F.col(f"o{i}")).alias(f"s{i}") for i in range(p)]
        new = near.groupBy(*key).agg(*means, *about, *shift, F.min("was").alias("was"))
        ridge = lambda i, j: F.lit((0.1 * least[i]) ** 2 if i == j else 0.0)
        cov = [(F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") + ridge(i, j)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
        new = _factored(new.select(*key, *(f"m{i}" for i in range(p)), *cov, "was"))
        det = sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00"))
        found = materialize(new.select(*key, *cells, det.alias("det"), "was").coalesce(1), "model")
        steps.append(found.select(*key, *cells, "det"))
        # approximate bounds may let a determinant swing for good: what fell no more is done
        model = found.where("was IS NULL OR was - det >= 1e-4").select(*steps[-1].columns)
        if model.isEmpty():
            break
    every = reduce(DataFrame.unionByName, steps)
    model = every.groupBy("_group").agg(F.min_by(F.struct(*cells), F.struct("det", "_start")).alias("_best"))
    model = materialize(model.select("_group", "_best.*"), "model")
    middle = _with_distance(rows, hint(_factored(model)), "_group").groupBy("_group").agg(F.count("*").alias("n"), (F.percentile_approx("distance", 0.5, 1000) / 4.351).alias("wide"))  # the median for 5 dimensions
    scaled = [(F.col(f"c{i}{j}") * F.greatest("wide", F.lit(1.0)) + F.lit(least[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    final = materialize(model.join(middle, "_group").select("_group", "n", *(f"m{i}" for i in range(p)), *scaled), "final")
    wider = _shrunk(final, final.where("_group = '*'").withColumnRenamed("_group", "_wider"), F.lit("*"))
    narrow_groups = materialize(table.select(lang, source).distinct(), "groups").select("_lang", "_source", level[0].alias("_group"), level[1].alias("_above"))
    own = narrow_groups.join(final, "_group", "left").drop("_group")
    final = materialize(_shrunk(own, wider.withColumnRenamed("_group", "_wider"), F.col("_above")).drop("_above", "n"), "models")
    out = table.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    out = _with_distance(out, small(_factored(final)), ["_lang", "_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", zero) <= cut)
    return out.withColumn("kept", kept).drop("_lang", "_source", *names, *(f"o{i}" for i in range(p)))


def _shrunk(own: DataFrame, wider: DataFrame, name: Column) -> DataFrame:
    """own's centres and scatters mixed with those of the wider group of that name, which
    counts as SHRINK documents; groups without documents have the wider one's."""
    p = 5
    fields = [*(f"m{i}" for i in range(p)), *(f"c{i}{j}" for i in range(p) for j in range(i + 1))]
    above = wider.select("_wider", *(F.col(c).alias(f"w_{c}") for c in fields))
    both = own.join(small(materialize(above, "wider")), name == F.col("_wider"), "left")
    n = F.coalesce("n", F.lit(0))
    w = n / (n + SHRINK)
    a, b = (lambda c: F.coalesce(c, f"w_{c}")), (lambda c: F.coalesce(f"w_{c}", c))
    apart = [a(f"m{i}") - b(f"m{i}") for i in range(p)]
    mixed = [(w * a(c) + (1 - w) * b(c)).alias(c) for c in fields[:p]]
    mixed += [(w * a(f"c{i}{j}") + (1 - w) * b(f"c{i}{j}") + w * (1 - w) * apart[i] * apart[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return both.select(*(c for c in own.columns if c not in fields), *mixed)


def _factored(model: DataFrame) -> DataFrame:
    """Adds l00.., the scatter's Cholesky factor."""
    p = 5
    for j in range(p):
        for i in range(j, p):
            inner = F.col(f"c{i}{j}")
            for k in range(j):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))) if i == j else inner / F.col(f"l{j}{j}"))
    return model


def _with_distance(rows: DataFrame, model: DataFrame, on, how: str = "inner", extra: list[str] | None = None) -> DataFrame:
    """Adds distance, the squared Mahalanobis distance of x0.. from the group's factored
    model, and the centre as o0... extra are columns of the model that the rows get too."""
    p = 5
    keys = [on] if isinstance(on, str) else on
    out = rows.join(model.withColumnsRenamed({f"m{i}": f"o{i}" for i in range(p)}), keys, how)
    out = out.drop(*(f"c{i}{j}" for i in range(p) for j in range(i + 1)), *(c for c in ("_start",) if c not in (extra or [])))
    for i in range(p):
        inner = F.col(f"x{i}") - F.col(f"o{i}")
        for k in range(i):
            inner = inner - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", inner / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") ** 2 for i in range(1, p)), F.col("y0") ** 2)
    return out.withColumn("distance", total).drop(*(f"y{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for every row of docs (doc_id, text, lang, source): its counts and verdicts."""
    own = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    m = [F.col(f"_m.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge(measure(own).drop("text")).select("doc_id", *m, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return judge(measure(packed).drop("text")).where("kept").select("_doc.*")
