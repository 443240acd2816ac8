"""Training-data operators against brute force, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomscape.llm import queries as Q
from loomscape.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs():
    return sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def awkward(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, None, None, None, 0, 1.0),
        (2, "", "en", "s", 0, 1.0),
        (3, " \n\t ", "en", None, 0, 2.0),
        (4, words, "en", "s", 0, None),
        (4, words, "en", "s", 0, None),
        (5, words + " end", "en", "s", 0, 3.0),
        (6, words.upper(), "en", "s", 0, 3.0),
        (7, ("long " * 30 + "\n") * 2000, "fr", "s", 0, 3.0),
        (8, "one", "fr", "s", 0, 3.0),
        (None, "no id " + words, "fr", "s", 0, 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double")


def groups(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_url_filter_sql(spark):
    from oracle import compare

    assert compare(spark, SF, "op1_url_filter") == ""


def test_url_filter_edges(spark):
    from loomscape.llm.url_filter import filter_urls

    urls = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://x.example.com/en/1", "http://www.example.com/en/1", "http://net/es/", "ftp://a.b.net/es", "http://xcom/", "http://spam.org/x", "http://a.spam.org"]
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(rows, Q.URL_RULES, ["spam.org"]).collect()}
    want = {4: ("com/", "allow"), 6: ("example.com/en/", "block"), 7: ("www.example.com/en/", "allow"), 8: ("net/es/", "block"), 11: (None, "block"), 12: (None, "block")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert filter_urls(rows.where("false"), Q.URL_RULES).count() == 0


def test_url_filter_long_and_repeated(spark):
    import time

    from loomscape.llm.url_filter import filter_urls

    urls = ["http://" + "a." * 100_000 + "spam.org/x", "http://spam.org/" + "en/" * 200_000, "http://" + "." * 50_000, "http://a.spam.org.", "http://b.com/" + "?" * 9] * 2
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    begin = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(rows, Q.URL_RULES, ["spam.org"]).collect()}
    assert got == {i: (("com/", "allow") if i % 5 == 4 else (None, "block" if i % 5 < 2 else "allow")) for i in range(10)}
    assert time.time() - begin < 120


def test_cascade_ends_where_hashes_clash(spark):
    from loomscape.llm.url_filter import build_cascade

    universe = spark.createDataFrame([(f"k{i}", i // 2) for i in range(400)], "key string, h long")
    cascade = build_cascade(universe, universe.where("key IN ('k0', 'k7', 'k10', 'k11')"))
    assert cascade.clashes == {"k1", "k6"}
    found = cascade.listed(np.array([i // 2 for i in range(400)], np.uint64))
    assert {f"k{i}" for i in np.flatnonzero(found).tolist()} - cascade.clashes == {"k0", "k7", "k10", "k11"}


def test_near_duplicates_brute_force(spark, docs):
    sets = {}
    for r in docs:
        w = SPACED.findall(low(r["text"]))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = groups(pairs, ids)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op2_minhash_near_dedup(spark, SF).collect()}
    assert got == {i: (len(sets[i]), part[i], part[i] == i) for i in ids}


def test_near_duplicates_awkward(spark, awkward):
    from loomscape.llm.near_duplicates import drop_near_duplicates, near_duplicates

    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    part = {r.doc_id: r.component_id for r in rows}
    assert part[4] == part[5] == part[6] == 4 and part[1] == 1 and part[8] == 8
    left = drop_near_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert near_duplicates(awkward.where("false")).count() == 0


def test_sketch_fills_and_estimates():
    from loomscape.llm.near_duplicates import sketch

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        assert (sketch(rng.integers(0, 2**63, n, dtype=np.uint64)) != np.iinfo(np.uint64).max).all()
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    same = np.mean([np.mean(sketch(np.append(both, a)) == sketch(np.append(both, b)))])
    assert abs(same - 0.6) < 0.15


def test_candidate_filter_follows_its_ids(spark):
    from loomscape.llm.near_duplicates import _may_be_in

    ids = spark.range(0, 3000, 10)
    for size in (1 << 15, 1 << 18):
        rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(size)).alias("slot"))
        got = {r.doc_id for r in rows.mapInArrow(_may_be_in(ids, size), "doc_id long").collect()}
        assert set(range(0, 3000, 10)) <= got and len(got) < 300 + 2 * 30_000 * 300 / size


def lines_to_drop(texts, size):
    """By doc_id, the numbers of lines that an exact join of all lines drops."""
    places = [(i, k, t) for i in sorted(texts) for k, x in enumerate(texts[i].split("\n")) if (t := x.strip(" \t\n\x0b\f\r").lower())]
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, _, t in places))}
    runs = [{t[i : i + size] for i in range(max(1, len(t) - size + 1))} for t in number]
    having = collections.defaultdict(list)
    for i, own in enumerate(runs):
        for x in own:
            having[x].append(i)
    pairs = {(j, i) for i, own in enumerate(runs) for j, n in collections.Counter(j for x in own for j in having[x] if j < i).items() if 100 * n >= 75 * (len(own) + len(runs[j]) - n)}
    part, seen, out = groups(pairs, range(len(runs))), set(), set()
    for doc, k, t in places:
        if part[number[t]] in seen:
            out.add((doc, k))
        seen.add(part[number[t]])
    return out


def test_line_dedup_brute_force(spark, docs):
    from loomscape.llm.line_dedup import SHINGLE, dropped_lines

    assert SHINGLE <= 7  # 60 characters of which one is changed stay alike
    line = "the quick brown fox jumps over the lazy dog and goes home to the wood"
    odd = ["Ein Wort über die Größe der Bäume im Wald", "ein wort ÜBER die größe der bäume im wald", "日本語の行は短い", "\u3000日本語の行は短い", "ab", "AB ", "abc", " ", "\U0001f600" * 7, "\U0001f600" * 9]
    texts = {r["doc_id"]: r["text"] or "" for r in docs} | {10**6: "\n".join(odd), 10**6 + 1: line, 10**6 + 2: "x\n" + line.replace("dog", "dig")}
    want = lines_to_drop(texts, SHINGLE)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, k) for r in dropped_lines(table).collect() for k in r.dropped}
    assert got <= want  # links that bands miss can but leave lines
    assert len(got) >= 0.99 * len(want) and {(10**6 + 2, 1), (10**6, 1), (10**6, 5), (10**6, 9)} <= got


def test_line_dedup_recall(spark):
    from loomscape.llm.line_dedup import dropped_lines

    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz      ")
    rows = []
    for i in range(1500):
        line = "a" + "".join(rng.choice(letters, 58)) + "z"
        at = int(rng.integers(12, 48))
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "#" + line[at + 1 :])]  # one of 60 characters is another
    got = [r.doc_id for r in dropped_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert all(i % 2 for i in got) and len(got) >= 0.9 * 1500


def test_line_dedup_compares_few(spark, monkeypatch):
    from loomscape.llm import line_dedup

    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for i in range(20):  # groups of 30 lines, each two of which are alike
        line = "".join(rng.choice(letters, 300))
        rows += [(100 * i + k, line[: (at := int(rng.integers(0, 300)))] + "#" + line[at + 1 :]) for k in range(30)]
    counts = []
    cut = line_dedup.materialize

    def counted(df, name="cut"):
        out = cut(df, name)
        counts.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dropped_lines(table).collect()}
    assert got == {d for d, _ in rows if d % 100}
    assert sum(counts) < 2 * 20 * 29 and len(counts) <= 2  # not all 435 pairs of a group, and no rounds of centres


def test_line_hashes_are_of_two_kinds(spark):
    from loomscape.llm.line_dedup import _lines

    rows = _lines(spark.createDataFrame([(1, "one\ntwo words")], "doc_id long, text string"))
    assert rows.where(F.xxhash64("line", F.lit(1)) == F.col("h2")).count() == 0  # that one follows from h1


def test_affine_bands():
    from loomscape.llm.line_dedup import affine_bands

    for side in (2, 4, 8):
        bands = affine_bands(side)
        assert len(bands) == side * (side + 1) and all(len(set(b)) == side for b in bands)
        assert all(len(set(a) & set(b)) <= 1 for i, a in enumerate(bands) for b in bands[:i])


def test_line_dedup_awkward(spark, awkward):
    from loomscape.llm.line_dedup import dedup_lines, line_report

    named = awkward.withColumns({"dropped": F.lit(1), "part": F.lit("x"), "_doc": F.lit(2.0)})
    left = dedup_lines(named)
    assert left.dtypes == named.dtypes and left.count() == awkward.count()
    text = {r.doc_id: r.text for r in left.where("doc_id <> 4").collect()}
    assert text[1] is None and text[2] == "" and text[5] == "" and text[6] == "" and text[8] == "one"
    assert text[7].count("long") == 30
    report = {r.doc_id: tuple(r)[1:] for r in line_report(awkward).collect()}
    assert report[1] == report[3] == (0, 0, []) and report[5] == (1, 1, [0]) and report[7][:2] == (2000, 1999)
    assert dedup_lines(awkward.where("false")).count() == 0 and line_report(awkward.where("false")).count() == 0
    long = spark.createDataFrame([(1, "x" * 300_000 + "\n" + "".join(f"{i} " for i in range(200_000))), (2, "y\n" + "".join(f"{i} " for i in range(200_000)) + "z")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in line_report(long).collect()} == {1: [], 2: [1]}


PAGES = [
    ("<html><body><nav><ul><li>Menu<li>Home</ul></nav><article><h1>T &amp; U</h1><p>One\n  two<br>three<p>four</article><footer>F</footer>", "T & U\nOne two three\nfour"),
    ("<main><p>m</p><div id='comments'><article class='comment'><p>no</p></article></div><aside>s</aside><p>n", "m\nn"),
    ("<article><p class='ad'>buy</p><p>x</p><script>if(a<b){'</p>'}</script><section class=comments><p>c</p></section><form>q</form><p>y &lt;b&gt;", "x\ny <b>"),
    ("<article><p>a <b>bold</b> and <i>more</i> text<p>see <span class='ad'>buy</span> this <a class=share href='#'>share", "a bold and more text\nsee this"),
    ("<div class='cookie-notice'>ok?</div><div>only <i>text</i></div>", "only text"),
    ("<article><header><h1>Title</h1></header><p>A <em class='social'>social</em> science, <b class='ad-free'>ad free</b><div class='notice-period'>a notice period</div><div class='share-buttons'>tweet</div><footer>f</footer>", "Title\nA social science, ad free\na notice period"),
    ("</b></i></section>" * 3000 + "<b>" * 3000 + "deep" + "</i></u>" * 3000, "deep"),
    (None, ""),
    ("", ""),
    ("plain < 5 & more", "plain < 5 & more"),
]


def test_html_cases(spark):
    from loomscape.llm.html_text import extract_text

    rows = spark.createDataFrame([(i, f"http://h{i}.org/", p, 1) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert extract_text(rows.where("false")).count() == 0


def test_html_repeated_runs(spark):
    from loomscape.llm.html_text import extract_text

    foot = "<div>all pages of this site say the very same words down here always</div>"
    rows = [(i, "http://one.org/x", f"<div>page {i} has a text of its own number {i * i}</div>{foot}") for i in range(6)]
    rows.append((6, "http://two.org/", foot))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"page {i} has a text of its own number {i * i}" for i in range(6))
    assert got[6] == "all pages of this site say the very same words down here always"


def test_html_menus_and_copies(spark):
    from loomscape.llm.html_text import extract_text

    menu = "<nav>" + " ".join(f"menu{k}" for k in range(20)) + "</nav>"
    foot = "<div>all pages of this site say the very same words down here always</div>"
    own = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(4)]
    rows = [(i, f"http://one.org/{i}", f"{menu}<div>{t}</div>{foot}") for i, t in enumerate(own)]
    rows += [(10 + i, "http://two.org/copy", f"<div>{own[0]}</div>") for i in range(5)]
    rows += [(20 + i, "http://three.org/", f"<article>{t}</article>{foot}") for i, t in enumerate(own[:2])]
    rows.append((22, "http://three.org/", f"<div>{own[2]}</div>{foot}"))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(own)), **{10 + i: own[0] for i in range(5)}, **{20 + i: own[i] for i in range(3)}}


def test_html_repeats_within_articles(spark):
    from loomscape.llm.html_text import extract_text

    note = "please accept that this site of ours keeps some small files on your machine"
    own = [" ".join(f"p{i}w{k}" for k in range(30)) for i in range(6)]
    shared = " ".join(f"s{k}" for k in range(20))  # in articles only: a text, no boilerplate
    rows = [(i, "http://one.org/x", f"<div class=cookie>{note}</div><article><p>{own[i]}</p><p>{shared}</p></article>") for i in range(4)]
    rows += [(4, "http://one.org/y", f"<article><p>{note}</p><p>{own[4]}</p></article>"), (5, "http://two.org/", f"<main><p>{note}</p><p>{own[5]}</p></main>")]
    rows += [(6, "http://one.org/z", f"<main><p>{note}</p><p>Short.</p><p>{own[5]}</p></main>"), (7, "http://one.org/z", f"<div><p>{note}</p><p>Short.</p><p>{own[5]}</p></div>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    # a marked article is whole, even where it says what stands beside others
    want = {i: f"{own[i]}\n{shared}" for i in range(4)} | {4: f"{note}\n{own[4]}", 5: f"{note}\n{own[5]}", 6: f"Short.\n{own[5]}", 7: f"Short.\n{own[5]}"}
    for most in (2_000_000, 0):  # by broadcast, by join
        assert {r.page_id: r.text for r in extract_text(table, most_runs=most).collect()} == want


def test_html_longest_repeats_brute_force(spark):
    from loomscape.llm.html_text import MIN_PAGES, RUN, extract_text

    rng = np.random.default_rng(9)
    parts = [" ".join(f"b{j}x{k}" for k in range(int(rng.integers(4, 30)))) for j in range(12)]  # shared, some too short
    pages = {}
    for i in range(40):
        blocks = [" ".join(f"u{i}y{j}z{k}" for k in range(int(rng.integers(3, 25)))) for j in range(3)] + [parts[j] for j in rng.integers(0, 12, 3)]
        blocks += [" ".join([parts[int(rng.integers(0, 12))], *(f"v{i}q{k}" for k in range(int(rng.integers(1, 40))))])]
        pages[i] = (f"http://h{i % 2}.org/{i}", [blocks[j] for j in rng.permutation(len(blocks))])
    want = {}
    for i, (url, blocks) in pages.items():
        hosts = [[x.split() for x in b] for u, b in pages.values() if u[:13] == url[:13]]
        left = []
        for b in blocks:
            words, covered = b.split(), set()
            for s in range(len(words)):  # the longest substring of the block from here that stands on enough pages
                best = 0
                for n in range(RUN, len(words) - s + 1):
                    if sum(any(w[k : k + n] == words[s : s + n] for w in h for k in range(len(w) - n + 1)) for h in hosts) < MIN_PAGES:
                        break
                    best = n
                covered.update(range(s, s + best))
            if 2 * len(covered) < len(words):
                left.append(b)
        want[i] = "\n".join(left)
    table = spark.createDataFrame([(i, u, "".join(f"<div>{b}</div>" for b in bs)) for i, (u, bs) in pages.items()], "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in extract_text(table).collect()} == want


WRAPPED = [
    "<aside>{}</aside>", "<nav>{}</nav>", "<div hidden>{}</div>", "<div class='related'>{}</div>", "<div class='advert'>{}</div>", "<section class='post-comments'>{}</section>",
    "<div class='comment-respond'>{}</div>", "<ol class='commentlist'>{}</ol>", "<div class='newsletter-form'>{}</div>", "<div class='cookie-policy'>{}</div>", "<div class='site-header'>{}</div>",
    "<div class='site-footer'>{}</div>", "<ul class='main-nav'>{}</ul>", "<aside data-u=/x/>{}</aside>", "<article class='advert'>{}</article>",
]


@pytest.mark.parametrize("wrapper", WRAPPED)
def test_html_wrappers_win_over_what_they_hold(wrapper):
    from loomscape.llm.html_text import BOILERPLATE, page_blocks

    teaser = wrapper.format("<article><h3>teaser</h3><p>of another</p></article>")
    for page in (f"<article><p>main text</p></article>{teaser}", f"<article><p>main text</p>{teaser}</article>", f"{teaser}<article><p>main text</p></article>"):
        found = page_blocks(page)
        assert [t for k, t in found if k == 0] == ["main text"] and {k for k, t in found if t != "main text"} == {BOILERPLATE}


def test_html_kept_parts():
    from loomscape.llm.html_text import page_blocks

    page = "<form id=aspnetForm><input><article><div class='post-header'><h1>T</h1></div><p>let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> hold</p><xmp>a &amp; <b></xmp><p>end</p></article><button>Go</button></form>"
    assert [t for k, t in page_blocks(page) if k == 0] == ["T", "let x<2 hold", "a &amp; <b>", "end"]
    long = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>"
    assert page_blocks(long) == [(0, "word & word")] * 100_000


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.1"])
def test_html_pages(spark, sf_dir):
    import html

    want = {}
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    assert {r.page_id: r.text for r in Q.op4_html_text(spark, sf_dir).collect()} == want


def test_suffix_classes():
    from loomscape.llm.html_text import suffix_classes

    rng = np.random.default_rng(5)
    tokens, at = rng.integers(0, 3, 400).astype(np.uint64), np.array([0, 90, 95, 250, 400])
    rank = suffix_classes(tokens, at, 5)
    where = {}
    for i in range(400):
        end = at[np.searchsorted(at, i, side="right")]
        assert (rank[i] < 0) == (i + 5 > end)
        if rank[i] >= 0:
            assert where.setdefault(tuple(tokens[i : i + 5]), rank[i]) == rank[i]
    assert len(set(where.values())) == len(where)


def test_decontamination_brute_force(spark, docs):
    windows = collections.defaultdict(set)
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = ALNUM.findall(low(r["text"]))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    want = {}
    for r in docs:
        w, hit, items = ALNUM.findall(low(r["text"])), set(), set()
        for m in set(map(len, windows)):
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    items |= windows[tuple(w[k : k + m])]
        want[r["doc_id"]] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    assert {r.doc_id: tuple(r)[1:] for r in Q.op5_benchmark_decontamination(spark, SF).collect()} == want


@pytest.mark.parametrize("most", [3, 1000])
def test_decontamination_awkward(spark, awkward, most):
    from loomscape.llm.decontamination import contamination, digests, drop_contaminated

    items = spark.createDataFrame([(1, "w3 w4 W5"), (2, " ".join(f"w{i}" for i in range(20, 33))), (3, None), (4, "!!"), (None, "one"), (2, "w3 w4 w5"), (5, "absent words here")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in digests(contamination(awkward, items, max_windows=most)).collect()}
    assert got[1] == got[2] == (0, 0, 0) and got[4] == (40, 16, 2) and got[6] == (40, 16, 2) and got[8] == (1, 1, 0)
    assert drop_contaminated(awkward, items).columns == awkward.columns
    assert digests(contamination(awkward, items.where("false"))).where("contaminated").count() == 0


def test_license_scan(spark, docs):
    phrases = {tuple(p.split()): label for p, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items()}
    want = {}
    for r in docs:
        w = ALNUM.findall(low(r["text"]))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        want[r["doc_id"]] = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    rows = Q.op6_license_scan(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_license_templates(spark, awkward):
    from loomscape.llm.licenses import scan_licenses

    rows = spark.createDataFrame([(1, "x\nReleased under the MIT Licence, MIT license."), (2, "all rights are reserved now"), (3, "rights reserved"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in scan_licenses(rows).collect()}
    assert got[1] == ("mit", "mit", 1.0) and got[2] == ("", "all-rights-reserved", 1.0) and got[3] == ("", "", 0.0) and got[4] == ("", "", 0.0)
    assert scan_licenses(awkward).count() == awkward.count()


def test_license_wrapped(spark):
    from loomscape.llm.licenses import TEMPLATES, scan_licenses

    rows, want = [], {}
    for text, label in TEMPLATES.items():
        w = text.split()
        for width in (3, 5, 8):
            want[len(rows)] = label
            rows.append((len(rows), "some words before\n# " + "\n# ".join(" ".join(w[k : k + width]) for k in range(0, len(w), width)) + "\nand more behind"))
    half = "Redistribution and use in source and binary forms, with or".split()
    rows += [(1000, "\n".join(half)), (1001, "\n".join(half[:5] + ["far"] * 40 + "modification are permitted provided that the following conditions are met".split()))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i][0] and got[i][1] == 1.0 for i, label in want.items())
    assert got[1000] == got[1001] == ([""], 0.0)


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards_round_trip(spark, docs):
    start, want = 0, {}
    for r, ids in zip(docs, ids_of("byte_bpe_50k.json", [r["text"] for r in docs], 0), strict=True):
        want[r["doc_id"]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in Q.op7_token_shards(spark, SF).collect()} == want


def test_encoder_on_odd_texts():
    import random

    from loomscape.llm.tokens import Encoder

    rng = random.Random(1)
    texts = [None, "", " ", "\n", " a  b \n\n c", "don't I'll 'S it's", "foo\n", "x1y2 33", "naïve ÀÉ×÷ù…", "日本語 é ́x", "<|endoftext|> a", "B<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>", "a" * 3000, "ΑΣ Σ \x00\x1c a\xa0b"]
    texts += ["".join(rng.choice(" \n\taB1.'é×ßñ,$%…'ñ́日") for _ in range(50)) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        got = []
        for b in Encoder.of(tokenizer_path(name)).blocks(pa.array(texts)):
            got += [b.ids[s:e].tolist() for s, e in zip(b.at[:-1], b.at[1:], strict=True)]
        assert got == [x[:-1] for x in ids_of(name, texts, 0)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):  # begins anew again and again
        got = []
        for b in Encoder(tokenizer_path(name), bits=9).blocks(pa.array(texts)):
            got += [b.ids[s:e].tolist() for s, e in zip(b.at[:-1], b.at[1:], strict=True)]
        assert got == [x[:-1] for x in ids_of(name, texts, 0)]


def test_encoder_on_long_texts():
    import random

    from loomscape.llm.tokens import Encoder

    rng = random.Random(2)
    words = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(260_000))  # far more pieces than slots
    texts = [words, "a", "é" * 30_000 + words[:10_000] + "日本" * 20_000, "x <|endoftext|> " + words[:50_000] + "<|ENDOFTEXT|>", " <|startoftext|>A<|endoftext|>B"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [x[:-1] for x in ids_of(name, texts, 0)]
        for bits in (12, 22):
            got = []
            for b in Encoder(tokenizer_path(name), bits=bits).blocks(pa.array(texts)):
                got += [b.ids[s:e].tolist() for s, e in zip(b.at[:-1], b.at[1:], strict=True)]
            assert got == want


def test_wavelet_matrix():
    from loomscape.llm.wavelet import WaveletMatrix, encode

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 511, 512, 513, 3000):
        x = (rng.zipf(1.3, n) % 50257).astype(np.uint16)
        w = WaveletMatrix(encode(x))
        assert (w.to_numpy() == x).all() and len(w) == n
        for i in rng.integers(0, n, 10) if n else []:
            token = int(x[i])
            assert w.access(int(i)) == token and w.count(token) == (x == token).sum() and w.rank(token, int(i)) == (x[:i] == token).sum()
            assert w.occurrences(token) == np.flatnonzero(x == token).tolist()
        assert w.count(60000) == 0 and w.select(60000, 0) == -1


def test_lm_scores_order(spark):
    from loomscape.llm.lm_scoring import fit, pseudo_likelihood, score

    line = "the cat sat on the mat and then the dog sat on the rug because it was warm there "
    rows = [(i, " ".join((line * 3).split()[i % 5 :]), 0) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4)
    net = fit(table, words=24, buckets=4, rounds=3)
    mixed = table.withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    a = score(table, net).agg(F.avg("mean_log_likelihood")).first()[0]
    b = score(mixed, net).agg(F.avg("mean_log_likelihood")).first()[0]
    assert a > b + 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.mean_log_likelihood) for r in pseudo_likelihood(odd, words=4, buckets=2).collect()}
    assert got[1] == got[2] == (0, None) and got[3][0] == 1 and got[3][1] < 0
    assert pseudo_likelihood(odd.where("false")).count() == 0


def test_lm_scores_words_not_buckets(spark):
    from loomscape.llm.lm_scoring import fit, score

    rows = [(i, "the cat often" if i % 4 == 1 else f"the cat once{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = fit(table, words=2, buckets=1)
    own = {r.doc_id: r.log_likelihood for r in score(table, model).collect()}
    assert all(abs(own[1] - own[i] - np.log(15)) < 1e-4 for i in range(0, 60, 2)) and len(own) == 60
    assert abs(sum(np.exp(r.share) for r in model.shares.collect()) - 1) < 1e-9
    new = score(spark.createDataFrame([(1, "the cat gibberish"), (1, "the cat gibberish")], "doc_id int, text string"), model).collect()
    assert len(new) == 2 and all(r.log_likelihood < min(own.values()) - 0.5 for r in new)


def test_lm_vocabulary_grows(spark):
    from loomscape.llm.lm_scoring import fit

    text = " ".join(f"w{i}" for i in range(1100))
    small, large = (spark.createDataFrame([(text,)] * n, "text string") for n in (3, 4500))
    assert fit(small, rounds=1).network.classes == 960 + 64
    assert fit(large, rounds=1).network.classes == 1100 + 64


def test_lm_two_levels():
    from loomscape.llm.lm_scoring import new_network

    rng = np.random.default_rng(1)
    net = new_network(np.zeros(0, np.uint64), rng.integers(0, 9, 11), width=5)
    near = rng.integers(0, 12, (4, 40))
    net.low[:] = rng.normal(0, 1, net.low.shape)
    every = np.stack([net.log_probabilities(near, np.full(40, k)) for k in range(11)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)  # over all classes
    for i in range(40):  # word for word, by the definition
        h = np.tanh(net.shift + sum(net.seen[k][near[k, i]] for k in range(4)))
        for k in range(11):
            g, m = divmod(k, net.size)
            a, b = h @ net.top + net.top_bias, h @ net.low[g] + net.low_bias[g]
            assert abs(a[g] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum()) - every[k, i]) < 1e-4


def test_lm_slopes():
    from loomscape.llm.lm_scoring import new_network, train

    rng = np.random.default_rng(2)
    target, near = rng.integers(0, 10, 50), rng.integers(0, 11, (4, 50))
    make = lambda: new_network(np.zeros(0, np.uint64), np.arange(10), width=3)
    net, loss = make(), lambda n: -n.log_probabilities(near, target).mean()
    moved = make()
    train(moved, iter([(near, target)]), rate=1e-4)  # one step: rate * slope / sqrt(1e-3 + slope ** 2)
    for p, q in zip(net.parameters(), moved.parameters(), strict=True):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 12)]:
            step, own = 2e-2, p[at]
            p[at] = own + step
            up = loss(net)
            p[at] = own - step
            slope = (up - loss(net)) / (2 * step)
            p[at] = own
            assert abs((own - q[at]) - 1e-4 * slope / np.sqrt(1e-3 + slope**2)) < 2e-6


def test_lm_gradient():
    from loomscape.llm.lm_scoring import new_network, train

    rng = np.random.default_rng(0)
    target = rng.integers(0, 6, 4000)
    near = np.stack([np.roll(target, -o) for o in (-2, -1, 1, 2)])
    near[1] = (target + 1) % 6  # the word before tells the word
    net = new_network(np.zeros(0, np.uint64), np.ones(6))
    before = net.log_probabilities(near, target).mean()
    for _ in range(30):
        train(net, iter([(near, target)]))
    assert net.log_probabilities(near, target).mean() > before + 1


def test_packing(spark, docs):
    want = {}
    for r, ids in zip(docs, ids_of("word_bpe_49k.json", [r["text"] for r in docs], 1), strict=True):
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k] = (s, len(ids[s : s + 4096]), crc(ids[s : s + 4096]))
    rows = Q.op9_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in map(sorted, held.values()):
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)])[:-1].tolist() and sum(n for _, n in pieces) <= 4096
    assert len(held) <= -(-sum(r.length for r in rows) // 4096) + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


@pytest.mark.parametrize("low, high, many", [(1, 101, 3000), (40, 61, 500), (100, 101, 50), (1, 3, 900), (30, 36, 1000), (51, 52, 7)])
def test_sweeps(spark, low, high, many):
    from loomscape.llm.packing import pack

    lengths = np.random.default_rng(4).integers(low, high, many).tolist()
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").withColumn("piece", F.lit(0)).repartition(4)
    held = collections.defaultdict(list)
    for r in pack(table, 100).collect():
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(n for x in held.values() for _, n in x) == sorted(lengths)
    for x in map(sorted, held.values()):  # gapless and not too long
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x)])[:-1].tolist() and sum(n for _, n in x) <= 100
    assert len(held) <= 1.03 * best_fit_decreasing(lengths, 100) + 1


def test_packing_awkward(spark, awkward):
    from loomscape.llm.packing import pack_documents

    named = awkward.withColumns({"length": F.lit(1), "offset": F.lit("x"), "sequence_id": F.lit(None).cast("string")})
    rows = pack_documents(named, tokenizer_path("word_bpe_49k.json")).collect()
    whole = collections.Counter(r.doc_id for r in rows if not r.piece)
    assert whole == collections.Counter(r.doc_id for r in awkward.collect())
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1} and len([r for r in rows if r.doc_id == 7]) > 10
    assert pack_documents(awkward.where("false"), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_shards_awkward(spark, awkward):
    from loomscape.llm.token_output import round_trip

    rows = sorted(round_trip(awkward.withColumns({"start": F.lit(1), "part": F.lit("x")}), tokenizer_path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in awkward.collect())
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert round_trip(awkward.where("false"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_quality_base(spark, docs):
    want = {}
    for r in docs:
        t = r["text"] or ""
        w = SPACED.findall(t)
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want[r["doc_id"]] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))
    rows = Q.op10_quality_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_keeps_clean_and_rejects_junk(spark):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = [r for r in Q.op10_quality_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in label and not r.base_failed]
    assert all(r.kept for r in rows if label[r.doc_id])
    junk = [r.kept for r in rows if not label[r.doc_id]]
    assert sum(junk) <= 0.15 * len(junk)


def test_quality_outliers_do_not_mask(spark):
    from loomscape.llm.quality import quality_rules

    rng = np.random.default_rng(7)
    rows = []
    for i in range(200):
        w = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(120)]
        if i >= 120:  # two in five
            for k in range(int(rng.integers(20, 60))):
                w[k] = "#" * int(rng.integers(1, 4)) + w[k].upper()
        rows.append((i, " ".join(w), "en", "s"))
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(120, 200))


def test_quality_steps_end_by_group(spark, monkeypatch):
    """A group whose determinant falls no more takes no further step, though approximate
    bounds would let determinants swing for good."""
    from pyspark.sql import functions as F

    from loomscape.llm import quality

    draw = lambda seed: F.floor(F.rand(seed) * 400 + F.rand(seed + 9) * 400).cast("long")
    counts = {"n_words": F.lit(400).cast("long") + draw(1), "word_chars": 3000 + 9 * draw(2), "n_symbols": draw(3), "n_dup_lines": draw(4) % 40, "n_repeat_words": draw(5) % 90, "n_lines": 40 + draw(6), "n_capitals": draw(7)}
    rows = spark.range(60000).select("id", F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.struct(*(c.alias(n) for n, c in counts.items())).alias("_m"))
    steps = []
    materialize = quality.materialize

    def counted(df, name="cut"):
        out = materialize(df, name)
        if name == "bounds":
            steps.append(out.count())
        return out

    monkeypatch.setattr(quality, "materialize", counted)
    assert quality.judge(rows).where("distance IS NULL").count() == 0
    assert steps[0] == 2 * (21 + 3 + 1)
    assert len(steps) < 20 and steps[-1] < steps[0]


def test_quality_awkward(spark, awkward):
    from loomscape.llm.quality import keep_good, quality_rules

    assert quality_rules(awkward).count() == awkward.count()
    left = keep_good(awkward)
    assert left.columns == awkward.columns and left.dtypes == awkward.dtypes
    assert keep_good(awkward.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        assert at.columns == columns, name
    want = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == want
