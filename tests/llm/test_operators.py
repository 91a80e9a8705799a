import random
import zlib
from collections import Counter
from unittest.mock import Mock, patch

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import common, decontam, html_text, jaccard, langid, line_dedup, lm, mixing, quality, search, tokens, words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make_docs(spark, rows):
    """rows of (doc_id, text, lang, source); extra columns clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "n": F.lit("x"), "rep": F.lit(1), "component": F.lit(2), "size": F.lit("s"), "p": F.lit(0.5)})


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "word", "en", "a"), (4, long, "en", "b"), (5, long, "fr", "b"), (5, long, "fr", "b"), (None, "no id here at all", None, "c"), (7, "  \n\t ", "en", ""), (8, "1234 !!!", "en", "c"), (9, "Ünïcödé \U0001f600 text", "de", "c")]
    return make_docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make_docs(spark, [])


# --- shared pieces


@given(st.lists(st.text(alphabet="aB \t\n\x0bé .", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_hashed_words(texts):
    hashes, bounds = words.hashed_words(texts)
    plain = [t.encode().lower().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 3)] + [(100 + k, 101 + k) for k in range(40)], "a long, b long")
    got = dict(map(tuple, common.connected_components(edges).collect()))
    assert {k: v for k, v in got.items() if k < 50} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4} and {got[k] for k in range(100, 141)} == {100}


def test_id_filter(spark):
    ids = spark.range(0, 5000, 7).select("id")
    bits = common.id_filter(ids)
    assert common.passes(bits, np.arange(0, 5000, 7)).all() and common.passes(bits, np.arange(10**6, 10**6 + 5000)).mean() < 0.01


# --- op1


def test_mixing_targets_and_balance(spark):
    docs = make_docs(spark, [(i, prose(i, 5 + i % 60), "en", f"s{i % 4}" if i % 9 else None) for i in range(600)])
    got = mixing.balanced_mix(docs).toPandas()
    again = mixing.balanced_mix(docs).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == 600
    total = got["size"].sum()
    by = got.groupby(got["source"].fillna("~")).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    size, weight = by["size"].to_numpy(float), np.array([3, 1, 2, 3, 1][: len(by)], float)
    want, capped = np.zeros(len(by)), np.zeros(len(by), bool)
    for _ in range(10):
        rest = 1.5 * total - (2 * size[capped]).sum()
        want = np.where(capped, 2 * size, rest * weight / weight[~capped].sum())
        capped |= want > 2 * size
    assert np.allclose(by["target"], want) and (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 1).all()
    assert mixing.apply_mix(docs, mixing.balanced_mix(docs)).count() == got["copies"].sum()


def test_mixing_of_large_documents_meets_targets(spark):
    rng = random.Random(8)
    sizes = [rng.choice([3, 700, 2600, 5200, 9000]) + rng.randint(0, 400) for _ in range(240)]
    docs = spark.createDataFrame([(i, "w " * n, f"s{i % 4}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.balanced_mix(docs).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(0.01 * g["target"].iloc[0], g["size"].min() / 2)
    assert (got["taken"] <= 2 * got["size"]).all()


@given(st.lists(st.integers(0, 20_000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_ladder(sizes):
    got = mixing.ladder([float(x) for x in sizes])
    assert len(set(got)) == len(got) == min(len(sizes), mixing.LANDING)
    assert not got or sizes[got[0]] == max(sizes)


def test_mix_tells_null_and_empty_sources_apart(spark):
    rows = [(1, "a b c", None), (1, "a b c", ""), (2, "d e", ""), (None, "x y", None), (2, "d e", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.balanced_mix(docs)
    want = Counter()
    for r in mix.collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.apply_mix(docs, mix).collect()) == +want


def test_mixing_odd(odd, none):
    got = mixing.balanced_mix(odd).toPandas()
    assert len(got) == 10 and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.apply_mix(odd, mixing.balanced_mix(odd)).columns == odd.columns
    assert mixing.balanced_mix(none).count() == 0


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.floats(0.05, 0.95))
@settings(max_examples=80, deadline=None)
def test_flight_keeps_totals(sizes, p):
    out = mixing.flight([p] * len(sizes), [float(x) for x in sizes], np.random.default_rng(0))
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - p * len(sizes)) < 1e-5 and abs(np.dot(out, sizes) - p * sum(sizes)) < 1e-3


# --- op2


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_is_exact(spark):
    rng = random.Random(4)
    items = [prose(100 + k, 9) for k in range(12)]
    rows = []
    for i in range(60):
        item = list(items[i % 12])
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice([[], ["q"], [item[k], "z"]])
        rows.append((i, prose(i, 20) + " " + "".join(item).upper() + " " + prose(i + 500, 10), "en", "a"))
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (92, items[0]), (93, "tiny")], "item_id long, text string")
    docs = make_docs(spark, rows + [(70, "tiny", "en", "a"), (71, "a tiny text", "en", "a")])
    got = {(r.doc_id, m.item_id): m.distance for r in decontam.mark(docs, bench).collect() for m in r.matches}
    want = {}
    for i, text, _, _ in rows:
        for k, item in enumerate(map(decontam.normal, items)):
            d = distance_in(item, decontam.normal(text))
            if d <= int(len(item) * decontam.ERROR_RATE):
                want[i, k] = d
    assert got == want | {(70, 93): 0} and len(want) > 20


def test_short_items_are_found_at_word_bounds(spark):
    bench = spark.createDataFrame([(1, "What is 7 times 8 ok?"), (2, "one"), (3, "is 7 times"), (9, "what is 7 TIMES 8, ok")], "item_id long, text string")
    texts = ["Well: what is 7 times 8, OK? yes", "this is 7 timeshares", "one", "one two", "What is 7 times 8 ok", "what is 7 times 8 okay"]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: sorted((m.item_id, m.distance) for m in r.matches) for r in decontam.mark(docs, bench).collect()}
    assert got == {0: [(1, 0), (3, 0)], 1: [], 2: [(2, 0)], 3: [], 4: [(1, 0), (3, 0)], 5: [(3, 0)]}


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontam.mark(odd, bench).where("size(matches) > 0").count() == 0 and decontam.mark(none, bench).count() == 0


# --- op3


def test_quality(spark):
    rng = random.Random(3)
    bad = lambda i: " ".join(w + "###" for w in prose(i, rng.randint(20, 60)).split())
    docs = make_docs(spark, [(i, prose(i, rng.randint(20, 60)) if i % 3 else bad(i), "en", "a") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels, langid.fold("doc_id", 5) != 0).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    assert ((held["score"] >= 0.3) == (held["doc_id"] % 3 > 0)).mean() > 0.95 and got["score"].between(0, 1).all()


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score_quality(odd, labels, F.lit(True)).collect())
    assert quality.score_quality(none, labels, F.lit(True)).count() == 0
    assert quality.score_quality(odd, labels.limit(0), F.lit(True)).first().score == pytest.approx(0.5)


# --- op4


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 24)).astype(np.float32)
    v[17] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(401, None), (402, []), (403, [None] * 24), (404, [float("nan")] * 24), (450, [1e10] * 24), (None, [1.0] * 24), (7, [0.5] * 3), (100, [float(x) for x in v[3]]), (100, [-1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and None not in e and not any(np.isnan(e))]
    want = []
    for at, (q, a) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for k, (i, b) in enumerate(ok) if k != at)[:5]
            want += [(q, k + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_counts_empty_vectors(spark):
    df = spark.createDataFrame([(50, [-1.0]), (1, []), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in search.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("rank").collect()] == [(1, 1, 0), (2, 2, -65536)]


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


# --- op5


def test_html():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
    <header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-notice">Cookies</div><!-- c --><main><h1>Big&nbsp;News</h1>
    <p>One <b>bo</b>ld &amp; true<p>Two<br>lines<div class="ad-slot">Buy</div><form>Name <input></form><aside>Side</aside>
    <table><tr><td>a<td>b</table><section id="reader-comments">First!</section></main><footer>&copy; me</footer><p>tail<foo"""
    assert html_text.extract(page) == "Big News One bold & true Two lines a b"
    assert html_text.extract('<div class="layout no-sidebar"><p>kept</p></div>') == "kept" and html_text.extract('<div class="post has-comments">kept<div class="comments">gone</div></div>') == "kept"
    assert html_text.extract('<div id="page-menu"><p>all there is</p><div class="ad">gone</div></div>') == "all there is"
    assert html_text.extract("</b>" * 20_000 + "<p>x") == "x"
    assert html_text.extract("") == "" and html_text.extract("just text &lt;") == "just text <" and html_text.extract("<p>" * 5000 + "x") == "x"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="post-comments-enabled"><p>The article</p></div><p>short foot</p>', "The article short foot"),
        ('<div id="main-menu-wrapper"><p>a b c d</p></div>c', "a b c d c"),
        ('<article class="promo-article"><p>art text here</p></article>x', "art text here"),
        ('<div class="widget-content"><p>one two three</p></div>Copyright', "one two three Copyright"),
        ('<body><form><p>one two</p><p>three</p><input></form></body>', "one two three"),
        ("<form id=f><div><h1>T</h1>words of it</div></form>", "T words of it"),
        ("<form>Name</form>", ""),
        ("<form><label>Name</label></form><p>x</p>", "x"),
        ("<main>a</main><article>b</article>", "a b"),
        ("<h1>T</h1><article>b</article>", "T b"),
        ('<main>one two<div class="ad-slot">Buy now</div><div class="comments-area">x y z u v w</div></main>', "one two"),
        ('<div class="menu-box"><a>l l l l l l</a></div><p>short</p>', "short"),
    ],
)
def test_doubtful_elements_are_weighed(page, text):
    assert html_text.extract(page) == text


def test_templates(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>Welcome to the shop</p></div><p>{prose(i, 20)}</p></body>") for i in range(12)]
    copies = [(100 + i, f"http://k.example/{i}", f"<body><p>{prose(7, 20)}</p></body>") for i in range(12)]
    odd = [(200, None, None), (201, "x", ""), (None, "http://h.example/z", "<p>only")]
    df = spark.createDataFrame(pages + copies + odd, "page_id long, url string, html string").withColumn("hashes", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    assert got == {i: prose(i, 20) for i in range(12)} | {100 + i: prose(7, 20) for i in range(12)} | {200: "", 201: "", None: "only"}
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# --- op6


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80)])
def test_jaccard_is_exact(spark, width, num):
    rng = random.Random(width)
    rows, base = [], [prose(1000 + k, 60).split() for k in range(6)]
    for i in range(240):
        text = list(base[i % 6])
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"new{rng.randint(0, 3)}"
        rows.append((i, " ".join(text[: rng.choice([60, 60, 58, 2, 1])]), "en", "a"))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (None, rows[0][1], "en", "a"), (903, "Alpha  BETA", "en", "a"), (904, "alpha beta", "en", "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.JaccardJoin(make_docs(spark, rows), width, num, 100).link().collect() if r.doc_id is not None}
    sets = {}
    for i, t, _, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    part = {i: i for i in sets if i is not None}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in part:
        for b in part:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert got == {i: (len(sets[i]), root(i)) for i in part}


@pytest.mark.parametrize("num, shared, own, more", [(90, 63, 1, 6), (80, 20, 1, 4)])
def test_jaccard_inner_sizes(spark, num, shared, own, more):
    """A link to a member whose size is inside its group's range: 64 to 69 among 68, 69, 70 at 0.9; 21 to 24 among 23, 24, 25 at 0.8."""
    names = sorted((f"w{k}" for k in range(200)), key=lambda w: int(words.shingle_sets([w], 1)[0][0]))
    x_own, y_own, both = names[:own], names[own : own + more + 1], names[50 : 50 + shared]
    rows = [(1, x_own + both), (2, y_own[:more] + both), (3, y_own[:more] + both[:-1]), (4, y_own + both)]
    docs = make_docs(spark, [(i, " ".join(t), "en", "a") for i, t in rows] + [(9, "far away", "en", "a")])
    got = {r.doc_id: r.component_id for r in jaccard.JaccardJoin(docs, 1, num, 100).link().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_jaccard_least_need(spark, num):
    join = jaccard.JaccardJoin(make_docs(spark, []), 1, num, 100)
    n = spark.range(1, 130).select(F.col("id").alias("n"))
    low, high = f"({num} * n + 99) div 100", f"(100 * n) div {num}"
    rows = n.select("n", F.expr(f"explode(sequence({low}, {high}))").alias("low")).select("n", "low", F.expr(f"explode(sequence(low, {high}))").alias("high"))
    bound = F.expr(join.least_need("n", "low", "high"))
    true = F.expr(f"array_min(transform(sequence(low, high), b -> {join.need('n', 'b')}))")
    assert rows.where(bound != true).count() == 0


def test_overlaps_of_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 200, rng.integers(0, 60))).astype(np.uint64) for _ in range(k)] for k in (7, 9))
    assert jaccard.overlaps(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert jaccard.overlaps([left[0]], [np.zeros(0, np.uint64)]).tolist() == [[0]]


def test_jaccard_odd(odd, none):
    got = {r.doc_id: r.component_id for r in jaccard.JaccardJoin(odd).link().collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 7: 7, 8: 8, 9: 9}
    assert jaccard.JaccardJoin(none).link().count() == 0


# --- op7


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def linked(a, b):
    return abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= line_dedup.edits(min(len(a), len(b)))


@given(st.text(alphabet="ab", max_size=14), st.text(alphabet="ab", max_size=14), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, tau):
    assert line_dedup.within(a, b, tau) == (edit_distance(a, b) <= tau)


@given(st.text(alphabet="ab", min_size=9, max_size=32), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abc-")), max_size=2))
@settings(max_examples=400, deadline=None)
def test_linked_lines_share_a_key(a, changes):
    b = list(a)
    for at, c in changes:
        b[at % len(b) : at % len(b) + (at % 2)] = [] if c == "-" else [c]
        b = b or ["c"]
    a, b = sorted((a, "".join(b)), key=len)
    found = line_dedup.Lines([a, b])
    assert found.sizes.tolist() == [len(a), len(b)] and found.spelled(1) == b
    if a != b and linked(a, b):
        own, more = (list(zip(*(x.tolist() for x in found.keys(np.array([k]))))) for k in (0, 1))
        held = {k for k, who in own if not who & 1}
        assert held & {k for k, _ in more}


@given(st.lists(st.none() | st.text(alphabet="aé \n\t\x1c\u2003\U0001f600", max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_lines_are_cut_like_strings(texts):
    some = [t for t in texts if t is not None]
    found = line_dedup.Lines(some) if some else None
    plain = [line_dedup.lines_of(t) for t in some]
    assert (found.counts if some else []) == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    if some:
        assert [found.spelled(k) for k in range(len(flat))] == flat and [i == 0 for i in found.ids] == [x == "" for x in flat]
        assert len(set(zip(flat, found.ids.tolist()))) == len(set(flat)) == len(set(found.ids.tolist()))


def brute_lines(texts):
    """texts: (order key, text) in order -> for each: kept numbers, links, lines' classes as sets of lines."""
    every = sorted({x for _, t in texts for x in line_dedup.lines_of(t) if x})
    near = {x: {y for y in every if y != x and linked(x, y)} for x in every}
    part = {}
    for x in every:
        seen, todo = {x}, [x]
        while todo:
            todo = [z for y in todo for z in near[y] if z not in seen and not seen.add(z)]
        part[x] = frozenset(seen)
    first, out = set(), []
    for _, t in texts:
        kept, links, classes = [], 0, []
        for k, x in enumerate(line_dedup.lines_of(t)):
            if not x or part[x] not in first:
                kept.append(k)
            if x:
                first.add(part[x])
                links += len(near[x])
            classes.append(part.get(x))
        out.append((len(classes), kept, links, classes))
    return out


def same_lines(spark, rows):
    """kept_lines against brute force; rows of (doc_id, text)."""
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]]))
    want = [(i, n, kept, links) for (i, _), (n, kept, links, _) in zip(ordered, brute_lines(ordered))]
    got = line_dedup.kept_lines(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.doc_id, r.n_lines, r.kept, r.n_links) for r in got), key=key) == sorted(want, key=key)
    names, brute = {}, {}
    for r in got:
        for c in r.classes:
            names.setdefault(c, 0)
    for _, t in rows:
        for x in line_dedup.lines_of(t):
            brute[x] = 1
    assert len(names) == len({c for _, _, _, cs in brute_lines(ordered) for c in cs})
    return docs, ordered


def test_line_dedup_is_exact(spark):
    rng = random.Random(8)
    base = [prose(k, 7) for k in range(15)] + ["short one", "twelve chars", "nineteen characters"]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(6):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(line))
                line[k : k + 1] = rng.choice([[], ["q"], [line[k], "z"]])
            lines.append("".join(line))
        rows.append((i % 70, "\n".join([*lines, "", " "])))
    rows += [(500, None), (None, "x\nx"), (None, base[3] + "!\nx"), (501, ""), rows[5], rows[5]]
    docs, ordered = same_lines(spark, rows)
    out = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    want = Counter((i, None if t is None else "\n".join(line_dedup.lines_of(t)[k] for k in kept)) for (i, t), (_, kept, _, _) in zip(ordered, brute_lines(ordered)))
    assert out == want


def test_line_dedup_in_blocks(spark, monkeypatch):
    """Links inside a class of a bucket with more than SMALL pairs, dealt out in several blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 100)
    rng = random.Random(5)
    base, kinds = prose(77, 6), []
    for _ in range(40):
        line = list(base)
        for k in rng.sample(range(len(line)), rng.randint(0, 2)):
            line[k] = rng.choice("0123456789")
        kinds.append("".join(line))
    same_lines(spark, [(i, "\n".join([kinds[i], "", kinds[(7 * i) % 40], "alone " + prose(i, 8)])) for i in range(40)])


def test_line_dedup_odd(odd, none):
    assert line_dedup.kept_lines(odd).count() == 10 and line_dedup.kept_lines(none).count() == 0


# --- op8


def test_lm(spark):
    docs = make_docs(spark, [(i, prose(i % 40, 30 + i % 7), ("en", "fr", None)[i % 3], "a") for i in range(200)] + [(300, None, "en", "a"), (301, "Zzz never seen", "en", "a")])
    got = {r.doc_id: r for r in lm.score_corpus(docs, langid.fold("doc_id", 7) == 2).collect()}
    rows = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = Counter(w for i, t in rows.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in rows.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    known = [r for r in got.values() if r.n_tokens > 10]
    assert np.mean([r.score > r.base_score for r in known]) > 0.9


def test_lm_odd(odd, none):
    assert lm.score_corpus(odd, F.lit(False)).count() == 10 and lm.score_corpus(odd, F.lit(True)).where("train_tokens = 0 and base_score = 0").count() == 10
    assert lm.score_corpus(none, F.lit(False)).count() == 0


def test_mixing_model_is_a_distribution():
    data, starts, ends = lm.spelled(b" ".join(w.encode() for w in WORDS) + b" ")
    windows, n = np.unique(lm.windows_of(data), return_counts=True)
    model = lm.learn(windows, n)
    for context in (0, windows[5] >> 8, 0x787878):
        every = (np.uint32(context) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert np.exp2(-model.bits(every)).sum() == pytest.approx(1.0, abs=1e-6)
    assert (2.0 ** -model.cost(data)).max() <= 1


def test_all_windows_teach(spark, monkeypatch):
    """Windows of one count, far more than a part or the driver's former share: each is in the tables, in the fit and findable in the cache."""
    monkeypatch.setattr(lm, "MAX_WINDOWS", 100, raising=False)
    monkeypatch.setattr(lm, "PART_WINDOWS", 300, raising=False)
    windows = np.unique(np.random.default_rng(1).integers(0x61616161, 0x7A7A7A7A, 1500))
    rows = spark.createDataFrame([(int(w), 3) for w in windows], "window long, n long").repartition(3)
    model = lm.train(rows)
    assert model.zeros[0].sum() + model.ones[0].sum() == 8 * 3 * len(windows)
    assert (model.bits(windows[:50].astype(np.uint32)) < 8).all() and np.isin(model.keys[model.keys > 0], windows).all()
    assert np.isin(windows, model.keys).mean() > 0.99
    again = lm.train(rows.repartition(5))
    assert (again.weights == model.weights).all() and (again.refine == model.refine).all()


def test_one_part_learns_like_a_table(spark):
    data, _, _ = lm.spelled(b" ".join(w.encode() for w in WORDS) + b" ")
    windows, n = np.unique(lm.windows_of(data), return_counts=True)
    made, plain = lm.train(spark.createDataFrame([(int(w), int(k)) for w, k in zip(windows, n)], "window long, n long").repartition(3)), lm.learn(windows, n)
    assert all((a == b).all() for x, y in ((made.zeros, plain.zeros), (made.ones, plain.ones)) for a, b in zip(x, y))
    assert np.allclose(made.weights, plain.weights) and np.allclose(made.cost(data), plain.cost(data), atol=1e-5)


def test_every_occurrence_teaches_however_documents_are_cut():
    texts = ["alfa beta alfa", "Beta alfa", None, "gamma alfa beta", "alfa", "delta"]
    batch = lambda rows: pa.RecordBatch.from_pydict({"doc_id": pa.array(rows, pa.int64()), "held": pa.array([r == 5 for r in rows], pa.bool_()), "class": pa.array([0] * len(rows), pa.int64()), "text": pa.array([texts[r] for r in rows], pa.string())})
    want = Counter()
    for r in range(5):
        for word in [*(texts[r] or "").lower().split(), ""]:
            data = b"\0\0\0" + word.encode() + b" "
            want.update(int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3))
    for cut in ([[0, 1, 2, 3, 4, 5]], [[0], [1, 2], [3, 4, 5]]):
        got = Counter()
        with patch("pyspark.TaskContext.get", lambda: Mock(partitionId=lambda: 0)):
            for rows in lm._chunk_rows([batch(c) for c in cut], 1):
                for kind, window, n in zip(*(rows.column(c).to_pylist() for c in ("kind", "hash", "n"))):
                    if kind == 2:
                        got[window] += n
        assert got == want


def test_scores_dont_depend_on_the_cut(spark):
    docs = make_docs(spark, [(i, prose(i % 40, 30 + i % 7), ("en", "fr", None)[i % 3], "a") for i in range(60)])
    scores = lambda parts: {r.doc_id: pytest.approx(r.score, rel=1e-6) for r in lm.score_corpus(docs.repartition(parts, "doc_id"), F.col("doc_id") % 7 == 2).collect()}
    assert scores(1) == {k: v.expected for k, v in scores(5).items()}


# --- op9


def test_language(spark):
    rng = random.Random(2)
    talk = {"x": ["lorem", "ipsum", "dolor", "sit"], "y": ["kuzu", "vota", "zent", "praw"]}
    docs = make_docs(spark, [(i, " ".join(rng.choice(talk[k]) for _ in range(12)), k, "a") for i in range(120) for k in ["xy"[i % 2]]] + [(500, None, "x", "a"), (501, "12 34 ½ ²", "x", "a"), (502, "", None, "a")])
    model = langid.train(docs, langid.fold("doc_id", 4) != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert all(got[i][0] == "xy"[i % 2] and got[i][1] > 0.5 for i in range(120))
    assert {got[i][0] for i in (500, 501, 502)} == {"und"}


def test_language_odd(odd, none):
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none, F.lit(True))).collect()} == {"und"}
    assert langid.identify(none, langid.train(odd, F.lit(True))).count() == 0 and langid.identify(odd, langid.train(odd, F.lit(True))).count() == 10


def test_ppm_is_a_distribution():
    windows = np.random.default_rng(0).integers(97, 101, (300, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    model = langid.build_model({"a": np.unique(windows[:150], return_counts=True), "b": np.unique(windows[150:], return_counts=True)})
    share = np.exp2(-model.bits.astype(float))
    unseen = 256 - (model.bits.shape[1] - 1)
    assert np.allclose(share[:, 1:].sum(axis=1) + unseen * share[:, 0], 1, atol=1e-4)


# --- op10


@given(st.lists(st.integers(0, 400), min_size=1, max_size=900), st.sampled_from([1, 7, 64, 256]))
@settings(max_examples=60, deadline=None)
def test_codec_round_trip(ids, every):
    ids = np.array(ids)
    kinds, counts = np.unique(ids, return_counts=True)
    lengths = tokens.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0**-lengths) <= 1
    codec = tokens.Codec(kinds, lengths)
    bits, marks = codec.encode(ids, every)
    assert codec.decode(bits, len(ids), marks, every).tolist() == ids.tolist()


@given(st.text(alphabet="aZé ,.\n\t'9²Г\U0001f600\x1c-", max_size=40))
@settings(max_examples=150, deadline=None)
def test_memo_equals_library(text):
    enc = tokens.encoder(tokens.default_tokenizer())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_store(spark, odd, none, tmp_path):
    enc = tokens.encoder(tokens.default_tokenizer())
    more = odd.unionByName(make_docs(spark, [(20, "a <|endoftext|> b", "en", "a"), (-3, prose(5, 300), "en", "a")]))
    tokens.write_tokens(more, (tmp_path / "a").as_uri(), tokens.default_tokenizer(), 2)
    got = tokens.read_tokens(spark, (tmp_path / "a").as_uri()).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in more.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got) == want
    assert [r.doc_id for r in got] == [None, -3, 1, 2, 3, 4, 5, 5, 7, 8, 9, 20]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    tokens.write_tokens(none, (tmp_path / "b").as_uri(), tokens.default_tokenizer(), 2)
    assert tokens.read_tokens(spark, (tmp_path / "b").as_uri()).count() == 0
