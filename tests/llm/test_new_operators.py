import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import common, decision_list, filter_audit, whitening
from tests.llm.test_operators import make_docs, prose


def test_join_by_counts_and_by_id(spark):
    """One key holds most rows, others few: each row comes once, inner and left; null ids find nothing."""
    rows = common.stored(spark.createDataFrame([(7, k) for k in range(900)] + [(k, k) for k in range(100, 140)] + [(None, 1)], "id long, v int"))
    table = spark.createDataFrame([(7, "hot"), (100, "a"), (101, "b"), (5000, "no row")], "id long, name string")
    sized = common.stored(table.join(rows.groupBy("id").agg(F.count("*").alias("n")), "id", "left"))
    assert Counter(r.name for r in common.join_by_counts(rows, sized, ["id"], "n", rows.count()).collect()) == {"hot": 900, "a": 1, "b": 1}
    left = Counter(r.name for r in common.join_by_id(rows, table, "id", "left").collect())
    assert left == {"hot": 900, "a": 1, "b": 1, None: 39}
    assert Counter(r.name for r in common.join_by_id(rows, table, "id").collect()) == {"hot": 900, "a": 1, "b": 1}


# --- op11


def vectors(spark, rows):
    """rows of (vec_id, embedding); extra columns clash with names used inside."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"label": F.lit(1), "x": F.lit("x"), "h": F.lit(0.5), "copies": F.lit(3), "n": F.lit("n"), "whitened": F.lit(1)})


def plain_fit(x, weights):
    n = int(weights.sum())
    mean = (x * weights[:, None]).sum(axis=0) / n
    c = x - mean
    values, axes = np.linalg.eigh((c * weights[:, None]).T @ c / n)
    return n, mean, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("weigh", ["counts", "one"])
def test_whiten_equals_plain(spark, weigh):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, base[0].tolist()) for k in range(400)] + [(7, base[7].tolist()), (None, base[9].tolist())]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, rows), 4, weigh).toPandas()
    kept = [(i, np.floor(64 * np.array(v, np.float64))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = np.array([v for _, v in kept]) + 1_000_000
    distinct, back, counts = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    n, mean, values, axes = plain_fit(distinct, counts if weigh == "counts" else np.ones(len(distinct), int))
    assert len(got) == len(kept) and set(got["n"]) == {n} and (got["identity_error"] < 1e-9).all()
    want = (x - mean) @ axes[:, :4] / np.sqrt(values[:4])
    s = [int(round(m * n)) for m in mean]
    by = defaultdict(set)
    for (i, _), z, row in zip(kept, want, x):
        by[i].add((tuple(np.round(np.abs(z), 6)), sum((n * int(a) - b) ** 2 for a, b in zip(row, s))))
    for r in got.itertuples():
        i = None if r.vec_id is None or math.isnan(r.vec_id) else int(r.vec_id)
        assert (tuple(np.round(np.abs(r.whitened), 6)), r.deviation) in by[i]
        assert np.allclose(r.explained, values[:4] / values.sum())
    signs = np.sign(np.array(got["whitened"].tolist())[0]) == np.sign(np.array(got["whitened"].tolist())[1:])
    assert len(signs)  # one axis for all rows: the correlation with the plain result is 1 or -1
    order = got.set_index("vec_id")["whitened"]
    mine, plain = np.array([order.loc[float(k)] for k in range(60) if k not in (7,)]), want[[k for k in range(60) if k != 7]]
    assert np.allclose(np.abs((mine * plain).sum(axis=0)), (plain**2).sum(axis=0))


def test_whiten_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(2, 0, [])] * 2
    short = whitening.whiten(vectors(spark, [(1, []), (2, [1.0]), (3, [0.0, 3.0]), (4, [2.0, 0.0]), (5, [1.0, 1.0])])).toPandas()
    assert len(short) == 5 and {len(w) for w in short["whitened"]} == {2} and (short["identity_error"] < 1e-9).all()
    far = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).toPandas()
    assert len(far) == 3 and (far["deviation"] == (1 << 63) - 1).sum() == 2


def test_whitening_query_has_a_row_for_each_component(spark, sf_dir):
    got = whitening.op11_whitening(spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(rows["embedding"].tolist(), np.float64)) + 1_000_000
    n, mean, values, axes = plain_fit(x, np.ones(len(x)))
    assert len(got) == 32 * n and set(got["component"]) == set(range(1, 33))
    table = got.pivot_table(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    want = (x - mean) @ axes[:, :32] / np.sqrt(values[:32])
    assert np.allclose(np.abs(table), np.abs(want), atol=1e-6)
    assert np.allclose(got.groupby("component")["explained"].first(), values[:32] / values.sum())


# --- op12

alphabet = "aB# $\t\n\r\x0b\f\x1c\x85 é!.1"


def plain_counts(text):
    words = "".join(" " if c in " \t\n\r\x0b\f" else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\f")]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)]


@given(st.text(alphabet=alphabet, max_size=60))
@settings(max_examples=200, deadline=None)
def test_text_counts_equal_plain(text):
    got = decision_list.text_counts(text.encode())
    assert got[:5] == plain_counts(text)
    assert got[5:] == [len({w for w in text.encode().split()}), len([x for x in text.split("\n") if x.strip(" \t\n\r\x0b\f")]), len(text), sum("A" <= c <= "Z" for c in text), text.count("!"), text.count("."), text.count("1")]


def marked(spark, n=300):
    """Junk is loud, or repeats itself; a tenth has no label."""
    rows = []
    for i in range(n):
        text = prose(i, 60 + i % 50)
        rows.append((i, ("! " + text if i % 6 == 0 else " ".join([prose(i, 4)] * 20) if i % 6 == 1 else text), "en", "a"))
    labels = [(i, int(i % 6 > 1), 0) for i in range(n) if i % 10 != 9]
    return make_docs(spark, rows).withColumns({"n_words": F.lit("clash"), "rule": F.lit(9), "__label": F.lit(1)}), spark.createDataFrame(labels + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_rules_find_planted_junk(spark):
    docs, labels = marked(spark)
    judged, rules = decision_list.judge(docs, labels)
    got = judged.toPandas()
    assert len(got) == 300 and rules.default == 1 and rules.rules and "loud_share" in str(rules)
    assert (got["verdict"] == (got["doc_id"] % 6 > 1)).mean() > 0.99
    assert set(got[got["verdict"] == 0]["rule"]) <= set(range(1, len(rules.rules) + 1)) and (got[got["verdict"] == 1]["rule"] == 0).all()
    assert all(right >= decision_list.LEAST_RIGHT * n for _, _, n, right in rules.rules)


def test_histogram_and_condition_equal_plain(spark):
    """One step of growing, on numbers that a loop counts too."""
    rng = np.random.default_rng(5)
    bins, label, part = rng.integers(0, 5, (200, 2)), rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    table = spark.createDataFrame([(bytes(b.tolist()), int(y), int(p)) for b, y, p in zip(bins, label, part)], "bins binary, label int, part int")
    rule, earlier = (decision_list.Condition(0, True, 3),), [(decision_list.Condition(1, False, 3),)]
    live = (bins[:, 0] <= 3) & ~(bins[:, 1] > 3)
    got = decision_list.histogram(table, [5, 5], earlier, rule)
    for p in range(2):
        for y in range(2):
            for k in range(2):
                assert got[p, y, k].tolist() == np.bincount(bins[live & (part == p) & (label == y), k], minlength=5).tolist()
    condition, left = decision_list.best_condition(got, [5, 5], 1, set())
    if condition:
        side = bins[:, condition.stat] <= condition.at
        side = live & (side if condition.below else ~side)
        assert left.tolist() == [[int((side & (part == p) & (label == y)).sum()) for y in range(2)] for p in range(2)]


def test_rules_odd_tables(spark):
    docs, labels = marked(spark, 40)
    assert decision_list.judge(docs.limit(0), labels)[0].count() == 0
    assert {r.verdict for r in decision_list.judge(docs, labels.limit(0))[0].collect()} == {1}
    assert {r.verdict for r in decision_list.judge(docs, labels.where("quality = 0"))[0].collect()} == {0}
    odd = make_docs(spark, [(1, None, None, None), (None, "x y z x y z", None, "s"), (2, "", "en", "s"), (2, "", "en", "s"), (3, prose(1, 30_000), "en", "s")])
    got = decision_list.judge(odd, labels)[0].toPandas()
    assert sorted(got["n_words"]) == [0, 0, 0, 6, 30_000] and got["verdict"].isin([0, 1]).all() and got.loc[got["n_words"] == 6, "n_repeat_words"].tolist() == [6]


def test_quality_rules_query(spark, sf_dir):
    got = {r.doc_id: r for r in decision_list.op12_quality_rules(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], plain_counts(d.text or "")
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert all(got[i].kept for i in good if i in got and not got[i].base_failed)


# --- op13


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(max_examples=100, deadline=None)
def test_positional_counts(words):
    got = filter_audit.positional_counts(np.array(words, np.int64), 32)
    assert got.tolist() == [sum(w >> k & 1 for w in words) for k in range(32)]


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    facts = []
    for i, text, _, source in docs:
        text = text or ""
        words = text.encode().split()
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text]}
        facts.append((source or "", f, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part in {p for p, _, _, _ in facts}:
        mine, removed_by = [x for x in facts if x[0] == part], Counter()
        rows = []
        for order in map("".join, permutations("ABCDE")):
            live = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in live if x[1][c]]
                live = [x for x in live if not x[1][c]]
                fails = [x for x in mine if x[1][c]]
                removed_by[c] += len(gone)
                rows.append((c, (part, order, step, len(live), len(gone), len(fails) - len(gone), sum(sum(x[1].values()) == 1 for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone))))
        out += [(*row, removed_by[c]) for c, row in rows]
    return sorted(out)


def test_audit_equals_plain(spark):
    texts = ["", "a b", prose(1, 250), prose(2, 220) + " $", "SHOUT " * 210, prose(3, 300).upper(), " ".join(["x y"] * 150)]
    rows = [(i, texts[i % 7], "en", [None, "", "a", "b"][i % 4]) for i in range(300)]
    rows += [(500 + i, texts[2], "en", "a") for i in range(200)] + [(None, texts[2], "en", "a"), (None, None, None, None), (7, texts[2], "en", "b"), (7, texts[2], "en", "b"), (2, texts[2], "en", "b"), (9, prose(1, 20_000), "fr", "é")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 700, 3)] + [(3, 1, None), (None, 1, 1), (6, None, None), (7, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(make_docs(spark, rows).withColumns({"fails": F.lit("f"), "part": F.lit(0), "good": F.lit(1)}), table)
    assert sorted(map(tuple, got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())) == plain_audit(rows, labels)
    assert filter_audit.audit(make_docs(spark, []), table).count() == 0
    assert filter_audit.audit(make_docs(spark, rows), table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
