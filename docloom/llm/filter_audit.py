"""Filter interaction audit: truth-table survival words and carry-save positional popcounts.

With k filters (five at most) a document is one word of 2^k bits: bit S is set if it survives every filter of the subset S. Each task counts,
for each part and label, how many of its words have each bit set. Words are added bit by bit: carry-save adders turn three words of
one weight into a sum of that weight and a carry of twice the weight, until two words of each weight are left. Spark adds the
counts of all tasks. How many documents survive each subset is all that any order of the filters needs, so every step of every order, and the
shares of each filter over all orders, follow from 2^k numbers a part and label.

A document is marked good or toxic if any label row of its doc_id says so; null labels say nothing. Rows without doc_id have no label, and are
neither a copy of another document nor an original. Rows that share text and doc_id are no copies of each other.
Every row counts once. A null text is empty, a null source is the empty string. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, drop_stored, join_by_counts, join_by_id, lean, stored

#: What is counted of each subset: all survivors, and those with a label.
KINDS = ("all", "good", "toxic")
#: Parts that a task holds at once; beyond them it passes on what it has counted.
PARTS = 4096


def survival_word(fails: Column, k: int) -> Column:
    """The word of a document whose failed filters are the bits of `fails`."""
    words = [sum(1 << s for s in range(1 << k) if not s & f) for f in range(1 << k)]
    return F.get(F.array(*[F.lit(w).cast("long") for w in words]), fails)


def positional_counts(words: np.ndarray, bits: int) -> np.ndarray:
    """How many of the words have each bit set."""
    out, level, cur = np.zeros(bits, np.int64), 0, words.astype(np.uint32)
    while len(cur):
        carries = []
        while len(cur) >= 3:
            k = len(cur) // 3
            a, b, c = cur[:k], cur[k : 2 * k], cur[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            cur = np.concatenate([half ^ c, cur[3 * k :]])
        for w in cur.tolist():
            out += ((w >> np.arange(bits)) & 1) << level
        cur, level = np.concatenate(carries) if carries else cur[:0], level + 1
    return out


def survivors(marked: DataFrame, k: int) -> DataFrame:
    """marked(part, good, toxic, word) -> part, n: for each kind and subset, in this order, how many survive."""
    bits = 1 << k

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def passed_on():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.reshape(-1).tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "n"])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("part").dictionary_encode()
            code, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            word = b.column("word").to_numpy()[order]
            flags = [np.ones(len(word), bool), *[b.column(c).to_numpy(zero_copy_only=False)[order] for c in KINDS[1:]]]
            ends = np.searchsorted(code[order], np.arange(len(names) + 1))
            for name, i, j in zip(names, ends[:-1], ends[1:]):
                mine = held.setdefault(name, np.zeros((len(KINDS), bits), np.int64))
                for row, flag in zip(mine, flags):
                    row += positional_counts(word[i:j][flag[i:j]], bits)
            if len(held) > PARTS:
                yield from passed_on()
        yield from passed_on()

    size = len(KINDS) * bits
    parts = marked.select("part", *KINDS[1:], "word").mapInArrow(lean(run), "part string, n array<long>")
    return parts.groupBy("part").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(size)]).alias("n"))


def every_order(counts: DataFrame, letters: str) -> DataFrame:
    """counts(part, n), as survivors() gives it -> one row for each part, order of the filters and step."""
    k, bits = len(letters), 1 << len(letters)
    at = lambda kind, subset: F.get("n", F.lit(KINDS.index(kind) * bits) + subset)
    # A filter's removals over all orders: the subsets before it, each as often as orders begin with that subset and it.
    shares = []
    for f in range(k):
        own = [s for s in range(bits) if not s >> f & 1]
        times = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in own]
        shares.append(sum((F.lit(t) * (at("all", F.lit(s)) - at("all", F.lit(s | 1 << f))) for s, t in zip(own, times)), F.lit(0).cast("long")))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = counts.select("part", "n", F.array(*shares).alias("shares"), F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"before": before, "filter": F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1})
    steps = steps.withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("filter"))))
    one = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    removed = at("all", F.col("before")) - at("all", F.col("after"))
    fails = at("all", F.lit(0)) - at("all", one)
    alone = at("all", F.lit(bits - 1) - one) - at("all", F.lit(bits - 1))
    lost = lambda kind: at(kind, F.col("before")) - at(kind, F.col("after"))
    return steps.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), alone.alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("filter")).alias("shapley"),
    )


def text_failures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text and with `fails`: bits of the filters on a text alone. 1: under 200 words; 2: distinct words are less than
    half of all; 4: more than 2 % capitals; 8: a character of [#$%&*|]."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in (text_col, "fails")]
    cut = docs.select(*kept, text.alias("__text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("__words"))
    n, kinds = F.size("__words"), F.size(F.array_distinct("__words"))
    bad = [n < 200, 100 * kinds < 50 * n, 100 * F.regexp_count("__text", F.lit("[A-Z]")) > 2 * F.length("__text"), F.col("__text").rlike("[#$%&*|]")]
    return cut.select(*kept, sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bad)), F.lit(0)).alias("fails"))


def with_copies(docs: DataFrame, bit: int) -> DataFrame:
    """A stored docs(doc_id, key, fails, ...) without key: `bit` is added to fails where a smaller doc_id has the same key."""
    texts = stored(docs.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id")).where("n_copies > 1"))
    both = join_by_counts(docs, texts, ["key"], "n_copies", docs.count(), "left")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    out = stored(both.withColumn("fails", F.col("fails") + F.when(later, bit).otherwise(0)).drop("key", "n_copies", "first_id"))
    drop_stored(texts)
    return out


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored docs(doc_id, ...) with good and toxic."""
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    return join_by_id(docs, marks, "doc_id", "left").fillna(False, ["good", "toxic"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order of the five filters A to E, for each source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), "text")
    facts = stored(text_failures(rows))
    flagged = with_copies(facts, 16)
    drop_stored(facts)
    marked = with_labels(flagged, labels).withColumn("word", survival_word(F.col("fails"), 5))
    with bounded_batches(docs.sparkSession, 100_000, 8):
        counts = stored(survivors(marked, 5))
    return every_order(counts, "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all 120 orders of the five filters, for each source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same by applying each order to each document.
ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM t LEFT JOIN l USING (doc_id)),
v AS (SELECT part, good, toxic, count(*) AS n, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS m FROM f GROUP BY part, good, toxic, a, b, c, d, e),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter FROM o, range(1, 6) r(step)),
r AS (SELECT v.*, s.*, m[letter] AS fails,
  len(list_filter(string_split(filter_order[1:step - 1], ''), lambda z: z <> '' AND m[z])) = 0 AS reached,
  len(list_filter(map_values(m), lambda z: z)) AS n_fails FROM v, s),
g AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (WHERE reached AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE reached AND fails), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE NOT reached AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND n_fails = 1), 0) AS unique_fails,
  coalesce(sum(n) FILTER (WHERE reached AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE reached AND fails AND toxic), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""
}
QUERIES = {"op13_filter_audit": op13_filter_audit}
