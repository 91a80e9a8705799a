"""Mixing sources to target weights: balanced sampling by the cube method.

Each source gets a target number of words. A source's documents are taken whole `floor(target / size)` times, and
once more by a balanced sample whose inclusion probability is the remaining fraction. The sample is drawn by
the cube method: the vector of probabilities moves at random inside the null space of the balancing
constraints (number of documents, number of words) until it meets a face of the unit cube, so both totals are kept at
every step and the probability of every document is kept in expectation. With two constraints any three undecided
documents allow a move that decides one of them, so each chunk of a source comes down to two undecided documents
at most. A ladder of LANDING documents, each near half the size of the one before, is left out of the flight of a chunk. Both, of
up to FAN chunks, are gathered and moved again, until one chunk a source is left. The landing then
decides the last two together with the last ladder, to the nearest total: sums of halving sizes come near any number.

A null source is a source of its own, the last in order. Null or empty texts have size 0 and still take part. Rows with
equal doc_id are separate documents. Sources without words have target 0. An empty table gives an empty result. Further columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, lookup_join, stored

#: Documents in a chunk of the first flight, and chunks whose undecided documents meet in one chunk of the next.
CHUNK, FAN = 2048, 1024
#: Documents of a source, of halving sizes, that the flight leaves to the landing.
LANDING = 16
EDGE = 1e-9


def flight(p: list[float], size: list[float], rng: np.random.Generator) -> list[float]:
    """Moves p inside the null space of (count, size) until at most two entries lie strictly between 0 and 1."""
    live: list[int] = []
    for i, x in enumerate(p):
        if not EDGE < x < 1 - EDGE:
            p[i] = float(round(x))
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = (size[k] for k in live)
        move = (b - c, c - a, a - b)
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(live, move) if u)
        down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(live, move) if u)
        step = up if rng.random() * (up + down) < down else -down
        for k, u in zip(live, move):
            p[k] = min(1.0, max(0.0, p[k] + step * u))
            if p[k] < EDGE or p[k] > 1 - EDGE:
                p[k] = float(round(p[k]))
        live = [k for k in live if 0 < p[k] < 1]
    return p


def ladder(size: list[float]) -> list[int]:
    """Places of LANDING entries, or all if fewer, of falling sizes: the largest, then at each step the one nearest to half the last step."""
    left, want, out = sorted(range(len(size)), key=lambda k: (size[k], k)), max(size, default=0.0), []
    sizes = [size[k] for k in left]
    while left and len(out) < LANDING:
        at = bisect_left(sizes, want)
        if at == len(left) or at and want - sizes[at - 1] <= sizes[at] - want:
            at -= 1
        out.append(left.pop(at))
        sizes.pop(at)
        want = max(want / 2, 1.0)
    return out


def land(p: list[float], size: list[float]) -> list[float]:
    """Decides the entries left between 0 and 1, LANDING + 2 at most: the outcome nearest in words, then in documents."""
    live = [k for k, x in enumerate(p) if 0 < x < 1]
    outcomes = np.arange(1 << len(live))[:, None] >> np.arange(len(live)) & 1
    sizes, shares = np.array([size[k] for k in live]), np.array([p[k] for k in live])
    off_words, off_count = np.abs((outcomes - shares) @ sizes), np.abs((outcomes - shares).sum(axis=1))
    best = outcomes[np.lexsort((off_count, np.round(off_words, 6)))[0]]
    for x, k in zip(best.tolist(), live):
        p[k] = float(x)
    return p


def _decide(seed: int, turn: int, last: bool):
    """Flight, and in the last turn landing, of one chunk; the draw depends on the chunk's place and rows only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "doc_id", "no_id"], ascending=[False, True, True, True], kind="stable")
        rng = np.random.default_rng([seed, turn, int(pdf["source_no"].iloc[0]), int(pdf["chunk"].iloc[0])])
        size = pdf["size"].astype(float).tolist()
        p = pdf["p"].tolist()
        open_ones = [k for k, x in enumerate(p) if EDGE < x < 1 - EDGE]
        steps = {open_ones[k] for k in ladder([size[k] for k in open_ones])}
        moved = [k for k in range(len(p)) if k not in steps]
        for k, x in zip(moved, flight([p[k] for k in moved], [size[k] for k in moved], rng)):
            p[k] = x
        if not last:
            return pdf.assign(p=p)
        return pdf.assign(p=land(p, size))

    return run


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(source, n, source_size) -> source, source_no, n, source_size, target. One row a source.

    Targets are least(limit * size, level * weight). The level rises round by round as sources that reach their
    limit hand what is left over to the others, by weight, until none is above.
    """
    spark = sizes.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    ranked = stored(ranked.withColumn("weight", F.get(cycle, F.col("source_no") % len(weights))))
    full = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * float(limit), 0.0
    while True:
        at_limit = cap < F.col("weight") * level
        spent, left = ranked.agg(F.sum(F.when(at_limit, cap)), F.sum(F.when(~at_limit, F.col("weight")))).first()
        new = (share * full - (spent or 0.0)) / left if left else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight")


def balanced_mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, tie (hash of the text), size, source_size, target, copies and taken of every document."""
    spark = docs.sparkSession
    rows = stored(
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    )
    stats = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    table = stored(source_targets(stats, weights, share, limit))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    lookup = stored(table.select(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("source_null"), "source_no", "source_size", "target", chunks.alias("chunks"), ratio.alias("ratio")))
    most = table.agg(F.max(chunks)).first()[0] or 1
    keyed = rows.withColumns({"source_key": F.coalesce("source", F.lit("")), "source_null": F.col("source").isNull()})
    joined = lookup_join(keyed, lookup, ["source_key", "source_null"], F.struct("doc_id", "tie")).drop("source_key", "source_null")
    cur = joined.withColumns({
        "base": F.floor(F.col("ratio") + EDGE).cast("int"),
        "chunk": F.pmod(F.xxhash64("doc_id", "tie"), F.col("chunks")).cast("int"),
    }).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("base"))).drop("ratio", "chunks")
    schema, parts, turn = cur.schema, [], 0
    while True:
        last = most <= 1

        done = stored(cur.groupBy("source_no", "chunk").applyInPandas(_decide(seed, turn, last), schema))
        parts.append(done if last else done.where("p <= 0 or p >= 1"))
        if last:
            break
        cur = done.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int"))
        most, turn = -(-most // FAN), turn + 1
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    copies = (F.col("base") + F.round("p").cast("int")).cast("int")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "tie", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """Every row of docs as often as the mix takes it. Rows alike in doc_id, text and source share their copies in turn, by a hash of all their columns.

    A null source and an empty one are apart, and so are a null doc_id and any other.
    """
    keys = ["__id", "__tie", "__source", "__none"]
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nulls = F.col("doc_id").isNull().cast("int") * 2 + F.col("source").isNull().cast("int")
    plan = mix.groupBy(key("doc_id").alias("__id"), F.col("tie").alias("__tie"), key("source").alias("__source"), nulls.alias("__none"))
    plan = stored(plan.agg(F.sum("copies").alias("__sum"), F.count("*").alias("__n"), F.max("copies").alias("__most")))
    named = docs.withColumns({"__id": key("doc_id"), "__tie": F.xxhash64("text"), "__source": key("source"), "__none": nulls})
    single = named.join(plan.where("__n = 1 and __sum > 0").hint("shuffle_merge"), keys).withColumn("__copies", F.col("__sum"))
    among = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    alike = named.join(plan.where("__n > 1 and __sum > 0").hint("shuffle_merge"), keys).withColumn("__k", F.row_number().over(among))
    each = F.floor(F.col("__sum") / F.col("__n")) + F.when(F.col("__k") <= F.col("__sum") % F.col("__n"), 1).otherwise(0)
    alike = alike.withColumn("__copies", each).drop("__k")
    both = single.unionByName(alike).where("__copies > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2, repeating over the sources; 150 % of all words; at most twice a source."""
    mix = balanced_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), (3, 1, 2), 1.5, 2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op1_mixing": op1_mixing}
