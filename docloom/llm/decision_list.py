"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule, a conjunction of thresholds, is grown one condition at a time by information gain on two thirds of the labelled
documents that no earlier rule covers; its last conditions are then pruned for as long as that helps on the other third; a rule that is right on too
few of that third (or, where it covers none of it, is wrong in growing) is dropped and another
statistic begins the next, until none is left. Rules speak for the rarer label, and what no rule covers gets the label that is
most frequent there. The list becomes one ordered Spark conditional expression.

Growing and pruning see all labelled documents: each step is one Spark job that counts, in every task, the documents that the rule so far
covers by statistic, bin, label and part; only these counts (statistics x bins x 4) reach the driver. Bins lie between quantiles
of each label's values (approximate ones, of a fixed number).

Statistics cover whole texts; a null text has none and counts as empty. Labels that are null are ignored, several labels of one
doc_id count as their largest; rows that share a doc_id each learn and get their verdict; a null doc_id has no label. Without labels all
documents are kept; with labels of one kind that label is every document's verdict. An empty table gives no rows. Columns named like a
statistic or a result give way to it, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, drop_stored, join_by_id, lean, map_texts, stored

#: Quantiles of each label that thresholds are taken from; conditions of a rule; rules of a list.
QUANTILES, MAX_CONDITIONS, MAX_RULES = 48, 4, 24
#: What a rule must get right on the documents it wasn't grown on, and how many it must cover in growing.
LEAST_RIGHT, LEAST_COVERED = 0.9, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kinds", "n_lines", "n_chars", "n_upper", "n_loud", "n_points", "n_digits"]
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    runs = code[:n]
    for k in range(1, width):
        # Pairs are numbered anew, so that products stay small.
        runs = np.unique(runs * len(ids) + code[k : k + n], return_inverse=True)[1]
    twice = np.bincount(runs)[runs] > 1
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : k + n] |= twice
    return int(inside.sum())


def text_counts(data: bytes) -> list[int]:
    """COUNTS of one text in UTF-8."""
    without = lambda drop: len(data) - len(data.translate(None, drop))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    chars = len(data) - without(bytes(range(0x80, 0xC0)))
    return [
        len(words), chars - without(_SPACE), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated(words), len(set(words)), len(lines), chars,
        without(_UPPER), without(b"!?"), without(b".,;:"), without(_DIGITS),
    ]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with COUNTS of it."""

    def make():
        def work(texts):
            rows = [text_counts(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]

        return work

    return map_texts(docs, make, ", ".join(f"{c} long" for c in COUNTS), text_col, keep_text=False)


def statistics() -> dict[str, Column]:
    """What thresholds are put on, by name."""
    word, char, line = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / word, "symbols_per_word": F.col("n_symbols") / word, "dup_line_share": F.col("n_dup_lines") / line,
        "repeat_share": F.col("n_repeat_words") / word, "kinds_share": F.col("n_kinds") / word, "kinds_growth": F.log(F.greatest(F.col("n_kinds"), F.lit(1))) / F.log(word + 1), "words_per_line": F.col("n_words") / line, "upper_share": F.col("n_upper") / char,
        "loud_share": F.col("n_loud") / char, "point_share": F.col("n_points") / char, "digit_share": F.col("n_digits") / char,
    }


@dataclass(frozen=True)
class Condition:
    """A statistic (by place) of which a document has at most, or more than, the bin `at`."""

    stat: int
    below: bool
    at: int


Rule = tuple[Condition, ...]


@dataclass
class DecisionList:
    """Ordered rules (statistic, at most?, threshold) with the verdict they give, how many of the held-back labelled documents
    they cover and get right, and the verdict of what no rule covers."""

    rules: list[tuple[tuple[tuple[str, bool, float], ...], int, int, int]]
    default: int

    def expressions(self) -> tuple[Column, Column]:
        """(number of the rule that decides, from 1, or 0; its verdict) as ordered conditionals."""
        number, verdict = None, None
        for k, (rule, says, _, _) in enumerate(self.rules, 1):
            met = F.lit(True)
            for name, below, at in rule:
                met = met & (F.col(f"__{name}") <= at if below else F.col(f"__{name}") > at)
            number = F.when(met, k) if number is None else number.when(met, k)
            verdict = F.when(met, says) if verdict is None else verdict.when(met, says)
        if number is None:
            return F.lit(0), F.lit(self.default)
        return number.otherwise(0), verdict.otherwise(self.default)

    def __str__(self) -> str:
        text = [" and ".join(f"{n} {'<=' if b else '>'} {t:.6g}" for n, b, t in rule) + f" -> {says} ({right} of {n})" for rule, says, n, right in self.rules]
        return "\n".join([*text, f"else -> {self.default}"])


def covered(bins: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(bins), bool)
    for c in rule:
        out &= (bins[:, c.stat] <= c.at) if c.below else (bins[:, c.stat] > c.at)
    return out


def histogram(binned: DataFrame, sizes: list[int], earlier: list[Rule], rule: Rule) -> np.ndarray:
    """counts[part, label, statistic, bin] of the documents that the rule covers and no earlier one does. binned: bins binary, label int, part int."""
    wide = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(4 * len(sizes) * wide, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, len(sizes))
            live = covered(bins, rule)
            for r in earlier:
                live &= ~covered(bins, r)
            group = (b.column("part").to_numpy() * 2 + b.column("label").to_numpy())[live].astype(np.int64)
            for k in range(len(sizes)):
                total += np.bincount((group * len(sizes) + k) * wide + bins[live, k], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    with bounded_batches(binned.sparkSession, 100_000, 8):
        rows = binned.mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4 * len(sizes) * wide, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(2, 2, len(sizes), wide)


def best_condition(counts: np.ndarray, sizes: list[int], target: int, barred: set[int]) -> tuple[Condition | None, np.ndarray]:
    """The condition of the highest information gain by counts[part, label, statistic, bin], if any gains, and what it covers: [part, label].

    Its threshold is then tightened for as long as that makes it more right on the documents held back.
    """
    low = counts.cumsum(axis=3)
    whole = low[:, :, 0, -1]
    best, gain = None, 1e-9
    p0, n0 = int(whole[0, target]), int(whole[0, 1 - target])
    left = lambda c: low[:, :, c.stat, c.at] if c.below else whole - low[:, :, c.stat, c.at]
    for c in (Condition(k, below, at) for k, size in enumerate(sizes) if k not in barred for at in range(size - 1) for below in (True, False)):
        p, n = int(left(c)[0, target]), int(left(c)[0, 1 - target])
        if p >= LEAST_COVERED and p + n < p0 + n0:
            g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
            if g > gain:
                best, gain = c, g
    if best is None:
        return None, whole
    tighter = range(best.at + 1) if best.below else range(best.at, sizes[best.stat] - 1)
    ways = [Condition(best.stat, best.below, at) for at in tighter]
    ways = [c for c in ways if left(c)[0, target] >= LEAST_COVERED]
    best = max(ways, key=lambda c: (rightness(*left(c)[1, [target, 1 - target]].tolist()), left(c)[1, target], left(c)[0, target], -abs(c.at - best.at)))
    return best, left(best)


def rightness(right: int, wrong: int) -> float:
    return (right - wrong) / max(right + wrong, 1)


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below a value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def learn(labelled: DataFrame, names: list[str]) -> DecisionList:
    """labelled(names..., label 0 or 1, part 0 grows or 1 prunes) -> the list."""
    sizes_by = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes_by) < 2:
        return DecisionList([], next(iter(sizes_by), 1))
    target = min(sizes_by, key=lambda k: (sizes_by[k], k))
    shares = [k / QUANTILES for k in range(QUANTILES)]
    seen = labelled.groupBy("label").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).collect()
    cuts = [sorted({float(v) for r in seen for v in r[n]}) for n in names]
    sizes = [len(c) + 1 for c in cuts]
    # Bin b holds what is above cut b - 1 and at most cut b.
    bins = [bin_of(F.col(n), c) for n, c in zip(names, cuts)]
    binned = stored(labelled.select(F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in bins])).alias("bins"), "label", "part"))
    rules: list[tuple[Rule, int, int]] = []
    barred: set[int] = set()
    while len(rules) < MAX_RULES:
        earlier, rule, steps = [r for r, _, _ in rules], (), []
        while len(rule) < MAX_CONDITIONS:
            condition, left = best_condition(histogram(binned, sizes, earlier, rule), sizes, target, barred if not rule else set())
            if condition is None:
                break
            rule = (*rule, condition)
            right, wrong, missed = int(left[1, target]), int(left[1, 1 - target]), int(left[0, 1 - target])
            steps.append((rightness(right, wrong), -len(rule), right, wrong, missed))
            if not missed:
                break
        if not steps:
            break
        _, size, right, wrong, missed = max(steps)
        if right >= LEAST_RIGHT * (right + wrong) and (right or not missed):
            rules.append((rule[:-size], right + wrong, right))
            barred = set()
        else:
            barred.add(rule[0].stat)  # no rule that holds begins with it
    rest = histogram(binned, sizes, [r for r, _, _ in rules], ())[:, :, 0, :].sum(axis=(0, 2))
    drop_stored(binned)
    named = [(tuple((names[c.stat], c.below, cuts[c.stat][c.at]) for c in r), target, n, right) for r, n, right in rules]
    return DecisionList(named, int(rest[1] >= rest[0]) if rest.sum() else 1 - target)


def judge(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "quality") -> tuple[DataFrame, DecisionList]:
    """docs(doc_id, text, ...) without text, with COUNTS, rule (the number of the rule that decides, 0 if none does) and verdict (0 or 1), and the list."""
    spark = docs.sparkSession
    with bounded_batches(spark):
        table = stored(with_counts(docs))
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if usable is None else usable))
    marked = marked.groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("__label"))
    stats = statistics()
    sample = join_by_id(table.select("doc_id", *COUNTS), marked, "doc_id")
    part = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).cast("int")
    sample = stored(sample.select(*[c.alias(n) for n, c in stats.items()], F.col("__label").alias("label"), part.alias("part")))
    rules = learn(sample, list(stats))
    drop_stored(sample)
    number, verdict = rules.expressions()
    kept = [c for c in table.columns if c not in ("rule", "verdict")]
    return table.select(*kept, *[c.alias(f"__{n}") for n, c in stats.items()]).select(*kept, number.alias("rule"), verdict.alias("verdict")), rules


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or more than most_repeated percent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and whether it stays by base limits and the list learned from all labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged, _ = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = base_failed()
    return judged.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & (F.col("verdict") == 1)).alias("kept"), "rule")


QUERIES = {"op12_quality_rules": op12_quality_rules}
