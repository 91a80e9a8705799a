"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees of a random forest are grown on labelled documents; every path from a root to a node is a
conjunctive rule over the statistics. A logistic regression with lasso penalty weighs the rules, and those with a weight other than 0
are compiled into one Spark column expression, so scoring runs inside the JVM over any number of documents.

The fit uses a bounded sample: the SAMPLE_ROWS labelled documents with the smallest hash of doc_id among those allowed.
Statistics cover whole texts; a null text counts as empty and gets a score like any other. Labels that are null are
ignored, several labels of one doc_id count as their largest. With no label, or labels of one kind only, the
score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WORD, stored
from docloom.llm.langid import fold

SAMPLE_ROWS, TREES, DEPTH, LASSO = 8000, 16, 3, 0.001
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as columns, in two layers: counts first, then ratios of them by name."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return {
        "n_chars": F.length(text),
        "n_words": F.regexp_count(text, F.lit(WORD)),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#$%&*@^~|<>=+_{}\[\]\\]")),
        "n_loud": F.regexp_count(text, F.lit("[!?]")),
        "n_points": F.regexp_count(text, F.lit("[.,;:]")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
        "n_long": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{16}")),
        "n_kinds": F.size(F.array_distinct(words)),
        "n_lines": F.size(lines),
        "n_line_kinds": F.size(F.array_distinct(lines)),
    }


def ratios() -> dict[str, Column]:
    per_char, per_word = F.greatest("n_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    share = {k: F.col(f"n_{k}") / per_char for k in ("upper", "symbols", "loud", "points", "digits")}
    return {f"{k}_share": v for k, v in share.items()} | {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("n_chars") / per_word,
        "long_share": F.col("n_long") / per_word,
        "kinds_share": F.col("n_kinds") / per_word,
        "line_words": F.col("n_words") / F.col("n_lines"),
        "line_kinds_share": F.col("n_line_kinds") / F.col("n_lines"),
    }


FEATURES = ["upper_share", "symbols_share", "loud_share", "points_share", "digits_share", "log_words", "word_length", "long_share", "kinds_share", "line_words", "line_kinds_share"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the statistics in FEATURES; columns named like one of them or like a count give way."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = [*statistics(text), *ratios()]
    kept = [c for c in docs.columns if c != text_col and c not in made]
    counted = docs.select(*kept, *[c.alias(k) for k, c in statistics(text).items()])
    return counted.select(*kept, *[c.alias(k) for k, c in ratios().items()])


def tree_rules(node, features: list[str], path: Rule = ()) -> list[Rule]:
    """Every path from the root to a node below it; a condition is (statistic, at most?, threshold)."""
    out = [path] if path else []
    if node.numDescendants() > 0:
        name, at = features[node.split().featureIndex()], float(node.split().threshold())
        for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
            out += tree_rules(child, features, (*path, (name, below, at)))
    return out


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, below, at in rule:
        out = out & (F.col(name) <= at if below else F.col(name) > at)
    return out


def logit(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def fit(sample: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """sample(FEATURES..., label) -> (intercept, weighted rules)."""
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else ones / n
        return logit(share), []
    vectors = sample.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in FEATURES])).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird").fit(vectors)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t._java_obj.rootNode(), FEATURES)))
    flags = sample.select(array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"), "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(flags)
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]


def compile_score(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The rule ensemble as one column: the probability of label 1."""
    z = F.lit(intercept)
    for rule, weight in rules:
        z = z + F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows without text, with statistics, score and the number of rules."""
    table = stored(with_statistics(docs))
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & usable)
    marked = marked.groupBy("doc_id").agg(F.max(label_col).cast("double").alias("__label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS rows of 16 bytes, so the broadcast is bounded by that parameter.
    sample = stored(table.join(F.broadcast(marked), "doc_id").select(*FEATURES, F.col("__label").alias("label")).coalesce(8))
    intercept, rules = fit(sample)
    return table.withColumn("score", compile_score(intercept, rules))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five folds; scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels, fold("doc_id", 5) != 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
