"""Learning from corrections: contexts, patterns, generated rules and their use; text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S


def contexts(docs: DataFrame, values: DataFrame, size: int = 150) -> DataFrame:
    """values(doc_id, field, value, ...) with the text before and after the value and the heading above, where it stands in its document."""
    both = values.join(docs.select("doc_id", "text").hint("shuffle_merge"), "doc_id")
    return both.select(*values.columns, F.inline(F.array(S.prefix_suffix("text", "value", size))))


def learned_patterns(found: DataFrame, least_prefix: int = 8) -> DataFrame:
    """field, prefix pattern and how many values it was learned from: the last line before a value, made general."""
    line = F.trim(F.element_at(F.split("prefix", "\n"), -1))
    return found.where(F.length(line) >= least_prefix).groupBy("field", S.generalize(line).alias("prefix_pattern")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def apply_patterns(docs: DataFrame, patterns: DataFrame, most_patterns: int = 5000) -> DataFrame:
    """doc_id, field, value: what follows each pattern on its line; of several hits the best supported pattern's.

    The best `most_patterns` patterns are used, which bounds the table that is sent to every task.
    """
    best = patterns.orderBy(F.desc("n"), "field", "prefix_pattern").limit(most_patterns)
    rules = best.groupBy("field").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "prefix_pattern"))).alias("ps"))
    hit = lambda p: F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("(?iu)"), p["prefix_pattern"], F.lit(r"[ \t]*([^\n]{1,200})")), F.lit(1))
    tried = F.filter(F.transform("ps", hit), lambda v: v != "")
    both = docs.select("doc_id", "text").crossJoin(F.broadcast(rules))  # a row for each field, at most most_patterns patterns in all
    return both.select("doc_id", "field", S.clean_string(F.get(tried, F.lit(0))).alias("value")).where("value <> ''")


def prefix_clusters(found: DataFrame, least: int = 3) -> DataFrame:
    """field, key (last three words before the value), n: contexts that end alike."""
    words = F.regexp_extract_all(F.lower(F.right("prefix", F.lit(100))), F.lit(r"(?U)(\p{L}{3,})"), 1)
    key = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3), " ")
    return found.where(F.size(words) > 0).groupBy("field", key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fill_blanks(extractions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blank values take the candidate of their (doc_id, field), with its method."""
    offer = candidates.select("doc_id", "field", F.col("value").alias("__v"), F.col("method").alias("__m"))
    both = extractions.join(offer.hint("shuffle_merge"), ["doc_id", "field"], "left")
    empty = S.is_blank("value") & F.col("__v").isNotNull()
    return both.withColumns({"method": F.when(empty, F.col("__m")).otherwise(F.col("method")), "value": F.when(empty, F.col("__v")).otherwise(F.col("value"))}).drop("__v", "__m")


# Quality of a training example by its source.
SOURCE_QUALITY = {"correction": 1.0, "manual": 0.95, "approved": 0.90, "rules_validated": 0.60, "rules_raw": 0.35, "auto": 0.20}


def example_quality(source: Column, text_length: Column) -> Column:
    """The source's weight (0.3 if unknown), a little more for long texts, 1 at most."""
    weights = F.create_map(*[F.lit(x) for kv in SOURCE_QUALITY.items() for x in kv])
    bonus = F.when(text_length > 200, 0.05).otherwise(0.0) + F.when(text_length > 500, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(F.try_element_at(weights, source), F.lit(0.3)) + bonus)


def text_features(df: DataFrame, text_col: str = "text", bits: int = 14) -> DataFrame:
    """Hashed counts of the words and word pairs of whole texts, as `features`."""
    from pyspark.ml.feature import HashingTF

    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.zip_with("__words", F.slice("__words", 2, F.greatest(F.lit(1), F.size("__words") - 1)), lambda a, b: F.concat_ws(" ", a, b))
    tokens = df.withColumn("__words", words).withColumn("__tokens", F.concat("__words", pairs))
    return HashingTF(inputCol="__tokens", outputCol="features", numFeatures=1 << bits).transform(tokens).drop("__tokens", "__words")


def ranked_by_hash(df: DataFrame, group: str, key: str, name: str, slices: int = 256) -> DataFrame:
    """df with the place, from 1, of each row in its group by the hash of its key. A group is ranked slice by slice of the hash's range, so no task holds a whole group."""
    h = F.xxhash64(key)
    bits = 64 - (slices.bit_length() - 1)
    cut = df.withColumns({"__h": h, "__slice": F.shiftright(h, bits).cast("int")})
    sizes = cut.groupBy(group, "__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("__g"), F.col("__slice").alias("__s"), before.alias("__before"))  # slices times groups rows
    inside = F.row_number().over(Window.partitionBy(group, "__slice").orderBy("__h"))
    placed = cut.withColumn("__inside", inside).join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s")))
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__h", "__slice", "__inside", "__g", "__s", "__before")


def train_classifier(examples: DataFrame, label_col: str, weight_col: str | None = None, folds: int | None = None):
    """(model, labels): logistic regression on text features, classes in balance; with folds also the accuracy of each fold."""
    from pyspark.ml.classification import LogisticRegression

    labels = [r[0] for r in examples.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(200).collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    data = text_features(examples).withColumn("__y", number.cast("double")).where("__y >= 0")
    n = data.count()
    sizes = {r[0]: r[1] for r in data.groupBy("__y").count().collect()}
    balance = F.create_map(*[F.lit(x) for y, k in sizes.items() for x in (y, n / (len(sizes) * k))])
    data = data.withColumn("__w", F.element_at(balance, F.col("__y")) * (F.col(weight_col) if weight_col else F.lit(1.0)))
    make = lambda: LogisticRegression(labelCol="__y", weightCol="__w", maxIter=12, regParam=0.01)
    data = data.persist()  # a bounded training sample that every fit reads many times
    scores = []
    if folds:
        data = ranked_by_hash(data, "__y", "doc_id", "__rank").withColumn("__fold", F.pmod("__rank", F.lit(folds))).drop("__rank")
        for k in range(folds):
            tested = make().fit(data.where(F.col("__fold") != k)).transform(data.where(F.col("__fold") == k))
            scores.append(tested.agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0])
    model = make().fit(data)
    data.unpersist()
    return model, labels, scores


def predict_top(model, labels: list, docs: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """docs with `classes`: the k most probable labels above `least`, with their probabilities."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in labels])
    ranked = F.array_sort(F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("minus"), F.get(names, i).alias("label"))))
    kept = F.slice(F.filter(ranked, lambda x: -x["minus"] > least), 1, k)
    return model.transform(text_features(docs)).select(*docs.columns, F.transform(kept, lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("p"))).alias("classes"))


def metrics(predicted: DataFrame, truth: str, label: str = "label") -> DataFrame:
    """One row: n, accuracy, and F1 averaged over the true classes by their sizes."""
    pairs = predicted.groupBy(F.col(truth).alias("t"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("y"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))))
    each = sides.groupBy("c").agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit")).where("c is not null")
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("real") + F.col("said"))).otherwise(0.0)
    return each.agg(F.sum("real").alias("n"), F.round(F.sum("hit") / F.sum("real"), 6).alias("accuracy"), F.round(F.sum(f1 * F.col("real")) / F.sum("real"), 6).alias("f1"))


def predict(model, labels: list, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs with label and confidence; label null below `least`."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(text_features(docs))
    names = F.array(*[F.lit(x) for x in labels])
    conf = F.array_max(vector_to_array("probability"))
    return out.select(*docs.columns, F.when(conf >= least, F.element_at(names, F.col("prediction").cast("int") + 1)).alias("label"), conf.alias("confidence"))
