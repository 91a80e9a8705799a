"""Statistics, quality and status over the learning logs. `as_of` and windows are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import compare_key

#: Days that count as recent, least accuracy, and the change that counts as a trend.
RECENT_DAYS, LEAST_ACCURACY, TREND = 30, 0.7, 0.05
# Weights of methods in a vote.
METHOD_WEIGHTS = {"rules": 0.7, "ml": 0.6, "learned_pattern": 0.65, "auto_rule": 0.55, "similar_doc": 0.5, "corrected": 1.0}


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def data_quality(training: DataFrame) -> DataFrame:
    """Number and mean quality of active examples overall, by source and by field, and distinct values, in one pass."""
    df = training.where("is_active")
    sets = df.groupingSets([[], ["source"], ["field"]], "source", "field")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count_distinct("value").alias("n_values"), F.grouping_id().alias("level"))


def value_statistics(memory: DataFrame, top: int = 20) -> DataFrame:
    """Per field: n, distinct, mean, deviation, extremes and the most frequent values."""
    base = memory.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    order = Window.partitionBy("field").orderBy(F.desc("k"), "value")
    common = memory.groupBy("field", "value").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    listed = common.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("common"))
    return base.join(listed.hint("shuffle_merge"), "field")


def anomalies(values: DataFrame, stats: DataFrame, sigma: float = 2.5, least_n: int = 5) -> DataFrame:
    """Values further than sigma deviations from their field's mean, for fields with enough values."""
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    # stats has one row a field.
    return values.join(F.broadcast(stats.select("field", "n", "mean", "std")), "field").where((F.col("n") >= least_n) & (F.col("std") > 0)).withColumn("z", z).where(F.col("z") > sigma).drop("n", "mean", "std")


def extraction_quality(log: DataFrame, as_of: Column, recent_days: int = RECENT_DAYS) -> DataFrame:
    """Per field: n, corrections and accuracy, of all time and recent, and the trend."""
    recent = F.col("ts") > as_of - F.expr(f"interval {recent_days} days")
    wrong = F.col("was_corrected")
    out = log.groupBy("field").agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"), F.count_if(recent).alias("recent_n"), F.count_if(recent & wrong).alias("recent_wrong"))
    share = lambda bad, n: F.round(1 - F.col(bad) / F.col(n), 6)
    out = out.withColumns({"accuracy": share("n_wrong", "n"), "recent_accuracy": F.when(F.col("recent_n") > 0, share("recent_wrong", "recent_n"))})
    change = F.col("recent_accuracy") - F.col("accuracy")
    return out.withColumn("trend", F.when(change > TREND, "improving").when(change < -TREND, "declining").otherwise("stable"))


def problem_fields(quality: DataFrame, least: float = LEAST_ACCURACY) -> DataFrame:
    """Fields below a recent accuracy, with what to do about them."""
    advice = F.when(F.col("recent_accuracy") < 0.3, "rewrite rules").when(F.col("recent_n") < 10, "collect corrections").otherwise("review patterns")
    return quality.where(F.col("recent_accuracy") < least).select("field", "recent_n", "recent_accuracy", advice.alias("advice"))


def pattern_statistics(log: DataFrame) -> DataFrame:
    """Per field: patterns used, successes, failures."""
    per = log.groupBy("field", "pattern_id").agg(F.count_if(~F.col("was_corrected")).alias("s"), F.count_if("was_corrected").alias("f"))
    return per.groupBy("field").agg(F.count("*").alias("n_patterns"), F.sum("s").alias("successes"), F.sum("f").alias("failures"))


def pattern_table(log: DataFrame, fail_factor: int = 2, least_fails: int = 3) -> DataFrame:
    """Patterns with counters, confidence (s + 1) / (n + 2), raised a little when well proven, and whether they stay active."""
    per = log.groupBy("field", "pattern_id").agg(F.count_if(~F.col("was_corrected")).alias("s"), F.count_if("was_corrected").alias("f"))
    base = (F.col("s") + 1) / (F.col("s") + F.col("f") + 2)
    raised = F.when((F.col("s") + F.col("f") >= 5) & (base > 0.7), F.least(F.lit(0.95), base + 0.05)).otherwise(base)
    active = ~((F.col("f") > fail_factor * F.col("s")) & (F.col("f") >= least_fails))
    return per.withColumns({"confidence": F.round(raised, 6), "is_active": active})


def top_patterns(table: DataFrame, k: int = 50) -> DataFrame:
    """The k best active patterns of each field."""
    order = Window.partitionBy("field").orderBy(F.desc(F.col("s") / (F.col("s") + F.col("f") + 1)), F.desc("s"), "pattern_id")
    return table.where("is_active").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recommendations(training: DataFrame, few: int = 20, good: float = 0.7) -> DataFrame:
    """What each field needs: nothing yet, more examples, better ones, or training."""
    per = training.where("is_active").groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    kind = F.when(F.col("n") < 5, "empty").when(F.col("n") < few, "few examples").when(F.col("mean_quality") < good, "low quality").otherwise("trainable")
    return per.select("field", "n", "mean_quality", kind.alias("advice"))


def field_intelligence(log: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics and accuracy of each field with a maturity class."""
    acc = log.groupBy("field").agg(F.round(1 - F.avg(F.col("was_corrected").cast("double")), 6).alias("accuracy"))
    out = stats.select("field", "n", "n_values").join(acc.hint("shuffle_merge"), "field")
    level = F.when(F.col("n") < 5, "new").when((F.col("n") >= 50) & (F.col("accuracy") >= 0.9), "expert").when((F.col("n") >= 20) & (F.col("accuracy") >= 0.75), "mature").otherwise("learning")
    return out.withColumn("maturity", level)


def vote(candidates: DataFrame) -> DataFrame:
    """The best value of each (doc_id, field): weights times confidences added by compare key, raised for agreement; of the
    winner the most confident candidate, its confidence raised to 0.98 at most. A single candidate stays as it is."""
    weights = F.create_map(*[F.lit(x) for kv in METHOD_WEIGHTS.items() for x in kv])
    scored = candidates.withColumn("w", F.col("confidence") * F.coalesce(F.try_element_at(weights, F.col("method")), F.lit(0.5)))
    key = compare_key(F.col("value").cast("string"))
    groups = scored.groupBy("doc_id", "field", key.alias("key")).agg(F.sum("w").alias("total"), F.count("*").alias("n"), F.max(F.struct("confidence", "method", "value")).alias("best"))
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc(F.round(F.col("total") * (1 + 0.15 * (F.col("n") - 1)), 9)), "best.value")
    top = groups.withColumn("r", F.row_number().over(order)).where("r = 1")
    conf = F.when(F.col("n") == 1, F.col("best.confidence")).otherwise(F.least(F.lit(0.98), F.col("best.confidence") * (1 + 0.1 * (F.col("n") - 1))))
    return top.select("doc_id", "field", F.col("best.value").alias("value"), F.round(conf, 6).alias("confidence"), F.col("best.method").alias("method"))


def running_statistics(log: DataFrame) -> DataFrame:
    """Number, total and extremes of each field's values so far."""
    w = Window.partitionBy("field").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("id", "field", F.count("*").over(w).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).over(w).cast("double").alias("total"), F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


def model_versions(registry: DataFrame) -> DataFrame:
    """Versions numbered per field in order of training; the last one is active."""
    w = Window.partitionBy("field").orderBy("trained_at")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return registry.withColumn("version", F.row_number().over(w)).withColumn("is_active", F.col("version") == F.max("version").over(full.orderBy("trained_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def rollback(versions: DataFrame) -> DataFrame:
    """The version before the active one becomes active, where there is one."""
    last = F.max("version").over(Window.partitionBy("field"))
    return versions.withColumn("is_active", F.col("version") == F.greatest(F.lit(1), last - 1))


def keep_champion(versions: DataFrame) -> DataFrame:
    """Each version with whether its accuracy is at least that of the best before it."""
    before = F.max("accuracy").over(Window.partitionBy("field").orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    return versions.withColumn("accepted", before.isNull() | (F.col("accuracy") >= before))


def corrections_since_training(feedback: DataFrame, every: int = 5) -> DataFrame:
    """Corrections of each field numbered, with the training epoch and whether one fires (every `every` corrections)."""
    w = Window.partitionBy("field").orderBy("ts", "id")
    n = F.row_number().over(w)
    return feedback.select("id", "field", (F.floor((n - 1) / every)).cast("long").alias("epoch"), ((n - 1) % every + 1).cast("int").alias("since"), (n % every == 0).alias("fires"))


def latest_corrections(feedback: DataFrame) -> DataFrame:
    """The newest correction of each (doc_id, field)."""
    return feedback.groupBy("doc_id", "field").agg(F.max_by(F.struct("corrected", "id"), F.struct("ts", "id")).alias("c")).select("doc_id", "field", F.col("c.corrected").alias("corrected"), F.col("c.id").alias("id"))


def overlay(extractions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Extractions with the newest correction in place of the value, method "corrected"."""
    last = latest_corrections(feedback).select("doc_id", "field", F.col("corrected").alias("__new"))
    out = extractions.join(last.hint("shuffle_merge"), ["doc_id", "field"], "left")
    return out.withColumns({"method": F.when(F.col("__new").isNotNull(), "corrected").otherwise(F.col("method")), "value": F.coalesce("__new", "value")}).drop("__new")


def reevaluate(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of two scored results the new one if it scores at least as high."""
    both = new.select(key, F.col("score").alias("new_score")).join(old.select(key, F.col("score").alias("old_score")).hint("shuffle_merge"), key, "left")
    return both.withColumn("keeps", F.when(F.col("old_score").isNull() | (F.col("new_score") >= F.col("old_score")), "new").otherwise("old"))


def soft_delete(training: DataFrame, ids: DataFrame) -> DataFrame:
    """Examples named in ids become inactive."""
    gone = ids.select("id", F.lit(True).alias("__gone")).distinct()
    return training.join(gone.hint("shuffle_merge"), "id", "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")


def add_examples(training: DataFrame, new: DataFrame) -> DataFrame:
    """New examples whose (field, value) no active example has, each once."""
    known = training.where("is_active").select("field", "value").distinct()
    return new.join(known.hint("shuffle_merge"), ["field", "value"], "left_anti").dropDuplicates(["field", "value"])


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of both tables added by key."""
    return old.select(*keys, "n").unionAll(new.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def mark_wrong(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Log rows with was_correct: false where (doc_id, field) was corrected."""
    bad = feedback.select("doc_id", "field").distinct().withColumn("__bad", F.lit(True))
    return log.join(bad.hint("shuffle_merge"), ["doc_id", "field"], "left").withColumn("was_correct", F.col("__bad").isNull()).drop("__bad")


def failing_patterns(log: DataFrame, feedback: DataFrame, last: int = 5) -> DataFrame:
    """Failures charged to patterns: for each corrected (doc_id, field) the last log rows before it."""
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("ts"), F.desc("id"))
    recent = log.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    hit = recent.join(feedback.select("doc_id", "field").distinct().hint("shuffle_merge"), ["doc_id", "field"], "left_semi")
    return hit.groupBy("pattern_id").agg(F.count("*").alias("n"))


def field_history(log: DataFrame, k: int = 10, only_correct: bool = True) -> DataFrame:
    """The k newest values of each field."""
    rows = log.where("not was_corrected") if only_correct else log
    w = Window.partitionBy("field").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("field", "rank", "id", "value")


def newest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(k)


def corrections_with_samples(feedback: DataFrame, samples: DataFrame) -> DataFrame:
    """Corrections beside the training sample of the same field and value, and samples that no correction explains (id null)."""
    key = ["field", "value"]
    fb = feedback.select("id", "field", F.floor("corrected").cast("long").alias("value"))
    own = samples.groupBy(*key).agg(F.min("id").alias("sample_id"))
    linked = fb.join(own.hint("shuffle_merge"), key, "left").select("id", *key, "sample_id")
    orphans = own.join(fb.select(*key).distinct().hint("shuffle_merge"), key, "left_anti").select(F.lit(None).cast("long").alias("id"), *key, "sample_id")
    return linked.unionAll(orphans)


def training_order(training: DataFrame, least_quality: float, k: int) -> DataFrame:
    """Each field's k best active examples of at least a quality."""
    w = Window.partitionBy("field").orderBy(F.desc("quality"), "id")
    rows = training.where("is_active").where(F.col("quality") >= least_quality)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("field", "rank", "id", "value", "source")


def train_status(feedback: DataFrame, versions: DataFrame, every: int = 5) -> DataFrame:
    """Per field: corrections since its last training, and whether it is ready for another."""
    last = versions.groupBy("field").agg(F.max("trained_at").alias("last"))
    both = feedback.join(F.broadcast(last), "field", "left")  # one row a field
    out = both.groupBy("field").agg(F.count_if(F.col("last").isNull() | (F.col("ts") >= F.col("last"))).alias("pending"))
    return out.withColumn("ready", F.col("pending") >= every)


def quality_report(training: DataFrame, versions: DataFrame) -> DataFrame:
    """Data quality beside the active model of each field; fields without a model have a null version."""
    data = training.where("is_active").groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    return data.join(versions.where("is_active").select("field", "version", "accuracy").hint("shuffle_merge"), "field", "left")


def learning_status(log: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: documents, extractions, share that is right, patterns and how many are active."""
    a = log.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_extractions"), F.round(1 - F.avg(F.col("was_corrected").cast("double")), 6).alias("share_right"))
    b = patterns.agg(F.count("*").alias("n_patterns"), F.count_if("is_active").alias("n_active"))
    return a.crossJoin(F.broadcast(b))  # one row each
