"""Learning logs derived from `events`: what was extracted, by which method, and what was corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names by the remainder of event_id.
METHODS = ["rules", "learned_pattern", "auto_rule", "ml"]
SOURCES = ["correction", "manual", "approved", "rules_validated", "rules_raw", "auto"]


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, field, value, method, confidence, was_corrected, pattern_id, ts."""
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(e: DataFrame) -> DataFrame:
    """Events, a table or a stream, as an extraction log."""
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), (F.col("event_id") % 4).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), "value", method.alias("method"), ((_k() % 100) / 100.0).alias("confidence"), (_k() % 5 == 0).alias("was_corrected"), (F.col("event_id") % 20).alias("pattern_id"), "ts")


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections: id, doc_id, field, original, corrected, ts."""
    log = extraction_log(spark, sf_dir).where("was_corrected")
    return log.select("id", "doc_id", "field", F.col("value").alias("original"), (F.col("value") + 1).alias("corrected"), "ts")


def training_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, field, value, source, quality, is_active, ts."""
    log = extraction_log(spark, sf_dir)
    source = F.get(F.array(*[F.lit(m) for m in SOURCES]), (F.col("id") % 6).cast("int"))
    return log.select("id", "field", F.floor("value").cast("long").alias("value"), source.alias("source"), (1.0 - (F.col("id") % 6) * 0.1).alias("quality"), (F.col("id") % 11 != 0).alias("is_active"), "ts")


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trained model a field and week: field, trained_at, n_samples, accuracy."""
    log = extraction_log(spark, sf_dir)
    week = F.date_trunc("week", "ts")
    return log.groupBy("field", week.alias("trained_at")).agg(F.count("*").alias("n_samples"), F.round(1 - F.avg(F.col("was_corrected").cast("double")), 6).alias("accuracy"))
