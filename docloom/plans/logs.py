"""Queries over the learning logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import analytics as A
from docloom.sources import logs as L

_LOG = """
log AS (SELECT event_id AS id, user_id AS doc_id, event_type AS field, value, ['rules','learned_pattern','auto_rule','ml'][event_id % 4 + 1] AS method,
  (CAST(props->>'$.k' AS INTEGER) % 100) / 100.0 AS confidence, CAST(props->>'$.k' AS INTEGER) % 5 = 0 AS was_corrected, event_id % 20 AS pattern_id, ts FROM events),
fb AS (SELECT id, doc_id, field, value AS original, value + 1 AS corrected, ts FROM log WHERE was_corrected),
td AS (SELECT id, field, CAST(floor(value) AS BIGINT) AS value, ['correction','manual','approved','rules_validated','rules_raw','auto'][id % 6 + 1] AS source,
  1.0 - (id % 6) * 0.1 AS quality, id % 11 <> 0 AS is_active, ts FROM log),
reg AS (SELECT field, date_trunc('week', ts) AS trained_at, count(*) AS n_samples, round(1 - avg(CASE WHEN was_corrected THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM log GROUP BY ALL),
ver AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY trained_at) AS INTEGER) AS version FROM reg),
pat AS (SELECT field, pattern_id, count(*) FILTER (WHERE NOT was_corrected) AS s, count(*) FILTER (WHERE was_corrected) AS f FROM log GROUP BY ALL),
q AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE was_corrected) AS n_wrong, count(*) FILTER (WHERE recent) AS recent_n, count(*) FILTER (WHERE recent AND was_corrected) AS recent_wrong
  FROM (SELECT *, ts > (SELECT max(ts) FROM log) - INTERVAL 7 DAY AS recent FROM log) GROUP BY field),
qa AS (SELECT *, round(1 - n_wrong / n, 6) AS accuracy, CASE WHEN recent_n > 0 THEN round(1 - recent_wrong / recent_n, 6) END AS recent_accuracy FROM q),
pc AS (SELECT *, CASE WHEN s + f >= 5 AND (s + 1) / (s + f + 2) > 0.7 THEN least(0.95, (s + 1) / (s + f + 2) + 0.05) ELSE (s + 1) / (s + f + 2) END AS c, NOT (f > 2 * s AND f >= 3) AS is_active FROM pat)
"""


def _as_of(log: DataFrame) -> F.Column:
    return F.lit(log.agg(F.max("ts")).first()[0])


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = L.extraction_log(spark, sf_dir)
    return A.extraction_quality(log, _as_of(log), 7)


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pattern_table(L.extraction_log(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.model_versions(L.model_registry(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_statistics(L.extraction_log(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


QUERIES = {
    "global_stats": lambda s, d: L.extraction_log(s, d).agg(F.count("*").alias("n_extractions"), F.count_distinct("doc_id").alias("n_docs"), F.count_if("was_corrected").alias("n_corrections"), F.count_distinct("field").alias("n_fields")),
    "corrections_by_field": lambda s, d: A.count_by(L.feedback_log(s, d), "field"),
    "samples_by_field": lambda s, d: A.count_by(L.training_data(s, d).where("is_active"), "field"),
    "data_quality_sets": lambda s, d: A.data_quality(L.training_data(s, d)).select("source", "field", "n", "mean_quality", "n_values"),
    "value_stats": lambda s, d: _rounded(_stats(s, d)).select("field", "n", "n_values", "mean", "std", "low", "high", F.get("common", F.lit(0)).alias("most_common")),
    "value_anomalies": lambda s, d: A.anomalies(L.extraction_log(s, d), _stats(s, d)).select("id", "field", "value", F.round("z", 6).alias("z")),
    "quality_trend": _quality,
    "problem_fields": lambda s, d: A.problem_fields(_quality(s, d), 0.81),
    "pattern_stats": lambda s, d: A.pattern_statistics(L.extraction_log(s, d)),
    "pattern_counters": _patterns,
    "top_patterns": lambda s, d: A.top_patterns(_patterns(s, d), 5).select("field", "rank", "pattern_id", "s", "f"),
    "recommendations": lambda s, d: A.recommendations(L.training_data(s, d), 20, 0.76),
    "field_intelligence": lambda s, d: A.field_intelligence(L.extraction_log(s, d), _stats(s, d)),
    "candidate_vote": lambda s, d: A.vote(L.extraction_log(s, d).withColumn("value", F.floor("value").cast("long"))),
    "running_stats": lambda s, d: A.running_statistics(L.extraction_log(s, d)),
    "model_versions": lambda s, d: _versions(s, d),
    "rollback": lambda s, d: A.rollback(_versions(s, d)).select("field", "version", "is_active"),
    "champion": lambda s, d: A.keep_champion(_versions(s, d)).select("field", "version", "accuracy", "accepted"),
    "train_epochs": lambda s, d: A.corrections_since_training(L.feedback_log(s, d)),
    "corrections_overlay": lambda s, d: A.overlay(L.extraction_log(s, d), L.feedback_log(s, d)).select("id", "doc_id", "field", "value", "method"),
    "corrections_list": lambda s, d: A.newest(L.feedback_log(s, d), 100).select("id", "doc_id", "field", "original", "corrected"),
    "smart_reevaluation": lambda s, d: A.reevaluate(
        L.extraction_log(s, d).where("id % 2 = 0").groupBy("doc_id").agg(F.round(F.avg("confidence"), 6).alias("score")),
        L.extraction_log(s, d).where("id % 2 = 1").groupBy("doc_id").agg(F.round(F.avg("confidence"), 6).alias("score")),
    ),
    "soft_delete": lambda s, d: A.count_by(A.soft_delete(L.training_data(s, d), L.feedback_log(s, d)), "field", "is_active"),
    "add_examples": lambda s, d: A.count_by(A.add_examples(L.training_data(s, d).where("id % 2 = 0"), L.training_data(s, d).where("id % 2 = 1")), "field"),
    "pattern_upsert": lambda s, d: A.upsert_counts(A.count_by(L.extraction_log(s, d), "field", "pattern_id"), A.count_by(L.feedback_log(s, d).withColumn("pattern_id", F.col("id") % 30), "field", "pattern_id"), ["field", "pattern_id"]),
    "mark_wrong": lambda s, d: A.count_by(A.mark_wrong(L.extraction_log(s, d), L.feedback_log(s, d)), "field", "was_correct"),
    "failing_patterns": lambda s, d: A.failing_patterns(L.extraction_log(s, d), L.feedback_log(s, d)),
    "field_history": lambda s, d: A.field_history(L.extraction_log(s, d)),
    "active_versions_text": lambda s, d: _versions(s, d).where("is_active").agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.format_string("%s:v%d", "field", "version"))), ", "), F.lit("rules-only")).alias("model_version")),
    "corrections_samples": lambda s, d: A.corrections_with_samples(L.feedback_log(s, d), L.training_data(s, d)),
    "training_order": lambda s, d: A.training_order(L.training_data(s, d), 0.6, 20),
    "train_status": lambda s, d: A.train_status(L.feedback_log(s, d), _versions(s, d)),
    "quality_report": lambda s, d: A.quality_report(L.training_data(s, d), _versions(s, d)),
    "learning_status": lambda s, d: A.learning_status(L.extraction_log(s, d), _patterns(s, d)),
    "monitoring": lambda s, d: _quality(s, d).select("field", "n", "accuracy", (F.col("n") >= 3).alias("ruleable")),
}

_W = f"WITH {_LOG} "
ORACLE_SQL = {
    "global_stats": _W + "SELECT count(*) AS n_extractions, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE was_corrected) AS n_corrections, count(DISTINCT field) AS n_fields FROM log",
    "corrections_by_field": _W + "SELECT field, count(*) AS n FROM fb GROUP BY field",
    "samples_by_field": _W + "SELECT field, count(*) AS n FROM td WHERE is_active GROUP BY field",
    "data_quality_sets": _W + "SELECT source, field, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_quality, count(DISTINCT value) AS n_values FROM td WHERE is_active GROUP BY GROUPING SETS ((), (source), (field))",
    "value_stats": _W + ", c AS (SELECT field, value, count(*) AS k FROM log GROUP BY field, value) SELECT field, count(*) AS n, count(DISTINCT value) AS n_values, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, (array_agg(value ORDER BY k DESC, value))[1] AS most_common FROM (SELECT log.*, c.k FROM log JOIN c USING (field, value)) GROUP BY field",
    "value_anomalies": _W + ", s AS (SELECT field, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM log GROUP BY field) SELECT id, field, value, round(abs(value - mean) / std, 6) AS z FROM log JOIN s USING (field) WHERE n >= 5 AND std > 0 AND abs(value - mean) / std > 2.5",
    "quality_trend": _W + "SELECT *, CASE WHEN recent_accuracy - accuracy > 0.05 THEN 'improving' WHEN recent_accuracy - accuracy < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM qa",
    "problem_fields": _W + "SELECT field, recent_n, recent_accuracy, CASE WHEN recent_accuracy < 0.3 THEN 'rewrite rules' WHEN recent_n < 10 THEN 'collect corrections' ELSE 'review patterns' END AS advice FROM qa WHERE recent_accuracy < 0.81",
    "pattern_stats": _W + "SELECT field, count(*) AS n_patterns, CAST(sum(s) AS BIGINT) AS successes, CAST(sum(f) AS BIGINT) AS failures FROM pat GROUP BY field",
    "pattern_counters": _W + "SELECT field, pattern_id, s, f, round(CAST(c AS DOUBLE), 6) AS confidence, is_active FROM pc",
    "top_patterns": _W + "SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY s / (s + f + 1) DESC, s DESC, pattern_id) AS INTEGER) AS rank, pattern_id, s, f FROM pc WHERE is_active) WHERE rank <= 5",
    "recommendations": _W + ", p AS (SELECT field, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_quality FROM td WHERE is_active GROUP BY field) SELECT *, CASE WHEN n < 5 THEN 'empty' WHEN n < 20 THEN 'few examples' WHEN mean_quality < 0.76 THEN 'low quality' ELSE 'trainable' END AS advice FROM p",
    "field_intelligence": _W + ", p AS (SELECT field, count(*) AS n, count(DISTINCT value) AS n_values, round(1 - avg(CASE WHEN was_corrected THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM log GROUP BY field) SELECT *, CASE WHEN n < 5 THEN 'new' WHEN n >= 50 AND accuracy >= 0.9 THEN 'expert' WHEN n >= 20 AND accuracy >= 0.75 THEN 'mature' ELSE 'learning' END AS maturity FROM p",
    "candidate_vote": _W + """, c AS (SELECT doc_id, field, CAST(floor(value) AS BIGINT) AS value, method, CAST(confidence AS DOUBLE) AS confidence, CAST(confidence AS DOUBLE) * CASE method WHEN 'rules' THEN 0.7 WHEN 'ml' THEN 0.6 WHEN 'learned_pattern' THEN 0.65 WHEN 'auto_rule' THEN 0.55 ELSE 0.5 END AS w FROM log),
g AS (SELECT doc_id, field, value, sum(w) AS total, count(*) AS n, max({'c': confidence, 'm': method}) AS best FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY round(total * (1 + CAST(0.15 AS DOUBLE) * (n - 1)), 9) DESC, value) AS r FROM g)
SELECT doc_id, field, value, round(CASE WHEN n = 1 THEN best.c ELSE least(CAST(0.98 AS DOUBLE), best.c * (1 + CAST(0.1 AS DOUBLE) * (n - 1))) END, 6) AS confidence, best.m AS method FROM r WHERE r = 1""",
    "running_stats": _W + "SELECT id, field, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS total, min(value) OVER w AS low, max(value) OVER w AS high FROM log WINDOW w AS (PARTITION BY field ORDER BY ts, id ROWS UNBOUNDED PRECEDING)",
    "model_versions": _W + "SELECT *, version = max(version) OVER (PARTITION BY field) AS is_active FROM ver",
    "rollback": _W + "SELECT field, version, version = greatest(1, max(version) OVER (PARTITION BY field) - 1) AS is_active FROM ver",
    "champion": _W + "SELECT field, version, accuracy, coalesce(accuracy >= max(accuracy) OVER (PARTITION BY field ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM ver",
    "train_epochs": _W + ", n AS (SELECT id, field, row_number() OVER (PARTITION BY field ORDER BY ts, id) AS n FROM fb) SELECT id, field, (n - 1) // 5 AS epoch, CAST((n - 1) % 5 + 1 AS INTEGER) AS since, n % 5 = 0 AS fires FROM n",
    "corrections_overlay": _W + ", c AS (SELECT doc_id, field, arg_max(corrected, {'t': ts, 'i': id}) AS new FROM fb GROUP BY ALL) SELECT id, doc_id, field, coalesce(new, value) AS value, CASE WHEN new IS NULL THEN method ELSE 'corrected' END AS method FROM log LEFT JOIN c USING (doc_id, field)",
    "corrections_list": _W + "SELECT id, doc_id, field, original, corrected FROM fb ORDER BY ts DESC, id DESC LIMIT 100",
    "smart_reevaluation": _W + ", a AS (SELECT doc_id, round(avg(CAST(confidence AS DOUBLE)), 6) AS s FROM log WHERE id % 2 = 1 GROUP BY 1), b AS (SELECT doc_id, round(avg(CAST(confidence AS DOUBLE)), 6) AS s FROM log WHERE id % 2 = 0 GROUP BY 1) SELECT a.doc_id, a.s AS new_score, b.s AS old_score, CASE WHEN b.s IS NULL OR a.s >= b.s THEN 'new' ELSE 'old' END AS keeps FROM a LEFT JOIN b USING (doc_id)",
    "soft_delete": _W + "SELECT field, is_active AND id NOT IN (SELECT id FROM fb) AS is_active, count(*) AS n FROM td GROUP BY ALL",
    "add_examples": _W + "SELECT field, count(*) AS n FROM (SELECT DISTINCT field, value FROM td WHERE id % 2 = 1 EXCEPT SELECT field, value FROM td WHERE id % 2 = 0 AND is_active) GROUP BY field",
    "pattern_upsert": _W + "SELECT field, pattern_id, count(*) AS n FROM (SELECT field, pattern_id FROM log UNION ALL SELECT field, id % 30 FROM fb) GROUP BY ALL",
    "mark_wrong": _W + "SELECT field, (doc_id, field) NOT IN (SELECT (doc_id, field) FROM fb) AS was_correct, count(*) AS n FROM log GROUP BY ALL",
    "failing_patterns": _W + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY ts DESC, id DESC) AS r FROM log) SELECT pattern_id, count(*) AS n FROM r WHERE r <= 5 AND (doc_id, field) IN (SELECT (doc_id, field) FROM fb) GROUP BY pattern_id",
    "field_history": _W + "SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY ts DESC, id DESC) AS INTEGER) AS rank, id, value FROM log WHERE NOT was_corrected) WHERE rank <= 10",
    "active_versions_text": _W + "SELECT coalesce(string_agg(field || ':v' || v, ', ' ORDER BY field), 'rules-only') AS model_version FROM (SELECT field, max(version) AS v FROM ver GROUP BY field)",
    "corrections_samples": _W + ", f AS (SELECT id, field, CAST(floor(corrected) AS BIGINT) AS value FROM fb), o AS (SELECT field, value, min(id) AS sample_id FROM td GROUP BY ALL) SELECT f.id, field, value, sample_id FROM f LEFT JOIN o USING (field, value) UNION ALL SELECT NULL, field, value, sample_id FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.field = o.field AND f.value = o.value)",
    "training_order": _W + "SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY quality DESC, id) AS INTEGER) AS rank, id, value, source FROM td WHERE is_active AND quality >= 0.6) WHERE rank <= 20",
    "train_status": _W + ", t AS (SELECT field, max(trained_at) AS last FROM reg GROUP BY field) SELECT field, count(*) FILTER (WHERE last IS NULL OR ts >= last) AS pending, count(*) FILTER (WHERE last IS NULL OR ts >= last) >= 5 AS ready FROM fb LEFT JOIN t USING (field) GROUP BY field",
    "quality_report": _W + ", p AS (SELECT field, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_quality FROM td WHERE is_active GROUP BY field), m AS (SELECT field, version, accuracy FROM ver QUALIFY version = max(version) OVER (PARTITION BY field)) SELECT * FROM p LEFT JOIN m USING (field)",
    "learning_status": _W + "SELECT * FROM (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_extractions, round(1 - avg(CASE WHEN was_corrected THEN 1.0 ELSE 0.0 END), 6) AS share_right FROM log), (SELECT count(*) AS n_patterns, count(*) FILTER (WHERE is_active) AS n_active FROM pc)",
    "monitoring": _W + "SELECT field, n, accuracy, n >= 3 AS ruleable FROM qa",
}
