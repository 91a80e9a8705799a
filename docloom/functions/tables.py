"""Table functions for SQL, without Python: they are called with LATERAL and run as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, memory: DataFrame | None = None, similar: DataFrame | None = None) -> list[str]:
    """Registers match_all(text, pattern) and, over memory(id, doc_id, field, value, method, confidence, was_correct, ts) and similar(doc_id, other, score),
    field_history(field, k, only_correct) and similar_values(doc_id, field). Gives their names.

    match_all: every hit of a pattern without regard to case, with its number, 1-based place and 50 characters on either side. The pattern has no groups.
    field_history: the k newest values of a field (200 at most). similar_values: the newest right value that each similar document has for a field.
    """
    made = {
        "match_all(s STRING, p STRING)": r"""TABLE(n INT, value STRING, at INT, context STRING) RETURN
SELECT i + 1, hit, start, substring(s, greatest(1, start - 50), least(start - 1, 50) + length(hit) + 50) FROM (
  SELECT i, hit, 1 + aggregate(slice(gaps, 1, i + 1), 0, (a, g) -> a + length(g)) + aggregate(slice(hits, 1, i), 0, (a, h) -> a + length(h)) AS start
  FROM (SELECT regexp_extract_all(s, concat('(?iu)', p), 0) AS hits, split(s, concat('(?iu)', p)) AS gaps) LATERAL VIEW posexplode(hits) AS i, hit)""",
    }
    if memory is not None:
        memory.createOrReplaceTempView("docloom_memory")
        made["field_history(f STRING, k INT, only_correct BOOLEAN)"] = """TABLE(rank INT, id BIGINT, doc_id STRING, value STRING, method STRING, confidence DOUBLE) RETURN
SELECT r, id, doc_id, value, method, confidence FROM (
  SELECT id, CAST(doc_id AS STRING) AS doc_id, field, CAST(value AS STRING) AS value, method, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY field, only_correct ORDER BY ts DESC, id DESC) AS r
  FROM docloom_memory WHERE field = f AND (was_correct OR NOT only_correct)) WHERE r <= least(k, 200)"""
    if memory is not None and similar is not None:
        similar.createOrReplaceTempView("docloom_similar")
        made["similar_values(d STRING, f STRING)"] = """TABLE(other STRING, score DOUBLE, value STRING) RETURN
SELECT x.other, x.score, m.value FROM docloom_similar x JOIN (
  SELECT CAST(doc_id AS STRING) AS doc_id, field, max_by(CAST(value AS STRING), struct(ts, id)) AS value FROM docloom_memory WHERE was_correct GROUP BY doc_id, field) m ON m.doc_id = x.other
WHERE x.doc_id = d AND m.field = f"""
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {body}")
    return [n.split("(")[0] for n in made]
