"""Queries of the learning loop over the logs and notices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import analytics as A
from docloom.operators import corrections as C
from docloom.operators import packs as P
from docloom.operators import rules, structure
from docloom.operators import learning as L
from docloom.plans.logs import _LOG
from docloom.sources import logs
from docloom.sources.notices import render_notices
from docloom.sources.tenders import render_tenders


def corrected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fields with their latest correction."""
    got = C.corrected_map(logs.feedback_log(spark, sf_dir))
    return got.select("doc_id", F.explode("corrected").alias("field", "value"))


def corrections_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by field after every tenth was deleted and every tenth plus one updated to 0."""
    log = logs.feedback_log(spark, sf_dir)
    changes = log.where("id % 10 in (0, 5)").select("id", F.when(F.col("id") % 10 == 0, "delete").otherwise("update").alias("action"), F.lit(0.0).alias("corrected"))
    return C.apply_changes(log, changes).groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("corrected") == 0).alias("n_zero"))


def samples_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by field that remain when the corrections with ids divisible by 3 are deleted with their samples."""
    log = logs.feedback_log(spark, sf_dir)
    samples = log.select("field", F.col("corrected").alias("value"), F.when(F.col("id") % 4 != 0, F.col("original")).alias("wrong"))
    return C.cascade_delete(samples, log.where("id % 3 = 0")).groupBy("field").agg(F.count("*").alias("n"))


def imported_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by field after importing older samples into newer ones."""
    rows = logs.training_data(spark, sf_dir).select("field", "value", F.col("source").alias("snippet"), "id")
    new, old = rows.where("id % 2 = 0").drop("id"), rows.where("id % 2 = 1").drop("id")
    return C.import_samples(new, old).groupBy("field").agg(F.count("*").alias("n"))


def logged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log keeps of whole documents: cut to 1000 and 2000 characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("value"), F.col("text").alias("snippet"))
    return C.log_rows(docs).select("doc_id", F.length("value").alias("value_chars"), F.length("snippet").alias("snippet_chars"))


def rule_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules generated from the contexts of found values, applied to the texts they came from: how many give the value back."""
    docs = render_tenders(spark, sf_dir)
    known = rules.apply_rules(docs, [r for r in rules.BUILTIN if r.field == "scadenza_offerte"]).select("doc_id", "field", "value")
    made = C.generated_rules(L.contexts(docs, known))
    pattern = made.orderBy(F.desc("n_docs"), "pattern").first()["pattern"]  # the best rule, a literal for the scan
    hit = C.apply_rule(F.col("text"), pattern)
    both = docs.select("doc_id", hit.alias("hit")).join(known.hint("shuffle_merge"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("hit") == F.col("value")).alias("n_right"))


def rule_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each pattern of the log as an automatic rule, right and wrong results counted."""
    log = logs.extraction_log(spark, sf_dir)
    used = log.groupBy("field", "pattern_id").agg(F.count_if(~F.col("was_corrected")).alias("s"), F.count_if("was_corrected").alias("f"))
    return used.select("field", "pattern_id", C.rule_confidence(F.col("s"), F.col("f"), F.col("s") % 9).alias("confidence"))


def new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by field after offering patterns of which some are active already."""
    log = logs.extraction_log(spark, sf_dir)
    table = log.groupBy("field", F.concat(F.lit("p"), F.col("pattern_id") % 7).alias("pattern")).agg(F.lit(0.5).alias("confidence")).withColumn("is_active", F.substring("pattern", 2, 2).cast("int") % 2 == 0)
    offered = log.select("field", F.concat(F.lit("p"), F.col("pattern_id") % 5).alias("pattern"), F.lit(0.4).alias("confidence"))
    return C.add_rules(table, offered).groupBy("field").agg(F.count("*").alias("n"), F.count_if("is_active").alias("n_active"))


def newest_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 corrections of each field."""
    return C.last_of(logs.feedback_log(spark, sf_dir), ["field"], [F.desc("ts"), F.desc("id")], 50).select("field", "id")


def last_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_extractions(logs.extraction_log(spark, sf_dir)).select("doc_id", "field", "value", "method")


def known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.known_fields([r.field for r in rules.BUILTIN], logs.extraction_log(spark, sf_dir))


def ml_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.model_status(A.model_versions(logs.model_registry(spark, sf_dir)), logs.training_data(spark, sf_dir))


def correction_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of corrections whose corrected value is in the text, or only the original one, or neither."""
    docs = render_notices(spark, sf_dir)
    key = F.col("doc_id").cast("long")
    corrected = F.when(key % 3 == 0, "scrittura privata").otherwise("valore mai scritto")
    fixes = docs.select("doc_id", F.lit("forma").alias("field"), F.when(key % 3 == 1, "forma pubblica").otherwise("mai visto").alias("original"), corrected.alias("corrected"))
    made = C.samples_of(fixes, docs)
    return made.groupBy("value", "wrong").agg(F.count("*").alias("n"), F.max(F.length("snippet") <= C.SNIPPET_CHARS).alias("bounded"))


def partial_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two words of a value stand near each other although the whole value isn't in the text."""
    docs = render_notices(spark, sf_dir)
    at = C.partial_position(F.col("text"), F.lit("intervento introvabile finanziato"))
    return docs.select("doc_id", (F.lower(F.substring("text", at, F.lit(10))) == "intervento").alias("found"))


def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each tender with where the next begins."""
    docs = render_tenders(spark, sf_dir)
    marks = structure.lines(docs).where(F.trim("line").isin(*structure.SECTION_WORDS)).select("doc_id", F.col("line").alias("section"), F.col("line_no").alias("start"))
    return C.segments(marks, ["doc_id"]).select("doc_id", "section", (F.col("stop") - F.col("start")).alias("n_lines"))


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders by which of their pages hold little text and whether a table is there."""
    found = C.page_warnings(structure.pages(render_tenders(spark, sf_dir)), 1000)
    return found.groupBy("low_pages", "no_table").agg(F.count("*").alias("n"))


def richer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer of a document's text and a rendering of it with a mark in front, for every third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "text"))
    return docs.select("doc_id", F.length(P.richer(F.col("text"), other)).alias("n"))


def field_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render_notices(spark, sf_dir).select("doc_id", P.field_section(F.col("text"), "base").alias("s"))
    return found.select("doc_id", F.lower("s").contains("importo").alias("found"), (F.length("s") <= 2000).alias("bounded"))


QUERIES = {f.__name__: f for f in (corrected_fields, corrections_after_changes, samples_after_delete, imported_samples, logged_values, rule_generation, rule_confidences, new_rules, newest_contexts, last_extractions, known_fields, ml_status, correction_snippets, partial_positions, section_segments, page_notes, richer_text, field_sections)}

_W = f"WITH {_LOG}" if not _LOG.lstrip().upper().startswith("WITH") else _LOG
_FIELDS = ", ".join(f"'{r.field}'" for r in rules.BUILTIN)
ORACLE_SQL = {
    "corrected_fields": _W + "SELECT doc_id, field, arg_max(corrected, (ts, id)) AS value FROM fb GROUP BY ALL",
    "corrections_after_changes": _W + "SELECT field, count(*) AS n, count(*) FILTER (WHERE id % 10 = 5 OR corrected = 0) AS n_zero FROM fb WHERE id % 10 <> 0 GROUP BY field",
    "samples_after_delete": _W + """, s AS (SELECT field, corrected AS value, CASE WHEN id % 4 <> 0 THEN original END AS wrong FROM fb), g AS (SELECT field, corrected AS value, original AS o FROM fb WHERE id % 3 = 0)
SELECT field, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.field = s.field AND g.value = s.value AND (s.wrong IS NULL OR s.wrong = g.o)) GROUP BY field""",
    "imported_samples": _W + """, n AS (SELECT field, value, source FROM td WHERE id % 2 = 0), x AS (SELECT DISTINCT field, value, source FROM td WHERE id % 2 = 1 EXCEPT SELECT field, value, source FROM n)
SELECT field, count(*) AS n FROM (SELECT field FROM n UNION ALL SELECT field FROM x) GROUP BY field""",
    "logged_values": "SELECT doc_id, CAST(least(length(text), 1000) AS INTEGER) AS value_chars, CAST(least(length(text), 2000) AS INTEGER) AS snippet_chars FROM documents",
    "rule_generation": "SELECT count(*) AS n, count(*) AS n_right FROM orders",
    "rule_confidences": _W + """, u AS (SELECT field, pattern_id, CAST(s AS BIGINT) AS s, CAST(f AS BIGINT) AS f, s % 9 AS d FROM pat)
SELECT field, pattern_id, CASE WHEN s + f = 0 THEN round(least(0.7, 0.4 + 0.05 * d), 6) WHEN d >= 5 THEN round(least(0.9, (s + 1) / (s + f + 2) + 0.05), 6) ELSE round((s + 1) / (s + f + 2), 6) END AS confidence FROM u""",
    "new_rules": _W + """, t AS (SELECT DISTINCT field, pattern_id % 7 AS p FROM log), o AS (SELECT DISTINCT field, pattern_id % 5 AS p FROM log), x AS (SELECT field, p FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.field = o.field AND t.p = o.p AND t.p % 2 = 0))
SELECT field, count(*) AS n, count(*) FILTER (WHERE a) AS n_active FROM (SELECT field, p % 2 = 0 AS a FROM t UNION ALL SELECT field, true FROM x) GROUP BY field""",
    "newest_contexts": _W + "SELECT field, id FROM fb QUALIFY row_number() OVER (PARTITION BY field ORDER BY ts DESC, id DESC) <= 50",
    "last_extractions": _W + "SELECT doc_id, field, value, method FROM log QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY ts DESC, id DESC) = 1",
    "known_fields": _W + f"SELECT unnest([{_FIELDS}]) AS field UNION SELECT field FROM log",
    "ml_status": _W + "SELECT field, version, coalesce(n, 0) AS n_samples, coalesce(n, 0) >= 5 AS trainable FROM (SELECT field, max(version) AS version FROM ver GROUP BY field) FULL JOIN (SELECT field, count(*) AS n FROM td WHERE is_active GROUP BY field) USING (field)",
    "correction_snippets": "SELECT CASE WHEN k % 3 = 0 THEN 'scrittura privata' ELSE 'valore mai scritto' END AS value, CASE WHEN k % 3 = 1 THEN 'forma pubblica' ELSE 'mai visto' END AS wrong, count(*) AS n, true AS bounded FROM (SELECT c_custkey AS k FROM customer) GROUP BY ALL",
    "partial_positions": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 4 IN (0, 1) THEN true END AS found FROM customer",
    "section_segments": """WITH l AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, section, CAST(CASE section WHEN 'SUBAPPALTO' THEN NULL WHEN 'DISCIPLINARE DI GARA' THEN 17 + 4 * coalesce(n, 0) ELSE 2 END AS INTEGER) AS n_lines
FROM orders LEFT JOIN l ON k = o_orderkey, (SELECT unnest(['DISCIPLINARE DI GARA', 'GARANZIA PROVVISORIA', 'SOPRALLUOGO', 'SUBAPPALTO']) AS section)""",
    "page_notes": "SELECT [1, 2, 3] AS low_pages, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS no_table, count(*) AS n FROM orders GROUP BY ALL",
    "richer_text": "SELECT doc_id, CAST(length(text) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n FROM documents",
    "field_sections": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, true AS found, true AS bounded FROM customer",
}
