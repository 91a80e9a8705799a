"""Queries of adaptive enhancement and of checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.scalars import amount_text
from docloom.operators import adaptive as AD
from docloom.operators import corrections as C
from docloom.operators import learning as L
from docloom.operators import rules as R
from docloom.sources.tenders import lots, render_tenders
from docloom.shared import stored


def _tenders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tenders and their extractions, a third of whose subjects, deadlines and project codes are blanked."""
    docs = stored(render_tenders(spark, sf_dir).select("doc_id", "text"))
    pack = [r for r in R.BUILTIN if r.field in ("oggetto_appalto", "scadenza_offerte", "cup", "importo_totale")]
    found = R.apply_rules(docs, pack).select("doc_id", "field", "value", "method")
    k = F.col("doc_id").cast("long")
    gone = ((F.col("field") == "oggetto_appalto") & (k % 4 == 1)) | ((F.col("field") == "scadenza_offerte") & (k % 4 == 2)) | ((F.col("field") == "cup") & (k % 4 == 3))
    return docs, stored(found.withColumns({"value": F.when(gone, " ").otherwise(F.col("value")), "method": F.when(~gone, F.col("method"))}))


def adaptive_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank fields of tenders, filled by a generated rule (deadlines) or from tenders of the same customer (subjects), or left blank (project codes)."""
    docs, found = _tenders(spark, sf_dir)
    memory = stored(AD.memory_rows(found, docs))
    made = C.generated_rules(memory.where("field = 'scadenza_offerte'"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    w = Window.partitionBy("c").orderBy("k")
    others = o.select("k", F.array(*[f("k", n).over(w) for n in (1, 2) for f in (F.lag, F.lead)]).alias("near")).select("k", F.posexplode("near").alias("place", "other")).where("other is not null")
    similar = others.select(F.col("k").cast("string").alias("doc_id"), F.col("other").cast("string").alias("other"), (0.9 - 0.1 * F.col("place")).alias("score"))
    return AD.enhance(docs, found, made, similar, memory).where("field <> 'importo_totale'")


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and subjects of tenders against the profile of their field; every 97th amount is ten times too large and every 89th subject far too long."""
    docs, found = _tenders(spark, sf_dir)
    k = F.col("doc_id").cast("long")
    some = found.where("field in ('importo_totale', 'oggetto_appalto') and trim(value) <> ''")
    bent = some.withColumn("value", F.when((F.col("field") == "importo_totale") & (k % 97 == 0), (F.col("value").cast("double") * 10).cast("decimal(18,2)").cast("string")).when((F.col("field") == "oggetto_appalto") & (k % 89 == 0), F.repeat("value", F.lit(9))).otherwise(F.col("value")))
    return AD.checked(bent, AD.value_profiles(some)).select("doc_id", "field", "anomalies", "is_valid", "confidence")


RECORD = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("total", T.DecimalType(18, 2)), T.StructField("date", T.DateType(), False), T.StructField("open", T.BooleanType()),
    T.StructField("body", T.StructType([T.StructField("name", T.StringType(), False), T.StructField("segment", T.StringType())])),
    T.StructField("lots", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType(), False), T.StructField("amount", T.DoubleType())]))),
])


def record_conformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON, some of them damaged, against their schema."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    total = F.when(k % 7 == 1, "molto").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    name = F.when(k % 6 != 5, F.concat(F.lit("Ente "), F.col("o_custkey").cast("string")))
    body = F.when(k % 10 == 9, F.to_json(F.array(F.lit("x")))).otherwise(F.to_json(F.struct(name.alias("name"), F.col("o_orderstatus").alias("segment"))))
    lot = lambda n, damage: F.concat(F.lit('{"number": '), F.when(damage, '"due"').otherwise(str(n)), F.lit(', "amount": 12.5}'))
    whole = F.concat(
        F.lit('{"id": '), k.cast("string"), F.lit(', "_internal": 1, "total": "'), total, F.lit('"'),
        F.when(k % 5 == 3, "").otherwise(F.concat(F.lit(', "date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))),
        F.lit(', "open": '), F.when(k % 8 == 7, '"forse"').otherwise("true"), F.lit(', "body": '), body, F.lit(', "lots": ['), lot(1, F.lit(False)), F.lit(", "), lot(2, k % 4 == 1), F.lit("]}"),
    )
    raw = F.when(k % 11 == 2, F.substring(whole, F.lit(1), F.length(whole) - 9)).when(k % 13 == 12, F.lit("[1, 2]")).otherwise(whole)
    got = AD.conform(o.select(k.alias("doc_id"), raw.alias("raw")), "raw", RECORD)
    return got.select("doc_id", "errors", "conforms", F.col("record.total").cast("double").alias("total"), F.col("record.body.name").alias("name"), F.get(F.col("record.lots.number"), F.lit(1)).alias("second"))


def summary_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots whose amounts come from an economic summary where their own are missing: each order's line items as a summary, gross beside net."""
    items = lots(spark, sf_dir)
    money = lambda c: F.concat(amount_text(c.cast("decimal(18,2)")), F.lit(" €"))
    line = F.concat(F.lit("Lavori parte "), F.col("lot").cast("string"), F.lit(": lordo "), money(F.col("amount") * 2), F.lit(", netto "), money(F.col("amount")), F.lit(", IVA "), money(F.col("amount") * 0.22))
    k = F.col("o_orderkey")
    per = items.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("lot", line.alias("line"), "amount"))).alias("p"))
    heading = F.when(k % 5 == 0, "Riepilogo delle spese").when(k % 2 == 0, "Quadro tecnico\neconomico").otherwise("Tabella QTE")
    again = F.when(k % 3 == 0, F.get("p", F.lit(0))["line"])
    text = F.concat_ws("\n", F.lit("Premessa"), heading, F.lit("[TABELLA pag.1] 1,00 € 90.000,00 € 2,00 €"), F.array_join(F.transform("p", lambda x: x["line"]), "\n"), again, F.lit("Totale 99.000,00 € 88.000,00 € 1,00 €"))
    own = F.transform("p", lambda x: F.struct(x["lot"].alias("number"), F.when(k % 7 != 0, x["amount"]).alias("amount")))
    got = per.select(k.alias("doc_id"), AD.lots_with_summary(own, text).alias("lots"))
    return got.select("doc_id", F.posexplode("lots").alias("place", "x")).select("doc_id", "place", "x.number", F.col("x.amount").cast("double").alias("amount"))


QUERIES = {f.__name__: f for f in (adaptive_enhancement, value_checks, record_conformity, summary_lots)}

ORACLE_SQL = {
    "adaptive_enhancement": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 'Fornitura ' || o_orderkey || ' segmento ' || c_mktsegment AS subject, strftime(o_orderdate, '%d/%m/%Y') || ' ore 12:30' AS deadline,
  'C' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'B' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS cup FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT k, lag(k) OVER w AS a, lead(k) OVER w AS b, lag(k, 2) OVER w AS c, lead(k, 2) OVER w AS d FROM o WINDOW w AS (PARTITION BY c ORDER BY k)),
t AS (SELECT k, unnest([{'o': a, 's': 0.9}, {'o': b, 's': 0.8}, {'o': c, 's': 0.7}, {'o': d, 's': 0.6}], recursive := true) FROM s),
h AS (SELECT k, count(*) AS n, max(s) AS s FROM (SELECT k, s FROM t WHERE o IS NOT NULL AND o % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC) <= 2) GROUP BY k)
SELECT CAST(k AS VARCHAR) AS doc_id, 'oggetto_appalto' AS field, CASE WHEN k % 4 = 1 AND h.k IS NULL THEN ' ' ELSE subject END AS value,
  CASE WHEN k % 4 <> 1 THEN 'rules' WHEN h.k IS NOT NULL THEN 'similar_doc(' || CAST(round(round(CAST(0.7 * 0.8 * s * (CASE WHEN n = 2 THEN 1.1 ELSE 1 END) AS DOUBLE), 6) * 100) AS INTEGER) || '%)' END AS method
FROM o LEFT JOIN h USING (k)
UNION ALL SELECT CAST(k AS VARCHAR), 'scadenza_offerte', deadline, CASE WHEN k % 4 = 2 THEN 'auto_rule(70%)' ELSE 'rules' END FROM o
UNION ALL SELECT CAST(k AS VARCHAR), 'cup', CASE WHEN k % 4 = 3 THEN ' ' ELSE cup END, CASE WHEN k % 4 <> 3 THEN 'rules' END FROM o""",
    "value_checks": """
WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS total, 'Fornitura ' || o_orderkey || ' segmento ' || c_mktsegment AS subject FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT k, 'importo_totale' AS field, CAST(total AS VARCHAR) AS value, CAST(CASE WHEN k % 97 = 0 THEN CAST(CAST(total AS DOUBLE) * 10 AS DECIMAL(18,2)) ELSE total END AS VARCHAR) AS bent FROM o
  UNION ALL SELECT k, 'oggetto_appalto', subject, CASE WHEN k % 89 = 0 THEN repeat(subject, 9) ELSE subject END FROM o WHERE k % 4 <> 1),
p AS (SELECT field, count(*) AS n, avg(TRY_CAST(value AS DOUBLE)) AS mean, stddev_samp(TRY_CAST(value AS DOUBLE)) AS std, avg(length(value)) AS len FROM v GROUP BY field),
c AS (SELECT field, value, count(*) AS k FROM v GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) <= 20),
x AS (SELECT v.k, field, bent, abs(TRY_CAST(bent AS DOUBLE) - mean) / std AS z, length(bent) / len AS share, c.k / (SELECT sum(c2.k) FROM c c2 WHERE c2.field = v.field) AS often FROM v JOIN p USING (field) LEFT JOIN c ON c.field = v.field AND c.value = bent),
y AS (SELECT *, coalesce(z > 2.5, false) AS far, share > 5 OR share < 0.1 AS odd FROM x),
b AS (SELECT *, CASE WHEN far THEN greatest(0.1, 1 - z / 10) WHEN odd THEN 0.3 ELSE 0.5 END AS base FROM y)
SELECT CAST(k AS VARCHAR) AS doc_id, field, list_filter([CASE WHEN far THEN 'numeric' END, CASE WHEN odd THEN 'length' END], lambda e: e IS NOT NULL) AS anomalies, NOT far AND NOT odd AS is_valid,
  round(CAST(CASE WHEN often IS NOT NULL THEN greatest(base, least(0.75, 0.5 + 0.2 * often)) ELSE base END AS DOUBLE), 6) AS confidence FROM b""",
    "record_conformity": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderkey % 11 = 2 OR o_orderkey % 13 = 12 AS broken FROM orders)
SELECT k AS doc_id, CASE WHEN broken THEN ['$: not a JSON object'] ELSE list_filter([
    CASE WHEN k % 7 = 1 THEN 'total: not of type decimal(18,2)' END, CASE WHEN k % 5 = 3 THEN 'date: field required' END, CASE WHEN k % 8 = 7 THEN 'open: not of type boolean' END,
    CASE WHEN k % 10 = 9 THEN 'body: not an object' WHEN k % 6 = 5 THEN 'body.name: field required' END, CASE WHEN k % 4 = 1 THEN 'lots[1].number: not of type int' END], lambda e: e IS NOT NULL) END AS errors,
  NOT broken AND k % 7 <> 1 AND k % 5 <> 3 AND k % 8 <> 7 AND k % 10 <> 9 AND k % 6 <> 5 AND k % 4 <> 1 AS conforms,
  CASE WHEN NOT broken AND k % 7 <> 1 THEN CAST(total AS DOUBLE) END AS total, CASE WHEN NOT broken AND k % 10 <> 9 AND k % 6 <> 5 THEN 'Ente ' || c END AS name,
  CASE WHEN NOT broken AND k % 4 <> 1 THEN 2 END AS second FROM o""",
    "summary_lots": """
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS lot, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY ALL),
big AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lot) - 1 AS place FROM i WHERE amount > 50000 AND NOT EXISTS (SELECT 1 FROM i j WHERE j.k = i.k AND j.lot < i.lot AND j.amount > 50000 AND abs(j.amount - i.amount) < 1)),
own AS (SELECT k, bool_or(k % 7 = 0 OR amount <= 10000) AS unsound FROM i GROUP BY k),
n AS (SELECT k, count(*) AS n FROM big GROUP BY k),
d AS (SELECT own.k, coalesce(unsound AND k % 5 <> 0 AND n >= 2, false) AS taken FROM own LEFT JOIN n USING (k))
SELECT k AS doc_id, CAST(place AS INTEGER) AS place, CAST(place + 1 AS INTEGER) AS number, CAST(amount AS DOUBLE) AS amount FROM big JOIN d USING (k) WHERE taken
UNION ALL SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY lot) - 1 AS INTEGER), CAST(lot AS INTEGER), CASE WHEN k % 7 <> 0 THEN CAST(amount AS DOUBLE) END FROM i JOIN d USING (k) WHERE NOT taken""",
}
