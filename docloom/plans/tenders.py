"""Queries over rendered tenders. Their SQL recomputes the expected values from the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import record, rules, structure
from docloom.sources.tenders import lots, render_tenders

_ORDERS = """
o AS (SELECT o_orderkey k, CAST(o_orderkey AS VARCHAR) AS doc_id, upper(sha256(CAST(o_orderkey AS VARCHAR))) AS h,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderstatus, o_orderdate, n_name, c_mktsegment, 60 + o_orderkey % 31 AS tech
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT l_orderkey AS k, l_linenumber AS lot, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
  FROM lineitem GROUP BY ALL)
"""


def amount_by_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awarded amount and number of tenders per contracting body, from text alone."""
    wide = rules.wide(render_tenders(spark, sf_dir))
    return wide.groupBy(F.col("stazione_appaltante").alias("body")).agg(F.sum(F.col("importo_totale").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))


def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.wide(render_tenders(spark, sf_dir)).select("doc_id", "cig", "cup", "cpv")


def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.wide(render_tenders(spark, sf_dir))
    return wide.select("doc_id", F.col("importo_totale").cast("decimal(18,2)").alias("total"), S.format_amount(F.col("importo_totale").cast("decimal(18,2)")).alias("shown"))


def extract_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_tenders(spark, sf_dir)
    return docs.select("doc_id", record.procedure_label(F.col("text")).alias("procedure"), record.criterion_label(F.col("text")).alias("criterion"))


def extract_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offer deadline, not the date for questions before it, as text and as a date."""
    wide = rules.wide(render_tenders(spark, sf_dir)).select("doc_id", F.col("scadenza_offerte").alias("deadline"))
    return wide.withColumn("day", F.to_date(F.substring("deadline", 1, 10), "dd/MM/yyyy"))


def extract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.wide(render_tenders(spark, sf_dir))
    return wide.select("doc_id", F.col("punteggio_tecnica").cast("int").alias("technical"), F.col("punteggio_economica").cast("int").alias("economic"), F.col("durata_mesi").cast("int").alias("months"))


def extract_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_tenders(spark, sf_dir)
    return docs.select("doc_id", *[c.alias(k) for k, c in record.clause_flags(F.col("text")).items()])


def extract_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each field was found in, and how many of its values are valid."""
    long = rules.validate_fields(rules.apply_rules(render_tenders(spark, sf_dir)))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


def pages_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = structure.pages(render_tenders(spark, sf_dir))
    return pages.groupBy("page_num").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("Lotto 1\n")).alias("with_lot_1"))


def page_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_tenders(spark, sf_dir)
    found = rules.apply_rules(docs, [r for r in rules.BUILTIN if r.field in ("cig", "cup", "scadenza_offerte")])
    paged = structure.page_of_value(structure.pages(docs), found)
    return paged.groupBy("field", "page_num").agg(F.count("*").alias("n"))


#: Fields of a lot's segment.
_LOT = {"cig": lambda x: S.first_match(x, [r"CIG[\s:]*([A-Z0-9]{10})\b"]), "amount": lambda x: S.parse_amount(S.first_match(x, [r"importo\s+lotto[\s ]*€[\s ]*([\d.,]+)"]))}


def lot_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = structure.lot_segments(render_tenders(spark, sf_dir))
    return segments.select("doc_id", "lot", *[f(F.col("segment")).alias(k) for k, f in _LOT.items()])


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.table_records(render_tenders(spark, sf_dir))
    cell = lambda k: F.get("cells", F.lit(k))
    return rows.select("doc_id", cell(0).cast("int").alias("code"), cell(1).alias("description"), cell(2).cast("int").alias("points"))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(render_tenders(spark, sf_dir)).where("section is not null").groupBy("section").agg(F.count("*").alias("n"))


def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = structure.section_text("text", ["SOPRALLUOGO"], structure.SECTION_WORDS + ["Durata"])
    return render_tenders(spark, sf_dir).select("doc_id", text.alias("site_visit"))


def coherence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each tender's record by status, and the score that follows."""
    docs = render_tenders(spark, sf_dir)
    segments = structure.lot_segments(docs)
    amount = S.parse_amount(S.first_match("segment", [r"importo\s+lotto[\s ]*€[\s ]*([\d.,]+)"]))
    return record.coherence(rules.wide(docs), segments.select("doc_id", amount.alias("amount")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of tenders: each text is rendered once, its lots are read where its fields are."""
    docs = render_tenders(spark, sf_dir)
    fields = [rules.extracted(F.col("text"), r).alias(r.field) for r in rules.BUILTIN]
    return record.build_rows(docs.select("doc_id", *fields, structure.lot_records(F.col("text"), _LOT).alias("lotti")))


def build_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar leaves of the nested record."""
    nested = _records(spark, sf_dir)
    return nested.select("doc_id", F.col("record.identificativi.cig").alias("cig"), F.col("record.importi.totale").alias("total"), F.size("record.lotti").alias("n_lots"), F.element_at("record.cig_lotti", "lotto_1").alias("cig_lot_1"), "confidence", "score")


def flatten_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record as (path, documents with a value)."""
    return record.flatten(_records(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 documents."""
    docs = render_tenders(spark, sf_dir)
    latest = docs.orderBy(F.desc("upload_ts"), F.col("doc_id").cast("long")).limit(50)
    wide = rules.wide(latest)
    return latest.join(wide, "doc_id").select("doc_id", "filename", F.coalesce("cig", F.lit("N/D")).alias("cig"), F.coalesce("stazione_appaltante", F.lit("N/D")).alias("body"))


def fields_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry groups with how many tenders have a value of each."""
    found = rules.apply_rules(render_tenders(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("n"))
    groups = rules.fields_by_category(spark).select("category", "position", F.explode("fields").alias("field"))
    joined = groups.join(F.broadcast(found), "field", "left")  # one row a field of the registry
    return joined.groupBy("category", "position").agg(F.count("*").alias("n_fields"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))


QUERIES = {f.__name__: f for f in (amount_by_body, extract_identifiers, extract_amounts, extract_procedure, extract_deadline, extract_scores, extract_flags, extract_long, pages_explode, page_of_value, lot_amounts, table_rows, chunk_sections, section_slice, coherence_report, build_record, flatten_record, history, fields_by_category)}

_CUP = "'C' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || 'B' || lpad(CAST(k AS VARCHAR), 8, '0')"
_IT = "translate(format('{:,.2f}', CAST(total AS DOUBLE)), ',.', '.,')"
ORACLE_SQL = {
    "amount_by_body": f"WITH {_ORDERS} SELECT 'Comune di ' || n_name AS body, CAST(sum(total) AS DECIMAL(28,2)) AS total, count(*) AS n FROM o GROUP BY 1",
    "extract_identifiers": f"WITH {_ORDERS} SELECT doc_id, h[1:10] AS cig, {_CUP} AS cup, lpad(CAST(k AS VARCHAR), 8, '0') || '-' || CAST(k % 10 AS VARCHAR) AS cpv FROM o",
    "extract_amounts": f"WITH {_ORDERS} SELECT doc_id, total, 'EUR ' || {_IT} AS shown FROM o",
    "extract_procedure": f"WITH {_ORDERS} SELECT doc_id, CASE o_orderstatus WHEN 'F' THEN 'Procedura aperta' WHEN 'O' THEN 'Procedura negoziata' ELSE 'Procedura ristretta' END AS procedure, CASE WHEN k % 2 = 0 THEN 'OEPV' ELSE 'Minor prezzo' END AS criterion FROM o",
    "extract_deadline": f"WITH {_ORDERS} SELECT doc_id, strftime(o_orderdate, '%d/%m/%Y') || ' ore 12:30' AS deadline, CAST(o_orderdate AS DATE) AS day FROM o",
    "extract_scores": f"WITH {_ORDERS} SELECT doc_id, CAST(tech AS INTEGER) AS technical, CAST(100 - tech AS INTEGER) AS economic, CAST(12 + k % 24 AS INTEGER) AS months FROM o",
    "extract_flags": f"WITH {_ORDERS} SELECT doc_id, k % 3 <> 0 AS provisional_guarantee, k % 5 = 0 AS site_visit, k % 4 <> 0 AS subcontracting, k % 7 = 0 AS pnrr FROM o",
    "extract_long": f"""WITH {_ORDERS}, f AS (SELECT unnest(['cig','cup','cpv','stazione_appaltante','oggetto_appalto','tipo_procedura','importo_totale','punteggio_tecnica','punteggio_economica','scadenza_offerte','durata_mesi','pnrr','sopralluogo_obbligatorio']) AS field, k, total FROM o)
SELECT field, count(*) AS n, count(*) AS n_valid FROM f
WHERE (field <> 'pnrr' OR k % 7 = 0) AND (field <> 'sopralluogo_obbligatorio' OR k % 5 = 0) AND (field <> 'importo_totale' OR total >= 100) GROUP BY field""",
    "pages_explode": f"WITH {_ORDERS} SELECT CAST(p AS INTEGER) AS page_num, count(*) AS n, count(*) FILTER (WHERE p = 2 AND EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND lot = 1)) AS with_lot_1 FROM o, (SELECT unnest([1, 2, 3]) AS p) GROUP BY p",
    "page_of_value": f"WITH {_ORDERS} SELECT field, CAST(page AS INTEGER) AS page_num, count(*) AS n FROM o, (VALUES ('cig', 1), ('cup', 1), ('scadenza_offerte', 3)) v(field, page) GROUP BY ALL",
    "lot_amounts": f"WITH {_ORDERS} SELECT CAST(k AS VARCHAR) AS doc_id, lot, upper(sha256(CAST(k AS VARCHAR) || '-' || CAST(lot AS VARCHAR)))[1:10] AS cig, amount FROM l WHERE k IN (SELECT k FROM o)",
    "table_rows": f"WITH {_ORDERS} SELECT CAST(k AS VARCHAR) AS doc_id, lot AS code, 'Voce di capitolato ' || lot AS description, lot * 5 AS points FROM l WHERE k IN (SELECT k FROM o)",
    "chunk_sections": f"WITH {_ORDERS} SELECT section, count(*) AS n FROM o, (SELECT unnest(['GARANZIA PROVVISORIA', 'SOPRALLUOGO', 'SUBAPPALTO', 'DISCIPLINARE DI GARA']) AS section) GROUP BY section",
    "section_slice": f"WITH {_ORDERS} SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'Il sopralluogo è obbligatorio.' ELSE 'Il sopralluogo non è previsto.' END AS site_visit FROM o",
    "coherence_report": f"""WITH {_ORDERS}, s AS (SELECT k, sum(amount) AS lots FROM l GROUP BY k),
c AS (SELECT doc_id, CAST(coalesce(lots, 0) > 0 AND abs(lots - total) <= 0.02 * total AS BOOLEAN) AS lots_ok, lots IS NULL AS no_lots FROM o LEFT JOIN s USING (k))
SELECT doc_id, CAST(4 + CASE WHEN lots_ok THEN 1 ELSE 0 END AS INTEGER) AS n_pass, CAST(CASE WHEN no_lots THEN 1 ELSE 0 END AS INTEGER) AS n_warn, CAST(CASE WHEN NOT lots_ok AND NOT no_lots THEN 1 ELSE 0 END AS INTEGER) AS n_fail,
CAST(CASE WHEN NOT lots_ok AND NOT no_lots THEN 0.9 ELSE 1.0 END AS DOUBLE) AS score FROM c""",
    "flatten_record": f"""WITH {_ORDERS} SELECT path, count(*) AS n FROM o, (SELECT unnest(['identificativi.cig','identificativi.cup','identificativi.cpv','soggetti.stazione','soggetti.oggetto','importi.totale','punteggi.tecnica','punteggi.economica','tempistiche.scadenza','tempistiche.mesi']) AS path)
WHERE path <> 'importi.totale' OR total >= 100 GROUP BY path""",
    "fields_by_category": f"""WITH {_ORDERS} SELECT category, CAST(p AS INTEGER) AS position, CAST(nf AS BIGINT) AS n_fields, CAST(CASE category WHEN 'Importi' THEN count(*) FILTER (WHERE total >= 100) WHEN 'Flag' THEN count(*) FILTER (WHERE k % 7 = 0) + count(*) FILTER (WHERE k % 5 = 0) ELSE nf * count(*) END AS BIGINT) AS n_values
FROM o, (VALUES ('Identificativi', 0, 3), ('Soggetti', 1, 1), ('Oggetto e Procedura', 2, 2), ('Importi', 3, 1), ('Punteggi', 4, 2), ('Tempistiche', 5, 2), ('Flag', 6, 2)) v(category, p, nf) GROUP BY category, p, nf""",
    "history": f"WITH {_ORDERS} SELECT doc_id, 'disciplinare_' || doc_id || '.txt' AS filename, h[1:10] AS cig, 'Comune di ' || n_name AS body FROM o ORDER BY o_orderdate DESC, k LIMIT 50",
    "build_record": f"""WITH {_ORDERS}, n AS (SELECT k, count(*) AS n, max(CASE WHEN lot = 1 THEN upper(sha256(CAST(k AS VARCHAR) || '-1'))[1:10] END) AS c1 FROM l GROUP BY k)
SELECT doc_id, h[1:10] AS cig, total, CAST(coalesce(n.n, 0) AS INTEGER) AS n_lots, c1 AS cig_lot_1,
 round(100.0 * (11 + CASE WHEN o.k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o.k % 5 = 0 THEN 1 ELSE 0 END) / 13, 1) AS confidence,
 round(CAST(11 + CASE WHEN o.k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o.k % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) + 0.3 * coalesce(n.n, 0), 2) AS score FROM o LEFT JOIN n USING (k)""",
}
