"""Queries of the rule packs over rendered notices. Their SQL recomputes the expected values from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import amount_text
from docloom.operators import packs as P
from docloom.sources.notices import render_notices
from docloom.sources.varied import render_varied


def _text() -> Column:
    return F.col("text")


def _query(*packs, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = {k: v for p in packs for k, v in p(_text()).items()}
        return render_notices(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in cols.items()], *[f(_text()).alias(k) for k, f in more.items()])

    return run


def notice_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria with the sum of their parts, one row each, and whether they add up to the technical maximum."""
    docs = render_notices(spark, sf_dir).select("doc_id", P.criteria(_text()).alias("rows"), P.scoring(_text())["technical"].alias("technical"))
    checked = docs.select("doc_id", P.criteria_sum(F.col("rows"), F.col("technical")).alias("sum_check"), F.explode(P.nested_criteria(F.col("rows"))).alias("c"))
    return checked.select("doc_id", "c.code", "c.points", F.size("c.parts").alias("n_parts"), "sum_check")


def notice_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = render_notices(spark, sf_dir).select("doc_id", F.explode(P.lots(_text())).alias("x"))
    return lots.select("doc_id", "x.lot", "x.name", "x.cig", "x.amount")


def notice_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for the reader, how many fields have a value, and a line on the procedure."""
    cols = P.amounts(_text()) | P.timing(_text()) | P.scoring(_text()) | P.requirements(_text())
    line = F.concat_ws(", ", *[P.procedure(_text())[k] for k in ("label", "scope", "method")])
    # Fields are columns before the messages mention them; mentioned inside the messages' array each would be extracted anew every time.
    used = {k: cols[k] for k in P.NOTED + ("opening", "turnover", "agreement")}
    docs = render_notices(spark, sf_dir).select("doc_id", line.alias("procedure"), *[c.alias(k) for k, c in used.items()])
    fields = {k: F.col(k) for k in used}
    found = P.methods_map({k: fields[k] for k in ("labour", "opening", "turnover", "agreement")})
    return docs.select("doc_id", F.array_join(P.notes(fields), "; ").alias("notes"), F.size(found).alias("n_found"), "procedure")


def notice_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date in the first five places, with its place and length of context, checked against the text."""
    hits = render_notices(spark, sf_dir).select("doc_id", "text", F.explode(P.matches_with_context(_text(), r"\d{2}/\d{2}/\d{4}")).alias("m"))
    right = (F.substring("text", F.col("m.at"), F.lit(10)) == F.col("m.value")) & F.col("m.context").contains(F.col("m.value"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))


def lettered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_notices(spark, sf_dir).select("doc_id", F.explode(P.lettered_items(_text())).alias("x")).select("doc_id", "x.letter", "x.item")


def _varied(**cols):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return render_varied(spark, sf_dir).select("doc_id", *[f(_text()).alias(k) for k, f in cols.items()])

    return run


def code_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for project codes of 11 to 15 characters, some in small letters or with blanks, and for lots' codes of 9 or 10."""
    k = F.col("c_custkey")
    cup = F.concat(F.when(k % 5 == 0, "c").otherwise("C"), F.lit("12B"), F.when(k % 3 == 0, " ").otherwise(""), F.lpad(k.cast("string"), 7, "0"), F.substring(F.lit("1234"), F.lit(1), (k % 5).cast("int")))
    lots = F.array(F.struct(F.lit(1).alias("lot"), F.lit("A123456789").alias("cig")), F.struct(F.lit(2).alias("lot"), F.when(k % 7 == 0, "A12345678").when(k % 7 != 1, "a123456789").alias("cig")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), P.code_formats(F.when(k % 11 != 0, cup), lots).alias("messages"))


def required_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories asked for, from sentences, tables and bold lines by turns, with decoys: a second table, totals, numbers out of range."""
    k = F.col("c_custkey")
    f = F.format_string
    big = lambda n: amount_text((F.lit(50_000 * n) + k).cast("decimal(18,2)"))
    sentence = f("Per la categoria E20 sono richiesti servizi di importo pari a € %s. Per la classe IA.02 di importo minimo € %s; categoria S.03 per classe seconda.", big(1), big(2))
    table = f("[TABELLA pag.1]\nCATEGORIA | Voce | Importo\nV.02 | Viabilità ordinaria | € 99.000,00\n\n[TABELLA pag.2]\nCATEGORIA | Descrizione | Grado | Importo complessivo\nE.22 | Edilizia monumentale | 1,55 | € %s\nS03 | Strutture in opera | 0,95 | %s €\nE.22 | Ripetizione della riga | 1,20 | € 77.000,00\n | TOTALE | | € 1,00\n", big(1), big(3))
    bold = f("Importo complessivo dei lavori progettati\n**CATEGORIA**\n**EDILIZIA**\nscuole e asili\n**E.08**\n0,95\n\n**€ %s**\n**IMPIANTI**\n** IA03 **\n1,15\nTOTALE\n€ 300.000,00\nIDRAULICA\nfogne\nD.04\n€ 50,00\nx\ny\nz\n€ 400.000,00\n", big(4))
    text = F.concat(F.lit("REQUISITI\n"), F.when(k % 4 == 0, sentence).when(k % 4 == 1, table).when(k % 4 == 2, bold).otherwise("Nessuna categoria richiesta: E.20 a parte."))
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", F.posexplode(P.required_categories(_text())).alias("place", "c")).select("doc_id", "place", "c.*")


QUERIES = {
    "required_categories": required_categories,
    "varied_deadlines": _varied(offers=lambda t: P.timing(t)["offers_until"], hour=lambda t: P.timing(t)["offers_hour"], questions=lambda t: P.timing(t)["questions_until"], opening=lambda t: P.timing(t)["opening"]),
    "varied_amounts": _varied(base=lambda t: P.amounts(t)["base"], safety=lambda t: P.amounts(t)["safety"]),
    "varied_scores": _varied(technical=lambda t: P.scoring(t)["technical"], economic=lambda t: P.scoring(t)["economic"]),
    "varied_people": _varied(rup=lambda t: P.responsible(t)["rup"], director=lambda t: P.responsible(t)["director"]),
    "varied_categories": _varied(codes=lambda t: F.transform(P.categories(t), lambda x: x["code"])),
    "varied_platforms": _varied(platform=lambda t: P.platform(t)["platform"], runner=lambda t: P.platform(t)["runner"], host=lambda t: P.platform(t)["url_host"], funding=lambda t: P.funding(t)["funding"], all_funding=lambda t: P.funding(t)["all_funding"]),
    "code_warnings": code_warnings,
    "notice_identifiers": _query(P.identifiers),
    "notice_body": _query(P.contracting_body, P.responsible),
    "notice_numbers": _query(P.numbers),
    "notice_funding": _query(P.funding, P.platform),
    "notice_procedure": _query(P.procedure, n_lots=P.lot_count),
    "notice_lots": notice_lots,
    "notice_lot_constraints": _query(P.lot_constraints),
    "notice_amounts": _query(P.amounts),
    "notice_categories": _query(codes=lambda t: F.transform(P.categories(t), lambda x: x["code"]), kinds=lambda t: F.transform(P.categories(t), lambda x: x["kind"])),
    "notice_timing": _query(P.timing),
    "notice_requirements": _query(P.requirements),
    "notice_roles": lambda s, d: render_notices(s, d).select("doc_id", F.explode(P.roles_list(_text())).alias("r")).select("doc_id", "r.name", "r.degree", "r.register", "r.years"),
    "notice_criteria": notice_criteria,
    "notice_scoring": _query(P.scoring),
    "notice_offer": _query(P.offer_format),
    "notice_administration": _query(P.administration),
    "notice_award": _query(P.award),
    "notice_clauses": _query(P.clauses),
    "notice_notes": notice_notes,
    "notice_matches": notice_matches,
    "lettered_items": lettered_items,
}

_K = """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS doc_id, n_name, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS d,
CAST(10000.5 + c_custkey * 37 % 900000 AS DECIMAL(18,2)) AS base, CAST(500 + c_custkey % 100 AS DECIMAL(18,2)) AS safety, CASE WHEN c_custkey % 3 <> 2 THEN CAST(2000 + c_custkey % 1000 AS DECIMAL(18,2)) END AS labour,
c_custkey % 11 AS e FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
"""
_SUM = "CASE WHEN abs(e + 70 - (e + 70)) <= 1 THEN 'pass' ELSE 'warn' END"
_IT = "'EUR ' || translate(format('{:,.2f}', CAST(labour AS DOUBLE)), ',.', '.,')"
_V = """WITH v AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS doc_id, DATE '2024-01-05' + CAST(c_custkey % 330 AS INTEGER) AS d FROM customer) """
ORACLE_SQL = {
    "required_categories": """SELECT k AS doc_id, CAST(place AS INTEGER) AS place, code, CAST(CASE WHEN n IS NOT NULL THEN 50000 * n + k END AS DECIMAL(18,2)) AS amount, CAST(grade AS DOUBLE) AS grade, description, layout
FROM (SELECT c_custkey AS k FROM customer), (VALUES (0, 0, 'E.20', 1, NULL, NULL, 'sentence'), (0, 1, 'IA.02', 2, NULL, NULL, 'sentence'), (0, 2, 'S.03', NULL, NULL, NULL, 'sentence'),
  (1, 0, 'E.22', 1, 1.55, 'Edilizia monumentale', 'table'), (1, 1, 'S.03', 3, 0.95, 'Strutture in opera', 'table'),
  (2, 0, 'E.08', 4, 0.95, 'EDILIZIA scuole e asili', 'lines'), (2, 1, 'IA.03', NULL, 1.15, 'IMPIANTI', 'lines'), (2, 2, 'D.04', NULL, NULL, 'IDRAULICA', 'lines')) v(layout_no, place, code, n, grade, description, layout) WHERE k % 4 = layout_no""",
    "varied_deadlines": _V + "SELECT doc_id, CAST(d + 40 AS DATE) AS offers, CASE WHEN k % 2 = 0 THEN '12:00' ELSE '9:30' END AS hour, CAST(d + 25 AS DATE) AS questions, CAST(d + 47 AS DATE) AS opening FROM v",
    "varied_amounts": _V + "SELECT doc_id, CAST(250000 + k * 7 AS DECIMAL(18,2)) AS base, CAST(1500.5 + k % 900 AS DECIMAL(18,2)) AS safety FROM v",
    "varied_scores": _V + "SELECT doc_id, CAST(65 + k % 20 AS INTEGER) AS technical, CAST(35 - k % 20 AS INTEGER) AS economic FROM v",
    "varied_people": _V + "SELECT doc_id, ['Maria Bianchi', 'Luca De Neri', 'Anna Maria Verdi'][k % 3 + 1] AS rup, ['Giulia Conti', 'Paolo Serra'][k % 2 + 1] AS director FROM v",
    "varied_categories": _V + "SELECT doc_id, [['E.20', 'IA.02', 'OG1'], ['S.03', 'D.04'], ['E.22', 'IB.08', 'OS30']][k % 3 + 1] AS codes FROM v",
    "varied_platforms": _V + """SELECT doc_id, ['TuttoGare', 'S.TEL.LA.', 'Asmecomm', 'Intercent-ER', 'Sintel'][k % 5 + 1] AS platform, [NULL, 'Regione Lazio', NULL, 'Regione Emilia-Romagna', 'ARIA S.p.A.'][k % 5 + 1] AS runner,
['bandi.tuttogare.it', 'gare.regione.lazio.it', 'app.asmecomm.it', 'intercenter.regione.it', 'www.sintel.regione.it'][k % 5 + 1] AS host,
['FESR', 'Decreto Dirigenziale', 'PON/POR', NULL, 'PNRR', 'Fondi propri'][k % 6 + 1] AS funding,
[[], ['Certificati Bianchi/TEE'], [], ['Conto Termico', 'GSE'], ['PNRR', 'PNRR M.7-1.7 Repower'], ['Fondi di Bilancio']][k % 6 + 1] AS all_funding FROM v""",
    "code_warnings": """SELECT c_custkey AS doc_id, list_filter([CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 5 = 0 THEN 'CUP' END, CASE WHEN c_custkey % 7 = 0 THEN 'CIG lotto 2' END], lambda x: x IS NOT NULL) AS messages FROM customer""",
    "notice_identifiers": _K + """SELECT doc_id, CASE WHEN k % 4 = 2 THEN [m, h1, h2] WHEN k % 4 = 3 THEN [m, h1, h2, h3] ELSE [m] END AS cigs, 'C' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || 'B' || lpad(doc_id, 11, '0') AS cup, NULL AS cui, '71240000-2' AS cpv_main, ['71250000-' || CAST(k % 10 AS VARCHAR)] AS cpv_other
FROM (SELECT *, upper(sha256(doc_id))[1:10] AS m, upper(sha256(doc_id || '-1'))[1:10] AS h1, upper(sha256(doc_id || '-2'))[1:10] AS h2, upper(sha256(doc_id || '-3'))[1:10] AS h3 FROM c)""",
    "notice_body": _K + """SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'Comune di ' ELSE 'Azienda Sanitaria ' END || n_name AS body, CASE WHEN k % 2 = 0 THEN 'Comune' ELSE 'Azienda sanitaria' END AS body_type, CASE WHEN k % 6 = 0 THEN 'Consorzio Acque' END AS delegating, NULL AS purchasing_body,
'gare' || doc_id || '@pec.example.it' AS pec, 'info' || doc_id || '@example.it' AS mail, CASE WHEN k % 2 = 1 THEN 'Via Roma, ' || CAST(k % 200 + 1 AS VARCHAR) END AS address, CASE k % 3 WHEN 0 THEN 'Mario Rossi' WHEN 1 THEN 'Anna Maria Bianchi' END AS rup, CASE WHEN k % 2 = 1 THEN 'Luca Verdi' END AS director FROM c""",
    "notice_numbers": _K + "SELECT doc_id, CAST(k AS BIGINT) AS tender_number, CAST(k % 500 + 1 AS INTEGER) AS decision_number, CAST(d - 30 AS DATE) AS decision_date FROM c",
    "notice_funding": _K + """SELECT doc_id, CASE k % 4 WHEN 0 THEN 'PNRR' WHEN 1 THEN 'FESR' END AS funding, CASE k % 4 WHEN 0 THEN ['PNRR'] WHEN 1 THEN ['Fondi regionali/europei'] WHEN 2 THEN ['Superbonus/Ecobonus', 'Conto Termico', 'GSE'] ELSE [] END AS all_funding,
CASE k % 3 WHEN 0 THEN 'Sintel' WHEN 1 THEN 'MePA' END AS platform, CASE k % 3 WHEN 0 THEN 'ARIA S.p.A.' WHEN 1 THEN 'Consip' END AS runner, CASE WHEN k % 3 = 0 THEN 'https://gare.example.org/sintel' END AS url, CASE WHEN k % 3 = 0 THEN 'gare.example.org' END AS url_host FROM c""",
    "notice_procedure": _K + """SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'Procedura negoziata' ELSE 'Procedura aperta' END || CASE WHEN k % 4 >= 2 THEN ' in ' || CAST(k % 4 AS VARCHAR) || ' lotti' ELSE '' END AS label, CASE WHEN k % 5 = 0 THEN 'sotto soglia' ELSE 'sopra soglia' END AS scope,
CASE WHEN k % 5 = 0 THEN 'Minor prezzo' ELSE 'OEPV' END AS method, CASE WHEN k % 5 = 0 THEN 'art. 50 d.lgs. 36/2023' ELSE 'd.lgs. 36/2023' END AS legal_reference, k % 8 = 0 AS framework, k % 5 <> 0 AS inversion, false AS concession, CAST(CASE WHEN k % 4 >= 2 THEN k % 4 ELSE 1 END AS INTEGER) AS n_lots FROM c""",
    "notice_lots": _K + ", l AS (SELECT c.*, i FROM c, (SELECT unnest([1, 2, 3]) AS i) WHERE k % 4 >= 2 AND i <= k % 4) SELECT doc_id, CAST(i AS INTEGER) AS lot, 'fornitura tipo ' || i AS name, upper(sha256(doc_id || '-' || i))[1:10] AS cig, CAST(base + i AS DECIMAL(18,2)) AS amount FROM l",
    "notice_lot_constraints": _K + "SELECT doc_id, false AS all_lots, k % 4 = 3 AS same_offer, false AS same_form, CAST(CASE WHEN k % 4 = 3 THEN 2 END AS INTEGER) AS most_lots FROM c",
    "notice_amounts": _K + """SELECT doc_id, base, safety, labour, CAST(coalesce(labour, safety) AS DECIMAL(18,2)) AS fixed, CAST(base - coalesce(labour, safety) AS DECIMAL(18,2)) AS discountable, k % 3 <> 0 AS revision, CAST(CASE WHEN k % 3 <> 0 THEN k % 3 + 4 END AS INTEGER) AS revision_percent, CASE WHEN k % 7 <> 0 THEN n_name END AS place FROM c""",
    "notice_categories": _K + "SELECT doc_id, CASE WHEN k % 2 = 0 THEN ['E.22', 'IA.01', 'OG1'] ELSE ['S.03'] END AS codes, CASE WHEN k % 2 = 0 THEN ['ENG', 'ENG', 'SOA'] ELSE ['ENG'] END AS kinds FROM c",
    "notice_timing": _K + """SELECT doc_id, CAST(d + 20 AS DATE) AS offers_until, CASE WHEN k % 2 = 0 THEN '12:30' ELSE '9:00' END AS offers_hour, CAST(d + 10 AS DATE) AS questions_until, CASE WHEN k % 3 <> 0 THEN CAST(d + 25 AS DATE) END AS opening, CAST(CASE WHEN k % 3 = 1 THEN 240 ELSE 180 END AS INTEGER) AS validity_days,
CAST(CASE k % 3 WHEN 0 THEN (k % 24 + 12) * 30 WHEN 1 THEN 90 ELSE 1095 END AS INTEGER) AS duration_days, CAST(NULL AS INTEGER) AS procedure_months, CAST(60 AS INTEGER) AS signing_days, CAST(35 AS INTEGER) AS standstill_days FROM c""",
    "notice_requirements": _K + """SELECT doc_id, ['imprese', 'raggruppamenti', 'consorzi'] AS bidders, false AS young_professional, CASE WHEN k % 2 = 0 THEN CAST(base * 2 AS DECIMAL(18,2)) END AS turnover, CASE WHEN k % 2 = 0 THEN base END AS similar_services, CASE WHEN k % 5 <> 0 THEN 'Metalmeccanici' END AS agreement, k % 5 <> 0 AS social_clause,
CAST(CASE WHEN k % 5 <> 0 THEN 30 END AS INTEGER) AS quota_percent, CASE WHEN k % 2 = 1 THEN false END AS roles_together, CAST(CASE WHEN k % 2 = 1 THEN 2 END AS INTEGER) AS least_team FROM c""",
    "notice_roles": _K + "SELECT doc_id, r.name, r.degree, r.register, CAST(r.years AS INTEGER) AS years FROM c, (VALUES ('Coordinatore', 'Ingegneria', 'Ingegneri', 10), ('Geologo', 'Geologia', NULL, 5)) r(name, degree, register, years) WHERE k % 2 = 1",
    "notice_criteria": _K + f"SELECT doc_id, p.code, CAST(CASE WHEN p.code = 'A' THEN e + 40 ELSE 30 END AS INTEGER) AS points, CAST(p.n AS INTEGER) AS n_parts, {_SUM} AS sum_check FROM c, (VALUES ('A', 2), ('B', 0)) p(code, n)",
    "notice_scoring": _K + "SELECT doc_id, CAST(e + 70 AS INTEGER) AS technical, CAST(30 - e AS INTEGER) AS economic, CAST(40 AS INTEGER) AS threshold, true AS rescaled, 'lineare' AS formula, CAST(2 AS INTEGER) AS decimals, false AS anomaly_check, NULL AS offer_mode FROM c",
    "notice_offer": _K + """SELECT doc_id, CAST(30 AS INTEGER) AS pages, 'A4' AS sheet, 'Arial' AS font, CAST(11 AS INTEGER) AS font_size, CAST(1.5 AS DOUBLE) AS spacing, ['copertina', 'indice'] AS without, CAST(NULL AS VARCHAR) AS not_counted,
CASE WHEN k % 2 = 0 THEN ['domanda di partecipazione', 'garanzia provvisoria'] ELSE CAST([] AS VARCHAR[]) END AS contents, CAST([] AS VARCHAR[]) AS offer_notes FROM c""",
    "notice_administration": _K + """SELECT doc_id, CAST(100 + k % 60 AS DECIMAL(18,2)) AS authority_fee, true AS stamp_duty, true AS dgue, CAST(NULL AS INTEGER) AS n_documents, k % 3 <> 0 AS remedial, CAST(CASE WHEN k % 3 <> 0 AND k % 35 + 1 <= 30 THEN k % 35 + 1 END AS INTEGER) AS remedial_days, true AS exclusion, false AS self_cleaning FROM c""",
    "notice_award": _K + "SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'forma pubblica amministrativa' ELSE 'scrittura privata' END AS form, CAST(35 AS INTEGER) AS standstill_days FROM c",
    "notice_clauses": _K + """SELECT doc_id, CAST(CASE WHEN k % 4 = 0 THEN 0.5 ELSE 1 END AS DOUBLE) AS penalty_per_mille, k % 4 = 0 AS duvri, k % 4 = 0 AS environmental, n_name AS court, k % 3 = 1 AS arbitration, true AS jury, true AS conduct, true AS traceability, CASE WHEN k % 4 = 0 THEN ['DNSH'] ELSE [] END AS pnrr_conditions, false AS advisory_board FROM c""",
    "notice_notes": _K + f"""SELECT doc_id, concat_ws('; ', CASE WHEN labour IS NOT NULL THEN 'Manodopera non ribassabile: ' || {_IT} END, CASE WHEN k % 3 = 0 THEN 'Prezzi fissi e invariabili' END, CASE WHEN k % 3 <> 0 THEN 'Revisione prezzi oltre il ' || CAST(k % 3 + 4 AS VARCHAR) || '%' END, 'Soglia di sbarramento: 40 punti', CASE WHEN k % 2 = 1 THEN 'Ruoli non cumulabili' END) AS notes,
CAST((CASE WHEN k % 3 <> 2 THEN 1 ELSE 0 END) + (CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_found,
CASE WHEN k % 5 = 0 THEN 'Procedura negoziata' ELSE 'Procedura aperta' END || CASE WHEN k % 4 >= 2 THEN ' in ' || CAST(k % 4 AS VARCHAR) || ' lotti' ELSE '' END || CASE WHEN k % 5 = 0 THEN ', sotto soglia, Minor prezzo' ELSE ', sopra soglia, OEPV' END AS procedure FROM c""",
    "notice_matches": _K + "SELECT doc_id, CAST(1 + (CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(1 + (CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM c",
    "lettered_items": _K + "SELECT doc_id, x.letter, x.item FROM c, (VALUES ('a', 'domanda di partecipazione'), ('b', 'garanzia provvisoria')) x(letter, item) WHERE k % 2 = 0",
}
