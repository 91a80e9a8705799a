import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import adaptive as AD
from docloom.operators import packs as P

D = datetime.date


def one(spark, texts, **cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.asDict() for r in df.select("i", *[f(F.col("text")).alias(k) for k, f in cols.items()]).orderBy("i").collect()]


def test_deadlines_in_many_forms(spark):
    cases = {
        "Scadenza presentazione offerte:\n15/03/2025 ore 12:00": (D(2025, 3, 15), "12:00"),
        "Le offerte dovranno pervenire entro e non oltre le ore 12:00 del giorno 20 marzo 2025": (D(2025, 3, 20), "12:00"),
        "Termine per il ricevimento delle offerte: 15/03/25 ore 12:00": (D(2025, 3, 15), "12:00"),
        "entro le ore 10:00 del 05/04/2025": (D(2025, 4, 5), "10:00"),
        "Le offerte " + "x " * 150 + "5.4.2025": (D(2025, 4, 5), None),
        "Le offerte vanno inviate dopo la seduta pubblica entro il 20/02/2025": (D(2025, 2, 20), None),
        "Quesiti entro il 1/2/2025": (None, None),
        "Offerte entro il 31/02/2025 o il 1/3/2025": (D(2025, 3, 1), None),
        "": (None, None),
    }
    got = one(spark, list(cases), day=lambda t: P.timing(t)["offers_until"], hour=lambda t: P.timing(t)["offers_hour"])
    assert [(r["day"], r["hour"]) for r in got] == list(cases.values())


def test_amounts_scores_people_and_codes(spark):
    texts = ["importo a base di gara pari ad € 500.000,00; oneri della sicurezza da interferenza (DUVRI 2) pari a € 500,00", "Importo a base di gara soggetto a ribasso: € 395.700,00", "importo a base di gara (art. 5) 12.000 euro, altro € 7"]
    got = one(spark, texts, base=lambda t: P.amounts(t)["base"], safety=lambda t: P.amounts(t)["safety"])
    assert [float(r["base"]) for r in got] == [500000, 395700, 12000] and float(got[0]["safety"]) == 500
    texts = ["offerta tecnica massimo 3 punti", "Offerta tecnica 80\n", "Punteggio massimo offerta tecnica: 80", "offerta tecnica massimo 3 punti; offerta tecnica massimo 70 punti", None]
    assert [r["x"] for r in one(spark, texts, x=lambda t: P.scoring(t)["technical"])] == [None, 80, 80, 70, None]
    texts = ["RUP: Ing. Mario Rossi Tel 06", "RUP Dott.ssa Maria Bianchi", "R.U.P. arch. Luca Neri", "Il RUP è nominato dall'ente: ing. Anna Verdi", "RUP: da nominare"]
    assert [r["x"] for r in one(spark, texts, x=lambda t: P.responsible(t)["rup"])] == ["Mario Rossi", "Maria Bianchi", "Luca Neri", "Anna Verdi", None]
    assert one(spark, ["E20 e IA02, poi E.20"], x=lambda t: F.transform(P.categories(t), lambda c: c["code"]))[0]["x"] == ["E.20", "IA.02"]
    texts = ["via MePA o Sintel", "Bando su Stella", "Asmecomm https://app.asmecomm.it/x.", "start"]
    got = one(spark, texts, name=lambda t: P.platform(t)["platform"], runner=lambda t: P.platform(t)["runner"], host=lambda t: P.platform(t)["url_host"])
    assert [(r["name"], r["runner"], r["host"]) for r in got] == [("Sintel", "ARIA S.p.A.", None), ("S.TEL.LA.", "Regione Lazio", None), ("Asmecomm", None, "app.asmecomm.it"), ("START", "Regione Toscana", None)]
    lots = F.array().cast("array<struct<lot:int,cig:string>>")
    assert [r["x"] for r in one(spark, ["C12B12345678", "c12b 1234567890", "C12B1234567"], x=lambda t: P.code_formats(t, lots))] == [[], [], ["CUP"]]


@pytest.mark.parametrize(
    ("text", "prefix", "want"),
    [
        ("Ente appaltante: Comune di Roma\nCIG: X", "di\nEnte appaltante ", "Comune di Roma"),
        ("Stazione appaltante indicata sotto - Provincia di Lecce\n\nAltro", "Stazione appaltante ", "Provincia di Lecce"),
        ("Ente appaltante: Comune\n\n", "Disciplinare\nEnte appaltante ", None),  # a word of the prefix is missing
        ("appaltante senza separatore", "appaltante: ", None),
        ("Stazione\n" + "x" * 400 + "appaltante: Comune\n\n", "Stazione appaltante ", None),  # the second word is too far
        ("appaltante: ab\n\n", "appaltante ", None),
        ("qualcosa", "di a il", None),
        ("qualcosa", None, None),
    ],
)
def test_value_after(spark, text, prefix, want):
    df = spark.createDataFrame([(text, prefix)], "text string, prefix string")
    assert df.select(AD.value_after(F.col("text"), F.col("prefix")).alias("v")).first().v == want


def test_enhance_never_replaces_and_votes(spark):
    docs = spark.createDataFrame([("a", "Oggetto appalto: Scuola\nCIG: 1\nDurata: 12 mesi\n\n"), ("b", "Oggetto appalto: Ponte\nCIG: 2\n"), ("c", "nulla"), (None, "x")], "doc_id string, text string")
    found = spark.createDataFrame([("a", "oggetto", "", None), ("a", "durata", None, None), ("b", "oggetto", "Ponte", "rules"), ("c", "oggetto", "0", None), ("a", "cig", "già noto", "rules")], "doc_id string, field string, value string, method string")
    rules = spark.createDataFrame([("durata", r"Durata[:\s]+([^\n]{1,200})", 0.7), ("durata", r"Durata[:\s]+(\d+)", 0.59), ("cig", r"CIG[:\s]+(\d)", 0.9)], "field string, pattern string, confidence double")
    memory = AD.memory_rows(found.where("value is not null"), docs)
    assert [(r.doc_id, r.field, r.confidence) for r in memory.where("prefix is not null").collect()] == [("b", "oggetto", 0.7)]
    similar = spark.createDataFrame([("a", "b", 0.5), ("c", "b", 0.5)], "doc_id string, other string, score double")
    got = {(r.doc_id, r.field): (r.value, r.method) for r in AD.enhance(docs, found, rules, similar, memory).collect()}
    assert got == {("a", "oggetto"): ("Scuola", "similar_doc(28%)"), ("a", "durata"): ("12 mesi", "auto_rule(70%)"), ("b", "oggetto"): ("Ponte", "rules"), ("c", "oggetto"): ("0", None), ("a", "cig"): ("già noto", "rules")}


def test_conform_odd_json(spark):
    from docloom.plans.adaptive import RECORD

    texts = [None, "", "null", "{}", '{"id": 1, "date": "2024-01-01", "lots": {}}', '{"id": "7", "date": "2024-13-01", "body": {"name": "x"}, "lots": [1, {"number": 2}]}', '{"id": 1, "date": "2024-01-01"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = [r.errors for r in AD.conform(df, "raw", RECORD).orderBy("i").collect()]
    bad = ["$: not a JSON object"]
    assert got == [bad, bad, bad, ["id: field required", "date: field required"], ["lots: not a list"], ["date: not of type date", "lots[0]: not an object"], []]


def test_body_and_subject_in_many_forms(spark):
    from docloom.operators import rules as R

    rule = {r.field: r for r in R.BUILTIN}
    bodies = {
        "STAZIONE APPALTANTE: Comune di Roma\nX": "Comune di Roma",
        "Amministrazione aggiudicatrice\nASL di Bari": "ASL di Bari",
        "la stazione appaltante si riserva di non aggiudicare": None,
        "La centrale unica di committenza è Unione dei Comuni": "Unione dei Comuni",
        "Spett.le\nProvincia di Lecce": "Provincia di Lecce",
        "Spettabile Azienda Ospedaliera": "Azienda Ospedaliera",
        "Ente appaltante – Regione Lazio": "Regione Lazio",
        "": None,
        None: None,
    }
    got = one(spark, list(bodies), x=lambda t: R.extracted(t, rule["stazione_appaltante"]))
    assert [r["x"] for r in got] == list(bodies.values())
    subjects = {
        "OGGETTO: Fornitura di carta per uffici": "Fornitura di carta per uffici",
        "1. Oggetto dell'appalto\nServizio di pulizia delle scuole": "Servizio di pulizia delle scuole",
        "Titolo della gara: Manutenzione del verde": "Manutenzione del verde",
        "bando avente ad oggetto la manutenzione delle strade": "la manutenzione delle strade",
        "Procedura aperta per l'affidamento dei lavori di rifacimento": "l'affidamento dei lavori di rifacimento",
        "l'oggetto della lite": None,
        None: None,
    }
    got = one(spark, list(subjects), x=lambda t: R.extracted(t, rule["oggetto_appalto"]))
    assert [r["x"] for r in got] == list(subjects.values())


def test_notices_are_rendered_by_many_tasks(spark):
    from docloom.sources.notices import render_notices
    from docloom.sources.varied import render_varied

    for render in (render_notices, render_varied):
        docs = render(spark, "/root/testdata/sf0.001")  # whose customers lie in one small file
        assert docs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert docs.count() == docs.select("doc_id").distinct().count() > 0


def test_notes_extract_each_field_once(spark):
    from docloom.plans.notices import notice_notes

    top = notice_notes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().expressions().mkString()
    assert "Manodopera non ribassabile" in top and "manodopera" not in top  # messages take the field's column, not its pattern


def test_checked_values_stay_spread(spark, monkeypatch):
    """One field holds all values: no task gets them all, with few profiles or with more than are broadcast."""
    from docloom import shared

    rows = [(i, "f", str(i % 50)) for i in range(400)] + [(500, "g", None), (501, None, "7")]
    values = spark.createDataFrame(rows, "doc_id long, field string, value string").repartition(4)
    got = []
    for most in (1000, 0):
        monkeypatch.setattr(shared, "LOOKUP_ROWS", most, raising=False)
        out = AD.checked(values, AD.value_profiles(values.where("value is not null"))).withColumn("at", F.spark_partition_id()).collect()
        got.append(sorted(str(r[:-1]) for r in out))
        assert len(out) == len(rows)
        tasks = [r["at"] for r in out]
        if most:
            assert max(map(tasks.count, tasks)) < 300
    assert got[0] == got[1]


def test_criteria_are_sorted_once_and_templates_filled(spark):
    from docloom.functions import scalars as S
    from docloom.sources import notices, varied

    text = "A | Organizzazione | 40\n\n A.1 | Metodo | 25 |\nA | Altro nome | 30\nB | Esperienza | 30"
    df = spark.createDataFrame([(text,), (None,)], "text string").select(P.criteria(F.col("text")).alias("x"))
    got = [r.x for r in df.collect()]
    assert [tuple(x) for x in got[0]] == [("A", "Organizzazione", 40), ("A.1", "Metodo", 25), ("B", "Esperienza", 30)] and got[1] is None
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # sought and sorted anew for every row before
    row = spark.createDataFrame([(7, None)], "n int, s string").select(S.filled("100%% di %s, n. %d", "s", "n").alias("x"), F.format_string("100%% di %s, n. %d", "s", "n").alias("y")).first()
    assert row.x == row.y == "100% di null, n. 7"
    for render in (notices.render_notices, varied.render_varied):
        assert "format_string" not in render(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_offer_has_its_envelope_and_notes(spark):
    long = "relazione " + "x" * 2500
    texts = [
        "Busta tecnica\nLa busta tecnica deve contenere, a pena di esclusione:\na) relazione sui\nservizi offerti;\nb) curricula\nN.B. a parte\n21. OFFERTA ECONOMICA\na) prezzo complessivo",
        f"20. OFFERTA TECNICA\na) {long};\nb) no;\nBUSTA ECONOMICA\na) prezzo complessivo",
        "Requisiti: a) iscrizione alla camera; b) bilanci. Offerta di n. 20 (venti) pagine (facciate); non rientrano nel conteggio la copertina e l'indice.",
        "L'offerta tecnica identica per entrambi i lotti. L'Offerta **Tecnica** deve rispettare le caratteristiche\nminime del capitolato. Nell'offerta tecnica va, a pena di esclusione, nulla di economico. La Commissione giudicatrice può chiedere chiarimenti ai concorrenti.",
        None,
    ]
    got = one(spark, texts, **{k: lambda t, k=k: P.offer_format(t)[k] for k in ("contents", "pages", "not_counted", "offer_notes")})
    assert [r["contents"] for r in got] == [["relazione sui servizi offerti", "curricula"], [long], [], [], None]
    assert (got[2]["pages"], got[2]["not_counted"]) == (20, "non rientrano nel conteggio la copertina e l'indice")
    assert got[3]["offer_notes"] == ["offerta tecnica identica per entrambi i lotti.", "L'Offerta Tecnica deve rispettare le caratteristiche minime del capitolato.", "l'offerta tecnica va, a pena di esclusione, nulla di economico.", "La Commissione giudicatrice può chiedere chiarimenti ai concorrenti."]
