"""Notices whose sentences take one of several forms each, drawn by a hash and so independently of each other and of the values they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import amount_text, filled
from docloom.operators.packs import MONTHS
from docloom.shared import spread


def render_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, one for each customer. Values follow the customer's key; wording, notation of dates and amounts, line breaks and the decoys around them don't."""
    k = F.col("c_custkey")
    f, lit = filled, F.lit

    def pick(name: str, *forms: Column) -> Column:
        return F.get(F.array(*forms), F.pmod(F.xxhash64(lit(name), k), lit(len(forms))).cast("int"))

    def date(name: str, days: int) -> Column:
        d = F.date_add(F.to_date(lit("2024-01-05")), (k % 330 + days).cast("int"))
        month = F.get(F.array(*[lit(m) for m in MONTHS]), F.month(d) - 1)
        return pick(name, *[F.date_format(d, p) for p in ("dd/MM/yyyy", "d.M.yyyy", "dd-MM-yyyy", "dd/MM/yy")], F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, F.year(d).cast("string")))

    def money(name: str, value: Column) -> Column:
        v = value.cast("decimal(18,2)")
        whole = F.regexp_replace(amount_text(v), ",00$", "")
        return pick(name, F.concat(lit("€ "), amount_text(v)), F.concat(amount_text(v), lit(" euro")), F.concat(lit("euro "), whole), F.concat(lit("EUR "), amount_text(v)), F.concat(whole, lit(" €")))

    hour = F.when(k % 2 == 0, "12:00").otherwise("9:30")
    until, asked, opened = date("until", 40), date("asked", 25), date("opened", 47)
    offers = pick(
        "offers", f("Scadenza presentazione offerte:\n%s ore %s", until, hour), f("Le offerte dovranno pervenire entro e non oltre le ore %s del giorno %s.", hour, until), f("Termine per il ricevimento delle offerte: %s ore %s", until, hour),
        f("Le offerte vanno inviate prima della seduta pubblica, entro il %s alle ore %s.", until, hour), f("Il plico con l'offerta, redatto secondo il modello allegato e firmato digitalmente da chi rappresenta il concorrente,\ndeve giungere entro il giorno %s, ore %s", until, hour),
    )
    questions = pick("questions", f("Richieste di chiarimenti entro il %s.", asked), f("I quesiti vanno posti non oltre il %s", asked), f("Chiarimenti:\n%s", asked), f("Termine per la presentazione dei quesiti %s", asked), f("Si risponde ai quesiti che giungono entro e non oltre il giorno %s.", asked))
    opening = pick("opening", f("Apertura delle buste: %s", opened), f("La prima seduta si tiene il giorno %s.", opened), f("In seduta pubblica, il %s, la commissione apre i plichi.", opened), f("Apertura delle offerte\n%s ore 15:00", opened), f("Seduta pubblica fissata per il %s ore 10:00", opened))
    base, safety = money("base", lit(250_000) + k * 7), money("safety", lit(1500.5) + k % 900)
    amounts = pick("amounts", f("Importo a base di gara: %s", base), f("importo a base di gara pari ad %s, oltre IVA", base), f("Importo a base di gara soggetto a ribasso: %s", base), f("L'importo posto a base d'asta ammonta a %s", base), f("Importo a base d'asta (esclusi gli oneri)\n%s", base))
    costs = pick("costs", f("oneri della sicurezza da interferenza (DUVRI 2) pari a %s", safety), f("Costi per la sicurezza: %s", safety), f("oneri della sicurezza non soggetti a ribasso %s", safety), f("Gli oneri per la sicurezza ammontano a %s", safety), f("costi della sicurezza\n%s", safety))
    t, e = (65 + k % 20).cast("int"), (35 - k % 20).cast("int")
    scores = pick("scores", f("Offerta tecnica: massimo %d punti; offerta economica: massimo %d punti", t, e), f("%d punti per l'offerta tecnica e %d punti per l'offerta economica", t, e), f("Offerta tecnica %d\nOfferta economica %d\n", t, e), f("Punteggio massimo offerta tecnica: %d\nPunteggio massimo offerta economica: %d", t, e), f("offerta tecnica (max %d/100), offerta economica (max %d/100)", t, e))
    who = F.get(F.array(lit("Maria Bianchi"), lit("Luca De Neri"), lit("Anna Maria Verdi")), (k % 3).cast("int"))
    rup = pick("rup", f("RUP: Ing. %s Tel 06 12345", who), f("R.U.P. Dott.ssa %s", who), f("Responsabile unico del progetto è l'arch. %s, Email x@y.it", who), f("Responsabile unico del procedimento:\n%s", who), f("Il RUP, nominato con atto interno, è il geom. %s.", who))
    boss = F.get(F.array(lit("Giulia Conti"), lit("Paolo Serra")), (k % 2).cast("int"))
    director = pick("director", f("Direttore dell'esecuzione: Ing. %s", boss), f("direttore dell'esecuzione %s", boss), f("Direttore dell’esecuzione è l'Arch. %s", boss))
    kinds = [("E{}20", "IA{}02", "OG1"), ("S{}03", "D{}04"), ("E{}22", "IB{}08", "OS30")]
    listed = lambda dot: F.get(F.array(*[lit(", ".join(c.format(dot) for c in cs)) for cs in kinds]), (k % 3).cast("int"))
    works = pick("works", f("Categorie: %s", listed(".")), f("classi e categorie %s", listed("")), f("Categorie d'opera\n%s\n", listed(".")))
    sites = [("TuttoGare", "https://bandi.tuttogare.it/x"), ("Stella", "https://gare.regione.lazio.it/HomePage.jsp"), ("Asmecomm", "https://app.asmecomm.it/bandi"), ("Intercenter", "https://intercenter.regione.it"), ("Sintel", "https://www.sintel.regione.it/login")]
    site = lambda i: F.get(F.array(*[lit(s[i]) for s in sites]), (k % 5).cast("int"))
    platform = pick("platform", f("Piattaforma telematica %s, indirizzo %s.", site(0), site(1)), f("Si usa %s (piattaforma raggiungibile a %s)", site(0), site(1)), f("La gara corre sulla piattaforma %s\n e la piattaforma sta a %s ;", site(0), site(1)))
    money_from = F.get(F.array(lit("Fondo Europeo di Sviluppo Regionale"), lit("decreto ministeriale, certificati bianchi"), lit("POR Lazio FSE 2021"), lit("incentivi del Conto Termico, Gestore dei Servizi Energetici"), lit("PNRR, Misura 7"), lit("fondi propri e fondi di bilancio")), (k % 6).cast("int"))
    source = pick("source", f("Finanziamento: %s.", money_from), f("L'intervento è finanziato da %s", money_from), f("Fonti\n%s", money_from))
    decoys = pick("decoys", lit("Vista la determina a contrarre n. 12 del 03/01/2024."), lit("Criterio dell'offerta economicamente più vantaggiosa, d.lgs. 36/2023 del 31 marzo 2023."), lit("L'offerta tecnica massimo 3 punti per ogni voce accessoria non conta."), lit("Pubblicato con decreto del 2.1.2024; validità dell'offerta 180 giorni."), lit("Premessa senza date."))
    blocks = pick("order", F.concat_ws("\n", offers, questions, opening), F.concat_ws("\n", questions, offers, opening), F.concat_ws("\n", opening, questions, offers))
    text = F.concat_ws("\n", lit("BANDO"), decoys, blocks, lit("Fine dei termini."), rup, director, platform, source, amounts, costs, works, scores)
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").select(k.cast("string").alias("doc_id"), text.alias("text"))
