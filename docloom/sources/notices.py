"""Tender notices rendered from customers, one for each, in several layouts, with decoys and missing parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import amount_text, filled
from docloom.shared import spread


def _money(c: Column) -> Column:
    return amount_text(c.cast("decimal(18,2)"))


def render_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, upload_ts. Layout, wording and what is missing go by remainders of the customer's key."""
    k = F.col("c_custkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    rows = rows.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # a fixed list of 25
    f, text, lit = filled, (lambda c: c.cast("string")), F.lit
    day = lambda n, fmt="dd/MM/yyyy": F.date_format(F.date_add(F.to_date(lit("2024-01-01")), (k % 300 + n).cast("int")), fmt)
    base, safety, labour = lit(10000.5) + k * 37 % 900000, lit(500) + k % 100, lit(2000) + k % 1000
    n_lots = (k % 4).cast("int")
    lot = lambda i: f("Lotto %d fornitura tipo %d CIG: %s importo base gara € %s", lit(i), lit(i), F.upper(F.substring(F.sha2(F.concat_ws("-", text(k), lit(str(i))), 256), 1, 10)), _money(base + i))
    lots = F.when(n_lots >= 2, F.concat_ws(" ", lit("Gara suddivisa in più parti."), lot(1), lot(2), F.when(n_lots == 3, lot(3)))).otherwise(lit("L'appalto è in lotto unico."))
    parts = [
        lit("BANDO E DISCIPLINARE"),
        F.when(k % 2 == 0, f("Stazione appaltante: Comune di %s", "n_name")).otherwise(f("Amministrazione aggiudicatrice è la Azienda Sanitaria %s, Via Roma, %d", "n_name", k % 200 + 1)),
        F.when(k % 6 == 0, lit("La procedura si svolge in nome e per conto di Consorzio Acque.")),
        f("PEC: gare%d@pec.example.it e posta: info%d@example.it", k, k),
        F.when(k % 3 == 0, lit("Responsabile unico del progetto: Ing. Mario Rossi")).when(k % 3 == 1, lit("RUP: Anna Maria Bianchi")),
        F.when(k % 2 == 1, lit("Direttore dell'esecuzione: Geom. Luca Verdi")),
        f("Gara n. %d indetta con determina a contrarre n. %d del %s.", k, k % 500 + 1, day(-30)),
        f("CIG: %s CPV principale 71240000-2, CPV secondari 71250000-%d", F.concat_ws(" ", F.substring(F.upper(F.sha2(text(k), 256)), 1, 5), F.substring(F.upper(F.sha2(text(k), 256)), 6, 5)), k % 10),
        F.concat(lit("CUP: "), lit("C"), F.lpad(text(k % 100), 2, "0"), lit("B"), F.lpad(text(k), 11, "0")),
        F.when(k % 4 == 0, lit("Intervento finanziato con fondi PNRR e fondi comunali.")).when(k % 4 == 1, lit("Intervento finanziato con fondi FESR.")).when(k % 4 == 2, lit("Spesa ammessa al Conto Termico del GSE; Superbonus 110 % escluso.")),
        F.when(k % 3 == 0, lit("Le offerte si presentano sulla piattaforma Sintel all'indirizzo https://gare.example.org/sintel e non via MePA.")).when(k % 3 == 1, lit("Si usa il MePA.")).otherwise(lit("Offerte in busta.")),
        F.when(k % 5 == 0, lit("Procedura negoziata sotto soglia ai sensi dell'art. 50 d.lgs. 36/2023, criterio del minor prezzo.")).otherwise(lit("Procedura aperta sopra soglia ai sensi del d.lgs. 36/2023, offerta economicamente più vantaggiosa, con inversione procedimentale.")),
        F.when(k % 8 == 0, lit("Si conclude un accordo quadro.")),
        lots,
        F.when(k % 2 == 0, f("Importo a base di gara: € %s", _money(base))).otherwise(f("Importo posto a base d'asta %s euro", _money(base))),
        f("oneri della sicurezza pari a € %s non soggetti a ribasso", _money(safety)),
        F.when(k % 3 != 2, f("costi della manodopera stimati in € %s", _money(labour))),
        F.when(k % 3 == 0, lit("I prezzi sono fissi e invariabili.")).otherwise(f("È ammessa la revisione dei prezzi per variazioni oltre il %d%%.", k % 3 + 4)),
        F.when(k % 7 == 0, lit("Luogo di esecuzione: vedi capitolato")).otherwise(F.concat(lit("Luogo di esecuzione: "), "n_name")),
        F.when(k % 2 == 0, lit("Categorie: E.22 IA.01 e lavori OG1, ancora E.22")).otherwise(lit("Categorie: S.03")),
        F.when(k % 4 == 3, lit("I concorrenti devono presentare la medesima offerta tecnica e possono aggiudicarsi al massimo due lotti.")),
        F.when(k % 2 == 0, f("Richieste di chiarimenti entro il %s; scadenza per la presentazione delle offerte: ore 12:30 del %s", day(10), day(20))).otherwise(f("Termine per le offerte %s ore 9:00\nTermine per i quesiti %s", day(20, "d.M.yyyy"), day(10, "d.M.yyyy"))),
        F.when(k % 3 != 0, f("apertura delle buste in seduta pubblica il %s", day(25))),
        F.when(k % 3 == 1, lit("L'offerta ha validità di 240 giorni.")),
        F.when(k % 3 == 0, f("Durata del contratto: %d mesi", k % 24 + 12)).when(k % 3 == 1, lit("Durata: 90 giorni")).otherwise(lit("Durata pari a 3 anni")),
        lit("Stipula entro 60 giorni dall'aggiudicazione; stand still di 35 giorni."),
        lit("Possono partecipare operatori economici, raggruppamenti temporanei e consorzi."),
        F.when(k % 2 == 0, f("fatturato globale minimo di € %s e servizi analoghi per € %s", _money(base * 2), _money(base))),
        F.when(k % 5 != 0, lit("CCNL: Metalmeccanici\nSi applica la clausola sociale. quota occupazionale del 30% per i giovani.")),
        F.when(k % 2 == 1, lit("Figure richieste (ruoli non cumulabili):\n- Coordinatore: laurea in Ingegneria, iscrizione all'ordine degli Ingegneri, 10 anni\n- Geologo: laurea in Geologia, 5 anni")),
        f("CRITERI\nA | Organizzazione | %d\nA.1 | Metodo di lavoro | 25\nA.2 | Gruppo proposto | %d\nB | Esperienza | 30", k % 11 + 40, k % 11 + 15),
        f("Offerta tecnica: massimo %d punti, offerta economica: %d punti; soglia minima di sbarramento di %d punti con riparametrazione, formula lineare, due decimali.", k % 11 + 70, 30 - k % 11, lit(40)),
        lit("La relazione non deve superare massimo 30 pagine in formato A4, carattere Arial dimensione 11, interlinea 1,5, esclusi copertina e indice."),
        F.when(k % 2 == 0, lit("Contenuto della busta: a) domanda di partecipazione; b) garanzia provvisoria; c) no.")),
        f("Contributo ANAC di € %s, imposta di bollo e DGUE. Motivi di esclusione di legge.", _money(lit(100) + k % 60)),
        F.when(k % 3 != 0, f("Il soccorso istruttorio è attivato con termine di %d giorni.", k % 35 + 1)),
        F.when(k % 2 == 0, lit("Il contratto è stipulato in forma pubblica amministrativa.")).otherwise(lit("Il contratto è stipulato mediante scrittura privata.")),
        F.when(k % 4 == 0, lit("Penale dello 0,5 per mille al giorno. DUVRI allegato. Criteri ambientali minimi e principio DNSH.")).otherwise(lit("Penali pari all'1 per mille.")),
        F.concat(lit("Foro competente: quello di "), "n_name"),
        F.when(k % 3 == 0, lit("È escluso il ricorso all'arbitrato.")).when(k % 3 == 1, lit("Le liti sono rimesse ad arbitrato.")),
        lit("La commissione giudicatrice valuta; codice di comportamento e tracciabilità si applicano."),
    ]
    return rows.select(text(k).alias("doc_id"), F.concat_ws("\n", *parts).alias("text"), F.date_add(F.to_date(lit("2024-01-01")), (k % 300).cast("int")).alias("upload_ts"))
