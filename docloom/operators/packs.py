"""Rule packs for tender notices: each gives named columns that are computed from a text column alone, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import scalars as S

_DATE = r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})"
_EUR = r"(?:€|euro|EUR)?\s*(\d[\d.,]*)"


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iud){pattern}"), F.lit(False))


def labels(text: Column, table: dict[str, str]) -> Column:
    """Names, in order, whose pattern occurs."""
    return F.filter(F.array(*[F.when(has(text, p), F.lit(k)) for k, p in table.items()]), lambda x: x.isNotNull())


def first_label(text: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(has(text, p), F.lit(k)) for k, p in table.items()])


def money(text: Column, *patterns: str) -> Column:
    """The first amount of ordered patterns; 1.234 without decimals is read as thousands, as Italian texts mean it."""
    return S.first_match(text, list(patterns), lambda x: S.parse_amount(x, dot3_thousands=True))


def day(text: Column, *patterns: str) -> Column:
    """The date that a pattern captures, written with slashes, dots or dashes."""
    return S.first_match(text, list(patterns), lambda x: F.try_to_date(F.regexp_replace(x, r"[.\-]", "/"), "d/M/yyyy"))


def identifiers(text: Column) -> dict[str, Column]:
    """Lenient identifiers: CIGs of ten or more characters, also written with blanks; CUP, CUI, main and other CPV codes."""
    spaced = F.transform(F.regexp_extract_all(text, F.lit(r"(?:CIG|C\.I\.G\.)[\s:]*((?:[A-Z0-9][ \t]?){10,12})\b"), 1), lambda x: F.regexp_replace(x, r"\s", ""))
    cpv = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{8}-\d)\b"), 1))
    return {
        "cigs": F.array_distinct(spaced),
        "cup": S.first_match(text, [r"\bC\.?U\.?P\.?[\s:]*([A-Z]\d{2}[A-Z]\d{11})\b"]),
        "cui": S.first_match(text, [r"\bC\.?U\.?I\.?[\s:]*([FSL]\d{16,24})\b"]),
        "cpv_main": F.get(cpv, F.lit(0)),
        "cpv_other": F.slice(cpv, 2, 50),
    }


# Kinds of contracting bodies and the words that name them, in order.
BODY_TYPES = {"Comune": r"\bcomune\b", "Azienda sanitaria": r"azienda\s+sanitaria|\bASL\b|\bASST\b", "Regione": r"\bregione\b", "Provincia": r"\bprovincia\b", "Università": r"universit", "Ministero": r"\bministero\b"}


def contracting_body(text: Column) -> dict[str, Column]:
    """Name, kind, delegating body, central purchasing body, certified and plain mail, address, from the head of a notice."""
    head = F.substring(text, 1, 5000)
    name = S.first_match(head, [r"(?:stazione|ente|amministrazione)\s+(?:appaltante|aggiudicatrice|committente)\s*[:\-–]?\s*(?:(?:è\s+)?(?:il|la)\s+)?([^\n,;]{4,120})"])
    mails = F.array_distinct(F.regexp_extract_all(F.lower(head), F.lit(r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})"), 1))
    certified = lambda m: m.rlike(r"@(?:[a-z0-9\-]+\.)*(?:pec|cert|legalmail)\.")
    return {
        "body": name,
        "body_type": F.when(name.isNotNull(), F.coalesce(first_label(name, BODY_TYPES), F.lit("Altro"))),
        "delegating": S.first_match(head, [r"(?:in\s+nome\s+e\s+)?per\s+conto\s+(?:di|del|della)\s+([^\n,;.]{4,100})", r"ente\s+delegante\s*:\s*([^\n,;]{4,100})"]),
        "purchasing_body": S.first_match(head, [r"centrale\s+(?:unica\s+)?di\s+committenza\s*[:\-–]\s*([^\n,;]{4,100})"]),
        "pec": F.get(F.filter(mails, certified), F.lit(0)),
        "mail": F.get(F.filter(mails, lambda m: ~certified(m)), F.lit(0)),
        "address": S.first_match(head, [r"((?:via|viale|piazza|corso|largo)\s+[^\n,;]{2,60},\s*\d+)"]),
    }


def responsible(text: Column) -> dict[str, Column]:
    """Who answers for the award (RUP) and who for the execution (director), by the words around each name; a name ends before words such as Tel or Email."""
    title = r"(?:(?:il|la)\s+|l['’]\s*)?(?:(?:dott|ing|arch|geom|avv|prof)\b\.?(?:\s?ssa\b)?\.?\s*)"
    no_name = r"(?!(?i:tel|telefono|fax|e-?mail|pec|indirizzo|documento|firmato|responsabile|unico|procedimento|progetto|servizio|settore|direzione|procedura|digitale|informatico)\b)"
    word = rf"{no_name}[A-ZÀ-Ú][a-zà-ú']+"
    person = rf"((?-iu:{word}(?:[ \t]+{word})+))"
    label = r"(?:responsabile\s+(?:unico\s+)?del\s+(?:procedimento|progetto)|\bR\.?U\.?P\b\.?)"
    after = r"[\s:,(\-–]*(?:è\s+)?"
    return {
        "rup": S.first_match(text, [rf"{label}{after}{title}*{person}", rf"{label}[\s\S]{{0,400}}?\b{title}{person}"]),
        "director": S.first_match(text, [rf"direttore\s+dell['’]esecuzione{after}{title}*{person}"]),
    }


def numbers(text: Column) -> dict[str, Column]:
    """Number of the tender; number and date of the decision to award."""
    decision = r"(?:determina|determinazione|delibera|decreto)(?:\s+a\s+contrarre)?\s+n(?:\.|umero)?\s*"
    return {
        "tender_number": S.first_match(text, [r"\bgara\s+(?:n\.|numero)\s*(\d{1,10})\b"]).cast("long"),
        "decision_number": S.first_match(text, [decision + r"(\d{1,6})"]).cast("int"),
        "decision_date": day(text, decision + r"\d{1,6}\s+(?:del|in\s+data)\s+" + _DATE),
    }


# The source of funding, by the first label whose words occur.
FUNDING = {
    "PNRR": r"PNRR|piano\s+nazionale\s+di\s+ripresa",
    "FESR": r"FESR|fondo\s+europeo\s+di\s+sviluppo\s+regionale",
    "PON/POR": r"\b(?:PON|POR|PR)\s+[a-z\s]+20\d{2}",
    "Decreto Dirigenziale": r"decreto\s+(?:dirigenziale|ministeriale)",
    "Fondi propri": r"(?:bilancio|fondi)\s+(?:propri|comunali|regionali)",
}
# All sources of funding, in order.
FUNDING_SOURCES = {
    "PNRR": r"PNRR",
    "PNRR M.7-1.7 Repower": r"\bM\.?7[^\n]*repower|misura\s+7|\bM7\s*[-.]?\s*1\.7",
    "Fondo Complementare PNC": r"fondo\s+complementare|PNC",
    "Superbonus/Ecobonus": r"superbonus|110\s*%|ecobonus",
    "Conto Termico": r"conto\s+termico",
    "Certificati Bianchi/TEE": r"certificat[oi]\s+bianch|\bTEE\b",
    "GSE": r"\bGSE\b|gestore\s+(?:dei\s+)?servizi\s+energetici",
    "Risorse proprie del concessionario": r"risorse\s+proprie\s+(?:del\s+)?(?:concession|operat)",
    "Fondi di Bilancio": r"fond[oi]\s+(?:di\s+)?bilancio",
    "Fondi regionali/europei": r"fond[oi]\s+(?:region|POR|FSC|FESR)",
}


def funding(text: Column) -> dict[str, Column]:
    """The source of funding by an ordered list, and all that are named."""
    return {"funding": first_label(text, FUNDING), "all_funding": labels(text, FUNDING_SOURCES)}


# Words that name an e-procurement platform, in order, with its name and who runs it.
PLATFORMS = {
    "sintel": ("Sintel", "ARIA S.p.A."),
    "tuttogare": ("TuttoGare", None),
    "net4market": ("Net4market", None),
    "mepa": ("MePA", "Consip"),
    "acquistinretepa": ("AcquistinretePa", "Consip"),
    "start": ("START", "Regione Toscana"),
    "s.tel.la": ("S.TEL.LA.", "Regione Lazio"),
    "stella": ("S.TEL.LA.", "Regione Lazio"),
    "traspare": ("TrasparE", None),
    "sardegna cat": ("SardegnaCat", "Regione Sardegna"),
    "empulia": ("EmPULIA", "InnovaPuglia"),
    "gare telematiche": ("Gare Telematiche", None),
    "appalti&contratti": ("Appalti&Contratti", None),
    "portale appalti": ("Portale Appalti", None),
    "maggioli": ("Maggioli", None),
    "asmecomm": ("Asmecomm", None),
    "intercent-er": ("Intercent-ER", "Regione Emilia-Romagna"),
    "intercenter": ("Intercent-ER", "Regione Emilia-Romagna"),
    "ariaspa": ("Sintel", "ARIA S.p.A."),
    "albofornitori": ("Albo Fornitori", None),
    "e-procurement": ("e-Procurement", None),
}
# Parts of a platform's host name.
PLATFORM_HOSTS = ["aria", "sintel", "tuttogare", "net4market", "traspare", "acquistinretepa", "start.toscana", "empulia", "intercent", "maggioli", "asmecomm", "portaleappalti", "mepa"]


def platform(text: Column) -> dict[str, Column]:
    """The first platform of an ordered list that the text names, who runs it, and its web address: one whose host is a platform's, else the one near the word platform."""
    escape = lambda w: w.replace(".", r"\.")
    named = F.coalesce(*[F.when(has(text, rf"\b{escape(k)}\b"), F.struct(F.lit(n).alias("name"), F.lit(r).cast("string").alias("runner"))) for k, (n, r) in PLATFORMS.items()])
    hosts = "|".join(escape(h) for h in PLATFORM_HOSTS)
    url = F.regexp_replace(S.first_match(text, [rf"(https?://[^/\s]*(?:{hosts})\S*)", r"(?:piattaforma|telematica)[^.\n]{0,200}?(https?://[^\s,;)]+)"]), r"[.,;)]+$", "")
    return {"platform": named["name"], "runner": named["runner"], "url": url, "url_host": F.try_parse_url(url, F.lit("HOST"))}


def procedure(text: Column) -> dict[str, Column]:
    """Label with the number of lots, scope, method, legal reference, framework, inversion, concession."""
    kind = first_label(text, {"Procedura aperta": r"procedura\s+aperta", "Procedura negoziata": r"procedura\s+negoziata", "Procedura ristretta": r"procedura\s+ristretta", "Dialogo competitivo": r"dialogo\s+competitivo", "Affidamento diretto": r"affidamento\s+diretto"})
    n = lot_count(text)
    threshold = first_label(text, {"sopra soglia": r"sopra\s+soglia|rilevanza\s+europea|comunitaria", "sotto soglia": r"sotto\s+soglia"})
    return {
        "label": F.when(n > 1, F.concat(kind, F.lit(" in "), n.cast("string"), F.lit(" lotti"))).otherwise(kind),
        "scope": threshold,
        "method": first_label(text, {"OEPV": r"economicamente\s+pi[uù]\s+vantaggiosa|qualit[aà]\s*/\s*prezzo", "Minor prezzo": r"minor\s+prezzo"}),
        "legal_reference": S.first_match(text, [r"(art\.?\s*\d+[^\n;,]{0,40}d\.?\s?lgs\.?\s*(?:n\.\s*)?\d+/\d{4})", r"(d\.?\s?lgs\.?\s*(?:n\.\s*)?\d+/\d{4})"]),
        "framework": has(text, r"accordo\s+quadro"),
        "inversion": has(text, r"inversione\s+procedimentale"),
        "concession": has(text, r"concessione\s+d[ei]"),
    }


def lot_count(text: Column) -> Column:
    """The largest number after the word lot, or a stated number of lots; 1 if there is none or more than 50."""
    seen = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\blotto\s+(?:n\.\s*)?(\d{1,4})\b"), 1), lambda x: x.cast("int"))
    most = F.greatest(F.array_max(seen), S.first_match(text, [r"(?:suddiviso|articolato)\s+in\s+(\w+)\s+lotti"], lambda x: S.number_word(x)))
    return F.when(most.isNull() | (most > 50) | (most < 1), 1).otherwise(most)


def lots(text: Column) -> Column:
    """Lots in order, also where all stand in one line: number, name, CIG, amount, safety costs, months, place."""
    parts = F.regexp_extract_all(text, F.lit(r"(?is)\b(lotto\s+(?:n\.\s*)?\d+\b(?:(?!\blotto\s+(?:n\.\s*)?\d).)*)"), 1)
    read = lambda x, p: F.nullif(F.trim(F.regexp_extract(x, "(?is)" + p, 1)), F.lit(""))

    def lot(x: Column) -> Column:
        return F.struct(
            read(x, r"^lotto\s+(?:n\.\s*)?(\d+)").cast("int").alias("lot"),
            read(x, r"^lotto\s+(?:n\.\s*)?\d+\s*[:\-–]?\s*([^\n:;,€]{3,80}?)(?=\s+(?:CIG|importo|base|durata|luogo)\b|[\n:;,€]|$)").alias("name"),
            read(x, r"\bCIG\s*:?\s*([A-Z0-9]{10})\b").alias("cig"),
            S.parse_amount(read(x, r"(?:importo(?!\s+(?:oneri|della\s+sicurezza))|base)[^€\n]{0,60}?€\s*([\d.,]*\d)")).alias("amount"),
            S.parse_amount(read(x, r"sicurezza[^€\n]{0,40}€\s*([\d.,]*\d)")).alias("safety"),
            read(x, r"durata[^\n]{0,40}?(\d{1,3})\s+mesi").cast("int").alias("months"),
            read(x, r"luogo[^\n:]{0,30}:\s*([^\n;,]{3,60})").alias("place"),
        )

    return F.transform(parts, lot)


def lot_constraints(text: Column) -> dict[str, Column]:
    """Whether bidders must bid for all lots or make identical offers, how many they may win, and in what form."""
    return {
        "all_lots": has(text, r"(?:obbligo|tenut[oi])[^\n.]{0,40}(?:tutti\s+i|ciascun)\s+lott"),
        "same_offer": has(text, r"medesima\s+offerta\s+tecnica"),
        "same_form": has(text, r"medesima\s+forma\s+(?:giuridica|di\s+partecipazione)"),
        "most_lots": S.first_match(text, [r"(?:aggiudica\w*|massimo)[^\n.]{0,30}?\b(\w+)\s+lott[oi]\b"], lambda x: S.number_word(x)),
    }


def amounts(text: Column) -> dict[str, Column]:
    """Base amount, safety and labour costs; fixed and discountable parts from explicit amounts only; price revision; place."""
    # The amount nearest to the label that has a currency sign on either side; numbers without one between them don't count. Else one right behind the label.
    sign = r"(?:€|\beuro\b|\bEUR\b)"
    forms = lambda label: [rf"{label}[^€]{{0,100}}?(?:€\.?\s*)?((?<={sign}\.?\s{{0,3}})\d[\d.,]*|(?<![\d.,])\d[\d.,]*(?=\s*{sign}))", rf"{label}[^€\d\n]{{0,60}}(\d[\d.,]*)"]
    base = S.first_match(text, forms(r"importo\s+(?:posto\s+)?a\s+base\s+(?:di\s+|d['’]\s*)(?:gara|asta)") + forms(r"base\s+d['’]\s*asta"), lambda x: S.let(S.parse_amount(x, dot3_thousands=True), lambda v: F.when(v > 100, v)))
    safety = money(text, *forms(r"(?:oneri|costi)\s+(?:della|per\s+la)\s+sicurezza"))
    labour = money(text, r"costi?\s+della\s+manodopera[^€\d\n]{0,40}" + _EUR)
    fixed = F.coalesce(labour, safety, F.lit(0).cast("decimal(18,2)"))
    return {
        "base": base,
        "safety": safety,
        "labour": labour,
        "fixed": F.when(base.isNotNull(), fixed).cast("decimal(18,2)"),
        "discountable": (base - fixed).cast("decimal(18,2)"),
        "revision": F.when(has(text, r"prezz[oi][^\n.]{0,30}fiss[oi]\s+e\s+invariabil"), F.lit(False)).when(has(text, r"revisione\s+(?:dei\s+)?prezz"), F.lit(True)),
        "revision_percent": F.when(~has(text, r"fiss[oi]\s+e\s+invariabil"), S.first_match(text, [r"revisione\s+(?:dei\s+)?prezz[^\n%]{0,120}?(\d{1,2}(?:,\d+)?)\s*%"])).cast("int"),
        "place": S.first_match(text, [r"luogo\s+di\s+(?:esecuzione|svolgimento|consegna)\s*[:\-–]?\s*([^\n;,.]{3,80})"], lambda x: F.when(~x.rlike(r"(?i)^(?:vedi|cfr|si\s+rinvia)"), x)),
    }


def categories(text: Column) -> Column:
    """Work categories in order of their first place, with or without their dot: code, kind (ENG for engineering services, SOA for works)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:IA|IB|[ESD])\.?\d{2}|[GTVP]\.\d{2}|O[GS]\s?\d{1,2}(?:-[AB])?)\b"), 1), lambda x: S.category_code(F.regexp_replace(x, r"\s", ""))))
    return F.transform(found, lambda c: F.struct(c.alias("code"), F.when(c.rlike("^O[GS]"), "SOA").otherwise("ENG").alias("kind")))


MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
_ANY_DATE = rf"(?<![\d/.\-])\d{{1,2}}[/.\-]\d{{1,2}}[/.\-](?:\d{{4}}|\d{{2}})(?![\d/])|\b\d{{1,2}}°?\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}\b"
#: Words that tell what a date is for: what a wording that continues (an offer's kind, its validity, a decision) isn't about is "other".
_ROLES = {
    "opening": r"apertura\s+(?:delle\s+|dei\s+)?(?:buste|offerte|plichi)|prima\s+seduta|sedut[ae](?:\s+pubblic[ahe]+)?",
    "questions": r"chiariment\w*|quesit\w*",
    "other": r"offert[ae]\s+(?:economicamente|tecnic|economic)\w*|validit[aà]\s+(?:dell['’]\s*)?offert\w+|determin\w+|deliber\w+|decret\w+|d\.?\s?lgs",
    "offers": r"offert[ae]",
}


def read_date(x: Column) -> Column:
    """A date in figures, its year of two or four digits, or with the name of its month; null if there is no such day."""
    low = F.regexp_replace(F.lower(F.trim(x)), r"[.\-\s°]+", "/")
    for k, m in enumerate(MONTHS, 1):
        low = F.replace(low, F.lit(m), F.lit(str(k)))
    return F.try_to_date(F.regexp_replace(low, r"/(\d{2})$", "/20$1"), "d/M/yyyy")


def dated(text: Column, window: int = 500) -> Column:
    """Every date of a text in order: day, what it is for (by the last of the _ROLES in the `window` characters before it, across lines, or "deadline" if only a
    term is mentioned), and the hour beside it. A date that something is due by ("entro") isn't an opening's."""
    found = F.regexp_extract_all(text, F.lit(f"(?iu)({_ANY_DATE})"), 1)
    between = F.split(text, f"(?iu)(?:{_ANY_DATE})")
    # What stands before each date, carried on from part to part.
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("all"))
    step = lambda s, p: S.let(F.right(F.concat(s["tail"], F.lit(" "), p), F.lit(window)), lambda t: F.struct(t.alias("tail"), F.array_append(s["all"], t).alias("all")))
    tails = lambda p: F.aggregate(F.slice(p["between"], F.lit(1), F.size(p["found"])), start, step, lambda s: s["all"])
    words = "|".join(_ROLES.values())
    hour = r"(\d{1,2}[:.,]\d{2})"

    def role(word: Column) -> Column:
        return F.coalesce(*[F.when(word.rlike(f"(?iu)^(?:{p})$"), F.lit(k)) for k, p in _ROLES.items()])

    def one(day: Column, i: Column, before: Column, between: Column) -> Column:
        tail, rest = F.get(before, i), F.get(between, i + 1)
        marks = F.transform(F.regexp_extract_all(tail, F.lit(f"(?iu)({words})"), 1), role)
        since = F.regexp_extract(tail, rf"(?isu)^.*(?:{_ROLES['opening']})(.*)$", 1)
        due = (F.element_at(F.concat(F.array(F.lit("none")), marks), F.lit(-1)) == "opening") & since.rlike(r"(?iu)\bentro\b")
        used = F.when(due, F.filter(marks, lambda m: m != "opening")).otherwise(marks)
        term = F.when(F.right(tail, F.lit(200)).rlike(r"(?iu)\b(?:entro|scadenza|termine)\b"), "deadline").otherwise("none")
        at = F.coalesce(F.nullif(F.regexp_extract(rest, rf"(?iu)^[\s,;]*(?:alle\s+|h\.?\s*)?(?:ore\s+)?{hour}", 1), F.lit("")), F.nullif(F.regexp_extract(tail, rf"(?iu)ore\s+{hour}\s+(?:del\s+)?(?:giorno\s+)?$", 1), F.lit("")))
        return F.struct(read_date(day).alias("day"), F.coalesce(F.try_element_at(used, F.lit(-1)), term).alias("role"), F.translate(at, ".,", "::").alias("hour"))

    # Parts and tails are bound once; named inside the transform they would be made anew for every date.
    parts = F.struct(found.alias("found"), between.alias("between"))
    each = S.let(parts, lambda p: S.let(tails(p), lambda before: F.transform(p["found"], lambda d, i: one(d, i, before, p["between"]))))
    return F.filter(each, lambda x: x["day"].isNotNull())


def timing(text: Column) -> dict[str, Column]:
    """Deadlines for offers (else the first of no stated kind) and questions and the opening, each told by the words before it, the hour of the first; validity (180 days unless
    stated), duration in days with its wording, duration of the procedure in months, signing and standstill terms."""
    of = lambda dates, role: F.get(F.filter(dates, lambda x: x["role"] == role), F.lit(0))
    # The dates are told apart once and all fields picked from them in one struct, so that the fields share one expression.
    picked = S.let(dated(text), lambda dates: F.struct(F.coalesce(of(dates, "offers"), of(dates, "deadline")).alias("offers"), of(dates, "questions").alias("questions"), of(dates, "opening").alias("opening")))
    offers = picked["offers"]
    days = lambda p: S.first_match(text, [p]).cast("int")
    unit = lambda u: days(rf"durata(?!\s+(?:massima\s+)?della?\s+procedur)[^\n]{{0,60}}?(\d{{1,4}})\s+{u}")
    return {
        "offers_until": offers["day"],
        "offers_hour": offers["hour"],
        "questions_until": picked["questions"]["day"],
        "opening": picked["opening"]["day"],
        "validity_days": F.coalesce(days(r"(?:validit[aà]|vincolat[ao])[^\n]{0,80}?(\d{2,3})\s+giorni"), F.lit(180)),
        "duration_days": F.coalesce(unit("giorni"), unit("mesi") * 30, unit("anni") * 365),
        "procedure_months": days(r"durata\s+(?:massima\s+)?della?\s+procedur\w+[^.]{0,80}?(\d{1,3})\s*mesi"),
        "signing_days": days(r"stipula[^\n]{0,60}?entro\s+(\d{1,3})\s+giorni"),
        "standstill_days": days(r"stand\s*still[^\n]{0,40}?(\d{1,3})\s+giorni"),
    }


# Who may bid.
BIDDERS = {"imprese": r"imprese\s+individuali|operatori\s+economici", "professionisti": r"liberi\s+professionisti", "societa": r"societ[aà]\s+di\s+ingegneria", "raggruppamenti": r"raggruppament[oi]\s+temporane|\bRTI\b", "consorzi": r"consorzi", "geie": r"\bGEIE\b", "reti": r"aggregazioni|contratto\s+di\s+rete", "esteri": r"stabiliti\s+in\s+altri\s+stati"}


def requirements(text: Column) -> dict[str, Column]:
    """Bidders, turnover, similar services, collective agreement, social clause, quotas, team size and whether roles may be held together."""
    roles = roles_list(text)
    return {
        "bidders": labels(text, BIDDERS),
        "young_professional": has(text, r"giovane\s+professionista"),
        "turnover": money(text, r"fatturato\s+globale[^€\d\n]{0,60}" + _EUR),
        "similar_services": money(text, r"servizi\s+analoghi[^€\d\n]{0,80}" + _EUR),
        "agreement": S.first_match(text, [r"\bCCNL\s*:?\s*([^\n;,.]{3,60})"]),
        "social_clause": has(text, r"clausola\s+sociale"),
        "quota_percent": S.first_match(text, [r"quota[^\n%]{0,60}?(\d{1,3})\s*%"]).cast("int"),
        "roles_together": F.when(has(text, r"non\s+(?:sono\s+)?cumulabil"), F.lit(False)).when(has(text, r"cumulabil"), F.lit(True)),
        "least_team": F.coalesce(S.first_match(text, [r"gruppo\s+di\s+lavoro[^\n]{0,60}?(?:almeno|minimo\s+di)\s+(\w+)\s+(?:unit|professionist|component)"], lambda x: S.number_word(x)), F.when(F.size(roles) >= 2, F.size(roles))),
    }


def roles_list(text: Column, most: int = 20) -> Column:
    """Required roles: name, degree, register and years, from lines `- Role: laurea in ..., iscrizione ..., n anni`."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^\s*[\-•]\s*([^:\n]{4,80}:\s*laurea[^\n]*)"), 1)
    read = lambda x, p: F.nullif(F.trim(F.regexp_extract(x, "(?i)" + p, 1)), F.lit(""))
    role = lambda x: F.struct(read(x, r"^([^:]+):").alias("name"), read(x, r"laurea\s+(?:magistrale\s+)?in\s+([^,;]+)").alias("degree"), read(x, r"(?:iscri\w+\s+)?all?['’]?\s?(?:albo|ordine)\s+(?:degli|dei|delle)\s+([^,;]+)").alias("register"), read(x, r"(\d{1,2})\s+anni").cast("int").alias("years"))
    return F.slice(F.transform(F.array_distinct(found), role), 1, most)


def criteria(text: Column) -> Column:
    """Scoring criteria of lines `A.1 | name | points`: of each code the row with most points, in order; a dot makes a sub-criterion."""
    line = r"(?m)^\s*([A-Z](?:\.\d{1,2})?)\s*\|\s*([^|\n]{3,200}?)\s*\|\s*(\d{1,3})\s*\|?\s*$"
    # Whole lines are looked for once and then read; the sorted rows are bound once, since each row looks at the one before.
    part = lambda x, k: F.regexp_extract(x, line, k)
    rows = F.transform(F.regexp_extract_all(text, F.lit(line), 0), lambda x: F.struct(part(x, 1).alias("code"), (-part(x, 3).cast("int")).alias("minus"), part(x, 2).alias("name")))
    best = S.let(F.array_sort(rows), lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["code"] != x["code"])))
    return F.transform(best, lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"), (-x["minus"]).alias("points")))


def nested_criteria(rows: Column) -> Column:
    """Criteria with their sub-criteria; a criterion's points are the sum of its parts if it has any."""
    tops = F.filter(rows, lambda x: ~x["code"].contains("."))

    def under(x: Column) -> Column:
        subs = F.filter(rows, lambda y: y["code"].startswith(F.concat(x["code"], F.lit("."))))
        total = F.aggregate(subs, F.lit(0), lambda t, y: t + y["points"])
        return F.struct(x["code"].alias("code"), x["name"].alias("name"), F.when(F.size(subs) > 0, total).otherwise(x["points"]).alias("points"), subs.alias("parts"))

    return F.transform(tops, under)


def points(text: Column, part: str, least: int) -> Column:
    """Most points of the technical or economic part: stated behind it or before it, as a score, or alone at a line's end; the first from `least` to 100, form by form."""
    offer = rf"offerta\s+{part}"
    most = r"(?:max\.?\s*|massimo\s+|fino\s+a\s+)?(?:punti\s+)?"
    forms = [
        rf"{offer}\s*[:=(]?\s*{most}(\d{{1,3}})\s*(?:punti\b|pt\b|/\s*100|\))",
        rf"(\d{{1,3}})\s*punt[io]\s*(?:[-–]\s*|(?:per|alla)\s+)?(?:l['’]\s*)?{offer}",
        rf"punteggio\s+(?:massimo\s+)?(?:per\s+)?(?:dell['’]\s*|l['’]\s*)?{offer}\s*[:=]?\s*(\d{{1,3}})\b",
        rf"{offer}\s*[:=]?\s*(\d{{1,3}})[ \t]*(?:\n|$)",
    ]
    hits = lambda p: F.transform(F.regexp_extract_all(text, F.lit(f"(?iumd){p}"), 1), lambda x: x.cast("int"))
    return F.coalesce(*[F.get(F.filter(hits(p), lambda v: v.between(least, 100)), F.lit(0)) for p in forms])


def scoring(text: Column) -> dict[str, Column]:
    """Most points of each part, threshold, rescaling, formula, decimals, anomaly check."""
    return {
        "technical": points(text, "tecnica", 5),
        "economic": points(text, "economica", 1),
        "threshold": S.first_match(text, [r"soglia\s+(?:minima\s+)?di\s+sbarramento[^\d\n]{0,60}(\d{1,3})"]).cast("int"),
        "rescaled": has(text, r"riparametr"),
        "formula": first_label(text, {"lineare": r"formula\s+(?:\w+\s+)?lineare|interpolazione\s+lineare", "bilineare": r"bilineare", "quadratica": r"quadratica"}),
        "decimals": S.first_match(text, [r"\b(\w+)\s+(?:cifre\s+)?decimali"], lambda x: S.number_word(x)),
        "anomaly_check": has(text, r"anomal[ie]"),
        "offer_mode": first_label(text, {"ribasso": r"ribasso\s+(?:unico\s+)?percentuale", "prezzi unitari": r"prezzi\s+unitari", "rialzo": r"\brialzo\b"}),
    }


# The part on the envelope: from its heading, or the words that announce its contents, to the next numbered or other envelope's heading.
_ENVELOPE = r"(?:contenuto\s+della\s+busta|busta\s+tecnica[^:\n]*(?:deve\s+contenere|conterr[aà]|contiene)|^[ \t*#]*(?:\d+(?:\.\d+)*[.)]?[ \t]+)?(?:contenuto\s+della\s+)?(?:busta|offerta)\s+tecnica[ \t*]*$)"
_ENVELOPE_ENDS = r"[ \t*#]*(?:\d+\.\d*[.)]?[ \t]+\p{Lu}{3}|(?-i:BUSTA|OFFERTA)[ \t]+(?-i:ECONOMICA|AMMINISTRATIVA))"
# What an item's next line isn't: another item, or one of the sentences that follow a list.
_NO_ITEM = r"\s*(?:[a-z]\)\s|N\.B\.|L.\s*Offerta|La\s|Il\s|Si\s|\n|\z)"


def envelope(text: Column) -> Column:
    """Lettered items of the first part on the technical envelope, an item's lines joined; none without such a part."""
    part = F.regexp_extract(text, rf"(?iumd){_ENVELOPE}([^\n]*+(?:\n(?!{_ENVELOPE_ENDS})[^\n]*+)*+)", 1)
    return F.transform(lettered_items(F.regexp_replace(part, rf"(?<![.;:])[ \t]*\n(?!{_NO_ITEM})\s*", " ")), lambda x: S.clean_string(x["item"]))


def offer_notes(text: Column) -> Column:
    """Whole sentences on the technical offer: the same for both lots, least features, no prices in it, questions of the board."""
    gap = r"[\s*]+"
    # Each form with a word that it holds: a text without it isn't searched.
    forms = {
        "identica": rf"((?:offerta{gap}tecnica{gap}(?:deve{gap}essere{gap})?)?identica{gap}per{gap}entrambi{gap}i{gap}lotti[^.]*\.\s*(?:In{gap}caso{gap}di{gap}difformit(?:[^.]|\.\s*(?=\d))*\.)?)",
        "caratteristiche": rf"(L.offerta{gap}tecnica{gap}deve{gap}rispettare{gap}le{gap}caratteristiche{gap}minime[^.]*\.)",
        "pena": rf"(L.offerta{gap}tecnica[^.]*?a{gap}pena{gap}di{gap}esclusione[^.]*?economic[^.]*\.)",
        "chiarimenti": rf"(la{gap}commissione{gap}giudicatrice[^.]*?chiarimenti[^.]*\.)",
    }
    found = lambda low: F.array(*[F.when(F.contains(low, F.lit(w)), F.regexp_replace(S.first_match(text, [p]), r"\*{2,}", "")) for w, p in forms.items()])
    return F.filter(S.let(F.lower(text), found), lambda x: x.isNotNull())


def offer_format(text: Column) -> dict[str, Column]:
    """Pages, sheet, font, spacing of the technical report; what doesn't count, by kinds and in the text's words; contents of the technical envelope as items; notes on the offer."""
    return {
        "pages": S.first_match(text, [r"(?:massimo|max\.?|fino\s+a|non\s+(?:pi[uù]\s+di|oltre)|superiore\s+a|superare(?:\s+complessivamente)?)\s+(?:(?:di|le|n\.)\s*)?(\d{1,3})\s+(?:\([^)\n]*\)\s*)?(?:pagin|facciat|cartell)", r"\b(\d{1,3})\s*(?:\([^)\n]*\)\s*)?(?:pagine\s*)?\(?\s*facciate"]).cast("int"),
        "sheet": F.upper(S.first_match(text, [r"formato\s+(A[34])\b"])),
        "font": S.first_match(text, [r"(?:carattere|font)\s+([A-Z][a-z]+(?:\s+New\s+Roman)?)\b"]),
        "font_size": S.first_match(text, [r"(?:carattere|font)\s+[A-Za-z ]{3,30}?\s*(?:dimensione\s+)?(\d{1,2})\b"]).cast("int"),
        "spacing": S.first_match(text, [r"interlinea\s+(\d(?:[.,]\d)?)"], lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")),
        "without": labels(text, {"copertina": r"esclus[aoei][^\n.]{0,40}copertin", "indice": r"esclus[aoei][^\n.]{0,60}indice", "curricula": r"esclus[aoei][^\n.]{0,80}curricul"}),
        "not_counted": F.when(F.contains(F.lower(text), F.lit("conteggio")), S.first_match(text, [r"(?:non\s+rientrano|esclus[aoei]|eccetto)[^.]{0,30}conteggio[^.]*"])),
        "contents": envelope(text),
        "offer_notes": offer_notes(text),
    }


def lettered_items(text: Column) -> Column:
    """Items a) ... b) ... of more than five characters: letter and text."""
    parts = F.regexp_extract_all(text, F.lit(r"(?ms)(?:^|[;:,.]\s+|\n)([a-z]\)\s+(?:(?![;,]\s+[a-z]\)\s)[^\n])*)"), 1)
    items = F.transform(parts, lambda x: F.struct(F.substring(x, 1, 1).alias("letter"), F.regexp_replace(F.trim(F.substr(x, F.lit(3))), r"[;,.\s]+$", "").alias("item")))
    return F.filter(items, lambda x: F.length(x["item"]) > 5)


def administration(text: Column) -> dict[str, Column]:
    """Authority fee, stamp duty, DGUE, number of numbered documents (15 at most), remedial term of 1 to 30 days, exclusion and self-cleaning."""
    listed = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d{1,2})[.)]\s+\S"), 1), lambda x: x.cast("int"))
    term = S.first_match(text, [r"soccorso\s+istruttorio[^\n]{0,160}?(\d{1,3})\s+giorni"], lambda x: F.when(x.cast("int").between(1, 30), x)).cast("int")
    return {
        "authority_fee": money(text, r"contribut[oi][^\n€\d]{0,40}(?:ANAC|autorit[aà])[^\n€\d]{0,40}" + _EUR),
        "stamp_duty": has(text, r"(?:imposta\s+di|marca\s+da)\s+bollo"),
        "dgue": has(text, r"\bDGUE\b"),
        "n_documents": F.array_max(F.filter(listed, lambda x: x <= 15)),
        "remedial": has(text, r"soccorso\s+istruttorio"),
        "remedial_days": term,
        "exclusion": has(text, r"(?:cause|motivi)\s+di\s+esclusione"),
        "self_cleaning": has(text, r"self[\s\-]*cleaning"),
    }


def award(text: Column) -> dict[str, Column]:
    """How the contract is signed and how many lots one bidder may win."""
    return {
        "form": first_label(text, {"atto pubblico": r"atto\s+pubblico", "forma pubblica amministrativa": r"forma\s+pubblica\s+amministrativa", "scrittura privata": r"scrittura\s+privata", "corrispondenza": r"corrispondenza"}),
        "standstill_days": S.first_match(text, [r"stand\s*still[^\n]{0,40}?(\d{1,3})\s+giorni"]).cast("int"),
    }


def clauses(text: Column) -> dict[str, Column]:
    """Penalties per mille, safety document, environmental criteria, court, arbitration, jury, conduct, traceability, PNRR conditions, board."""
    return {
        "penalty_per_mille": S.first_match(text, [r"penal[ei][^\n]{0,60}?(\d(?:[.,]\d+)?)\s*(?:per\s+mille|‰)"], lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")),
        "duvri": has(text, r"\bDUVRI\b"),
        "environmental": has(text, r"criteri\s+ambientali|\bCAM\b"),
        "court": S.first_match(text, [r"foro\s+(?:competente\s*(?:è|:)?\s*)?(?:quello\s+)?di\s+([^\n;,.]{3,40})"]),
        "arbitration": F.when(has(text, r"(?:esclus[oa]|non\s+è\s+previst[oa])[^\n.]{0,40}arbitra|arbitra[^\n.]{0,40}esclus"), F.lit(False)).otherwise(has(text, r"arbitra|compromissoria")),
        "jury": has(text, r"commissione\s+giudicatrice"),
        "conduct": has(text, r"codice\s+di\s+comportamento"),
        "traceability": has(text, r"tracciabilit"),
        "pnrr_conditions": labels(text, {"DNSH": r"\bDNSH\b", "pari opportunità": r"pari\s+opportunit", "giovani": r"occupazione\s+giovanile"}),
        "advisory_board": has(text, r"collegio\s+consultivo"),
    }


#: Fields that messages are about.
NOTED = ("base", "labour", "revision", "revision_percent", "offers_until", "questions_until", "threshold", "roles_together")


def notes(fields: dict[str, Column]) -> Column:
    """Messages for what a reader should look at, from extracted fields; only those whose condition holds."""
    def get(k):
        return fields.get(k, F.lit(None))

    messages = [
        (get("base").isNull(), F.lit("Importo a base di gara non trovato")),
        (get("labour").isNotNull(), F.concat(F.lit("Manodopera non ribassabile: "), S.format_amount(get("labour")))),
        (get("revision") == F.lit(False), F.lit("Prezzi fissi e invariabili")),
        (get("revision_percent").isNotNull(), F.concat(F.lit("Revisione prezzi oltre il "), get("revision_percent").cast("string"), F.lit("%"))),
        (get("offers_until").isNull(), F.lit("Scadenza offerte non trovata")),
        (get("questions_until") > get("offers_until"), F.lit("Chiarimenti dopo la scadenza")),
        (get("threshold").isNotNull(), F.concat(F.lit("Soglia di sbarramento: "), get("threshold").cast("string"), F.lit(" punti"))),
        (get("roles_together") == F.lit(False), F.lit("Ruoli non cumulabili")),
    ]
    return F.filter(F.array(*[F.when(c, m) for c, m in messages]), lambda x: x.isNotNull())


def methods_map(fields: dict[str, Column], method: str = "rules") -> Column:
    """Names of the fields with a value, each with the method that found it."""
    pairs = [F.struct(F.lit(k).alias("k"), F.when(~S.is_blank(v.cast("string")), F.lit(method)).alias("v")) for k, v in fields.items()]
    return F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: v.isNotNull())


def criteria_sum(rows: Column, technical: Column) -> Column:
    """pass if the criteria without a dot add up to the technical maximum within 1, warn if not, null without either."""
    total = F.aggregate(F.filter(rows, lambda x: ~x["code"].contains(".")), F.lit(0), lambda t, x: t + x["points"])
    return F.when((F.size(rows) == 0) | technical.isNull(), None).when(F.abs(total - technical) <= 1, "pass").otherwise("warn")


def code_formats(cup: Column, lot_rows: Column) -> Column:
    """Messages for codes that don't have their format: the CUP (12 characters or more), and the CIG of each lot."""
    wrong = F.filter(lot_rows, lambda x: x["cig"].isNotNull() & ~F.upper(x["cig"]).rlike("^[A-Z0-9]{10}$"))
    lots_ = F.transform(wrong, lambda x: F.concat(F.lit("CIG lotto "), x["lot"].cast("string")))
    return F.concat(F.filter(F.array(F.when(cup.isNotNull() & ~F.regexp_replace(F.upper(cup), r"\s", "").rlike(r"^[A-Z]\d{2}[A-Z]\d{8,}$"), F.lit("CUP"))), lambda x: x.isNotNull()), lots_)


def matches_with_context(text: Column, pattern: str, around: int = 50, most: int = 5) -> Column:
    """Hits of a pattern without groups: value, 1-based place, text around; the first `most`."""
    # Hits and the lengths between them are bound once; mentioned inside transform() they would be searched for anew for every hit.
    found = F.struct(F.slice(F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), 0), 1, most).alias("hits"), F.transform(F.slice(F.split(text, f"(?iu){pattern}", most + 1), 1, most), lambda x: F.length(x)).alias("gaps"))
    none = F.array().cast("array<struct<value:string,at:int,context:string>>")

    def rows(f: Column) -> Column:
        def place(i: Column) -> Column:
            sizes = F.concat(F.slice(f["gaps"], 1, i + 1), F.transform(F.slice(f["hits"], 1, i), lambda x: F.length(x)))
            return F.aggregate(sizes, F.lit(1), lambda t, x: t + x)

        def hit(value: Column, i: Column) -> Column:
            return S.let(place(i), lambda at: F.struct(value.alias("value"), at.alias("at"), F.substring(text, F.greatest(F.lit(1), at - around), F.length(value) + around + F.least(at - 1, F.lit(around))).alias("context")))

        return F.transform(f["hits"], hit)

    return F.coalesce(S.let(found, rows), none)


# Words that lead to the section of a field, best first.
FIELD_WORDS = {"offers_until": ["scadenza", "termine"], "base": ["base di gara", "importo"], "roles": ["gruppo di lavoro", "figure professionali"], "criteria": ["criteri di valutazione", "punteggi"]}


def field_section(text: Column, field: str, before: int = 200, size: int = 2000) -> Column:
    """The window from 200 characters before the first of a field's words that occurs; null without one."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.instr(low, F.lit(w)), F.lit(0)) for w in FIELD_WORDS[field]])
    return F.when(at.isNotNull(), F.substring(text, F.greatest(F.lit(1), at - before), F.lit(size)))


def meaningful_prefix(prefix: Column, most: int = 120) -> Column:
    """What stands after the last structural mark (line end, full stop, semicolon) of a prefix, its last `most` characters."""
    tail = F.regexp_extract(prefix, r"(?s)^(?:.*(?:\n|[.;]\s))?(.*)$", 1)
    return F.right(F.when(F.trim(tail) == "", prefix).otherwise(tail), F.lit(most))


def meaningful_suffix(suffix: Column, most: int = 120) -> Column:
    """What stands before the first end mark of a suffix, its first `most` characters."""
    return F.substring(F.regexp_extract(suffix, r"(?s)^(.*?)(?:\n|[.;](?:\s|$)|$)", 1), 1, most)


def richer(plain: Column, markdown: Column) -> Column:
    """The longer of two renderings of a document."""
    return F.when(F.coalesce(F.length(markdown), F.lit(0)) > F.coalesce(F.length(plain), F.lit(0)), markdown).otherwise(plain)


_CODE = r"(?:IA|[ESDV])\.?\d{2}"
# Words that begin the name of a kind of works.
WORKS = "EDILIZIA|IMPIANTI|STRUTTUR|IDRAULIC|VIABILIT|INFRASTRUTTUR"


def required_categories(text: Column) -> Column:
    """Categories for which references are asked: code, amount, grade (complexity), description and the layout they were found in.

    From sentences; else from pipe tables that name a CATEGORIA, those about designed works before others, where a cell is an amount if above 10 000 and a
    grade if below 10; else from lines that hold a code alone, whose next four lines, up to a total, hold an amount above 100 or a grade. Of each code the first."""
    kind = "array<struct<code:string,amount:decimal(18,2),grade:double,description:string,layout:string>>"
    none = F.array().cast(kind)
    row = lambda code, amount, grade, words, layout: F.struct(S.category_code(code).alias("code"), amount.cast("decimal(18,2)").alias("amount"), grade.cast("double").alias("grade"), F.nullif(F.substring(words, 1, 200), F.lit("")).alias("description"), F.lit(layout).alias("layout"))
    nothing = F.lit(None).cast("string")

    said = F.regexp_extract_all(text, F.lit(rf"(?iu)(?:categori\w+|class\w+)\s+({_CODE}[^.\d][^.]{{0,100}}?(?:import\w+[^€\d]{{0,30}}€?\s*\d[\d.,]*\d|class\w+\s+\w+))"), 1)
    amount_in = lambda x: S.parse_amount(F.nullif(F.regexp_extract(x, r"(?i)import\w+[^€\d]{0,30}€?\s*(\d[\d.,]*\d)", 1), F.lit("")), dot3_thousands=True)
    inline = F.transform(said, lambda x: row(F.regexp_extract(x, rf"(?i)^({_CODE})", 1), amount_in(x), nothing, nothing, "sentence"))

    number = lambda c: F.when(c.rlike(r"(?i)^(?:euro\s+)?€?\s*[\d.,]+(?:\s*€)?$"), S.parse_amount(F.regexp_replace(c, r"(?i)euro|€", ""), dot3_thousands=True))

    def table(block: Column) -> Column:
        rows = F.transform(F.split(block, "\n"), lambda r: F.transform(F.split(r, r"\|"), lambda c: F.trim(c)))
        coded = F.filter(rows, lambda cells: F.exists(cells, lambda c: c.rlike(f"^{_CODE}$")))

        def entries(cells: Column) -> Column:
            values = F.filter(F.transform(cells, number), lambda v: v.isNotNull())
            words = F.filter(cells, lambda c: (F.length(c) > 10) & number(c).isNull())
            at = lambda test: F.get(F.filter(values, test), F.lit(0))
            return F.transform(F.filter(cells, lambda c: c.rlike(f"^{_CODE}$")), lambda c: row(c, at(lambda v: v > 10_000), at(lambda v: v < 10), F.array_join(words, " "), "table"))

        return F.flatten(F.transform(coded, entries))

    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)\[TABELLA[^\]]*\]\n(.*?)(?=\n\n|\n---|\n\[TABELLA|\z)"), 1), lambda b: F.upper(b).contains("CATEGORIA"))
    works = lambda b: b.contains("Importo complessivo") | b.contains("lavori progettati")
    tables = lambda bs: F.flatten(F.transform(bs, table)).cast(kind)
    from_tables = S.let(blocks, lambda bs: S.let(tables(F.filter(bs, works)), lambda first: F.when(F.size(first) > 0, first).otherwise(tables(F.filter(bs, lambda b: ~works(b))))))

    mark = F.regexp_instr(text, F.lit(r"(?i)importo\s+complessivo\s+dei\s+lavori\s+progettati|max\s+di\s+n\.\s*\d+\s+servizi|requisiti\s+di\s+capacit[^\n]*tecnica"))
    lines_ = F.transform(F.split(F.substring(text, mark, F.lit(5000)), "\n"), lambda x: F.trim(F.replace(x, F.lit("*"), F.lit(""))))

    def bold(ls: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            ahead = F.slice(ls, i + 2, 4)
            total = F.array_position(F.transform(ahead, lambda a: F.upper(a).contains("TOTALE")), F.lit(True)).cast("int")
            values = F.filter(F.transform(F.when(total > 0, F.slice(ahead, F.lit(1), total - 1)).otherwise(ahead), number), lambda v: v.isNotNull())
            back = F.slice(ls, F.greatest(F.lit(1), i - 3), F.least(i, F.lit(4)))
            heads = F.transform(back, lambda b, j: F.when(b.rlike(f"(?i)^(?:{WORKS})"), j))
            words = F.when(i > 0, F.array_join(F.filter(back, lambda b, j: (j >= F.array_max(heads)) & (F.length(b) > 5) & number(b).isNull()), " "))
            return F.when(x.rlike(f"^{_CODE}$"), row(x, F.get(F.filter(values, lambda v: v > 100), F.lit(0)), F.get(F.filter(values, lambda v: v < 10), F.lit(0)), words, "lines"))

        return F.filter(F.transform(ls, entry), lambda e: e.isNotNull()).cast(kind)

    from_lines = F.when(mark > 0, S.let(lines_, bold)).otherwise(none)
    found = F.coalesce(*[S.let(c, lambda x: F.when(F.size(x) > 0, x)) for c in (inline.cast(kind), from_tables, from_lines)], none)
    fresh = lambda acc, x: F.when(F.exists(acc, lambda a: a["code"] == x["code"]), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(found, none, fresh)
