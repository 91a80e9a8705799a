"""Rules as data: ordered patterns by field, applied to a documents table in one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S


@dataclass(frozen=True)
class Rule:
    """A field, its category, type (text, money, number, boolean, list), ordered patterns and validator."""

    field: str
    category: str
    kind: str
    patterns: tuple[str, ...]
    validator: str = "text"
    low: float | None = None
    high: float | None = None


# Who buys: a label that names the role, then a separator or a new line, then the name on one line. A mere mention of the role in a sentence has neither.
_ROLE = r"(?:amministrazione\s+aggiudicatrice|(?:stazione|ente|amministrazione)\s+(?:appaltante|concedente)|soggetto\s+aggiudicatore|centrale\s+(?:unica\s+)?di\s+committenza|committente)"
_BODY_NAMED = rf"\b{_ROLE}[ \t]*(?:(?:[:/–—-]|\bè\b)\s*|\n\s*)(\S[^\n]{{4,119}})"
# The addressee of a letter, abbreviated or in full.
_ADDRESSEE = r"\bspett(?:abile|abili|\.[ \t]?(?:le|li|mo))[ \t,:]*\n?[ \t]*(\S[^\n]{4,99})"
# What is bought: after a label at the start of a line, after a title's label, inside a sentence, or as what a tender is held for.
_OF_WHAT = r"(?:[ \t]+(?:dell[’']\s?(?:appalto|affidamento|intervento)|del(?:la)?[ \t]+(?:gara|procedura|contratto|bando|fornitura|servizio)))"
_SUBJECT_LABELLED = rf"(?m)^[ \t]*(?:[\d.]+[ \t]+)?oggetto{_OF_WHAT}?[ \t]*(?:[:–—-][ \t]*\n?|\n)[ \t]*([^\s:–—-][^\n]{{9,499}})"
_SUBJECT_TITLED = rf"(?m)^[ \t]*(?:titolo|denominazione){_OF_WHAT}[ \t]*(?:[:–—-][ \t]*\n?|\n)[ \t]*([^\s:–—-][^\n]{{9,499}})"
_SUBJECT_IN_SENTENCE = r"\b(?:avente|aventi|ha|hanno)\s+(?:ad|per|come)\s+oggetto[ \t]*:?\s*([^\s:][^\n]{9,499})"
_SUBJECT_OF_TENDER = r"\b(?:gara|procedura|bando|appalto)\b[^\n.;]{0,80}?\bper\s+((?:l[’']\s?|la\s|il\s|i\s|lo\s)(?:affidamento|appalto|acquisto|acquisizione|fornitura|servizio|servizi|esecuzione|realizzazione|lavori)\b[^\n]{5,480})"

# The built-in fields and their patterns, in order.
BUILTIN = [
    Rule("cig", "Identificativi", "text", (r"(?:CIG|C\.I\.G\.?)[\s:]*([A-Z0-9]{10})\b",), "cig"),
    Rule("cup", "Identificativi", "text", (r"(?:CUP|C\.U\.P\.?)[\s:]*([A-Z]\d{2}[A-Z]\d{8})\b",), "cup"),
    Rule("cpv", "Identificativi", "text", (r"(?:CPV|C\.P\.V\.?)[\s:]*(\d{8}-\d)",), "cpv"),
    Rule("stazione_appaltante", "Soggetti", "text", (_BODY_NAMED, _ADDRESSEE)),
    Rule("oggetto_appalto", "Oggetto e Procedura", "text", (_SUBJECT_LABELLED, _SUBJECT_TITLED, _SUBJECT_IN_SENTENCE, _SUBJECT_OF_TENDER)),
    Rule("tipo_procedura", "Oggetto e Procedura", "text", (r"procedura\s+(aperta|negoziata|ristretta)",)),
    Rule("importo_totale", "Importi", "money", (r"importo\s+(?:complessivo|totale)[^€\n]{0,60}€[\s ]*([\d.,]+)", r"valore\s+stimato[^€\n]{0,60}€[\s ]*([\d.,]+)"), "importi", 100, None),
    Rule("punteggio_tecnica", "Punteggi", "number", (r"offerta\s+tecnica[\s:]*(\d{1,3})\s*punti",), "punteggi", 5, 100),
    Rule("punteggio_economica", "Punteggi", "number", (r"offerta\s+economica[\s:]*(\d{1,3})\s*punti",), "punteggi", 1, 100),
    Rule("scadenza_offerte", "Tempistiche", "text", (r"scadenza\s+(?:presentazione|ricezione)\s+offerte[\s:]*(\d{1,2}/\d{1,2}/\d{4}(?:\s+ore\s+\d{1,2}[:.]\d{2})?)",), "date"),
    Rule("durata_mesi", "Tempistiche", "number", (r"durata[^\n]{0,60}?(\d{1,3})\s+mesi",), "number", 1, 600),
    Rule("pnrr", "Flag", "boolean", (r"\bPNRR\b", r"Piano\s+Nazionale\s+di\s+Ripresa"), "boolean"),
    Rule("sopralluogo_obbligatorio", "Flag", "boolean", (r"sopralluogo\s+(?:è\s+)?obbligatorio",), "boolean"),
]

CATEGORIES = ["Identificativi", "Soggetti", "Oggetto e Procedura", "Importi", "Punteggi", "Tempistiche", "Flag"]


def sound(rule: Rule) -> Rule:
    """The rule if all its patterns compile; a pattern that doesn't is refused when rules are loaded."""
    for p in rule.patterns:
        re.compile(p)
    if not rule.patterns:
        raise ValueError(f"{rule.field} has no pattern")
    return rule


def with_custom(rules: list[Rule], custom: list[Rule]) -> list[Rule]:
    """Rules with custom fields added; keys are lower-cased with underscores, and a built-in key is refused."""
    known = {r.field for r in rules}
    out = list(rules)
    for r in custom:
        key = r.field.strip().lower().replace(" ", "_")
        if key in known:
            raise ValueError(f"{key} is a built-in field")
        out.append(sound(Rule(key, r.category, r.kind, r.patterns, r.validator, r.low, r.high)))
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row for each pattern."""
    rows = [(r.field, r.category, r.kind, k, p, r.validator) for r in rules for k, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, "field string, category string, kind string, priority int, pattern string, validator string")


def extracted(text: Column, rule: Rule) -> Column:
    """The value of one rule as text: typed, normalised, ranges checked pattern by pattern."""
    if rule.kind == "boolean":
        return F.when(text.rlike("(?iud)" + "|".join(f"(?:{p})" for p in rule.patterns)), "true")
    if rule.kind == "list":
        return F.array_join(S.all_matches(text, list(rule.patterns)), "; ")
    if rule.kind in ("money", "number"):
        number = S.parse_amount if rule.kind == "money" else (lambda c: F.regexp_replace(c, r"\D", "").try_cast("int"))
        low, high = (rule.low if rule.low is not None else -1e18), (rule.high if rule.high is not None else 1e18)
        return S.first_match(text, list(rule.patterns), lambda hit: S.let(number(hit), lambda v: F.when((v >= low) & (v <= high), v))).cast("string")
    return S.first_match(text, list(rule.patterns))


def apply_rules(docs: DataFrame, rules: list[Rule] = BUILTIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, field, value, method, snippet: one row for each field found in each document."""
    text = F.col(text_col)
    entries = [F.struct(F.lit(r.field).alias("field"), extracted(text, r).alias("value")) for r in rules]
    long = docs.select(id_col, text_col, F.explode(F.array(*entries)).alias("e")).where("e.value is not null and e.value <> ''")
    at = F.instr(text, F.col("e.value"))
    snippet = F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - 80), F.length("e.value") + 160))
    return long.select(id_col, "e.field", "e.value", F.lit("rules").alias("method"), snippet.alias("snippet"))


def wide(docs: DataFrame, rules: list[Rule] = BUILTIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and one column for each field; no shuffle."""
    return docs.select(id_col, *[extracted(F.col(text_col), r).alias(r.field) for r in rules])


def valid(value: Column, validator: Column) -> Column:
    """Whether a value fits its validator."""
    plain = F.regexp_replace(value, r"[€\s\x{a0}]", "")
    # Dots are thousands before a comma or in groups of three.
    dots = plain.contains(",") | plain.rlike(r"^\d{1,3}(?:\.\d{3})+$")
    number = F.regexp_replace(F.when(dots, F.regexp_replace(plain, r"\.", "")).otherwise(plain), ",", ".").try_cast("double")
    return (
        F.when(validator == "cig", value.rlike(r"^[A-Z0-9]{10}$"))
        .when(validator == "cup", value.rlike(r"^[A-Z][0-9]{2}[A-Z][0-9]{8}$"))
        .when(validator == "cpv", value.rlike(r"^\d{8}-\d$"))
        .when(validator == "nuts", value.rlike(r"(?i)^IT[A-Z0-9]{1,3}$"))
        .when(validator == "importi", F.coalesce((number > 0) & (number < 5e10), F.lit(False)))
        .when(validator == "punteggi", F.coalesce(value.try_cast("int").between(0, 100), F.lit(False)))
        .when(validator == "number", number.isNotNull())
        .when(validator == "date", value.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"))
        .when(validator == "boolean", F.lower(value).isin("true", "false"))
        .otherwise(F.length(F.trim(value)).between(3, 2000))
    )


def validate_fields(extractions: DataFrame, rules: list[Rule] = BUILTIN) -> DataFrame:
    """extractions with `valid`, by each field's validator."""
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.field, r.validator)])
    return extractions.withColumn("valid", valid(F.col("value"), F.coalesce(F.try_element_at(kinds, F.col("field")), F.lit("text"))))


def fields_by_category(spark: SparkSession, rules: list[Rule] = BUILTIN) -> DataFrame:
    order = F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORIES) for x in (c, k)])
    table = rules_table(spark, rules).select("field", "category").distinct()
    return table.groupBy("category").agg(F.sort_array(F.collect_list("field")).alias("fields"), F.min(F.coalesce(F.try_element_at(order, F.col("category")), F.lit(99))).alias("position"))
