"""Building and checking the record of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import is_blank

#: Fields without which a record counts as incomplete.
CRITICAL = ["oggetto_appalto", "stazione_appaltante", "importo_totale", "cig", "scadenza_offerte"]


def procedure_label(text: Column) -> Column:
    """Label of the procedure, first rule that holds."""
    has = lambda p: text.rlike(f"(?iu){p}")
    return (
        F.when(has(r"procedura\s+aperta"), "Procedura aperta").when(has(r"procedura\s+negoziata"), "Procedura negoziata").when(has(r"procedura\s+ristretta"), "Procedura ristretta")
        .when(has(r"dialogo\s+competitivo"), "Dialogo competitivo").when(has(r"affidamento\s+diretto"), "Affidamento diretto")
    )


def criterion_label(text: Column) -> Column:
    has = lambda p: text.rlike(f"(?iu){p}")
    return F.when(has(r"economicamente\s+pi[uù]\s+vantaggiosa|\bOEPV\b|qualit[aà]\s*/\s*prezzo"), "OEPV").when(has(r"minor\s+prezzo|prezzo\s+pi[uù]\s+basso"), "Minor prezzo")


def merged_label(procedure: Column, criterion: Column) -> Column:
    """The criterion appended to the procedure unless that names it already."""
    return F.when(criterion.isNull() | F.lower(procedure).contains(F.lower(criterion)), procedure).otherwise(F.concat_ws(" - ", procedure, criterion))


def clause_flags(text: Column) -> dict[str, Column]:
    has = lambda p: text.rlike(f"(?iud){p}")
    return {
        "provisional_guarantee": has(r"garanzia\s+provvisoria") & ~has(r"garanzia\s+provvisoria\s+non\s+è\s+dovuta"),
        "site_visit": has(r"sopralluogo\s+è\s+obbligatorio"),
        "subcontracting": has(r"subappalto\s+è\s+ammesso") & ~has(r"subappalto\s+non\s+è\s+ammesso"),
        "pnrr": has(r"\bPNRR\b"),
    }


def checks(wide: DataFrame, lots: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """doc_id, check, status (pass, warn, fail): scores, their ranges, lots against the total, total, completeness."""
    sums = lots.groupBy("doc_id").agg(F.sum("amount").alias("__lots"))
    full = wide.join(sums.hint("shuffle_merge"), "doc_id", "left")
    tech, econ, total = F.col("punteggio_tecnica").try_cast("int"), F.col("punteggio_economica").try_cast("int"), F.col("importo_totale").try_cast("decimal(18,2)")
    missing = F.filter(F.array(*[F.when(is_blank(c), F.lit(c)) for c in CRITICAL]), lambda x: x.isNotNull())
    n, held = len(CRITICAL), len(CRITICAL) - F.size(missing)
    state = lambda ok, known: F.when(~known, "warn").when(ok, "pass").otherwise("fail")
    rows = {
        "score_sum": state(F.abs(tech + econ - 100) <= 1, tech.isNotNull() & econ.isNotNull()),
        "score_range": state(tech.between(0, 100) & econ.between(0, 100), tech.isNotNull() & econ.isNotNull()),
        "lot_sum": state(F.abs(F.col("__lots") - total) <= total * tolerance, F.col("__lots").isNotNull() & total.isNotNull()),
        "total_positive": state(total > 0, total.isNotNull()),
        "complete": F.when(held == n, "pass").when(held >= 0.6 * n, "warn").otherwise("fail"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in rows.items()])
    return full.select("doc_id", F.inline(entries))


def coherence(wide: DataFrame, lots: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Counts by status, and the score 1 - 0.1 for each failure."""
    table = checks(wide, lots, tolerance).groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).cast("int").alias(f"n_{s}") for s in ("pass", "warn", "fail")])
    return table.withColumn("score", F.greatest(F.lit(0.0), F.round(1 - 0.1 * F.col("n_fail"), 1)))


def build(wide: DataFrame, lots: DataFrame) -> DataFrame:
    """doc_id, nested record, confidence (share of filled fields) and score (filled fields and structure)."""
    by_doc = lots.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lot", "cig", "amount"))).alias("lotti"))
    return build_rows(wide.join(by_doc.hint("shuffle_merge"), "doc_id", "left"))


def build_rows(full: DataFrame) -> DataFrame:
    """build() of fields whose lots stand beside them: lotti, an array of structs (lot, cig, amount) in order."""
    lotti = F.coalesce("lotti", F.array().cast("array<struct<lot:int,cig:string,amount:decimal(18,2)>>"))
    names = F.map_from_entries(F.transform(lotti, lambda x: F.struct(F.concat(F.lit("lotto_"), x["lot"].cast("string")), x["cig"])))
    fields = [c for c in full.columns if c not in ("doc_id", "lotti")]
    filled = sum((F.when(is_blank(c), 0).otherwise(1) for c in fields), F.lit(0))
    nested = F.struct(
        F.struct("cig", "cup", "cpv").alias("identificativi"),
        F.struct(F.col("stazione_appaltante").alias("stazione"), F.col("oggetto_appalto").alias("oggetto")).alias("soggetti"),
        F.struct(F.col("importo_totale").cast("decimal(18,2)").alias("totale")).alias("importi"),
        F.struct(F.col("punteggio_tecnica").cast("int").alias("tecnica"), F.col("punteggio_economica").cast("int").alias("economica")).alias("punteggi"),
        F.struct(F.col("scadenza_offerte").alias("scadenza"), F.col("durata_mesi").cast("int").alias("mesi")).alias("tempistiche"),
        lotti.alias("lotti"),
        names.alias("cig_lotti"),
    )
    score = filled.cast("double") + 0.3 * F.size(lotti)
    return full.select("doc_id", nested.alias("record"), F.round(100.0 * filled / len(fields), 1).alias("confidence"), F.round(score, 2).alias("score"))


def flatten(nested: DataFrame, col: str = "record") -> DataFrame:
    """doc_id, path, value of every scalar leaf that isn't blank; paths follow the schema."""
    def leaves(schema, path):
        for f in schema.fields:
            here = f"{path}.{f.name}"
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, here)
            elif f.dataType.typeName() not in ("array", "map"):
                yield here

    paths = list(leaves(nested.schema[col].dataType, col))
    entries = F.array(*[F.struct(F.lit(p.split(".", 1)[1]).alias("path"), F.col(p).cast("string").alias("value")) for p in paths])
    return nested.select("doc_id", F.inline(entries)).where(~is_blank("value"))


def weak_fields(extractions: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that are blank or below a confidence."""
    return extractions.where(is_blank("value") | (F.coalesce("confidence", F.lit(0.0)) < least))
