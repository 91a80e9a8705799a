"""Adaptive enhancement: blank fields filled from generated rules and from where similar documents had their values; checks of values and of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import scalars as S
from docloom.operators import analytics as A
from docloom.operators import corrections as C
from docloom.operators import learning as L
from docloom.shared import lookup, stored

#: What a similar document's candidate keeps of its confidence; strategies and rules of a field that are tried; least confidence of a rule.
SIMILAR_SHARE, MOST_STRATEGIES, MOST_RULES, LEAST_RULE = 0.8, 2, 10, 0.6


def value_after(text: Column, prefix: Column, near: int = 300, reach: int = 500) -> Column:
    """The value that follows, in this text, the words that stood before a value in another one.

    The last three words of the prefix with more than four letters are looked up: the first one's first place, the others within `near` characters from
    there. The value begins after the first colon or dash within `reach` characters behind the first word and ends with its line, if a blank line, a line in capitals or,
    for a line that ends in a full stop, any line follows. Null if something isn't found, or for values up to 2 or from 500 characters.
    """
    low = F.lower(text)
    words = F.filter(F.split(F.lower(prefix), r"(?U)\s+"), lambda w: F.length(w) > 4)
    last = F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3)
    # A fold over the words: the place of the first, or 0 once one is missing.
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("first"))

    def step(s: Column, w: Column) -> Column:
        found = F.when(s["first"], F.instr(low, w)).when((s["at"] > 0) & F.substring(low, s["at"], F.lit(near)).contains(w), s["at"]).otherwise(0)
        return F.struct(found.alias("at"), F.lit(False).alias("first"))

    at = F.aggregate(last, start, step, lambda s: s["at"])

    def read(at: Column) -> Column:
        after = F.substring(text, at + F.length(F.get(last, F.lit(0))), F.lit(reach))
        hit = F.trim(F.regexp_extract(after, r"[:\-–]\s*([^\n]+?)(?:\n\n|\n(?=[A-Z]{2})|\.[ \t]*\n)", 1))
        return F.when((at > 0) & (F.length(hit) > 2) & (F.length(hit) < 500), S.clean_string(hit))

    return S.let(at, read)


def memory_rows(extractions: DataFrame, docs: DataFrame) -> DataFrame:
    """What a memory keeps of extractions(doc_id, field, value, method): scalar values that aren't blank, where they stand, with the weight of their method as confidence (0.5 for an unknown one)."""
    scalar = ~S.is_blank("value") & ~F.col("value").rlike(r"^\s*[\[{]")
    weights = F.create_map(*[F.lit(x) for kv in A.METHOD_WEIGHTS.items() for x in kv])
    kept = extractions.where(scalar).withColumn("confidence", F.coalesce(F.try_element_at(weights, F.col("method")), F.lit(0.5)))
    return L.contexts(docs, kept.select("doc_id", "field", "value", "method", "confidence")).withColumn("was_correct", F.lit(True))


def strategies(blanks: DataFrame, similar: DataFrame, memory: DataFrame, most: int = MOST_STRATEGIES) -> DataFrame:
    """doc_id, strategies: for each blank field the contexts in which at most `most` similar documents had a right value, the most confident first.

    blanks(doc_id, field), similar(doc_id, other, score), memory(doc_id, field, prefix, confidence, was_correct)."""
    known = memory.where("was_correct and prefix is not null").select(F.col("doc_id").alias("other"), "field", "prefix", "confidence")
    asked = blanks.select("doc_id", "field").join(similar.select("doc_id", "other", "score").hint("shuffle_merge"), "doc_id")
    offered = asked.join(known.hint("shuffle_merge"), ["other", "field"])
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), F.desc("score"), "other", "prefix")
    best = offered.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    entry = F.struct("field", "r", "prefix", (F.col("confidence") * F.col("score")).alias("confidence"))
    return best.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("strategies"))


def usable_rules(rules: DataFrame, most: int = MOST_RULES, least: float = LEAST_RULE) -> list[tuple[str, str, float]]:
    """The best active rules of each field: at most `most` a field come to the driver, to become literals of one scan."""
    rows = C.last_of(rules.where(F.col("confidence") >= least), ["field"], [F.desc("confidence"), F.asc("pattern")], most)
    return [(r.field, r.pattern, float(r.confidence)) for r in rows.select("field", "pattern", "confidence").orderBy("field", F.desc("confidence"), "pattern").collect()]


def enhance(docs: DataFrame, extractions: DataFrame, rules: DataFrame, similar: DataFrame, memory: DataFrame) -> DataFrame:
    """extractions(doc_id, field, value, method) with blank values filled: from rules(field, pattern, confidence); a field that no rule fills, from
    similar documents' contexts; of several candidates the vote's. The method names the source and its confidence. Values that aren't blank stay as they are."""
    blanks = extractions.where(S.is_blank("value")).select("doc_id", "field").distinct()
    fields = blanks.groupBy("doc_id").agg(F.collect_set("field").alias("fields"))
    # A document's text meets its blank fields and strategies once, in one row.
    rows = docs.select("doc_id", "text").join(fields.hint("shuffle_merge"), "doc_id").join(strategies(blanks, similar, memory).hint("shuffle_merge"), "doc_id", "left")
    kind = "array<struct<field:string,value:string,confidence:double,method:string>>"
    tries = [F.struct(F.lit(f).alias("field"), F.when(F.array_contains("fields", F.lit(f)), C.apply_rule(F.col("text"), p)).alias("value"), F.lit(c).alias("confidence"), F.lit("auto_rule").alias("method")) for f, p, c in usable_rules(rules)]
    by_rule = F.filter(F.array(*tries).cast(kind), lambda x: x["value"].isNotNull())
    staged = rows.withColumn("by_rule", by_rule)
    open_ones = F.filter(F.coalesce("strategies", F.array().cast("array<struct<field:string,r:int,prefix:string,confidence:double>>")), lambda s: ~F.exists("by_rule", lambda x: x["field"] == s["field"]))
    by_similar = F.transform(open_ones, lambda s: F.struct(s["field"].alias("field"), value_after(F.col("text"), s["prefix"]).alias("value"), (s["confidence"] * SIMILAR_SHARE).alias("confidence"), F.lit("similar_doc").alias("method")))
    found = staged.select("doc_id", F.inline(F.concat("by_rule", F.filter(by_similar, lambda x: x["value"].isNotNull()).cast(kind))))
    best = A.vote(found)
    named = best.select("doc_id", "field", F.col("value").alias("__v"), F.format_string("%s(%.0f%%)", "method", F.col("confidence") * 100).alias("__m"))
    both = extractions.join(named.hint("shuffle_merge"), ["doc_id", "field"], "left")
    fill = S.is_blank("value") & F.col("__v").isNotNull()
    return both.withColumns({"method": F.when(fill, F.col("__m")).otherwise(F.col("method")), "value": F.when(fill, F.col("__v")).otherwise(F.col("value"))}).select(*extractions.columns)


def value_profiles(memory: DataFrame, top: int = 20) -> DataFrame:
    """What values of a field look like: n, mean and deviation of those that are numbers, mean length, and its `top` values with their numbers."""
    number = S.parse_numeric("value")
    base = memory.groupBy("field").agg(F.count("*").alias("n"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"), F.avg(F.length("value")).alias("mean_length"))
    order = Window.partitionBy("field").orderBy(F.desc("k"), "value")
    often = memory.groupBy("field", "value").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    return base.join(often.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("value", "k"))).alias("common")).hint("shuffle_merge"), "field", "left")


def checked(values: DataFrame, profiles: DataFrame, sigma: float = 2.5) -> DataFrame:
    """values(field, value, ...) with anomalies (numeric, length), is_valid and confidence; values themselves stay as they are.

    A number is anomalous from more than sigma deviations on, if the field has five values; a text if it is more than 5 times or less than a tenth as
    long as the field's values are on average. Fields with under three values aren't judged. A value that is frequent gains confidence.
    """
    p = profiles.select("field", F.struct("n", "mean", "std", "mean_length", "common").alias("p"))
    # Few fields hold all values, so these stay where they are.
    both = lookup(values, stored(p), "field", F.struct(*values.columns), "left")
    z = F.when((F.col("p.n") >= 5) & (F.col("p.std") > 0), F.abs(S.parse_numeric("value") - F.col("p.mean")) / F.col("p.std"))
    share = F.length("value") / F.col("p.mean_length")
    known = (F.col("p.n") >= 3) & F.col("value").isNotNull()
    far, odd = F.coalesce(known & (z > sigma), F.lit(False)), F.coalesce(known & (F.col("p.mean_length") > 0) & (F.length("value") > 0) & ((share > 5) | (share < 0.1)), F.lit(False))
    often = F.try_element_at("p.common", F.col("value")) / F.aggregate(F.map_values("p.common"), F.lit(0).cast("long"), lambda a, b: a + b)
    base = F.when(far, F.greatest(F.lit(0.1), 1 - z / 10)).when(odd, 0.3).otherwise(0.5)
    sure = F.when(known & often.isNotNull(), F.greatest(base, F.least(F.lit(0.75), 0.5 + 0.2 * often))).otherwise(base)
    found = F.filter(F.array(F.when(far, "numeric"), F.when(odd, "length")), lambda x: x.isNotNull())
    return both.select(*values.columns, found.alias("anomalies"), (F.size(found) == 0).alias("is_valid"), F.round(sure, 6).alias("confidence"))


def _leaf_errors(raw: Column, kind: T.DataType, path: Column, required: bool) -> Column:
    """Errors of one value, its JSON text given (null if absent): an array of "path: message"."""
    none = F.array().cast("array<string>")
    absent = F.array(F.concat(path, F.lit(": field required"))) if required else none
    if isinstance(kind, T.StructType):
        is_object = F.ltrim(raw).startswith("{")
        inner = F.concat(*[_leaf_errors(F.get_json_object(raw, f"$.{f.name}"), f.dataType, F.concat(path, F.lit(f".{f.name}")), not f.nullable) for f in kind])
        return F.when(raw.isNull(), absent).when(is_object, inner).otherwise(F.array(F.concat(path, F.lit(": not an object"))))
    if isinstance(kind, T.ArrayType):
        items = F.from_json(raw, "array<string>")
        each = F.flatten(F.transform(items, lambda v, i: _leaf_errors(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), not kind.containsNull)))
        return F.when(raw.isNull(), absent).when(F.ltrim(raw).startswith("["), each).otherwise(F.array(F.concat(path, F.lit(": not a list"))))
    wrong = F.array(F.concat(path, F.lit(f": not of type {kind.simpleString()}")))
    fits = F.lit(True) if isinstance(kind, T.StringType) else raw.try_cast(kind).isNotNull()
    return F.when(raw.isNull(), absent).when(fits, none).otherwise(wrong)


def conform(df: DataFrame, raw_col: str, schema: T.StructType) -> DataFrame:
    """df with record (the JSON text in raw_col by the schema), errors (by path: missing where not nullable, not of the type, not an object or list)
    and conforms. A text that is no JSON object has one error and no record; otherwise fields that don't fit are null in the record and the text
    remains to fall back on. Keys that begin with an underscore, and others that the schema lacks, are ignored."""
    lenient = T.StructType([*[T.StructField(f.name, _nullable(f.dataType)) for f in schema], T.StructField("_corrupt", T.StringType())])
    raw = F.col(raw_col)
    parsed = df.withColumn("__r", F.from_json(raw, lenient, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    # Fields that don't fit also count as corrupt for the parser; only texts that aren't objects are refused as a whole.
    broken = F.json_object_keys(raw).isNull()
    inner = F.concat(*[_leaf_errors(F.get_json_object(raw, f"$.{f.name}"), f.dataType, F.lit(f.name), not f.nullable) for f in schema])
    errors = F.when(broken, F.array(F.lit("$: not a JSON object"))).otherwise(inner)
    record = F.when(~broken, F.struct(*[F.col(f"__r.{f.name}").alias(f.name) for f in schema]))
    return parsed.select(*df.columns, record.alias("record"), errors.alias("errors")).withColumn("conforms", F.size("errors") == 0)


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    return T.ArrayType(_nullable(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def summary_amounts(text: Column) -> Column:
    """Net amounts of an economic summary, one a line: in the 6000 characters around its heading, of each line with two amounts in euro or more the second to last,
    if above 50 000; totals are left out, and amounts within 1 euro of one before."""
    marks = r"(?i)QTE|quadro\s+tecnico\s+economico|importo\s+dei\s+lavori"
    at = F.regexp_instr(text, F.lit(marks))
    area = F.substring(text, F.greatest(F.lit(1), at - 200), F.lit(6200))
    body = F.filter(F.split(area, "\n"), lambda x: ~F.upper(F.ltrim(x)).startswith("TOTALE") & ~F.ltrim(x).startswith("[TABELLA"))
    amounts = lambda x: F.regexp_extract_all(x, F.lit(r"((?:\d{1,3}[ .])*\d{1,3}(?:[.,]\d{1,2})?|\d{4,}(?:[.,]\d{1,2})?)\s*€"), 1)
    net = F.transform(body, lambda x: S.let(amounts(x), lambda a: F.when(F.size(a) >= 2, S.parse_amount(F.replace(F.try_element_at(a, F.lit(-2)), F.lit(" "), F.lit("")), dot3_thousands=True))))
    kept = F.filter(net, lambda v: v > 50_000)
    new = F.aggregate(kept, F.array().cast("array<decimal(18,2)>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.abs(a - v) < 1), acc).otherwise(F.array_append(acc, v)))
    return F.when(at > 0, new).otherwise(F.array().cast("array<decimal(18,2)>"))


def lots_with_summary(lots: Column, text: Column) -> Column:
    """lots (array of struct number int, amount decimal), or those of the economic summary, if it has two at least and a lot's own amount is missing or at most 10 000."""
    kind = "array<struct<number:int,amount:decimal(18,2)>>"
    unsound = F.exists(lots, lambda x: F.coalesce(x["amount"] <= 10_000, F.lit(True)))
    return S.let(summary_amounts(text), lambda a: F.when((F.size(a) >= 2) & unsound, F.transform(a, lambda v, i: F.struct((i + 1).alias("number"), v.alias("amount"))).cast(kind)).otherwise(lots.cast(kind)))
