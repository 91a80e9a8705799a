"""The learning loop as table changes: corrections, samples, generated rules, status. Every function gives the new rows or the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S

#: Characters of a value and of a snippet that logs keep.
VALUE_CHARS, SNIPPET_CHARS = 1000, 2000


def log_rows(extractions: DataFrame) -> DataFrame:
    """Extractions as log rows: values and snippets cut to what a log keeps."""
    return extractions.withColumns({"value": F.substring("value", 1, VALUE_CHARS), "snippet": F.substring("snippet", 1, SNIPPET_CHARS)})


def import_samples(samples: DataFrame, old: DataFrame) -> DataFrame:
    """samples and those of an older table that they don't hold yet, by field, value and the first 200 characters of the snippet."""
    key = lambda df: df.withColumn("__head", F.substring("snippet", 1, 200))
    new = key(old).dropDuplicates(["field", "value", "__head"]).join(key(samples).select("field", "value", "__head").hint("shuffle_merge"), ["field", "value", "__head"], "left_anti")
    return samples.unionByName(new.select(*samples.columns))


def snippet_for(text: Column, corrected: Column, original: Column) -> Column:
    """Text to learn a correction from: around the corrected value, else around the original one, else the first 1500 characters; null up to 20."""
    chosen = F.coalesce(F.nullif(S.value_context(text, corrected), F.lit("")), F.nullif(S.value_context(text, original), F.lit("")), F.substring(text, 1, 1500))
    return F.when(F.length(chosen) > 20, F.substring(chosen, 1, SNIPPET_CHARS))


def samples_of(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """New samples of corrections(doc_id, field, original, corrected): field, value, wrong, snippet."""
    both = corrections.join(docs.select("doc_id", "text").hint("shuffle_merge"), "doc_id")
    return both.select("field", F.col("corrected").alias("value"), F.col("original").alias("wrong"), snippet_for(F.col("text"), F.col("corrected"), F.col("original")).alias("snippet")).where("snippet is not null")


def corrected_map(corrections: DataFrame, order: str = "ts") -> DataFrame:
    """Of each document the map from field to its latest correction; ties go to the larger id."""
    last = corrections.groupBy("doc_id", "field").agg(F.max_by("corrected", F.struct(order, "id")).alias("value"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("corrected"))


def apply_changes(corrections: DataFrame, changes: DataFrame) -> DataFrame:
    """corrections(id, ...) after changes(id, action update or delete, corrected)."""
    c = changes.select("id", "action", F.col("corrected").alias("__new"))
    both = corrections.join(c.hint("shuffle_merge"), "id", "left").where("action is null or action <> 'delete'")
    return both.withColumn("corrected", F.when(F.col("action") == "update", F.col("__new")).otherwise(F.col("corrected"))).select(*corrections.columns)


def cascade_delete(samples: DataFrame, deleted: DataFrame) -> DataFrame:
    """samples without those of deleted corrections: same field and value, and the same wrong value or none."""
    gone = deleted.select("field", F.col("corrected").alias("value"), F.col("original").alias("__o")).distinct()
    wrong = samples.where("wrong is not null").join(gone.hint("shuffle_merge"), (samples["field"] == gone["field"]) & (samples["value"] == gone["value"]) & (samples["wrong"] == gone["__o"]), "left_anti")
    none = samples.where("wrong is null").join(gone.select("field", "value").distinct().hint("shuffle_merge"), ["field", "value"], "left_anti").select(*samples.columns)
    return wrong.unionAll(none)


def last_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in an order; each task sends no more than k rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def document_extractions(log: DataFrame, doc_id=None) -> DataFrame:
    """The last extraction of each (document, field), of one document if named."""
    rows = log if doc_id is None else log.where(F.col("doc_id") == doc_id)
    return rows.groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "method", "confidence"), F.struct("ts", "id")).alias("x")).select("doc_id", "field", "x.*")


def field_history(log: DataFrame, field: str, k: int = 20) -> DataFrame:
    """The latest k extractions of a field."""
    return log.where(F.col("field") == field).orderBy(F.desc("ts"), F.desc("id")).limit(min(k, 200))


def common_part(prefixes: Column, least: int = 8) -> Column:
    """The longest text, of at least `least` characters, that the last 80 characters of all prefixes hold; the first of equal length."""
    tails = F.transform(prefixes, lambda p: F.right(p, F.lit(80)))
    head = F.get(tails, F.lit(0))
    # The window on head grows while all tails hold it, and else moves on by one: it never needs to shrink.
    state = F.struct(F.lit(1).alias("i"), F.lit(0).alias("n"), F.lit(1).alias("at"))

    def step(s: Column, _: Column) -> Column:
        longer = F.substring(head, s["i"], s["n"] + 1)
        fits = (s["i"] + s["n"] <= F.length(head)) & F.forall(tails, lambda t: t.contains(longer))
        grown = F.struct(s["i"].alias("i"), (s["n"] + 1).alias("n"), s["i"].alias("at"))
        return F.when(fits, grown).otherwise(F.struct((s["i"] + 1).alias("i"), s["n"].alias("n"), s["at"].alias("at")))

    best = F.aggregate(F.sequence(F.lit(1), 2 * F.greatest(F.lit(1), F.length(head))), state, step)
    return S.let(best, lambda b: F.when(b["n"] >= least, F.substring(head, b["at"], b["n"])))


def generated_rules(found: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Rules for all fields at once: field, pattern, n_docs, confidence.

    Of each field and last three words before its values, up to `most` contexts (the newest, if found has ts); what they all hold becomes
    the pattern, followed by the value.
    """
    words = F.regexp_extract_all(F.lower(F.right("prefix", F.lit(100))), F.lit(r"(?U)(\p{L}{3,})"), 1)
    keyed = found.withColumn("key", F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3), " ")).where("key <> ''")
    order = [F.desc("ts")] if "ts" in found.columns else []
    some = last_of(keyed, ["field", "key"], [*order, F.col("doc_id").asc(), F.col("prefix").asc()], most)
    groups = some.groupBy("field", "key").agg(F.sort_array(F.collect_list("prefix")).alias("ps"), F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n")).where(F.col("n") >= least)
    # explode makes each part once, however often it is used below
    part = groups.select("field", "n_docs", F.explode(F.array(common_part(F.col("ps")))).alias("part")).where("part is not null")
    pattern = F.concat(S.generalize(F.ltrim("part")), F.lit(r"[ \t]*([^\n]{1,200})"))
    return part.select("field", pattern.alias("pattern"), F.col("n_docs").cast("int").alias("n_docs"), new_confidence(F.col("n_docs")).alias("confidence"))


def new_confidence(n_docs: Column) -> Column:
    return F.round(F.least(F.lit(0.7), 0.4 + 0.05 * n_docs), 6)


def rule_confidence(right: Column, wrong: Column, n_docs: Column) -> Column:
    """Of an unused rule by its documents; else by its results, a little more (0.9 at most) from five documents on."""
    bayes = (right + 1) / (right + wrong + 2)
    used = F.when(n_docs >= 5, F.least(F.lit(0.9), bayes + 0.05)).otherwise(bayes)
    return F.when(right + wrong == 0, new_confidence(n_docs)).otherwise(F.round(used, 6))


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """rules with those new ones that no active rule of the field equals."""
    active = rules.where("is_active").select("field", "pattern")
    fresh = new.dropDuplicates(["field", "pattern"]).join(active.hint("shuffle_merge"), ["field", "pattern"], "left_anti")
    return rules.unionByName(fresh.withColumn("is_active", F.lit(True)).select(*rules.columns))


def apply_rule(text: Column, pattern: str) -> Column:
    """What an automatic rule captures: at most 2000 characters, without punctuation at the end."""
    hit = F.regexp_extract(text, f"(?iu){pattern}", 1)
    return F.nullif(F.regexp_replace(F.trim(F.substring(hit, 1, 2000)), r"[\s.,;:]+$", ""), F.lit(""))


def partial_position(text: Column, value: Column, gap: int = 50) -> Column:
    """Where a value stands in parts: the place of its first word, if at least two of its words follow each other within `gap` characters, else null."""
    words = F.filter(F.split(F.lower(F.trim(value)), r"\s+"), lambda w: F.length(w) > 0)
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def run(low: Column) -> Column:
        def step(state: Column, w: Column) -> Column:
            def moved(p: Column) -> Column:
                near = (state["n"] > 0) & (p["next"] > 0) & (p["next"] - state["stop"] <= gap)
                return F.when(near, F.struct(state["start"].alias("start"), (p["next"] + F.length(w)).alias("stop"), (state["n"] + 1).alias("n"))).when(
                    (state["n"] < 2) & (p["first"] > 0), F.struct(p["first"].alias("start"), (p["first"] + F.length(w)).alias("stop"), F.lit(1).alias("n"))
                ).otherwise(state)

            return S.let(F.struct(_instr_after(low, w, state["stop"]).alias("next"), F.instr(low, w).alias("first")), moved)

        return F.aggregate(words, zero, step)

    # The lower-cased text and each word's places are bound once; inside a lambda every mention would be computed anew.
    return S.let(F.lower(text), lambda low: S.let(run(low), lambda r: F.when(r["n"] >= 2, r["start"])))


def _instr_after(text: Column, word: Column, start: Column) -> Column:
    return S.let(F.instr(F.substring(text, start, F.length(text)), word), lambda at: F.when(at > 0, at + start - 1).otherwise(0))


def known_fields(registry: list[str], memory: DataFrame) -> DataFrame:
    """Distinct fields of the registry and of the memory."""
    spark = memory.sparkSession
    return spark.createDataFrame([(f,) for f in registry], "field string").unionAll(memory.select("field")).distinct()


def model_status(versions: DataFrame, training: DataFrame, least: int = 5) -> DataFrame:
    """Per field: active model version, active samples, whether there are enough to train."""
    models = versions.groupBy("field").agg(F.max("version").alias("version"))
    samples = training.where("is_active").groupBy("field").agg(F.count("*").alias("n_samples"))
    both = models.join(samples.hint("shuffle_merge"), "field", "full")
    return both.select("field", "version", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), (F.coalesce("n_samples", F.lit(0)) >= least).alias("trainable"))


def segments(marks: DataFrame, keys: list[str], start: str = "start") -> DataFrame:
    """Headers with the place where each segment ends: the next header's start, null for the last."""
    return marks.withColumn("stop", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def tables_to_chunks(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each table (doc_id, table_no, page_num) with the first chunk (chunk, page_start, page_end) that covers its page."""
    near = tables.join(chunks.select("doc_id", "chunk", "page_start", "page_end").hint("shuffle_merge"), "doc_id").where("page_num between page_start and page_end")
    return near.groupBy("doc_id", "table_no").agg(F.min("chunk").alias("chunk"))


def page_warnings(pages: DataFrame, least_words: int = 30) -> DataFrame:
    """Per document the pages with little text, and whether it has no table at all."""
    low = F.sort_array(F.collect_list(F.when(F.col("word_count") < least_words, F.col("page_num"))))
    return pages.groupBy("doc_id").agg(low.alias("low_pages"), (~F.bool_or(F.col("text").contains("|"))).alias("no_table"))
