"""The learning loop as streams: what corrections and extractions teach, kept in tables that survive a replayed micro-batch.

Every table is a `KeyedTable`, so applying a micro-batch twice leaves what applying it once leaves, and its rows add up to
what one batch over all events gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions import scalars as S
from docloom.operators import corrections as C
from docloom.operators import learning as L
from docloom.operators import rules as R
from docloom.shared import KeyedTable

#: Rows of a micro-batch up to which the ids of its documents are sent to every task.
BROADCAST_IDS = 10_000
#: Contexts of a field and a key that rules are made from.
CONTEXTS = 50
_TOP = "array<struct<newest:long,doc_id:string,prefix:string,id:long>>"


def recent_contexts(found: DataFrame) -> DataFrame:
    """found(id, doc_id, field, prefix, ts) -> field, key (the last three words before a value), n, top: the newest CONTEXTS of each, which can be merged."""
    words = F.regexp_extract_all(F.lower(F.right("prefix", F.lit(100))), F.lit(r"(?U)(\p{L}{3,})"), 1)
    keyed = found.withColumn("key", F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3), " ")).where("key <> ''")
    newest = -F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("field", "key").orderBy(newest, "doc_id", "prefix", "id")
    some = keyed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= CONTEXTS)
    return some.groupBy("field", "key").agg(F.array_sort(F.collect_list(F.struct(newest.alias("newest"), F.col("doc_id").cast("string").alias("doc_id"), "prefix", F.col("id").cast("long").alias("id")))).alias("top"))


def contexts_table(spark: SparkSession, path: str) -> KeyedTable:
    # A part has at most CONTEXTS entries a key, so a key's list is at most CONTEXTS times the parts between two folds.
    top = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, CONTEXTS)
    return KeyedTable(spark, path, f"field string, key string, top {_TOP}", ["field", "key"], {"top": top})


def rules_from(top: DataFrame) -> DataFrame:
    """L6 over contexts as recent_contexts() keeps them."""
    each = top.select("field", F.explode("top").alias("c"))
    found = each.select("field", "c.doc_id", "c.prefix", F.timestamp_micros(-F.col("c.newest")).alias("ts"))
    return C.generated_rules(found, most=CONTEXTS)


def near_documents(docs: DataFrame, values: DataFrame) -> DataFrame:
    """The documents that values name. Of a small micro-batch the ids are counted and sent to the documents; otherwise both meet in a shuffle."""
    ids = values.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if values.count() <= BROADCAST_IDS else ids.hint("shuffle_merge"), "doc_id", "left_semi")


class CorrectionLoop:
    """What corrections teach. apply(batch, number) takes corrections(id, doc_id, field, original, corrected, ts), values as text:

    patterns (field, prefix_pattern, n): what stands before corrected values; wrong (doc_id, field): extractions that no longer hold, with the latest
    correction; memory: corrected values as extractions of confidence 1; stats (field): mergeable sums of the corrected
    values that are numbers, and how many corrections there were; log: each correction with its reason; rules (field): those
    generated from the field's contexts when a batch last touched it.

    A correction without document, field or id is left out; one whose value isn't in its document teaches no pattern.
    Without docs only what is a record of corrections is kept: wrong, memory and log.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame | None, path: str, fold_every: int = 20):
        table = lambda name, schema, keys, merge: KeyedTable(spark, f"{path}/{name}", schema, keys, merge, fold_every)
        first = lambda *names: {c: F.any_value(c).alias(c) for c in names}
        self.docs = docs
        self.patterns = table("patterns", "field string, prefix_pattern string, n long", ["field", "prefix_pattern"], {"n": F.sum("n")})
        last = F.max(F.col("last"))
        self.wrong = table("wrong", "doc_id string, field string, last struct<ts:timestamp,id:long,corrected:string>", ["doc_id", "field"], {"last": last})
        self.memory = table("memory", "id long, doc_id string, field string, value string, method string, confidence double, ts timestamp", ["id"], first("doc_id", "field", "value", "method", "confidence", "ts"))
        self.log = table("log", "id long, doc_id string, field string, original string, corrected string, reason string, confidence double", ["id"], first("doc_id", "field", "original", "corrected", "reason", "confidence"))
        sums = {"n": F.sum("n"), "n_numbers": F.sum("n_numbers"), "total": F.sum("total"), "squares": F.sum("squares"), "low": F.min("low"), "high": F.max("high")}
        self.stats = table("stats", "field string, n long, n_numbers long, total decimal(38,4), squares decimal(38,4), low decimal(18,2), high decimal(18,2)", ["field"], sums)
        self.contexts = contexts_table(spark, f"{path}/contexts")
        self.contexts.fold_every = fold_every
        made = F.max_by("made", "batch")
        self.rules = table("rules", "field string, made array<struct<pattern:string,n_docs:int,confidence:double>>", ["field"], {"made": made})

    def apply(self, batch: DataFrame, number: int) -> None:
        rows = batch.where("id is not null and doc_id is not null and field is not null").dropDuplicates(["id"]).withColumn("ts", F.col("ts").cast("timestamp")).persist()
        try:
            self._keep(rows, number)
            if self.docs is not None:
                self._teach(rows, number)
        finally:
            rows.unpersist()

    def _keep(self, rows: DataFrame, number: int) -> None:
        last = F.max(F.struct("ts", "id", "corrected"))
        self.wrong.put(rows.groupBy("doc_id", "field").agg(last.alias("last")), number)
        self.memory.put(rows.select("id", "doc_id", "field", F.col("corrected").alias("value"), F.lit("correction").alias("method"), F.lit(1.0).alias("confidence"), "ts"), number)
        self.log.put(rows.withColumns({"reason": F.lit("human_correction"), "confidence": F.lit(1.0)}), number)

    def _teach(self, rows: DataFrame, number: int) -> None:
        values = rows.select("id", "doc_id", "field", F.col("corrected").alias("value"), "ts")
        found = L.contexts(near_documents(self.docs, values), values.where("value <> ''")).where("prefix is not null").persist()
        try:
            self.patterns.put(L.learned_patterns(found), number)
            self.contexts.put(recent_contexts(found), number)
        finally:
            found.unpersist()
        numbers = rows.select("field", S.parse_amount("corrected").alias("v"))
        self.stats.put(numbers.groupBy("field").agg(F.count("*").alias("n"), F.count("v").alias("n_numbers"), F.sum(F.col("v").cast("decimal(38,4)")).alias("total"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,4)")).alias("squares"), F.min("v").alias("low"), F.max("v").alias("high")), number)
        touched = rows.select("field").distinct()
        made = rules_from(self.contexts.read().join(touched.hint("shuffle_hash"), "field", "left_semi"))
        by = made.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("pattern", "n_docs", "confidence"))).alias("made"))
        self.rules.put(touched.join(by.hint("shuffle_merge"), "field", "left").withColumn("made", F.coalesce("made", F.array().cast("array<struct<pattern:string,n_docs:int,confidence:double>>"))), number)

    def statistics(self) -> DataFrame:
        """field, n_corrections, and of those that are numbers n, mean, std, low, high."""
        n, mean = F.col("n_numbers"), F.col("total").cast("double") / F.col("n_numbers")
        spread = F.greatest(F.col("squares").cast("double") - n * mean * mean, F.lit(0.0)) / (n - 1)
        return self.stats.read().select("field", F.col("n").alias("n_corrections"), n.alias("n"), F.when(n > 0, mean).alias("mean"), F.when(n > 1, F.sqrt(spread)).alias("std"), "low", "high")

    def corrected(self, extractions: DataFrame) -> DataFrame:
        """Extractions (doc_id, field, value, ...) with was_correct: false where a correction came."""
        bad = self.wrong.read().select("doc_id", "field", F.lit(True).alias("__bad"))
        return extractions.join(bad.hint("shuffle_merge"), ["doc_id", "field"], "left").withColumn("was_correct", F.col("__bad").isNull()).drop("__bad")


class ExtractionLoop:
    """Rules made anew for all fields each time `every` further documents have come, from the contexts of all values so far.

    apply(batch, number) takes documents(doc_id, text, upload_ts). The number of documents is kept by micro-batch; rules are made at the end of a micro-batch that
    crosses a multiple of `every`, and kept with the number of documents they were made from.
    """

    def __init__(self, spark: SparkSession, pack: list[R.Rule], path: str, every: int = 5, fold_every: int = 20):
        self.pack, self.every = pack, every
        self.contexts = contexts_table(spark, f"{path}/contexts")
        self.contexts.fold_every = fold_every
        self.counts = KeyedTable(spark, f"{path}/counts", "one int, n long", ["one"], {"n": F.sum("n")}, fold_every)
        keys = ["point", "field", "pattern"]
        self.rules = KeyedTable(spark, f"{path}/rules", "point long, field string, pattern string, n_docs int, confidence double", keys, {"n_docs": F.max("n_docs"), "confidence": F.max("confidence")}, fold_every)

    def apply(self, batch: DataFrame, number: int) -> None:
        docs = batch.where("doc_id is not null").dropDuplicates(["doc_id"]).persist()
        try:
            known = R.apply_rules(docs, self.pack).select("doc_id", "field", "value")
            found = L.contexts(docs, known).where("prefix is not null").join(docs.select("doc_id", F.col("upload_ts").alias("ts")).hint("shuffle_merge"), "doc_id")
            self.contexts.put(recent_contexts(found.withColumn("id", F.lit(0).cast("long"))), number)
            n = docs.count()
            self.counts.put(docs.groupBy(F.lit(1).alias("one")).agg(F.count("*").alias("n")), number)
            before = (self.counts.read(before=number).agg(F.sum("n")).first()[0]) or 0
            made = rules_from(self.contexts.read())
            if (before + n) // self.every == before // self.every:
                made = made.limit(0)  # a part without rows, should an earlier run of this batch have left one
            self.rules.put(made.withColumn("point", F.lit(before + n).cast("long")), number)
        finally:
            docs.unpersist()

    def current(self) -> DataFrame:
        """The rules made last."""
        all_rules = self.rules.read()
        return all_rules.where(F.col("point") == F.lit(all_rules.agg(F.max("point")).first()[0])).drop("point")


class TrainingSignals(StatefulProcessor):
    """A field's signals to train: when `every` corrections have gathered, but no sooner than `cooldown` after its last training.

    Corrections and trainings come in one stream (kind). A signal starts a training, so it takes the corrections gathered and begins a
    cooldown, as a training event does. Corrections that come in a cooldown are kept: a timer in event time gives the signal when it ends.
    State: corrections gathered, signals so far, end of the cooldown. Rows of a micro-batch are taken in the order of time; a micro-batch,
    which `maxFilesPerTrigger` bounds, is the most that one task sorts.
    """

    SCHEMA = "field string, ts timestamp, n_corrections long, n_signals long"

    def __init__(self, every: int = 5, cooldown_ms: int = 600_000):
        self.every, self.cooldown = every, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gathered", "n long, signals long, until long")

    def _signal(self, out: list, at: int, n: int, signals: int) -> tuple[int, int, int]:
        out.append((at, n, signals + 1))
        return 0, signals + 1, at + self.cooldown

    def _frame(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"field": [key[0]] * len(out), "ts": pd.to_datetime([o[0] for o in out], unit="ms"), "n_corrections": [o[1] for o in out], "n_signals": [o[2] for o in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, signals, until = self.state.get() if self.state.exists() else (0, 0, 0)
        out: list[tuple[int, int, int]] = []
        some = pd.concat(list(rows))
        some["ms"] = some["ts"].to_numpy("datetime64[ms]").astype("int64")
        for ms, kind in some.sort_values(["ms", "id"])[["ms", "kind"]].itertuples(index=False):
            if n >= self.every and until <= ms:
                n, signals, until = self._signal(out, until, n, signals)
            if kind == "training":
                n, until = 0, ms + self.cooldown
                continue
            n += 1
            if n >= self.every and until <= ms:
                n, signals, until = self._signal(out, ms, n, signals)
        self.state.update((n, signals, until))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if n >= self.every:
            self.handle.registerTimer(until)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, signals, until = self.state.get()
        out: list[tuple[int, int, int]] = []
        if n >= self.every and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(self._signal(out, until, n, signals))
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def training_signals(events: DataFrame, every: int = 5, cooldown_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """events(id, field, kind correction or training, ts), a stream -> field, ts, n_corrections, n_signals of each signal."""
    keyed = events.where("field is not null and ts is not null").withWatermark("ts", late).select("id", "field", "kind", "ts")
    return keyed.groupBy("field").transformWithStateInPandas(TrainingSignals(every, cooldown_ms), TrainingSignals.SCHEMA, "Append", "EventTime")
