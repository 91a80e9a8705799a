"""The event loop as Structured Streaming queries over the extraction log."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import analytics as A
from docloom.shared import folder
from docloom.sources.logs import as_log


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of its files."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents*.parquet")


def extracted_entities(documents: DataFrame, pack: dict[str, str]) -> DataFrame:
    """How often each named pattern occurs in documents as they arrive; no state."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in pack.items()])
    return documents.select("doc_id", F.inline(counts)).where("n > 0")


def anomalous_values(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Values of arriving events that lie apart from a stored snapshot of their field's statistics."""
    return A.anomalies(as_log(events), stats)


def running_field_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("field")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def correction_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extractions and corrections in each window of time; events later than the watermark are dropped."""
    wrong = F.get_json_object("props", "$.k").cast("int") % 5 == 0
    return events.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"))


def distinct_documents(events: DataFrame, late: str = "31 days") -> DataFrame:
    """The first event of each content within the watermark."""
    hashed = events.withColumn("content", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content"])


def correction_counter(events: DataFrame, every: int = 5) -> DataFrame:
    """A signal each time a field has gathered `every` corrections since its last one: field, n_corrections, n_signals so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, fired = state.get if state.exists else (0, 0)
        for pdf in batches:
            total += len(pdf)
        if total // every > fired:
            fired = total // every
            yield pd.DataFrame({"field": [key[0]], "n_corrections": [total], "n_signals": [fired]})
        state.update((total, fired))

    wrong = events.where(F.get_json_object("props", "$.k").cast("int") % 5 == 0).select(F.col("event_type").alias("field"), "event_id")
    return wrong.groupBy("field").applyInPandasWithState(step, "field string, n_corrections long, n_signals long", "total long, fired long", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives its rows, through Parquet in the shared folder (append) or memory."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    query = writer.format("memory").queryName(name).start() if mode != "append" else writer.format("parquet").option("path", f"{path}/rows").start()
    query.awaitTermination()
    return spark.table(name) if mode != "append" else spark.read.schema(stream.schema).parquet(f"{path}/rows")
