"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir; a local session that sets none gets one below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file:///tmp/docloom-streams"
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet and read back."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key over all tasks. A small table lies in one or two files and would otherwise keep as many tasks busy, however much each row costs."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


#: A lookup table of at most this many rows is broadcast; each row of a larger one is copied SALTS times.
LOOKUP_ROWS, SALTS = 1000, 32


def lookup(rows: DataFrame, table: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """rows joined with a stored table of one row a key. Very many rows may share a key: no shuffle brings them together, since the
    table's rows, counted first, go to every task or are copied, and rows are dealt over the copies by `by`."""
    if table.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(table), on, how)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies.hint("shuffle_merge"), [on, "__salt"], how).drop("__salt")


class KeyedTable:
    """Rows by key that grow by micro-batches and can be written again without harm.

    Each batch writes its own part, rows that can be merged (sums, extremes, latest values), so a batch that is replayed after a failure
    overwrites what it wrote. read() merges the parts by key. Every `fold_every` batches the parts so far are merged into one; a
    part that a fold holds is neither read nor written again. One stream writes a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: dict[str, Column], fold_every: int = 20):
        self.spark, self.path, self.keys, self.merge, self.fold_every = spark, path, keys, merge, fold_every
        self.schema = f"{schema}, batch long"
        self.names = [c for c in spark.createDataFrame([], schema).columns]

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the parts or folds that were written whole."""
        jvm, base = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _merged(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.groupBy(*self.keys).agg(*[e.alias(c) for c, e in self.merge.items()], F.max("batch").alias("batch")).select(*self.names, "batch")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows merged by key, of all batches or of those before one; without the batch's number. What a fold holds counts as before."""
        fold = max(self._numbers("fold"), default=-1)
        parts = [p for p in self._numbers("part") if p > fold and (before is None or p < before)]
        return self._merged([f"{self.path}/fold-{fold}"] * (fold >= 0) + [f"{self.path}/part-{p}" for p in parts]).drop("batch")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch's rows, again if need be."""
        fold = max(self._numbers("fold"), default=-1)
        if batch <= fold:
            return
        rows.select(*self.names).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/part-{batch}")
        parts = [p for p in self._numbers("part") if fold < p < batch]  # this batch may come again, so it stays apart
        if len(parts) >= self.fold_every:
            old = [f"{self.path}/fold-{fold}"] * (fold >= 0) + [f"{self.path}/part-{p}" for p in parts]
            self._merged(old).write.mode("overwrite").parquet(f"{self.path}/fold-{parts[-1]}")


def arriving(df: DataFrame, slices: list[Column], per_batch: int = 1) -> DataFrame:
    """df as a stream: a file for each condition of `slices` in turn, then one of the rest, `per_batch` files a micro-batch."""
    spark, path, rest = df.sparkSession, folder(df.sparkSession), F.lit(True)
    for cond in [*slices, F.lit(True)]:
        df.where(rest & cond).coalesce(1).write.mode("append").parquet(path)  # files are taken by their times
        rest = rest & ~F.coalesce(cond, F.lit(False))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drain_into(stream: DataFrame, apply, path: str) -> None:
    """Runs apply(batch, number) over every micro-batch that is there now."""
    stream.writeStream.foreachBatch(apply).trigger(availableNow=True).option("checkpointLocation", path).start().awaitTermination()


def drain_slices(df: DataFrame, slices: list[Column], apply, path: str) -> None:
    """Runs apply(batch, number) over df in micro-batches: one for each condition of `slices` in turn, then one of the rest. All tasks write a slice's files; the
    stream is run after each slice, from where it stood, and takes all files that are new."""
    spark, files, rest = df.sparkSession, folder(df.sparkSession), F.lit(True)
    for cond in [*slices, F.lit(True)]:
        df.where(rest & cond).write.mode("append").parquet(files)
        drain_into(spark.readStream.schema(df.schema).parquet(files), apply, path)
        rest = rest & ~F.coalesce(cond, F.lit(False))
