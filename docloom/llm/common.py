"""Helpers that the operators of this subpackage share: intermediate tables, small-table joins, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A lookup table of at most this many rows may be broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 50_000
#: Copies of each lookup row in a salted join.
SALTS = 32

WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one in spark.checkpoint.dir (below a temporary one where that is unset and the master is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "docloom-scratch").as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


@contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings for the length of a block; dots are written as double underscores."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded_batches(spark: SparkSession, rows: int = 4000, megabytes: int = 4):
    """Arrow batches of bounded size, in rows and in bytes, so that very long texts don't decide a worker's memory."""
    return conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch=str(megabytes << 20))


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read back: it survives lost executors, and the
    shuffle files that made it are removed at once."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Removes a table that stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with a stored lookup table whose keys may be hot in rows.

    The table's rows are counted: up to BROADCAST_ROWS of them are broadcast. Otherwise each of its rows is
    copied SALTS times and rows are spread over the copies by `spread`, so that no key lands in one task.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted.hint("shuffle_merge"), [*on, "__salt"], how)
        .drop("__salt")
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a new column: their number from 0, without gaps, in the given order; stored.

    Ranges of the order are numbered side by side, then each begins where the ones before it end: one small row a task is gathered.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("__range", LongType()), StructField(name, LongType())])

    def count(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, task)), pa.array(np.arange(n, n + k))], schema.names)
            n += k

    made = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(count), schema))
    sizes = made.groupBy("__range").agg(F.count("*").alias("n"))
    before = stored(sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")))
    return made.join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node that each node reaches. Nodes without edges are absent.

    Alternating large-star and small-star rounds. Smallest neighbours are aggregated with map-side combination and looked up by a key that
    is spread, so a hub with very many neighbours doesn't meet them in one task. Rounds are written to the shared folder
    and repeated until the sum of all labels and the edges stand still.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = stored(both)
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(cur)
    for _ in range(max_rounds):
        two = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = lookup_join(two.where("v > u"), low, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        lows = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = lookup_join(large, lows, ["u"], F.col("v")).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        new = stored(small.where("u <> v").distinct())
        for used in (cur, low, large, lows):
            drop_stored(used)
        cur = new
        now = state(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def lean(run):
    """run, for mapInArrow, with the memory of a task given back at its end: Python workers are used again by later tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return task


def map_texts(df: DataFrame, make, fields: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df, with or without its text column, and new columns that Python makes from the texts.

    make() is called once in each task and gives a function from an Arrow array of texts to a list of Arrow arrays,
    one for each of fields (a DDL string). Other columns pass through untouched; those named like a new one give way to it.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    at, new = df.columns.index(text_col), StructType.fromDDL(fields)
    kept = [k for k, name in enumerate(df.columns) if (keep_text or k != at) and name not in new.names]
    schema = StructType([df.schema.fields[k] for k in kept] + new.fields)

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *work(batch.column(at))], schema.names)

    return df.mapInArrow(lean(run), schema)


#: Bits of an id filter (8 MB); beyond so many ids it would let too many others pass to be worth its making; tasks that make it.
FILTER_BITS, FILTER_IDS, FILTER_TASKS = 26, 1 << 23, 8


def filter_places(ids):
    """Bit of each id (an array of 64-bit integers) in an id filter."""
    import numpy as np

    x = np.asarray(ids).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A broadcast bit set that holds every id of a stored table (id long) and few others: rows that it refuses need not be moved.

    It has a fixed size and is made by FILTER_TASKS tasks. None, which lets all pass, beyond FILTER_IDS ids; either way an exact join must follow.
    """
    import numpy as np
    import pyarrow as pa

    if ids.count() > FILTER_IDS:
        return None
    page = 1 << 16

    def set_bits(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at = filter_places(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, some in enumerate(bits.reshape(-1, page)):
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.tobytes()], pa.binary())], ["page", "bits"])

    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8).reshape(-1, page)
    for r in ids.coalesce(FILTER_TASKS).mapInArrow(set_bits, "page int, bits binary").toLocalIterator():
        bits[r["page"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def passes(wanted, ids):
    """Which ids an id filter lets through."""
    import numpy as np

    if wanted is None:
        return np.ones(len(ids), bool)
    at = filter_places(ids)
    return (wanted.value[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1


#: A key is hot when it holds more than a HOT_SHARE-th of all rows, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 256


def join_by_counts(rows: DataFrame, table: DataFrame, on: list[str], count_col: str, n: int, how: str = "inner") -> DataFrame:
    """A stored table of rows joined (inner or left) with a stored table that has one row a key and, in count_col, how many of the n rows hold the key.

    The keys of more than n / HOT_SHARE rows are fewer than HOT_SHARE, whatever the data, so they are broadcast and their rows
    stay where they are. All other keys meet in a shuffle, in which no key has more than n / HOT_SHARE rows.
    """
    hot = F.col(count_col) > n / HOT_SHARE
    few = table.where(hot)
    lead = rows.join(F.broadcast(few), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    return lead.unionByName(rest.join(table.where(~hot).hint("shuffle_merge"), on, how))


def join_by_id(rows: DataFrame, table: DataFrame, id_col: str, how: str = "inner") -> DataFrame:
    """A stored table of rows joined (inner or left) with a table of one row an id, some of whose ids very many rows may share. Null ids find nothing."""
    known = rows.where(F.col(id_col).isNotNull())
    sizes = known.groupBy(id_col).agg(F.count("*").alias("__rows"))
    sized = stored(table.join(sizes.hint("shuffle_merge"), id_col))
    out = join_by_counts(known, sized, [id_col], "__rows", rows.count(), how).drop("__rows")
    return out if how == "inner" else out.unionByName(rows.where(F.col(id_col).isNull()), allowMissingColumns=True)
