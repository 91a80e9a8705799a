"""The corpus pipeline: five operators over `documents`, each stage written and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, langid, mixing, tokens
from docloom.llm.common import bounded_batches, lookup_join, map_texts, scratch_dir, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null, empty, or without a letter."""
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs, model)
    # Stored here, since the size of Arrow batches is that of the session when they are made.
    with bounded_batches(spark, 1000, 1):
        return stored(found.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of texts whose sets of five-word shingles reach similarity 0.8: that of the smallest doc_id (null last).

    Texts, not doc_ids, make the groups, so rows that share a doc_id stay if their texts are apart. Rows without words all stay.
    """
    per_doc, parts = jaccard.JaccardJoin(docs, 5, 80, 100).groups()
    named = lookup_join(per_doc.where("n > 0"), parts, ["set_id"], F.xxhash64("doc_id"), "left")
    grouped = named.select("doc_id", "set_id", F.coalesce("component", "set_id").alias("component"))
    keeper = grouped.groupBy("component").agg(F.count("*").alias("k"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")).alias("first"))
    # Only groups of several rows are touched: of them the first (doc_id, set) stays, once.
    several = stored(keeper.where("k > 1").select("component", "first"))
    met = lookup_join(grouped, several, ["component"], F.xxhash64("doc_id", "set_id"))
    stays = (F.col("set_id") == F.col("first.set_id")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    fate = stored(met.select(F.col("doc_id").alias("own"), F.col("set_id").alias("name"), stays.alias("stays")).groupBy("own", "name", "stays").agg(F.count("*").alias("k")))
    same = (F.col("own").eqNullSafe(F.col("doc_id"))) & (F.col("name") == F.col("__set"))
    with bounded_batches(spark, 1000, 1):
        marked = map_texts(docs.withColumn("__text", F.col("text")), jaccard.text_sets(5), "__n bigint, __set bigint", "__text", keep_text=False)
        left = stored(marked.join(fate.hint("shuffle_merge"), same, "left").where("stays or stays is null"))
    once = left.where("k is null or k = 1").select(*docs.columns)
    if not fate.where("stays and k > 1").limit(1).count():
        return once
    return once.unionAll(left.where("k > 1").dropDuplicates(["doc_id", "__set"]).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("matches") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2, repeating; 150 % of all words; a document as often as the mix takes it."""
    return mixing.apply_mix(docs, mixing.balanced_mix(docs, (3, 1, 2), 1.5, 2.0))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in ascending order of doc_id and read back."""
    path = scratch_dir(spark)
    tokens.write_tokens(docs, path, tokens.default_tokenizer(), end_id=2)
    return tokens.read_tokens(spark, path, with_ids=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_output", token_output)]

#: Several stages (trained models, edit matching, sampling, tokenising) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = made if hasattr(made, "stored_at") else stored(made)
    return STAGES[-1][1](spark, docs, sf_dir)
