import pytest

import corpus_pipeline
from docloom.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def test_all_thirteen_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0 and counts[4] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == counts[4]
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [stage(spark, empty, sf_dir).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_near_duplicates_keep_every_different_text(spark):
    """Rows that share a doc_id are told apart by their texts; of a group one row stays, null ids last; rows without words stay."""
    a, b, c, d = "alpha beta gamma delta epsilon zeta", "something else altogether here now", "only null id twice here", "once more five words"
    rows = [(1, a), (1, b), (2, a), (2, a), (None, a), (None, c), (None, c), (7, ""), (7, None), (3, d), (3, d)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (7, ""), (7, None), (None, c), (3, d)], key=str)


def test_language_stage_works_in_small_batches(spark, sf_dir, monkeypatch):
    """The batches of the language stage, texts kept, are those of bounded_batches() when it runs."""
    import corpus_pipeline

    sizes, put = [], corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df: (sizes.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), put(df))[1])
    docs = spark.createDataFrame([(1, "una frase", "it", "a"), (2, "a sentence", "en", "a"), (3, "12", "en", "a")], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.language(spark, docs, sf_dir)
    assert sizes == ["1000"] and sorted(r.doc_id for r in got.collect()) == [1, 2] and got.columns == docs.columns
