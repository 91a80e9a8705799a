import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom import shared
from docloom.operators import corrections as C
from docloom.operators import learning as L
from docloom.operators import rules as R
from docloom.plans import streams
from docloom.streaming import learning as SL
from tests.oracle import same

DAY = datetime.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_keyed_table_survives_replays_and_folds(spark):
    table = shared.KeyedTable(spark, shared.folder(spark), "k string, n long, low int", ["k"], {"n": F.sum("n"), "low": F.min("low")}, fold_every=2)
    assert table.read().count() == 0
    put = lambda b: table.put(spark.createDataFrame([("a", b + 1, b), (f"k{b}", 1, 0)], "k string, n long, low int"), b)
    for b in range(5):
        put(b)
        put(b)  # replayed at once
        want = {("a", str(sum(range(1, b + 2))), "0")} | {(f"k{i}", "1", "0") for i in range(b + 1)}
        assert {(r.k, str(r.n), str(r.low)) for r in table.read().collect()} == want
    assert table._numbers("fold") and max(table._numbers("fold")) < 4  # the last batch can always come again
    put(0)  # long since folded: not counted again
    assert {r.k: r.n for r in table.read().collect()}["a"] == 15


def corrections(spark):
    texts = [(str(i), f"Premessa {i}\nTermine: sessanta giorni\nFoglio {i % 7}\nDurata del contratto: {i} mesi\nPenali: € {100 + i},50 al giorno") for i in range(40)]
    docs = spark.createDataFrame([*texts, (None, "x")], "doc_id string, text string")
    rows = []
    for i in range(40):
        rows.append((4 * i, str(i), "durata", "1 mese", f"{i} mesi", DAY + datetime.timedelta(hours=i)))
        if i % 2:
            rows.append((4 * i + 1, str(i), "penale", "0", f"{100 + i},50", DAY + datetime.timedelta(hours=i)))
        if i % 5 == 0:
            rows.append((4 * i + 2, str(i), "durata", f"{i} mesi", "assente", DAY + datetime.timedelta(hours=i + 1)))
    odd = [(None, "1", "durata", "a", "b", DAY), (900, None, "durata", "a", "b", DAY), (901, "1", None, "a", "b", DAY), (902, "77", "durata", None, None, None), rows[0]]
    return docs, spark.createDataFrame(rows + odd, "id long, doc_id string, field string, original string, corrected string, ts timestamp")


def test_correction_loop_in_batches_equals_one_batch(spark):
    docs, events = corrections(spark)
    whole = SL.CorrectionLoop(spark, docs, shared.folder(spark))
    whole.apply(events, 0)
    path = shared.folder(spark)
    parts = SL.CorrectionLoop(spark, docs, path, fold_every=1)
    hour = lambda h: F.col("ts") < F.lit(DAY + datetime.timedelta(hours=h))
    stream = shared.arriving(events, [hour(7), hour(20)])
    seen = []

    def apply(batch, number):
        parts.apply(batch, number)
        parts.apply(batch, number)  # as after a failure
        seen.append(number)

    shared.drain_into(stream, apply, f"{path}/state")
    assert seen == [0, 1, 2]
    for name in ("patterns", "wrong", "memory", "log", "stats", "contexts", "rules"):
        assert rows_of(getattr(parts, name).read()) == rows_of(getattr(whole, name).read()), name
    values = events.where("id is not null and doc_id is not null and field is not null").dropDuplicates(["id"]).select("doc_id", "field", F.col("corrected").alias("value"), "ts")
    found = L.contexts(docs, values).where("prefix is not null")
    assert rows_of(whole.patterns.read()) == rows_of(L.learned_patterns(found).select("field", "prefix_pattern", "n"))
    assert rows_of(whole.rules.read().select("field", F.inline("made"))) == rows_of(C.generated_rules(found))
    stats = {r.field: r for r in whole.statistics().collect()}
    assert stats["penale"].n == 20 and stats["penale"].mean == pytest.approx(sum(100.5 + i for i in range(1, 40, 2)) / 20) and stats["durata"].n_corrections == 49
    last = {(r.doc_id, r.field): r.last.corrected for r in whole.wrong.read().collect()}
    assert last["5", "durata"] == "assente" and last["6", "durata"] == "6 mesi"
    log = spark.createDataFrame([("5", "durata", "x"), ("5", "oggetto", "y")], "doc_id string, field string, value string")
    assert {(r.field, r.was_correct) for r in whole.corrected(log).collect()} == {("durata", False), ("oggetto", True)}


def test_rules_come_at_every_fifth_document(spark):
    docs = spark.createDataFrame([(str(i), f"Pagina\nScadenza presentazione offerte: {i + 1:02d}/03/2024 ore 12:00\n", datetime.date(2024, 3, i + 1)) for i in range(12)], "doc_id string, text string, upload_ts date")
    pack = [r for r in R.BUILTIN if r.field == "scadenza_offerte"]
    loop = SL.ExtractionLoop(spark, pack, shared.folder(spark))
    key = F.col("doc_id").cast("int")
    for number, (low, high) in enumerate([(0, 4), (4, 6), (6, 7), (7, 12)]):
        for _ in range(2):
            loop.apply(docs.where((key >= low) & (key < high)), number)
    made = {(r.point, r.n_docs) for r in loop.rules.read().collect()}
    assert made == {(6, 6), (12, 12)}
    known = R.apply_rules(docs, pack).select("doc_id", "field", "value")
    want = C.generated_rules(L.contexts(docs, known).join(docs.select("doc_id", F.col("upload_ts").cast("timestamp").alias("ts")), "doc_id"))
    assert rows_of(loop.current()) == rows_of(want)
    empty = SL.ExtractionLoop(spark, pack, shared.folder(spark))
    empty.apply(docs.limit(0), 0)
    assert empty.current().count() == 0


@pytest.mark.parametrize("name", ["stream_learned", "stream_rule_points"])
def test_rules_of_deadlines_on_one_day_equal_sql(spark, sf_dir, tmp_path, name):
    """Where the newest contexts carry one date, the 80 characters before the values are the same from their start."""
    for table in ("customer", "nation", "lineitem"):
        os.symlink(f"{sf_dir}/{table}.parquet", tmp_path / f"{table}.parquet")
    orders = pq.read_table(f"{sf_dir}/orders.parquet")
    at = orders.schema.get_field_index("o_orderdate")
    one_day = pa.array([orders["o_orderdate"][0].as_py()] * len(orders), orders.schema.field(at).type)
    pq.write_table(orders.set_column(at, orders.schema.field(at), one_day), tmp_path / "orders.parquet")
    same(streams.QUERIES[name](spark, str(tmp_path)), streams.ORACLE_SQL[name], str(tmp_path))


def test_corrections_are_kept_without_texts_and_by_all_tasks(spark, sf_dir, monkeypatch):
    """A slice is one micro-batch of many files, and records of corrections need no tender's text."""
    many = spark.range(0, 4000, 1, 4)
    seen = []
    shared.drain_slices(many, [F.col("id") < 1000, F.col("id") < 0, F.col("id") < 3000], lambda batch, n: seen.append((n, batch.count(), batch.select(F.input_file_name()).distinct().count())), f"{shared.folder(spark)}/state")
    assert [s[:2] for s in seen] == [(0, 1000), (1, 0), (2, 2000), (3, 1000)] and seen[2][2] > 1
    docs, events = corrections(spark)
    whole, bare = SL.CorrectionLoop(spark, docs, shared.folder(spark)), SL.CorrectionLoop(spark, None, shared.folder(spark))
    for loop in (whole, bare):
        loop.apply(events, 0)
    for name in ("wrong", "memory", "log"):
        assert rows_of(getattr(bare, name).read()) == rows_of(getattr(whole, name).read()), name
    monkeypatch.setattr(streams, "render_tenders", None)
    same(streams.stream_memory(spark, sf_dir), streams.ORACLE_SQL["stream_memory"], sf_dir)
