import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import analytics, corpus, corrections, learning, packs, record, rules, structure
from docloom.sources.tenders import lots


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


@pytest.mark.parametrize("raw, want", [("1.234,56", "€ 1.234,56"), ("€ 100.000,00", "€ 100.000,00"), ("1,234.56", "€ 1.234,56"), ("500", "€ 500,00"), (None, None), ("", None), ("n.d.", "n.d.")])
def test_normalize_amount(spark, raw, want):
    assert one(spark, raw, S.normalize_amount) == want


@pytest.mark.parametrize("raw, want", [("€ 1.234,56", "1234.56"), ("euro 184.430,11", "184430.11"), ("1.234.567", "1234567.00"), ("1.234", "1.23"), ("0,00", None), ("abc", None), (None, None), (".,;", None)])
def test_parse_amount(spark, raw, want):
    got = one(spark, raw, S.parse_amount)
    assert (None if got is None else str(got)) == want


def test_parse_amount_thousands(spark):
    assert one(spark, "1.234", lambda c: S.parse_amount(c, dot3_thousands=True)) == Decimal("1234.00")


@pytest.mark.parametrize("raw, want", [("due", 2), (" Cinque ", 5), ("42", 42), ("3 lotti", 3), ("x", None), (None, None)])
def test_number_word(spark, raw, want):
    assert one(spark, raw, S.number_word) == want


def test_text_functions(spark):
    assert one(spark, "  a \n b ,;: ", S.clean_string) == "a b"
    assert one(spark, "**Città** ’x’", S.clean_text) == "Città 'x'"
    assert one(spark, "A(cid:66)C(cid:x)", S.decode_glyphs) == "ABC(cid:x)"
    assert one(spark, "e20", S.category_code) == "E.20"
    assert one(spark, "12/03/2024", S.value_type) == "date"
    assert one(spark, "€ 12,5", S.value_type) == "numeric"
    assert one(spark, "aaa", lambda c: S.match_positions(c, F.lit("aa"))) == [1, 2]
    assert one(spark, "CIG: A1B2C3D4E5 e CIG Z9Y8X7W6V5", lambda c: S.all_matches(c, [r"CIG[\s:]*([A-Z0-9]{10})\b"])) == ["A1B2C3D4E5", "Z9Y8X7W6V5"]
    assert one(spark, "valore 1.000,00 € e € 2,50", S.find_amounts) == [Decimal("1000.00"), Decimal("2.50")]
    assert one(spark, "Importo: 12 - x", S.generalize) == r"Importo[:\s]+\d+\s+[-–—]\s+x"


@pytest.mark.parametrize("value, blank", [(None, True), ("", True), ("  ", True), ("0", True), ("False", True), ("x", False)])
def test_is_blank(spark, value, blank):
    assert one(spark, value, S.is_blank) is blank


def test_sql_functions(spark):
    S.register(spark)
    assert spark.sql("SELECT category_code('ia3'), format_amount(1234.5), clean_string(' a  b; ')").first() == ("IA.3", "EUR 1.234,50", "a b")


def test_value_context(spark):
    text = "Il Comune di Prato bandisce una gara. Importo 123456 euro."
    find = lambda v: one(spark, text, lambda c: S.value_context(c, F.lit(v), 10))
    assert "Prato" in find("prato") and "Importo" in find("importo massimo") and "123456" in find("€ 123456,00") and find("zz") == "" and find("x") == ""


@pytest.mark.parametrize("value, kind, ok", [("A1B2C3D4E5", "cig", True), ("A1", "cig", False), ("C12B00000001", "cup", True), ("12345678-9", "cpv", True), ("1.000", "importi", True), ("-1", "importi", False), ("101", "punteggi", False), ("80", "punteggi", True), ("01/02/2024", "date", True), ("ab", "text", False), ("true", "boolean", True)])
def test_validators(spark, value, kind, ok):
    assert spark.range(1).select(rules.valid(F.lit(value), F.lit(kind))).first()[0] is ok


def test_rules(spark):
    docs = spark.createDataFrame([(1, "CIG: A1B2C3D4E5\nimporto totale € 50,00\nvalore stimato € 9.000,00"), (2, None), (3, "")], "doc_id int, text string")
    got = {(r.doc_id, r.field): r.value for r in rules.apply_rules(docs).collect()}
    assert got == {(1, "cig"): "A1B2C3D4E5", (1, "importo_totale"): "9000.00"}
    more = rules.with_custom(rules.BUILTIN, [rules.Rule("Mio Campo", "Flag", "text", (r"mio:\s*(\w+)",))])
    assert more[-1].field == "mio_campo"
    with pytest.raises(ValueError):
        rules.with_custom(rules.BUILTIN, [rules.Rule("cig", "x", "text", ("a",))])
    with pytest.raises(Exception):
        rules.with_custom(rules.BUILTIN, [rules.Rule("bad", "x", "text", ("(",))])


def test_structure(spark):
    text = "[Pagina 1]\nART. 1 Oggetto\nriga uno di testo\n[Pagina 2]\nLotto 1\nprimo\nLotto 2\nsecondo\n[TABELLA x]\n1 | a | b\n | c | \n2 | d | e\n"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert [r.page_num for r in structure.pages(docs).orderBy("page_num").collect()] == [1, 2]
    assert [r.lot for r in structure.lot_segments(docs).orderBy("lot").collect()] == [1, 2]
    merged = structure.merge_continuations(structure.table_rows(docs)).orderBy("record").collect()
    assert [r.cells for r in merged] == [["1", "a c", "b"], ["2", "d", "e"]]
    table = spark.range(1).select(structure.markdown_table(["h", "kk"], F.array(F.array(F.lit("abc"), F.lit("d"))))).first()[0]
    assert table == "| h   | kk |\n| --- | -- |\n| abc | d  |"


def test_votes_and_overlay(spark):
    c = spark.createDataFrame([(1, "f", "x", 0.5, "rules"), (1, "f", "x", 0.4, "ml"), (1, "f", "y", 0.6, "rules"), (2, "f", "z", 0.3, "ml")], "doc_id int, field string, value string, confidence double, method string")
    got = {r.doc_id: (r.value, r.confidence) for r in analytics.vote(c).collect()}
    assert got == {1: ("x", 0.55), 2: ("z", 0.3)}


def test_upsert_and_migration(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, corpus.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert corpus.add_missing_columns(old, {"w": 0, "v": "z"}).columns == ["k", "v", "w"]


def test_scan_and_json(spark, tmp_path):
    (tmp_path / "disciplinare_1.txt").write_text("uno")
    (tmp_path / "altro.txt").write_text("due")
    assert [r.filename for r in corpus.scan_corpus(spark, str(tmp_path)).collect()] == ["disciplinare_1.txt"]
    assert corpus.scan_corpus(spark, str(tmp_path), "zzz").count() == 2
    corpus.write_nested(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1}'


def test_labels(spark):
    row = spark.createDataFrame([("Procedura aperta, offerta economicamente piu vantaggiosa",)], "t string").select(record.procedure_label(F.col("t")).alias("p"), record.criterion_label(F.col("t")).alias("c"))
    assert row.select(record.merged_label(F.col("p"), F.col("c"))).first()[0] == "Procedura aperta - OEPV"


def test_example_quality(spark):
    got = spark.range(1).select(learning.example_quality(F.lit("rules_validated"), F.lit(600)), learning.example_quality(F.lit("?"), F.lit(1)), learning.example_quality(F.lit("correction"), F.lit(900))).first()
    assert tuple(round(x, 6) for x in got) == (0.7, 0.3, 1.0)


def test_as_of_is_a_parameter(spark):
    log = spark.createDataFrame([(1, "f", True, datetime.datetime(2024, 1, 1)), (2, "f", False, datetime.datetime(2024, 3, 1))], "id int, field string, was_corrected boolean, ts timestamp")
    r = analytics.extraction_quality(log, F.lit(datetime.datetime(2024, 3, 2)), 30).first()
    assert (r.n, r.accuracy, r.recent_n, r.recent_accuracy, r.trend) == (2, 0.5, 1, 1.0, "improving")


def test_strategies(spark):
    similar = corpus.most_similar(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "a int, b int, score double"), 1)
    assert sorted((r.doc_id, r.other) for r in similar.collect()) == [(1, 3), (2, 1), (3, 1)]
    memory = spark.createDataFrame([(3, "f", "x", 0.5), (2, "f", "y", 1.0)], "doc_id int, field string, value string, confidence double")
    assert [tuple(r) for r in corpus.strategies(similar, memory).collect()] == [(1, "f", "x", 3, 0.45)]


def test_similar_documents_hot_terms(spark):
    """Pairs that share only a term which more than `hot` documents have are met too, each once."""
    docs = spark.createDataFrame([(i, f"common only{'abcdefghi'[i]}", "s" if i < 6 else f"t{i}") for i in range(9)], "doc_id long, text string, source string")
    got = sorted((r.a, r.b, r.score) for r in corpus.similar_documents(docs, hot=2).collect())
    score = lambda a, b: round(0.7 / 3 + (0.3 if b < 6 else 0), 6)
    assert got == [(a, b, score(a, b)) for a in range(9) for b in range(a + 1, 9)]


# --- forms that other texts use


def test_validators_read_italian_notation(spark):
    from docloom.operators import rules

    rows = [("1.234.567,89", "importi", True), ("100000", "importi", True), ("€ 100.000,00", "importi", True), ("1.234,56", "importi", True), ("0", "importi", False), ("abc", "importi", False), ("80", "punteggi", True), ("0", "punteggi", True), ("101", "punteggi", False), ("24", "number", True), ("x", "number", False), ("712400002", "cpv", False)]
    df = spark.createDataFrame(rows, "value string, validator string, want boolean")
    assert df.where(rules.valid(F.col("value"), F.col("validator")) != F.col("want")).count() == 0


def test_lots_in_one_line(spark):
    from docloom.operators import packs, structure

    text = "Gara suddivisa in 2 Lotto 1 servizi pulizia CIG: AAA1111111 importo base gara € 100.000,00 Lotto 2 servizi manutenzione CIG: BBB2222222 importo base gara € 200.000,00"
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert [r.lot for r in structure.lot_segments(docs).orderBy("lot").collect()] == [1, 2]
    got = docs.select(F.explode(packs.lots(F.col("text"))).alias("x")).select("x.*").collect()
    assert [(r.lot, r.cig, float(r.amount)) for r in got] == [(1, "AAA1111111", 100000.0), (2, "BBB2222222", 200000.0)]


def test_amounts_before_and_after_the_sign(spark):
    got = spark.range(1).select(S.find_amounts(F.lit("100,00 euro e 5.000,00 €, poi € 7,50 ed EUR")).alias("x")).first().x
    assert [float(v) for v in got] == [100.0, 5000.0, 7.5]


def test_vote_by_compare_key(spark):
    from docloom.operators import analytics

    rows = [("d", "f", "Comune di Roma", "rules", 0.6), ("d", "f", "comune  di roma.", "ml", 0.5), ("d", "f", "Altro", "corrected", 0.55)]
    got = analytics.vote(spark.createDataFrame(rows, "doc_id string, field string, value string, method string, confidence double")).first()
    assert got.value == "Comune di Roma"


def test_common_part_and_prefix_ends(spark):
    from docloom.operators import corrections, packs

    row = spark.range(1).select(
        corrections.common_part(F.array(F.lit("xx Scadenza offerte: "), F.lit("altro Scadenza offerte: "))).alias("a"),
        corrections.common_part(F.array(F.lit("abc"), F.lit("xyz"))).alias("b"),
        packs.meaningful_prefix(F.lit("prima riga.\nImporto totale: ")).alias("c"),
        packs.meaningful_suffix(F.lit(" euro. Poi altro")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (" Scadenza offerte: "[0:] if row.a.startswith(" ") else "Scadenza offerte: ", None, "Importo totale: ", " euro")


def test_tables_meet_their_chunk(spark):
    from docloom.operators import corrections

    tables = spark.createDataFrame([("a", 0, 2), ("a", 1, 9)], "doc_id string, table_no int, page_num int")
    chunks = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 2, 3), ("a", 2, 2, 4)], "doc_id string, chunk int, page_start int, page_end int")
    assert [tuple(r) for r in corrections.tables_to_chunks(tables, chunks).collect()] == [("a", 0, 1)]


def test_code_formats(spark):
    from docloom.operators import packs

    lots = F.array(F.struct(F.lit(1).alias("lot"), F.lit("AAA1111111").alias("cig")), F.struct(F.lit(2).alias("lot"), F.lit("short").alias("cig")))
    assert spark.range(1).select(packs.code_formats(F.lit("C12B0001"), lots).alias("x")).first().x == ["CUP", "CIG lotto 2"]


def test_metrics(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", None)]
    got = learning.metrics(spark.createDataFrame(rows, "y string, label string"), "y").first()
    assert (got.n, got.accuracy, got.f1) == (7, round(5 / 7, 6), round((2 * 3 / 7 * 4 + 2 * 2 / 6 * 3) / 7, 6))


def test_top_classes(spark):
    docs = spark.createDataFrame([(i, "rosso fuoco" if i % 2 else "verde prato", "r" if i % 2 else "v") for i in range(20)], "doc_id long, text string, y string")
    model, names, _ = learning.train_classifier(docs, "y")
    got = {r.doc_id: r.classes for r in learning.predict_top(model, names, docs, 1).collect()}
    assert all(c[0].label == ("r" if i % 2 else "v") and c[0].p > 0.5 and len(c) == 1 for i, c in got.items())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_table_records_equal_merged_rows_without_a_shuffle(spark):
    text = "[TABELLA 1]\n | sopra | x\n1 | Uno | 10\n | seguito\n2 | Due\n\nTesto\n[TABELLA 2]\nsenza | numero\n | ancora | | fine\n[TABELLA 3]\n7 | \n8 | a | b\n9 |x\n"
    docs = spark.createDataFrame([("a", text), ("b", "nessuna"), ("c", None), ("d", "[TABELLA]\n3 | c")], "doc_id string, text string")
    rows = lambda df: sorted((r.doc_id, r.table_no, r.record, tuple(r.cells)) for r in df.collect())
    made = structure.table_records(docs)
    assert rows(made) == rows(structure.merge_continuations(structure.table_rows(docs))) and len(rows(made)) == 8
    assert "Exchange" not in plan_of(made)[2]


def test_tenders_shuffle_lots_once(spark, sf_dir):
    plan = plan_of(lots(spark, sf_dir).groupBy("o_orderkey").agg(F.collect_list("amount")))[2]
    assert plan.count("Exchange ") == 1


def test_partial_position_binds_the_text_once(spark):
    docs = spark.createDataFrame([("Vista. Fondo dell'INTERVENTO che è finanziato", ), ("intervento " + "x" * 80 + " finanziato",), ("finanziato intervento",), ("poi intervento: intervento finanziato",), (None,)], "text string")
    at = corrections.partial_position(F.col("text"), F.lit("intervento introvabile finanziato"))
    found = docs.select(at.alias("at"))
    assert [r["at"] for r in found.collect()] == [19, None, None, 5, None]
    assert plan_of(found)[0].split("LocalRelation")[0].split("LogicalRDD")[0].count("lower(text") == 1


def test_matches_with_context_searches_once(spark):
    text = "01/02/2024 a 03/04/2025, " + "z" * 70 + " 05/06/2026" + " 07/08/2027" * 4
    docs = spark.createDataFrame([(text,), ("nulla",), (None,)], "text string")
    out = docs.select(packs.matches_with_context(F.col("text"), r"\d{2}/\d{2}/\d{4}").alias("m"))
    first, none, null = [r.m for r in out.collect()]
    want = [(m.group(), m.start() + 1, text[max(0, m.start() - 50) : m.end() + 50]) for m in re.finditer(r"\d{2}/\d{2}/\d{4}", text)][:5]
    assert [tuple(x) for x in first] == want and none == [] and null == []
    assert plan_of(out)[0].count("regexp_extract_all(") == 1


def test_ranked_by_hash_ranks_no_whole_group_in_one_window(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    whole = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id")))
    out = learning.ranked_by_hash(df, "y", "doc_id", "rank").withColumn("whole", whole)
    assert out.count() == 3000 and out.where("rank <> whole").count() == 0
    plan = plan_of(learning.ranked_by_hash(df, "y", "doc_id", "rank"))[1]
    assert "row_number() windowspecdefinition(y" in plan and "row_number() windowspecdefinition(y#" in plan and plan.count("__slice") > 0
    assert all("__slice" in line.split("ROWS")[0] or "row_number" not in line for line in plan.splitlines())


def test_records_render_texts_once(spark, sf_dir):
    from docloom.plans import tenders

    for name in ("build_record", "flatten_record"):
        plan = tenders.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("DISCIPLINARE DI GARA") == 1
