"""Tender texts rendered from the order tables, one document for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import amount_text
from docloom.shared import spread


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, lot, amount: line items of an order by number."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    # Dealt out by order once, over all tasks: sums by lot, lists by order and the join with orders all keep this partitioning, and texts are rendered and read in as many tasks.
    items = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", price.alias("price")), "l_orderkey")
    return items.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("lot")).agg(F.sum("price").cast("decimal(18,2)").alias("amount"))


def render_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, text, upload_ts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    digest = F.upper(F.sha2(key.cast("string"), 256))
    lot_text = lambda x: F.format_string("Lotto %d\nCIG: %s\nimporto lotto € %s", x["lot"], F.upper(F.substring(F.sha2(F.concat_ws("-", key, x["lot"]), 256), 1, 10)), amount_text(x["amount"]))
    row_text = lambda x: F.format_string("%d | Voce di capitolato %d | %d", x["lot"], x["lot"], x["lot"] * 5)
    # Only numbers are gathered; their text is made where the document is.
    parts = lots(spark, sf_dir).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("lot", "amount"))).alias("p"))
    date = lambda d, fmt="dd/MM/yyyy": F.date_format(d, fmt)
    tech = 60 + key % 31
    procedure = F.when(F.col("o_orderstatus") == "F", "aperta").when(F.col("o_orderstatus") == "O", "negoziata").otherwise("ristretta")
    text = F.concat_ws(
        "\n",
        F.lit("[Pagina 1]\nDISCIPLINARE DI GARA"),
        F.concat(F.lit("STAZIONE APPALTANTE: Comune di "), "n_name"),
        F.concat(F.lit("OGGETTO: Fornitura "), key.cast("string"), F.lit(" segmento "), "c_mktsegment"),
        F.concat(F.lit("CIG: "), F.substring(digest, 1, 10)),
        F.concat(F.lit("CUP: "), F.lit("C"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("B"), F.lpad(key.cast("string"), 8, "0")),
        F.concat(F.lit("CPV: "), F.lpad(key.cast("string"), 8, "0"), F.lit("-"), (key % 10).cast("string")),
        F.concat(F.lit("Procedura "), procedure),
        F.concat(F.lit("Criterio: "), F.when(key % 2 == 0, "offerta economicamente più vantaggiosa").otherwise("minor prezzo")),
        F.concat(F.lit("Importo complessivo dell'appalto\u00a0€ "), amount_text(F.col("o_totalprice").cast("decimal(18,2)"))),
        F.lit("Sommario ........................................ 3\n[Pagina 2]"),
        F.array_join(F.transform("p", lot_text), "\n"),
        F.lit("[TABELLA pag.2]"),
        F.array_join(F.transform("p", row_text), "\n"),
        F.lit("[Pagina 3]"),
        F.concat(F.lit("offerta tecnica: "), tech.cast("string"), F.lit(" punti")),
        F.concat(F.lit("offerta economica: "), (100 - tech).cast("string"), F.lit(" punti")),
        F.concat(F.lit("chiarimenti entro il "), date(F.date_sub("o_orderdate", 10)), F.lit(" ore 12:00")),
        F.concat(F.lit("Scadenza presentazione offerte: "), date("o_orderdate"), F.lit(" ore 12:30")),
        F.when(key % 3 == 0, "GARANZIA PROVVISORIA\nNon è dovuta.").otherwise("GARANZIA PROVVISORIA\nPari al 2% dell'importo."),
        F.when(key % 5 == 0, "SOPRALLUOGO\nIl sopralluogo è obbligatorio.").otherwise("SOPRALLUOGO\nIl sopralluogo non è previsto."),
        F.when(key % 4 == 0, "SUBAPPALTO\nIl subappalto non è ammesso.").otherwise("SUBAPPALTO\nIl subappalto è ammesso."),
        F.concat(F.lit("Durata del contratto: "), (12 + key % 24).cast("string"), F.lit(" mesi")),
        F.when(key % 7 == 0, "L'intervento è finanziato con fondi PNRR."),
    )
    # Customers are joined by key with a shuffle; nations are a fixed list of 25.
    base = orders.join(customer.hint("shuffle_merge"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    full = base.join(parts.hint("shuffle_merge"), "o_orderkey", "left")
    return full.select(key.cast("string").alias("doc_id"), F.concat(F.lit("disciplinare_"), key.cast("string"), F.lit(".txt")).alias("filename"), text.alias("text"), F.col("o_orderdate").alias("upload_ts"))
