"""Text structure: pages, sections, tables, lots and chunks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MARK = r"(?m)^(?:\[Pagina \d+\]|--- Pagina \d+ ---)\n?"
# Words that open a section of a rulebook.
SECTION_WORDS = ["GARANZIA PROVVISORIA", "SOPRALLUOGO", "SUBAPPALTO", "DISCIPLINARE DI GARA", "CRITERI DI VALUTAZIONE"]


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each page: page_num from 1, text, word_count."""
    parts = F.filter(F.split(text_col, PAGE_MARK), lambda x: F.trim(x) != "")
    out = docs.select(id_col, F.posexplode(parts).alias("p", "text"))
    return out.select(id_col, (F.col("p") + 1).alias("page_num"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"))


def page_of_value(pages_df: DataFrame, values: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first page of each (document, field, value): where it stands exactly, else where half of its long words do."""
    words = F.filter(F.split(F.lower("value"), r"\s+"), lambda w: F.length(w) > 4)
    both = values.select(id_col, "field", "value").join(pages_df.select(id_col, "page_num", F.lower("text").alias("t")).hint("shuffle_merge"), id_col)
    exact = F.min(F.when(F.instr("t", F.lower("value")) > 0, F.col("page_num")))
    near = F.min(F.when((F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.instr(F.col("t"), w) > 0)) * 2 >= F.size(words)), F.col("page_num")))
    return both.groupBy(id_col, "field", "value").agg(F.coalesce(exact, near).alias("page_num"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Runs of lines between headers, with the section that was open; short runs are dropped."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    header = F.trim("line").isin(*SECTION_WORDS) | F.col("line").rlike(r"^\s*(?:ART(?:ICOLO)?\.?|Art\.)\s*\d+") | F.col("line").rlike(r"^\s*\d+(?:\.\d+)*\.?\s+[A-ZÀ-Ú]{4,}")
    flagged = lines(docs, id_col, text_col).withColumn("header", F.when(header, F.trim("line")))
    placed = flagged.withColumns({"chunk": F.count("header").over(order), "section": F.last("header", ignorenulls=True).over(order)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = placed.groupBy(id_col, "chunk").agg(F.first("section", ignorenulls=True).alias("section"), text.alias("content"))
    return out.where(F.length(F.trim("content")) > min_chars)


def section_text(c: Column | str, starts: list[str], ends: list[str], cap: int = 4000) -> Column:
    """The text after the first of `starts` that opens a line and isn't in a table of contents, up to the nearest of `ends`."""
    t = F.col(c) if isinstance(c, str) else c
    head, stop = "|".join(starts), "|".join(ends) or r"\z"
    hit = F.regexp_extract(t, rf"(?isu)(?:^|\n)[ \t]*(?:{head})(?![^\n]*\.{{5}})[^\n]*\n(.{{0,{cap}}}?)(?=\n[ \t]*(?:{stop})|\z)", 1)
    return F.nullif(F.trim(hit), F.lit(""))


def _tables(text: Column) -> Column:
    """Pipe tables below a [TABELLA ...] mark, each an array of rows of trimmed cells."""
    blocks = F.regexp_extract_all(text, F.lit(r"\[TABELLA[^\]]*\]\n((?:[^\n]*\|[^\n]*\n?)+)"), 1)
    rows = lambda block: F.filter(F.split(block, "\n"), lambda x: x.contains("|"))
    return F.transform(blocks, lambda b: F.transform(rows(b), lambda r: F.transform(F.split(r, r"\|"), lambda x: F.trim(x))))


def table_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of pipe tables below a [TABELLA ...] mark: table_no, row_no, cells."""
    out = docs.select(id_col, F.posexplode(_tables(F.col(text_col))).alias("table_no", "rows"))
    return out.select(id_col, "table_no", F.posexplode("rows").alias("row_no", "cells"))


def table_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Records of pipe tables: table_no, record, cells. Rows whose first cell isn't a number join the record above, cell by cell.

    A table stands in one document's text, so its rows are put together there and no row is shuffled. Rows above the first number are record 0.
    """

    def records(rows: Column) -> Column:
        numbered = F.transform(rows, lambda r, i: F.struct(r.alias("cells"), i.alias("i")))
        first = F.filter(numbered, lambda x: F.get(x["cells"], F.lit(0)).rlike(r"^\d+$"))
        starts = F.concat(F.array(F.lit(0)), F.transform(first, lambda x: x["i"]))
        stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(rows)))
        return F.zip_with(starts, stops, lambda a, b: F.slice(rows, a + 1, b - a))

    def merged(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, lambda r: F.size(r)))
        column = lambda k: F.array_join(F.filter(F.transform(rows, lambda r: F.get(r, k)), lambda x: x != ""), " ")
        return F.transform(F.sequence(F.lit(0), width - 1), column)

    out = docs.select(id_col, F.posexplode(_tables(F.col(text_col))).alias("table_no", "rows"))
    each = out.select(id_col, "table_no", F.posexplode(records(F.col("rows"))).alias("record", "rows")).where(F.size("rows") > 0)
    return each.select(id_col, "table_no", F.col("record").cast("long").alias("record"), merged(F.col("rows")).alias("cells"))


def merge_continuations(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Table rows whose first cell isn't a number join the record above, cell by cell."""
    order = Window.partitionBy(id_col, "table_no").orderBy("row_no")
    marked = rows.withColumn("record", F.count(F.when(F.get("cells", F.lit(0)).rlike(r"^\d+$"), 1)).over(order))
    cells = marked.select(id_col, "table_no", "record", "row_no", F.posexplode("cells").alias("cell_no", "cell"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cell"))), lambda x: x["cell"]), lambda x: x != ""), " ")
    each = cells.groupBy(id_col, "table_no", "record", "cell_no").agg(joined.alias("cell"))
    return each.groupBy(id_col, "table_no", "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "cell"))), lambda x: x["cell"]).alias("cells"))


def _lot_parts(text: Column) -> Column:
    """The text from each `Lotto n`, wherever it stands, to the next one, as an array."""
    return F.filter(F.split(text, r"(?i)(?=\bLotto\s+\d+\b)"), lambda x: x.rlike(r"(?i)^Lotto\s+\d+\b"))


def _lot_number(segment: Column) -> Column:
    return F.regexp_extract(segment, r"(?i)^Lotto\s+(\d+)", 1).cast("int")


def lot_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 2000) -> DataFrame:
    """The text from each `Lotto n`, wherever it stands, to the next one."""
    out = docs.select(id_col, F.explode(_lot_parts(F.col(text_col))).alias("segment"))
    return out.select(id_col, _lot_number(F.col("segment")).alias("lot"), F.substring("segment", 1, cap).alias("segment"))


def lot_records(text: Column, fields: dict, cap: int = 2000) -> Column:
    """lot_segments() of one text as a sorted array of structs: lot, then fields(segment) by name."""
    each = lambda x: F.struct(_lot_number(x).alias("lot"), *[f(F.substring(x, 1, cap)).alias(k) for k, f in fields.items()])
    return F.array_sort(F.transform(_lot_parts(text), each))


def markdown_table(headers: list[str], rows: Column) -> Column:
    """Rows (arrays of text) as a Markdown table with padded columns."""
    n = len(headers)

    def longest(k: int) -> Column:
        return F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(F.coalesce(F.get(r, F.lit(k)), F.lit(""))))), F.lit(0))

    sizes = [F.greatest(F.lit(len(h)), longest(k)) for k, h in enumerate(headers)]

    def line(cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(c, s, " ") for c, s in zip(cells, sizes)]), F.lit(" |"))

    body = F.transform(rows, lambda r: line([F.coalesce(F.get(r, F.lit(k)), F.lit("")) for k in range(n)]))
    rule = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.repeat(F.lit("-"), s) for s in sizes]), F.lit(" |"))
    return F.array_join(F.concat(F.array(line([F.lit(h) for h in headers]), rule), body), "\n")
