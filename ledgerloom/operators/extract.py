"""From table cells to statement rows, and from extracted to confirmed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.headings import TITLE_LINES, detect_unit, first_heading_line, has_table_hint, is_contents_page, match_statement
from ledgerloom.functions.periods import has_any_value, has_year, keeps_row, label_cell, lettered_label_cell, values_by_period, year_headers
from ledgerloom.functions.text import clean_label
from ledgerloom.operators.hierarchy import classify_rows, infer_hierarchy
from ledgerloom.operators.selection import best_tables, first_of, grid_score, table_gate

REPORT = ["company_slug", "source_sha256", "source_fiscal_year", "statement"]


def rows_of_tables(cells: DataFrame, within: int = 5, *, fallback: bool = True) -> DataFrame:
    """Rows with a label and the values of each period column. The header is the first of the first rows that has a year, else row 0 or (without ``fallback``) the table is dropped."""
    table = Window.partitionBy("sha256", "table_idx")
    dated = F.when((F.col("row_idx") < within) & F.col("__dated"), F.col("row_idx"))
    header = F.coalesce(F.min(dated).over(table), F.lit(0) if fallback else F.lit(None).cast("int"))
    with_header = cells.withColumn("__dated", has_year(F.col("cells"))).withColumn("__header", header).where("__header is not null")
    years = F.max(F.when(F.col("row_idx") == F.col("__header"), year_headers(F.col("cells")))).over(table)
    body = with_header.withColumn("__years", years).where(F.col("row_idx") > F.col("__header")).where(keeps_row(F.col("cells"), F.col("__years"), F.col("__dated")))
    return body.select("sha256", "table_idx", "row_idx", label_cell(F.col("cells")).alias("raw_label"), values_by_period(F.col("cells"), F.col("__years")).alias("values_by_period_end"))


def statements_of(headings: DataFrame, rows: DataFrame) -> DataFrame:
    """For each document and kind the rows of its best table."""
    labels = rows.groupBy("sha256", "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "raw_label"))), lambda x: x["raw_label"]).alias("labels"))
    best = best_tables(headings.join(labels, ["sha256", "table_idx"])).select("sha256", "table_idx", F.col("kind").alias("statement"), "unit")
    return rows.join(best, ["sha256", "table_idx"])


def candidate_pages(pages: DataFrame, lines: int = TITLE_LINES) -> DataFrame:
    """The first page of each kind in a document that begins with the statement's title, is no table of contents and speaks of a table. ``pages``: sha256, page_idx, text."""
    told = pages.select("sha256", "page_idx", first_heading_line(F.col("text"), lines).alias("kind"), is_contents_page(F.col("text")).alias("contents"), has_table_hint(F.col("text")).alias("hint"), detect_unit(F.substring("text", 1, 2000)).alias("unit"))
    return first_of(told.where("kind is not null and not contents and hint"), ["sha256", "kind"], [F.col("page_idx")]).select("sha256", "kind", "page_idx", "unit")


def by_document(cells: DataFrame) -> DataFrame:
    """``cells`` dealt by their documents: what is told of tables, and the rows of the best ones, then come from one exchange."""
    return cells.select("sha256", "page_idx", "table_idx", "row_idx", "cells").repartition("sha256")


def rows_of_best(best: DataFrame, dealt: DataFrame) -> DataFrame:
    """The rows in ``dealt`` (see ``by_document``) of the tables that ``best`` names. Joined by document alone, as both are dealt; a join by page and table, too, would deal all rows again."""
    wanted = best.withColumnsRenamed({"page_idx": "__page", "table_idx": "__table"})
    own = F.col("page_idx").between(F.col("__page"), F.col("__page")) & F.col("table_idx").between(F.col("__table"), F.col("__table"))
    return wanted.join(dealt, "sha256").where(own).drop("__page", "__table")


def grid_statements(cells: DataFrame, headings: DataFrame, least_rows: int = 5, after: int = 1) -> DataFrame:
    """Rows of the best table near each heading's page (``headings``: sha256, kind, page_idx): on it or up to ``after`` pages further.

    Tables need three rows, two columns and a period column (``table_gate``); the highest ``grid_score`` wins, the first table on ties. A
    statement with fewer than ``least_rows`` rows is left to other extractors. ``cells``: sha256, page_idx, table_idx, row_idx, cells; row 0 is the header.
    """
    table = ["sha256", "page_idx", "table_idx"]
    years = F.size(F.filter(year_headers(F.col("cells")), lambda y: y.isNotNull()))
    digits = F.size(F.filter("cells", lambda c: c.rlike("[0-9]")))
    dated = F.greatest(F.max(F.when(F.col("row_idx") == 0, years)), F.lit(0))
    first = F.greatest(F.max(F.when(F.col("row_idx") == 1, years)), F.lit(0))
    body = F.col("row_idx") > 0
    dealt = by_document(cells)
    shapes = dealt.groupBy(*table).agg(F.count_if(body).alias("n"), F.max(F.size("cells")).alias("width"), F.when(dated > 0, dated).otherwise(first).alias("dated"), F.sum(F.when(body, digits).otherwise(0)).alias("digits"))
    gated = shapes.where(table_gate(F.col("n"), F.col("width"), F.col("dated")))
    near = gated.join(headings.select("sha256", "kind", F.col("page_idx").alias("heading")), "sha256").where(F.col("page_idx").between(F.col("heading"), F.col("heading") + after))
    scored = near.withColumn("score", grid_score(F.col("page_idx") == F.col("heading"), F.col("dated"), F.col("width"), F.col("digits"), F.col("n")))
    best = first_of(scored, ["sha256", "kind"], [F.col("score").desc(), F.col("page_idx"), F.col("table_idx")])
    rows = rows_of_best(best.select(*table, F.col("kind").alias("statement"), F.col("heading").alias("source_page")), dealt)
    header = Window.partitionBy("sha256", "statement")
    at = F.coalesce(F.min(F.when((F.col("row_idx") < 2) & has_year(F.col("cells")), F.col("row_idx"))).over(header), F.lit(0))
    named = rows.withColumn("__at", at).withColumn("__years", F.max(F.when(F.col("row_idx") == F.col("__at"), year_headers(F.col("cells")))).over(header)).where("row_idx > __at")
    label = lettered_label_cell(F.col("cells"))
    kept = named.where(F.exists("__years", lambda y: y.isNotNull())).select("sha256", "statement", "source_page", "table_idx", "row_idx", label.alias("raw_label"), values_by_period(F.col("cells"), F.col("__years")).alias("values_by_period_end")).where("raw_label is not null")
    return kept.withColumn("__n", F.count(F.lit(1)).over(header)).where(F.col("__n") >= least_rows).drop("__n")


#: Lines of a page that hold its title, rows of a table that hold its header, and rows of a table at least. Fixed values.
PAGE_TITLE_LINES, HEADER_ROWS, TABLE_ROWS = 6, 6, 3


def pdf_statements(pages: DataFrame, cells: DataFrame, after: int = 1) -> DataFrame:
    """Rows of the statements of page-oriented documents: ``sha256, statement, unit, source_page, table_idx, row_idx, raw_label, values_by_period_end``.

    A page whose first lines name a statement, and that is no table of contents, takes the best table of its own and the next ``after`` pages: the
    one with the most rows and cells with digits among those with a period header in their first rows, the first one on ties. Rows behind the header count if they have a label in their
    first cell and reach a period column. Of each kind the first page that gives rows counts. ``pages``: sha256, page_idx, text; ``cells`` (``schemas.TABLE_CELLS``) have all rows, the header's too.
    """
    table = ["sha256", "page_idx", "table_idx"]
    top = F.array_join(F.slice(F.split("text", r"\r\n|\r|\n"), 1, PAGE_TITLE_LINES), "\n")
    told = pages.select("sha256", "page_idx", match_statement(top).alias("statement"), is_contents_page(F.col("text")).alias("contents"), detect_unit(F.substring("text", 1, 2000)).alias("unit"))
    titled = told.where("statement is not null and not contents").select("sha256", "statement", "unit", F.col("page_idx").alias("source_page"))
    clean = by_document(cells).withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    digits = F.size(F.filter("cells", lambda c: c.rlike(r"\p{Nd}")))
    shapes = clean.groupBy(*table).agg(F.count(F.lit(1)).alias("n"), F.sum(digits).alias("digits"), F.min(F.when((F.col("row_idx") < HEADER_ROWS) & has_year(F.col("cells")), F.col("row_idx"))).alias("header"))
    gated = shapes.where((F.col("n") >= TABLE_ROWS) & F.col("header").isNotNull())
    near = gated.join(titled, "sha256").where(F.col("page_idx").between(F.col("source_page"), F.col("source_page") + after))
    best = first_of(near, ["sha256", "statement", "source_page"], [(F.col("n") + F.col("digits")).desc(), F.col("page_idx"), F.col("table_idx")])
    rows = rows_of_best(best.select(*table, "statement", "unit", "source_page", "header"), clean)
    own = Window.partitionBy("sha256", "statement", "source_page")
    dated = rows.withColumn("__years", F.max(F.when(F.col("row_idx") == F.col("header"), year_headers(F.col("cells")))).over(own)).where("row_idx > header")
    years = F.slice("__years", 1, F.size("cells"))
    # A row has values if it has a cell under a year.
    reached = dated.where((label_cell(F.col("cells")) != "") & F.exists(years, lambda y: y.isNotNull()))
    kept = reached.select("sha256", "statement", "unit", "source_page", "table_idx", "row_idx", label_cell(F.col("cells")).alias("raw_label"), values_by_period(F.col("cells"), years).alias("values_by_period_end"))
    return kept.withColumn("__first", F.min("source_page").over(Window.partitionBy("sha256", "statement"))).where("source_page = __first").drop("__first")


def confirm_rows(extracted: DataFrame) -> DataFrame:
    """Confirmation by rule: empty labels go, hierarchy is inferred, numbers become text."""
    kept = extracted.withColumn("label", clean_label(F.col("raw_label"))).where("label <> ''")
    ready = classify_rows(kept.withColumn("has_value", has_any_value(F.col("values_by_period_end"))), "raw_label")
    rows = infer_hierarchy(ready, REPORT, "row_idx", "raw_label")
    text = F.transform_values("values_by_period_end", lambda _, v: v.cast("string"))
    return rows.withColumn("values_by_period_end", text).withColumn("correct_kind", F.lit(True)).withColumn("confirmed_by", F.lit("rules")).drop("has_value", "raw_label")
