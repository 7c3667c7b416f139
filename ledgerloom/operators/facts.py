"""The store: upsert, reload, the consolidated view and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import CELL_KEYS, FACT_KEYS, LINE_KEYS


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: list[str] = FACT_KEYS, seq: str = "seq") -> DataFrame:
    """One row for each key: the last one written, by ``seq``; incoming rows come after existing ones. A top-1 window, which Spark limits before its shuffle."""
    rows = incoming.withColumn("__new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("__new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), F.col(seq).desc_nulls_last())
    return rows.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank", "__new")


def reset_company(existing: DataFrame, reloaded: DataFrame, slug: str | None = None, key: str = "company_slug") -> DataFrame:
    """Companies that were reloaded lose all their old rows; the others keep theirs."""
    old = existing.where(~F.col(key).eqNullSafe(slug)) if slug is not None else existing.join(reloaded.select(key).distinct(), key, "left_anti")
    return old.unionByName(reloaded, allowMissingColumns=True)


def write_facts(facts: DataFrame, path: str, parts: int = 16) -> None:
    """Replace the partitions of the companies in ``facts``; a crash leaves either the old or the new rows of a company.

    A company's lines are dealt to up to ``parts`` tasks, which small ones share: one company may hold a third of all rows.
    """
    part = F.pmod(F.xxhash64("statement", "canonical_name"), F.lit(parts))
    facts.repartition("company_slug", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_slug").parquet(path)


def consolidated(facts: DataFrame, keys: list[str] = CELL_KEYS, order: list[Column] | None = None, tolerance: str = "0.01", unit_aware: bool = False) -> DataFrame:
    """The newest filing's row of each cell, even if its value is null, and whether filings disagree by more than ``tolerance``.

    One shuffle and one sort: the row number and the aggregates share a window. ``unit_aware`` compares only values of one
    currency and unit with each other; by default raw values are compared, as they were filed.
    """
    newest = Window.partitionBy(*keys).orderBy(*(order or [F.col("source_fiscal_year").desc_nulls_last()]))
    cell = Window.partitionBy(*keys, *(["currency", "unit"] if unit_aware else []))
    restated = (F.count("value").over(cell) >= 2) & ((F.max("value").over(cell) - F.min("value").over(cell)) > F.lit(tolerance).cast("decimal(10,4)"))
    numbered = facts.withColumn("__rank", F.row_number().over(newest)).withColumn("__restated", restated)
    return numbered.where("__rank = 1").withColumn("is_restated", F.coalesce("__restated", F.lit(False))).drop("__rank", "__restated", "seq")


def consolidated_rows(line_items: DataFrame, cells: DataFrame) -> DataFrame:
    """Every line item with its cells (none: one row with nulls). Unordered: ``in_display_order`` sorts for a reader, sinks sort what they write."""
    return line_items.join(cells.drop("period_months", "source_sha256"), LINE_KEYS, "left")


def in_display_order(rows: DataFrame) -> DataFrame:
    """By company, statement and display order, newest period first; nulls last."""
    return rows.orderBy(F.col("company_slug").asc_nulls_last(), F.col("statement").asc_nulls_last(), F.col("display_order").asc_nulls_last(), F.col("period_end").desc_nulls_last())


def statement_rows(rows: DataFrame, company_slug: str, statement: str) -> DataFrame:
    """The rows of one statement: on a table partitioned by company only that partition is read."""
    return rows.where((F.col("company_slug") == company_slug) & (F.col("statement") == statement))


def statement_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("company_slug", "statement").agg(F.count(F.lit(1)).alias("n"))


def pivot_cells(rows: DataFrame) -> DataFrame:
    """One row for each line item with a map of period to (value, source year, restated); line items without cells keep an empty map."""
    cell = F.struct(F.col("period_end").cast("string").alias("key"), F.struct(F.col("value").cast("string").alias("value"), "source_fiscal_year", "is_restated").alias("value"))
    kept = ["depth", "parent_name", "is_header", "is_total", "display_order"]
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("period_end").isNotNull(), cell))))
    return rows.groupBy(*LINE_KEYS, *kept).agg(cells.alias("values"))


def document_header(rows: DataFrame) -> DataFrame:
    """Periods (newest first) and the first currency and unit met in row order."""
    order = F.struct(F.coalesce("display_order", F.lit(1 << 30)), F.date_diff(F.lit("9999-12-31").cast("date"), F.col("period_end")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    periods = F.reverse(F.array_sort(F.collect_set(F.col("period_end").cast("string")))).alias("periods")
    return rows.groupBy("company_slug", "statement").agg(first("currency"), first("unit"), periods, F.count_distinct("canonical_name").alias("n_rows"))


def statement_documents(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """One nested document for each company and statement; ``rows`` as of ``consolidated_rows``, section headers added."""
    from ledgerloom.operators.hierarchy import inject_sections

    lines = inject_sections(pivot_cells(rows), ["company_slug", "statement"])
    line = F.struct("display_order", "canonical_name", "depth", "is_header", "is_total", "parent_name", F.coalesce("values", F.expr("cast(map() as map<string,struct<value:string,source_fiscal_year:int,is_restated:boolean>>)")).alias("values"))
    body = lines.groupBy("company_slug", "statement").agg(F.array_sort(F.collect_list(line), lambda x, y: x["display_order"] - y["display_order"]).alias("rows"))
    names = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"), "ticker", "exchange")
    return body.join(document_header(rows), ["company_slug", "statement"]).join(names, "company_slug", "left").drop("n_rows")


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON text under company_slug=/statement=."""
    value = F.to_json(F.struct(*[c for c in documents.columns])).alias("value")
    documents.select("company_slug", "statement", value).write.mode("overwrite").partitionBy("company_slug", "statement").text(path)


def document_index(companies: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All companies with ``has_data``, and one row for each document."""
    have = documents.select(F.col("company_slug").alias("slug")).distinct().withColumn("has_data", F.lit(True))
    named = companies.drop("sources", "shares_outstanding_m", "market_ticker").join(have, "slug", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    return named, documents.select("company_slug", F.col("company").alias("company_name"), "ticker", "statement", "periods", F.size("rows").alias("rows"))


def company_coverage(companies: DataFrame, index: DataFrame) -> DataFrame:
    """Per company its statements, all periods (newest first) and a span text; companies without any are kept."""
    own = index.groupBy(F.col("company_slug").alias("slug")).agg(F.array_sort(F.collect_set("statement")).alias("statements"), F.flatten(F.collect_list("periods")).alias("p"))
    years = F.array_sort(F.array_distinct(F.transform("p", lambda x: F.substring(x, 1, 4))))
    n = F.size(years)
    span = F.when(n > 0, F.concat(F.get(years, F.lit(0)), F.lit("–"), F.get(years, n - 1), F.lit(" · "), n.cast("string"), F.lit(" yrs")))
    return companies.select("slug", "name").join(own, "slug", "left").select("slug", "name", "statements", F.reverse(F.array_sort(F.array_distinct("p"))).alias("periods"), span.alias("coverage"))
