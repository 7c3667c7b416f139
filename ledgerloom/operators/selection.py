"""Choosing among documents, tables, pages and extraction tiers: all top-1 windows, set operations and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.headings import ROW_SIGNALS, contains_any, signal_hits

# Fixed values.
TYPE_HINTS = ("registration document", "urd", "form 20-f", "annual report")
ENGLISH_HINTS = ("_uk.", "-uk.", "_uk_", "uk_", "_eng", "-eng", "english")
LARGE_BYTES = 8 * 1024 * 1024
PUBLISHABLE_CONFIDENCE = 0.5
TIERS = ("heuristic", "vision", "text")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return numbered(rows, keys, order, "__rank").where("__rank = 1").drop("__rank")


#: How many go to a verifier or a model at most: lines of a statement, pages of a document, filings of a company. Fixed values.
MOST_LINES, MOST_PAGES, MOST_FILINGS = 60, 12, 20


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """Of each key the first ``most`` rows."""
    return numbered(rows, keys, order, "place").where(F.col("place") <= most)


def of_company(docs: DataFrame, slug: str) -> DataFrame:
    """``docs`` as documents of one company, whatever was written before."""
    return docs.withColumn("company_slug", F.lit(slug))


def newest_first(docs: DataFrame) -> DataFrame:
    """Each company's documents with the place at which their year comes up."""
    return docs.withColumn("turn", F.dense_rank().over(Window.partitionBy("company_slug").orderBy(F.col("fiscal_year").desc_nulls_last())))


def annual_with_year(docs: DataFrame) -> DataFrame:
    return docs.where("kind = 'annual' and coalesce(fiscal_year, 0) <> 0")


def rank_candidates(docs: DataFrame) -> DataFrame:
    """Documents of a company and year, best first: type hint, English hint, confidence, size; ties keep input order (``ord``)."""
    link = F.lower(F.coalesce("link_text", F.lit("")))
    english = contains_any(link, ENGLISH_HINTS) | contains_any(F.lower("local_path"), ENGLISH_HINTS) | contains_any(F.lower("source_url"), ENGLISH_HINTS)
    order = [contains_any(link, TYPE_HINTS).desc(), english.desc(), F.col("confidence").desc_nulls_last(), (F.col("size_bytes") > LARGE_BYTES).desc(), F.col("ord")]
    return numbered(annual_with_year(docs), ["company_slug", "fiscal_year"], order)


def first_success(ranked: DataFrame, extracted: DataFrame) -> DataFrame:
    """Of each company and year the first ranked document with at least one statement. ``extracted``: sha256, n_statements."""
    useful = ranked.join(extracted.where("n_statements > 0").select("sha256", "n_statements"), "sha256")
    return first_of(useful, ["company_slug", "fiscal_year"], [F.col("rank")])


def publishable(verdict_missing: Column | None = None) -> Column:
    """The verdict has the right kind, no critical issue and enough confidence; a missing verdict (``verdict_missing``) passes."""
    ok = F.col("is_correct_kind") & ~F.exists("issues", lambda i: i["severity"] == "critical") & (F.col("confidence") >= PUBLISHABLE_CONFIDENCE)
    return ok if verdict_missing is None else verdict_missing | ok


def merge_tiers(rows: DataFrame, *, with_model: bool = True) -> DataFrame:
    """One tier's statement for each document and kind. ``rows``: source_sha256, statement, tier and the verdict's columns.

    Heuristic and vision results need a publishable verdict; text results fill what is still absent without one.
    Without a model every heuristic result is taken.
    """
    if not with_model:
        return rows.where("tier = 'heuristic'")
    accepted = rows.where((F.col("tier") == "text") | F.coalesce(publishable(F.col("confidence").isNull()), F.lit(False)))
    priority = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return first_of(accepted, ["source_sha256", "statement"], [priority])


def merge_extractors(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("source_sha256", "statement")) -> DataFrame:
    """All of ``first``, and of ``second`` the kinds that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def missing_kinds(accepted: Column, needs_vision: Column, kinds: tuple[str, ...] = ("income", "balance", "cashflow")) -> Column:
    """(all kinds - accepted) and those that a verdict sent back."""
    return F.array_sort(F.array_union(F.array_except(F.array(*[F.lit(k) for k in kinds]), accepted), needs_vision))


def best_tables(tables: DataFrame) -> DataFrame:
    """The table with the highest score for each document and kind, the first one on ties. ``tables``: sha256, kind, ord, labels (array)."""
    text = F.lower(F.array_join("labels", " "))
    hits = F.lit(0)
    for kind in ROW_SIGNALS:
        hits = F.when(F.col("kind") == kind, signal_hits(text, kind)).otherwise(hits)
    scored = tables.withColumn("score", 10 * hits + F.size("labels"))
    return first_of(scored, ["sha256", "kind"], [F.col("score").desc(), F.col("ord")])


def grid_score(on_heading_page: Column, year_columns: Column, columns: Column, digit_cells: Column, rows: Column) -> Column:
    """The share of period columns counts with its fraction: it tells tables apart that differ in nothing else."""
    return 1000 * on_heading_page.cast("int") + 500 * (year_columns / columns) + 10 * year_columns + digit_cells + rows


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of each kind in a document. ``pages``: sha256, page_idx, kind."""
    return pages.where("kind is not null").groupBy("sha256", "kind").agg(F.min("page_idx").alias("page_idx"))


def header_rows(cells: DataFrame, within: int, fallback: bool) -> DataFrame:
    """The header row of each table: the first of its first rows that has a year; else row 0 (``fallback``) or none."""
    from ledgerloom.functions.periods import has_year

    dated = F.when(has_year(F.col("cells")) & (F.col("row_idx") < within), F.col("row_idx"))
    found = cells.groupBy("sha256", "page_idx", "table_idx").agg(F.min(dated).alias("header_row"))
    return found.withColumn("header_row", F.coalesce("header_row", F.lit(0))) if fallback else found.where("header_row is not null")


def coverage_gaps(have: DataFrame, companies: DataFrame, this_year: int, span: int = 10) -> DataFrame:
    """Company and year without an annual document among the ``span`` years before ``this_year``."""
    wanted = companies.select(F.col("slug").alias("company_slug")).distinct().select("company_slug", F.explode(F.sequence(F.lit(this_year - span), F.lit(this_year - 1))).alias("fiscal_year"))
    return wanted.join(annual_with_year(have).select("company_slug", "fiscal_year").distinct(), ["company_slug", "fiscal_year"], "left_anti")


def kind_summary(docs: DataFrame) -> DataFrame:
    """Per company and kind the number of documents; annual rows also have their distinct years in order."""
    years = F.array_sort(F.collect_set(F.when((F.col("kind") == "annual") & (F.coalesce("fiscal_year", F.lit(0)) != 0), F.col("fiscal_year"))))
    return docs.groupBy("company_slug", "kind").agg(F.count(F.lit(1)).alias("n"), years.alias("years"))


def order_picks(picks: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Reachable picks (by their address or an archived copy), known years first and newest first; of equal addresses the first."""
    url = F.when(F.col("reachable"), F.col("url")).otherwise(F.col("snapshot_url"))
    kept = picks.withColumn("url", url).where("url is not null")
    if years:
        kept = kept.where(F.col("fiscal_year").isNull() | F.col("fiscal_year").isin(*years))
    order = [F.col("fiscal_year").isNull(), F.col("fiscal_year").desc_nulls_last(), F.col("ord")]
    return numbered(first_of(kept, ["company_slug", "url"], order), ["company_slug"], order, "position")


def found_gate(claimed: Column, has_search: Column, valid_pdfs: Column, ir_reachable: Column) -> Column:
    """Whether a company counts as found: without a claim and without search as claimed; with a valid document yes; else an unreachable page refutes it."""
    return F.when(~claimed & ~has_search, claimed).when(valid_pdfs > 0, True).when(~ir_reachable, False).otherwise(claimed)


def preferred_input(confirmed: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed rows where a key has them, else the extracted ones."""
    return confirmed.unionByName(extracted.join(confirmed.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def classify_cascade(docs: DataFrame, sniffed: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Rules first, then the front matter's text, then a model: each later step only where the one before was unsure.

    ``docs``: sha256, kind, fiscal_year, confidence (by name rules), local_path; ``sniffed`` has the same classification of
    each document's front matter, ``model`` a model's answers (a failed call has no row). ``classified_by`` names the
    step that counted.
    """
    from ledgerloom.functions.reports import needs_model, needs_sniff

    kept = [c for c in docs.columns if c not in ("kind", "fiscal_year", "confidence")]
    s = sniffed.select("sha256", F.col("kind").alias("s_kind"), F.nullif("fiscal_year", F.lit(0)).alias("s_year"), F.col("confidence").alias("s_conf"))
    own = docs.join(s, "sha256", "left")
    surer = F.coalesce(F.col("s_conf") > F.col("confidence"), F.lit(False))
    taken = needs_sniff(F.col("confidence"), F.col("fiscal_year"), F.col("local_path")) & (surer | (F.col("fiscal_year").isNull() & F.col("s_year").isNotNull()))
    step = own.select(
        *kept, F.when(taken & surer, F.col("s_kind")).otherwise(F.col("kind")).alias("kind"), F.when(taken, F.coalesce("s_year", "fiscal_year")).otherwise(F.col("fiscal_year")).alias("fiscal_year"),
        F.when(taken, F.greatest("confidence", "s_conf")).otherwise(F.col("confidence")).alias("confidence"), F.when(taken, "rules+sniff").otherwise("rules").alias("classified_by"),
    )
    if model is None:
        return step
    m = model.select("sha256", F.struct("kind", "fiscal_year", "confidence").alias("__m"))
    asked = needs_model(F.col("confidence")) & F.col("__m").isNotNull()
    pick = lambda c: F.when(asked, F.col(f"__m.{c}")).otherwise(F.col(c)).alias(c)
    return step.join(m, "sha256", "left").select(*kept, pick("kind"), pick("fiscal_year"), pick("confidence"), F.when(asked, "model").otherwise(F.col("classified_by")).alias("classified_by"))


def table_gate(rows: Column, columns: Column, year_columns: Column, *, least_rows: int = 3, least_columns: int = 2) -> Column:
    """Large enough to be a statement, with a period column."""
    return (rows >= least_rows) & (columns >= least_columns) & (year_columns >= 1)
