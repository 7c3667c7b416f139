"""Stages from the command line: ``python -m ledgerloom.cli STAGE --in ... --out ...``. Each reads what the one before wrote:

scrape (entry pages and addresses of the configuration) -> classify -> parse -> confirm -> normalize -> build -> export; ``companies``, ``add``, ``research`` and
``market`` stand beside the chain. Search, models and other fetchers are the caller's (``operators.providers``, ``operators.models``).
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import os
import pathlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import headings as H
from ledgerloom.functions import links as L
from ledgerloom.functions import reports as R
from ledgerloom.functions.text import label_slug
from ledgerloom.operators import extract, facts, frontier, ingest, market, models, providers, selection, taxonomy
from ledgerloom.operators.calls import CallTable, Respond
from ledgerloom.session import session
from ledgerloom.sources import files, html_tables


def configured(spark: SparkSession, path: str) -> DataFrame:
    return files.companies_from_yaml(spark, pathlib.Path(path).read_text())


def companies_(spark, a):
    configured(spark, a.companies).write.mode("overwrite").json(a.output)


def add(spark, a):
    """Adds a company, or addresses to its first source; the configuration is a small file and is replaced in one step."""
    path = pathlib.Path(a.companies)
    text = path.read_text() if path.exists() else ""
    if a.name:
        text = files.upsert_company_yaml(text, a.slug, {"name": a.name, "sources": [{"name": "direct", "direct_urls": a.url}]})
    else:
        text = files.append_direct_urls(text, a.slug, a.url)
    files.companies_from_yaml(spark, text)  # raises before anything is written
    staged = path.with_suffix(".new")
    staged.write_text(text)
    os.replace(staged, path)


def fetched(urls: DataFrame) -> DataFrame:
    """What the addresses of ``urls`` answer."""
    return urls.repartition("url").mapInPandas(providers.fetch_first([providers.UrlStrategy()], wait=0.5), providers.FETCH_SCHEMA)


def fetched_pages(urls: DataFrame) -> DataFrame:
    got = fetched(urls)
    bad = F.col("status") >= 400
    return got.select("url", F.when(F.col("error").isNull() & ~F.coalesce(bad, F.lit(True)), F.decode("body", "utf-8")).alias("html"), F.coalesce("error", F.when(F.coalesce(bad, F.lit(True)), F.concat_ws(" ", F.lit("status"), F.col("status").cast("string")))).alias("error"))


def scrape(spark, a):
    """Crawls each source from its entry pages by its own patterns, gets the documents, and adds them to what earlier runs have in ``--out``."""
    sources = frontier.sources_of(configured(spark, a.companies))
    run = uuid.uuid4().hex
    candidates, pages = frontier.crawl_sources(sources, frontier.PageStore(spark, f"{a.output}/pages/run={run}", fetched_pages))
    candidates.write.parquet(f"{a.output}/candidates/run={run}")
    candidates = spark.read.schema(candidates.schema).parquet(f"{a.output}/candidates/run={run}")
    wanted = ingest.with_limit(candidates, 0 if a.discover_only else a.limit)
    fetched(wanted.select("url").distinct()).write.parquet(f"{a.output}/fetched/run={run}")
    got = spark.read.schema(providers.FETCH_SCHEMA).parquet(f"{a.output}/fetched/run={run}")
    found = candidates.groupBy(*frontier.SOURCE).agg(F.count(F.lit(1)).alias("found"))
    ingest.scrape_run(sources, wanted, found, pages, got, a.output, discover_only=a.discover_only)


def html_of(spark: SparkSession, path: str) -> DataFrame:
    contents = spark.read.parquet(f"{path}/contents")
    return contents.select("sha256", F.decode("content", "utf-8").alias("html")).where(F.lower(F.substring("html", 1, 2000)).contains("<html") | F.lower("html").contains("<table"))


def responder(name: str) -> Respond:
    """The caller's function ``module:function``, which turns request texts into response texts; executors must be able to import it."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def calls_of(spark: SparkSession, a) -> CallTable:
    return CallTable(spark, a.calls or f"{a.output}/calls")


def classify(spark, a):
    """By names, by the front matter where names leave a doubt, and by a model (``--model``) where that does. ``--in``: the folder that scrape wrote."""
    docs = files.read_stage(spark, f"{a.input}/manifest", schemas.SCRAPED).withColumn("company_slug", label_slug(F.col("label")))
    ruled = docs.withColumn("__text", R.haystack(F.col("source_url"), F.col("local_path"), F.col("link_text"))).withColumn("__c", R.classify(F.col("__text"), R.matched_rule(F.col("__text"))))
    named = ruled.select("sha256", "source_url", "local_path", "company_slug", "link_text", "size_bytes", "ord", "__c.*")
    front = html_of(spark, a.input).select("sha256", F.lower(H.front_matter(H.html_text(F.col("html")))).alias("front"))
    sniffed = front.withColumn("c", R.classify(F.col("front"), R.matched_rule(F.col("front")))).select("sha256", "c.*")
    if a.model:
        unsure = selection.classify_cascade(named, sniffed).where(R.needs_model(F.col("confidence")))
        answers, _ = models.classify_by_model(unsure.select("sha256", "link_text").dropDuplicates(["sha256"]), front.select("sha256", F.col("front").alias("text")), calls_of(spark, a), responder(a.model), a.model)
        files.write_stage(selection.classify_cascade(named, sniffed, answers), a.output)
    else:
        files.write_stage(selection.classify_cascade(named, sniffed), a.output)


def parse(spark, a):
    """The first annual document of each company and year that holds a statement. ``--in``: scrape's folder, ``--classified``: classify's output."""
    docs = files.read_stage(spark, a.classified, schemas.CLASSIFIED)
    html = html_of(spark, a.input).join(docs.select("sha256").distinct(), "sha256", "left_semi")
    scanned = html_tables.scanned(html, f"{a.output}/scan")
    rows = extract.statements_of(html_tables.statement_headings(scanned), extract.rows_of_tables(html_tables.table_cells(scanned)))
    counted = rows.groupBy("sha256").agg(F.count_distinct("statement").alias("n_statements"))
    chosen = selection.first_success(selection.rank_candidates(docs), counted).select("sha256", "company_slug", "fiscal_year")
    currency = configured(spark, a.companies).select(F.col("slug").alias("company_slug"), F.col("reporting_currency").alias("currency"))
    whole = rows.join(chosen, "sha256").join(currency, "company_slug", "left")
    whole.select(
        "company_slug", F.col("sha256").alias("source_sha256"), F.col("fiscal_year").alias("source_fiscal_year"), "statement", "currency", "unit", F.lit(12).alias("period_months"), "row_idx", "raw_label", "values_by_period_end",
        F.lit(None).cast("int").alias("source_page"), F.col("table_idx").alias("source_table_index"),
    ).write.mode("overwrite").parquet(f"{a.output}/rows")


def confirm(spark, a):
    """By rule, or by a model (``--model``), and by rule where it fails."""
    rows = spark.read.parquet(f"{a.input}/rows")
    confirmed = models.confirm_by_model(rows, calls_of(spark, a), responder(a.model), a.model)[0] if a.model else extract.confirm_rows(rows)
    confirmed.write.mode("overwrite").parquet(f"{a.output}/rows")


def normalize(spark, a):
    """Facts, and the line items of each taxonomy. Labels that fit no name are mapped by a model (``--model``), if to a name that exists."""
    rows = spark.read.parquet(f"{a.input}/rows")
    reports = rows.groupBy(*taxonomy.GROUP, "source_sha256", "source_fiscal_year").agg(F.count(F.lit(1)).alias("n_rows"), F.min("source_sha256").alias("ord"))
    chosen = taxonomy.taxonomy_source(reports).select(*taxonomy.GROUP, "source_sha256")
    items = taxonomy.taxonomy(rows.join(chosen, [*taxonomy.GROUP, "source_sha256"], "left_semi"))
    taxonomy.line_items(items).write.mode("overwrite").parquet(f"{a.output}/items")
    drift = models.drift_by_model(rows, items, calls_of(spark, a), responder(a.model), a.model)[0] if a.model else None
    taxonomy.to_facts(taxonomy.resolve_labels(rows, items, drift)).write.mode("overwrite").parquet(f"{a.output}/facts")


def build(spark, a):
    """The store's companies that came again lose their old rows. ``--in``: normalize's folder."""
    facts.write_facts(facts.upsert(None, spark.read.parquet(f"{a.input}/facts")), f"{a.output}/facts")
    facts.write_facts(spark.read.parquet(f"{a.input}/items"), f"{a.output}/items")


def export(spark, a):
    """Documents and their index. ``--in``: the store."""
    stored = files.read_facts(spark, f"{a.input}/facts")
    items = spark.read.schema(schemas.LINE_ITEMS).parquet(f"{a.input}/items")
    companies = configured(spark, a.companies)
    documents = facts.statement_documents(facts.consolidated_rows(items, facts.consolidated(stored)), companies)
    facts.write_documents(documents, f"{a.output}/documents")
    files.write_index(*facts.document_index(companies, documents), f"{a.output}/index")


def research(spark, a):
    """Years without an annual document, for all configured companies. ``--in``: classify's output."""
    have = files.read_or_none(lambda: files.read_stage(spark, a.input, schemas.CLASSIFIED))
    have = spark.createDataFrame([], schemas.CLASSIFIED) if have is None else have
    selection.coverage_gaps(have, configured(spark, a.companies).select("slug"), a.year).write.mode("overwrite").json(a.output)


def market_(spark, a):
    """Market records from quotes (JSON lines: ticker, price, currency, previous_close, sparkline)."""
    quotes = spark.read.schema("ticker string, price double, currency string, previous_close double, sparkline array<double>").json(a.input)
    files.write_market(market.market_records(quotes, configured(spark, a.companies), F.unix_timestamp()), a.output)


STAGES = {f.__name__.rstrip("_"): f for f in (companies_, add, scrape, classify, parse, confirm, normalize, build, export, research, market_)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--in", dest="input")
    p.add_argument("--out", dest="output")
    p.add_argument("--companies", help="company configuration in YAML")
    p.add_argument("--classified", help="output of classify (parse)")
    p.add_argument("--slug", help="the company (add)")
    p.add_argument("--name", help="its name, if it is new (add)")
    p.add_argument("--url", action="append", default=[], help="an address (add)")
    p.add_argument("--model", help="a function module:function that answers requests (classify, confirm, normalize)")
    p.add_argument("--calls", help="folder of answers that all stages share; else one in --out")
    p.add_argument("--limit", type=int, help="documents of a source to get at most (scrape)")
    p.add_argument("--discover-only", action="store_true", help="find documents, get none (scrape)")
    p.add_argument("--year", type=int, default=datetime.date.today().year, help="the current year (research)")
    a = p.parse_args(argv)
    STAGES[a.stage](spark or session(), a)


if __name__ == "__main__":
    main()
