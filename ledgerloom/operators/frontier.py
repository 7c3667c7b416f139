"""Crawls by levels: each source's pages are fetched, its links are followed by its own patterns, and every level is written before the next one starts.

A page store keeps each page once, whatever number of sources and levels come across it, and what failed with its error; a crawl that is
broken off goes on with the pages it has. Within a source, pages come up level by level, in the order of the links that led to them: a link's
place is the list of the places on the way to it, so that no window over a whole source is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import links as L
from ledgerloom.operators.selection import first_of
from ledgerloom.sources import files

#: Takes distinct addresses (url); returns url, html and error: one row for each address that was tried.
Fetch = Callable[[DataFrame], DataFrame]
PAGES = "url string, html string, error string"
SOURCE = ["slug", "source_name"]
DEEPEST = 3


class PageStore:
    """Pages by address in a folder that all executors share; it only grows."""

    def __init__(self, spark: SparkSession, path: str, fetch: Fetch):
        self.spark, self.path, self.fetch = spark, path, fetch

    def read(self) -> DataFrame:
        found = files.read_or_none(lambda: self.spark.read.schema(PAGES).parquet(self.path))
        return self.spark.createDataFrame([], PAGES) if found is None else found

    def ensure(self, urls: DataFrame) -> None:
        """Fetches and appends the addresses of ``urls`` that the store doesn't have; those that failed in an earlier run are tried again by the next store of the folder only."""
        missing = urls.select("url").where("url is not null").distinct().join(self.read().select("url"), "url", "left_anti")
        got = self.fetch(missing).select("url", F.col("html").cast("string").alias("html"), F.col("error").cast("string").alias("error"))
        first_of(got, ["url"], [F.col("html").isNull(), F.col("html"), F.col("error")]).write.mode("append").parquet(self.path)

    def pages(self, urls: DataFrame) -> DataFrame:
        """``url, html, error`` of the addresses of ``urls``."""
        return self.read().join(urls.select("url").distinct(), "url", "left_semi")


def hyperlinks(pages: DataFrame, url: str = "url") -> DataFrame:
    """``url, ord, link, text`` of each page's links with an address: resolved, with the text between the tags (null if there is none)."""
    found = pages.select(url, F.posexplode(L.linked_elements(F.col("html"))).alias("ord", "element"))
    href = L.unescaped(L.anchor_href(F.col("element")))
    return found.select(url, "ord", L.resolve(F.col(url), href).alias("link"), L.element_text(F.col("element")).alias("text")).where("link is not null")


def sources_of(companies: DataFrame) -> DataFrame:
    """One row for each configured source: ``slug, source_name, label, entry_urls, direct_urls, link_filter, follow_links, max_follow_depth``."""
    none = F.array().cast("array<string>")
    rows = companies.select("slug", F.posexplode("sources").alias("n", "s"))
    return rows.select(
        "slug", "n", F.col("s.name").alias("source_name"), F.coalesce("s.label", F.concat_ws(":", "slug", "s.name")).alias("label"), F.coalesce("s.entry_urls", none).alias("entry_urls"), F.coalesce("s.direct_urls", none).alias("direct_urls"),
        F.coalesce("s.link_filter", F.lit(L.DOCUMENT_LINK)).alias("link_filter"), F.nullif("s.follow_links", F.lit("")).alias("follow_links"), F.least(F.coalesce("s.max_follow_depth", F.lit(1)), F.lit(DEEPEST)).alias("max_follow_depth"),
    )


def first_by_place(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row with the smallest place. An aggregation: what many pages link to is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "place")]
    return rows.groupBy(*keys).agg(F.min(F.struct("place", *rest)).alias("__r")).select(*keys, "__r.*")


def crawl_sources(sources: DataFrame, store: PageStore) -> tuple[DataFrame, DataFrame]:
    """Document candidates of ``sources`` (``sources_of``), and the pages that were visited.

    Candidates: slug, source_name, url, page_url, link_text, depth (null for configured addresses, which come first), place. A link is a document
    if the source's ``link_filter`` is found in its address; else it is followed if ``follow_links`` is found there, the page's
    depth is less than ``max_follow_depth`` and the source hasn't come to it before. A page without an answer has no links. Pages: slug, source_name, url, depth, place, error.
    """
    spark = store.spark
    root = files.scratch(spark, f"crawl-{uuid.uuid4().hex}")
    patterns = sources.select(*SOURCE, "link_filter", "follow_links", "max_follow_depth")
    entries = sources.select(*SOURCE, F.posexplode("entry_urls").alias("k", "url")).select(*SOURCE, "url", F.array("k").alias("place"))
    direct = sources.select(*SOURCE, F.posexplode("direct_urls").alias("k", "url")).select(*SOURCE, "url", F.array("k").alias("place"))
    level = first_by_place(entries.where("url is not null"), [*SOURCE, "url"])
    frontier = seen = None
    none = F.lit(None)
    found = [direct.where("url is not null").select(*SOURCE, "url", F.col("url").alias("page_url"), none.cast("string").alias("link_text"), none.cast("int").alias("depth"), "place")]
    visited = []
    for depth in range(DEEPEST + 1):
        level.select(*SOURCE, "url", "place").write.parquet(f"{root}/frontier-{depth}")
        frontier = spark.read.parquet(f"{root}/frontier-{depth}")
        if frontier.isEmpty():
            break
        seen = frontier.select(*SOURCE, "url") if seen is None else seen.unionByName(frontier.select(*SOURCE, "url"))
        store.ensure(frontier)
        pages = store.pages(frontier)
        visited.append(frontier.join(pages.select("url", "error"), "url", "left").withColumn("depth", F.lit(depth)))
        # A page's links are taken once, however many sources visit it; each source then judges them by its own patterns.
        hyperlinks(pages.where("html is not null")).write.parquet(f"{root}/links-{depth}")
        links = spark.read.parquet(f"{root}/links-{depth}").withColumnRenamed("url", "page_url")
        here = frontier.join(patterns, SOURCE).withColumnRenamed("url", "page_url").join(links, "page_url").withColumn("place", F.concat("place", F.array("ord")))
        told = here.withColumn("document", F.regexp_like("link", F.col("link_filter")))
        told.select(*SOURCE, F.col("link").alias("url"), "page_url", F.col("text").alias("link_text"), "place", "document", (~F.col("document") & F.coalesce(F.regexp_like("link", F.col("follow_links")), F.lit(False)) & (F.col("max_follow_depth") > depth)).alias("followed")).where(
            "document or followed"
        ).write.parquet(f"{root}/judged-{depth}")
        judged = spark.read.parquet(f"{root}/judged-{depth}")
        found.append(first_by_place(judged.where("document").select(*SOURCE, "url", "page_url", "link_text", F.lit(depth).alias("depth"), "place"), [*SOURCE, "url"]))
        level = first_by_place(judged.where("followed").select(*SOURCE, "url", "place"), [*SOURCE, "url"]).join(seen, [*SOURCE, "url"], "left_anti")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    order = [F.col("depth").isNotNull(), F.col("depth"), F.col("place")]
    first = whole.groupBy(*SOURCE, "url").agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "page_url", "link_text")).alias("r"))
    candidates = first.select(*SOURCE, "url", "r.page_url", "r.link_text", F.col("r.o1").alias("depth"), F.col("r.o2").alias("place"))
    pages = visited[0] if visited else frontier.withColumn("error", none.cast("string")).withColumn("depth", none.cast("int"))
    for part in visited[1:]:
        pages = pages.unionByName(part)
    return candidates, pages.select(*SOURCE, "url", "depth", "place", "error")


def in_order() -> list[Column]:
    """How candidates of a source follow each other: configured ones, then level by level as their links do."""
    return [F.col("depth").isNotNull(), F.col("depth"), F.col("place")]
