"""Links of crawled pages, documents by content, and bounded crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import links as L
from ledgerloom.operators.search import first_containing
from ledgerloom.operators.selection import first_of


def page_links(pages: DataFrame, *kept: str) -> DataFrame:
    """``page_url, seed_url, ord, label, url`` of each page's hyperlinks, resolved, and the columns ``kept`` of the page: an address may have several pages."""
    own = ["page_url", "seed_url", *kept]
    tags = pages.select(*own, F.posexplode(L.anchors(F.col("html"))).alias("ord", "tag"))
    return tags.select(*own, "ord", L.anchor_label(F.col("tag")).alias("label"), L.resolve(F.col("page_url"), L.anchor_href(F.col("tag"))).alias("url"))


def of_same_org(links: DataFrame, rules: DataFrame | None) -> DataFrame:
    """The rows of ``links`` (url, seed_url) whose address belongs to the seed's organisation: with a table of public suffixes ``rules`` by the registered domains that it tells.

    Each distinct host is resolved once and joined back. Hosts without a registered domain, such as suffixes themselves, belong only to themselves.
    """
    if rules is None:
        return links.where(L.same_org(F.col("url"), F.col("seed_url")))
    hosted = links.withColumn("__a", L.host(F.col("url"))).withColumn("__b", L.host(F.col("seed_url")))
    hosts = hosted.select(F.explode(F.array("__a", "__b")).alias("host")).where("host is not null").distinct()
    domains = registered_domains(hosts, rules).select("host", F.coalesce("domain", F.concat(F.lit("="), "host")).alias("domain"))
    side = lambda c: domains.select(F.col("host").alias(c), F.col("domain").alias(f"{c}_domain"))
    return hosted.join(side("__a"), "__a").join(side("__b"), "__b").where("__a_domain = __b_domain").select(*links.columns)


def pdf_links(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Document links to the seed's organisation (see ``of_same_org``): anchors first, then addresses in other attributes; of equal ones the first."""
    title = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("(IR page anchor)"))
    anchors = page_links(pages).where(L.looks_like_pdf(F.col("url"))).select("page_url", "seed_url", "url", title.alias("title"), F.lit(0).alias("source"), "ord")
    other = pages.select("page_url", "seed_url", F.posexplode(L.embedded_pdfs(F.col("html"))).alias("ord", "raw")).withColumn("url", L.resolve(F.col("page_url"), F.col("raw")))
    found = anchors.unionByName(other.select("page_url", "seed_url", "url", F.lit("(IR form/embed)").alias("title"), F.lit(1).alias("source"), "ord"))
    first = first_of(of_same_org(found, rules).drop("seed_url"), ["page_url", "url"], [F.col("source"), F.col("ord")])
    return first.withColumn("snippet", F.concat(F.lit("(crawled from "), L.path(F.col("page_url")), F.lit(")")))


def drilldown_links(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Links of the organisation (see ``of_same_org``) to pages of a year or period, without fragments, each once."""
    found = of_same_org(page_links(pages).where(L.is_drilldown(F.col("url"))), rules).withColumn("url", L.without_fragment(F.col("url")))
    return found.groupBy("page_url", "url").agg(F.min("ord").alias("ord"))


def distilled(pages: DataFrame, most_pdfs: int = 60, most_drilldowns: int = 40, rules: DataFrame | None = None) -> DataFrame:
    """A short text for each page: its title, its documents and the pages to look into next; ``rules`` as in ``of_same_org``."""
    top = lambda rows, n: rows.groupBy("page_url").agg(F.slice(F.array_sort(F.collect_list(F.struct("source", "ord", "url", "title"))), 1, n).alias("x"))
    pdfs = top(pdf_links(pages, rules), most_pdfs).select("page_url", F.transform("x", lambda p: F.concat(F.lit("- "), p["title"], F.lit(": "), p["url"])).alias("pdfs"))
    deeper = top(drilldown_links(pages, rules).withColumn("source", F.lit(0)).withColumn("title", F.lit("")), most_drilldowns).select("page_url", F.transform("x", lambda p: F.concat(F.lit("- "), p["url"])).alias("deeper"))
    empty = F.array().cast("array<string>")
    titled = pages.select("page_url", L.page_title(F.col("html")).alias("title")).join(pdfs, "page_url", "left").join(deeper, "page_url", "left")
    part = lambda name, c: F.concat(F.lit(f"{name} ("), F.size(F.coalesce(c, empty)).cast("string"), F.lit("):\n"), F.array_join(F.coalesce(c, empty), "\n"))
    return titled.select("page_url", F.concat_ws("\n", F.concat(F.lit("Title: "), F.col("title")), part("Documents", F.col("pdfs")), part("Drill-downs", F.col("deeper"))).alias("text"))


def crawl(seeds: DataFrame, edges: DataFrame, follow: Column, depth: int) -> DataFrame:
    """``seed, url, depth`` of pages within ``depth`` (3 at most) followed links: each page once, at its smallest depth.

    ``edges``: page, url; ``follow`` is a predicate on its columns. One join for each level, an anti join drops what was seen.
    """
    if not 0 <= depth <= 3:
        raise ValueError("depth must be 0 to 3")
    ways = edges.where(follow).select(F.col("page").alias("url"), F.col("url").alias("next")).distinct()
    seen = level = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")).distinct()
    for k in range(1, depth + 1):
        level = level.join(ways, "url").select("seed", F.col("next").alias("url"), F.lit(k).alias("depth")).distinct().join(seen, ["seed", "url"], "left_anti")
        seen = seen.unionByName(level)
    return seen


def url_candidates(direct: DataFrame, crawled: DataFrame) -> DataFrame:
    """Configured addresses before crawled ones; of equal addresses the first. Both: source_name, url, ord."""
    both = direct.withColumn("source", F.lit(0)).unionByName(crawled.withColumn("source", F.lit(1)), allowMissingColumns=True)
    return first_of(both, ["source_name", "url"], [F.col("source"), F.col("ord")])


def content_store(docs: DataFrame, content: str = "content") -> DataFrame:
    """One row for each distinct content, named by its SHA-256: the first by ``ord``."""
    return first_of(docs.withColumn("sha256", F.sha2(F.col(content), 256)), ["sha256"], [F.col("ord")])


def merge_manifest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By content, incoming rows over existing ones, later over earlier."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return first_of(both, ["sha256"], [F.col("__new").desc(), F.col("ord").desc()]).drop("__new")


def manifest_counters(attempts: DataFrame) -> DataFrame:
    """Found, downloaded and failed downloads of each source. ``attempts``: source_name, outcome."""
    return attempts.groupBy("source_name").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("outcome") == "downloaded").alias("downloaded"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def appended_urls(existing: Column, new: Column) -> Column:
    """New addresses after the existing ones, each once, in order."""
    return F.array_union(F.coalesce(existing, F.array().cast("array<string>")), new)


def is_document_response(status: Column, content_type: Column) -> Column:
    """A successful answer that isn't a web page."""
    return (status < 400) & ~F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def is_logo(content_type: Column, size: Column) -> Column:
    return content_type.startswith("image/") & (size <= 2 * 1024 * 1024)


def fetch_cascade(attempts: DataFrame) -> DataFrame:
    """The first strategy that succeeded for each address. ``attempts``: url, strategy_ord, status, body."""
    return first_of(attempts.where(F.col("status") < 400), ["url"], [F.col("strategy_ord")])


def archived_captures(captures: DataFrame) -> DataFrame:
    """Successful captures of an archive's list, the first of each address."""
    return first_of(captures.where("statuscode = '200'"), ["original"], [F.col("timestamp")])


def closest_snapshots(answers: DataFrame) -> DataFrame:
    """``url, snapshot_url``: the raw address of the archive's closest copy, from its availability answers (``url``, ``body``); without one no row."""
    schema = "archived_snapshots struct<closest:struct<available:boolean,url:string,timestamp:string>>"
    closest = F.from_json("body", schema)["archived_snapshots"]["closest"]
    found = answers.select("url", closest.alias("c")).where("c.available")
    return found.select("url", L.archive_raw_url(F.col("c.url"), F.col("c.timestamp")).alias("snapshot_url")).where("snapshot_url is not null")


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (host) with ``domain``: the label before the longest suffix that a rule of the table ``rules`` (rule) names, and that suffix.

    ``*.x`` stands for any label before x, ``!y`` for a name that such a rule does not cover; a host without a rule has its last label as
    suffix; a host that is a suffix has none. All suffixes of each distinct host are joined to the rules by equality.
    """
    names = hosts.select("host").where("host is not null").distinct().withColumn("labels", F.split("host", r"\."))
    tails = names.select("host", "labels", F.posexplode(F.transform("labels", lambda _, k: F.array_join(F.slice("labels", k + 1, F.size("labels")), "."))).alias("k", "tail"))
    parent = F.when(F.instr("tail", ".") > 0, F.concat(F.lit("*."), F.expr("substring(tail, instr(tail, '.') + 1)")))
    asked = tails.select("host", F.size("labels").alias("n"), "k", F.explode(F.array(F.col("tail"), parent, F.concat(F.lit("!"), F.col("tail")))).alias("rule")).where("rule is not null")
    # Labels in the suffix: an exception's without its first; the default rule is the last label.
    found = asked.join(rules.select("rule").distinct(), "rule").select("host", F.when(F.col("rule").startswith("!"), 1000 + F.col("n") - F.col("k") - 1).otherwise(F.col("n") - F.col("k")).alias("length"))
    longest = found.groupBy("host").agg(F.max("length").alias("length"))
    length = F.coalesce(F.col("length") % 1000, F.lit(1))
    domain = F.when(F.size("labels") > length, F.array_join(F.slice("labels", F.size("labels") - length, length + 1), "."))
    return hosts.join(names.join(longest, "host", "left").select("host", domain.alias("domain")), "host", "left")


def filings(submissions: DataFrame, forms: tuple[str, ...] = ("20-F", "10-K", "40-F")) -> DataFrame:
    """All filings of the wanted forms: parallel arrays zipped up to the shortest, with the address of the document. What a model is shown of them is its caller's choice (``selection.MOST_FILINGS``)."""
    arrays = ("form", "accessionNumber", "primaryDocument", "filingDate")
    n = F.least(*[F.size(a) for a in arrays])
    zipped = submissions.select("cik", F.posexplode(F.slice(F.arrays_zip(*arrays), F.lit(1), n)).alias("ord", "f")).select("cik", "ord", "f.*").where(F.col("form").isin(*forms))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.regexp_replace("accessionNumber", "-", ""), F.lit("/"), F.col("primaryDocument"))
    return zipped.withColumn("url", url)


def cik_lookup(needles: DataFrame, tickers: DataFrame) -> DataFrame:
    """The first company whose ticker is the needle or whose title contains it; the number padded to ten digits.

    All needles are answered: tickers by equality, titles by an inverted index (``search.first_containing``). ``ord`` must be distinct.
    """
    asked = needles.withColumn("__asked", F.lower(F.trim("needle")))
    distinct = asked.select(F.col("__asked").alias("asked")).distinct()
    by_ticker = tickers.where("ticker is not null").groupBy(F.lower("ticker").alias("asked")).agg(F.min("ord").alias("ord")).join(distinct, "asked", "left_semi")
    by_title = first_containing(distinct, tickers.select("ord", F.lower("title").alias("title")))
    first = by_ticker.unionByName(by_title.select("asked", F.col("ord").cast(by_ticker.schema["ord"].dataType).alias("ord"))).groupBy("asked").agg(F.min("ord").alias("ord"))
    found = first.join(tickers, "ord").withColumnRenamed("asked", "__asked").join(asked, "__asked").drop("__asked")
    return first_of(found, ["needle"], [F.col("ord")]).withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0"))
