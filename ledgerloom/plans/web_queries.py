"""Crawled pages, documents by content, market series and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import headings as H
from ledgerloom.functions import links as L
from ledgerloom.operators import crawl as C
from ledgerloom.operators import market as M
from ledgerloom.plans.registry import query, table

HREF_SQL = r"""(?i)<a\b[^>]*?\bhref\s*=\s*[''"]([^''"]+)[''"][^>]*>"""
HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), F.col("url").alias("seed_url"), "html")


@query(f"SELECT url AS page_url, {HOST_SQL} AS host, coalesce(nullif(substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 1, 160), ''), '(no title)') AS title, contains(lower(url), '/files/') OR regexp_matches(regexp_replace(lower(url), '[#?].*$', ''), '\\.pdf$') AS pdf, regexp_replace(url, '#.*$', '') AS clean FROM pages")
def page_summary(spark, sf_dir):
    u = F.col("page_url")
    return crawled(spark, sf_dir).select("page_url", L.host(u).alias("host"), L.page_title(F.col("html")).alias("title"), L.looks_like_pdf(u).alias("pdf"), L.without_fragment(u).alias("clean"))


@query(f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{HREF_SQL}', 1)) AS href FROM pages)
  SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE '?' END AS link, count(*) AS n FROM h GROUP BY 1, 2""")
def page_links(spark, sf_dir):
    return C.page_links(crawled(spark, sf_dir), "page_id").groupBy("page_id", F.col("url").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT page_id, k, CASE k WHEN 0 THEN '/financials/' || (2000 + page_id % 20) WHEN 1 THEN '/reports/q1-2024#tab' WHEN 2 THEN '/financials' WHEN 3 THEN 'https://other.example.org/reports/2020' WHEN 4 THEN '/dam/jcr:9' ELSE '/x/annual.pdf?v=2' END AS href FROM pages, range(0, 6) r(k))
  SELECT page_id, k, k IN (0, 1, 3) AS drilldown, k <> 3 AS same_org, k >= 4 AS pdf FROM l""")
def link_tests(spark, sf_dir):
    k = F.col("k")
    url = F.when(k == 0, F.concat(F.lit("/financials/"), (2000 + F.col("page_id") % 20).cast("string"))).when(k == 1, "/reports/q1-2024#tab").when(k == 2, "/financials").when(k == 3, "https://other.example.org/reports/2020").when(k == 4, "/dam/jcr:9").otherwise("/x/annual.pdf?v=2")
    base = F.lit("https://www.acme.example.com/ir/")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>")).alias("k")).withColumn("url", L.resolve(base, url))
    return rows.select("page_id", "k", L.is_drilldown(F.col("url")).alias("drilldown"), L.same_org(F.col("url"), base).alias("same_org"), L.looks_like_pdf(F.col("url")).alias("pdf"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.pdf' ELSE '.bin' END AS suffix, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'unknown' END AS format FROM part""")
def file_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 4
    url = F.when(k == 0, "https://e.example/a/R.PDF?x=1").when(k == 1, "https://e.example/a/r.html").otherwise("https://e.example/api/asset/7")
    kind = F.when(k == 2, "application/pdf; charset=x").when(k == 3, "image/png")
    return table(spark, sf_dir, "part").select("p_partkey", L.file_suffix(url, kind).alias("suffix"), L.file_format(F.lit("blob"), url).alias("format"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS ord, count(*) AS copies FROM documents GROUP BY 1")
def content_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("ord"))
    first = C.content_store(docs).select("sha256", "ord")
    return first.join(docs.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies")), "sha256")


@query("SELECT md5(text) AS sha256, max(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END) = 1 AS incoming, max(CASE WHEN doc_id % 2 = 1 THEN doc_id + 1000000 ELSE doc_id END) % 1000000 AS ord FROM documents GROUP BY 1")
def merge_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("sha256"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 2 == 1).alias("incoming"))
    return C.merge_manifest(docs.where("not incoming"), docs.where("incoming"))


# Customers link to customers: an edge is followed if its number is even. Everyone is a seed, two links deep.
@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % (SELECT count(*) FROM customer) AS b FROM orders WHERE o_orderkey % 2 = 0),
  w AS (SELECT c_custkey AS seed, c_custkey AS url, 0 AS depth FROM customer UNION SELECT w.seed, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.url WHERE w.depth < 2)
  SELECT CAST(seed AS VARCHAR) AS seed, CAST(url AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""")
def bounded_crawl(spark, sf_dir):
    return customer_crawl(spark, sf_dir, 2)


def customer_crawl(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    n = F.broadcast(customers.agg(F.count(F.lit(1)).alias("n")))
    edges = table(spark, sf_dir, "orders").crossJoin(n).select(F.col("o_custkey").cast("string").alias("page"), (F.col("o_orderkey") % F.col("n")).cast("string").alias("url"), "o_orderkey")
    return C.crawl(customers.select(F.col("c_custkey").cast("string").alias("seed")), edges, F.col("o_orderkey") % 2 == 0, depth)


# All customers are seeds, and any customer can be a target.
@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % (SELECT count(*) FROM customer) AS b FROM orders WHERE o_orderkey % 2 = 0),
  w AS (SELECT c_custkey AS seed, c_custkey AS url, 0 AS depth FROM customer UNION SELECT w.seed, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.url WHERE w.depth < 3)
  SELECT CAST(seed AS VARCHAR) AS seed, CAST(url AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""")
def full_crawl(spark, sf_dir):
    return customer_crawl(spark, sf_dir, 3)


@query("""SELECT l_shipmode AS source_name, n AS found, d AS downloaded, f AS failed FROM (SELECT l_linestatus AS l_shipmode, count(*) n, count(*) FILTER (l_returnflag = 'A') d, count(*) FILTER (l_returnflag = 'R') f FROM lineitem GROUP BY 1)""")
def manifest_counters(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "A", "downloaded").when(F.col("l_returnflag") == "R", "failed")
    return C.manifest_counters(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source_name"), outcome.alias("outcome")))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, CASE o_orderkey % 3 WHEN 0 THEN '20-F' WHEN 1 THEN '6-K' ELSE '10-K' END AS form FROM orders)
  SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(ord AS INTEGER) AS ord, form, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '/d.htm' AS url FROM f WHERE form <> '6-K' AND o_custkey > 0""")
def filings(spark, sf_dir):
    o = F.col("o_orderkey")
    form = F.when(o % 3 == 0, "20-F").when(o % 3 == 1, "6-K").otherwise("10-K")
    number = F.concat(F.substring(o.cast("string"), 1, 1), F.lit("-"), F.substring(o.cast("string"), 2, 20))
    subs = table(spark, sf_dir, "orders").where("o_custkey > 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(o.alias("k"), form.alias("form"), number.alias("n")))).alias("x"))
    arrays = subs.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.transform("x", lambda e: e["form"]).alias("form"), F.transform("x", lambda e: e["n"]).alias("accessionNumber"), F.transform("x", lambda e: F.lit("d.htm")).alias("primaryDocument"), F.transform("x", lambda e: F.lit("2024-01-01")).alias("filingDate"))
    return C.filings(arrays).select(F.regexp_replace("cik", "^0+", "").alias("cik"), "ord", "form", "url")


SERIES_SQL = "s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_id % 13 <> 0)"
POINTS_SQL = SERIES_SQL + ", p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS point FROM s WHERE n <= 60 OR i IN (SELECT CAST(floor(k * n / 60.0) AS BIGINT) FROM range(0, 60) r(k)))"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 13 != 0, F.col("value")))
    return M.downsample(e, ["user_id"], ["ts", "event_id"])


@query("WITH " + POINTS_SQL + " SELECT user_id, point, value FROM p")
def downsampled(spark, sf_dir):
    return series(spark, sf_dir).select("user_id", "point", "value")


@query("WITH " + POINTS_SQL + """, m AS (SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM p GROUP BY 1)
  SELECT user_id, point, round(point * 100.0 / (n - 1), 6) AS x, round(30 - (value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 30, 6) AS y FROM p JOIN m USING (user_id)""")
def sparkline_xy(spark, sf_dir):
    return M.sparkline_xy(series(spark, sf_dir).select("user_id", "point", "value"), ["user_id"]).select("user_id", "point", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT user_id, min(value) AS low, max(value) AS high, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1")
def sparkline_summary(spark, sf_dir):
    return M.sparkline_summary(table(spark, sf_dir, "events"), ["user_id"], ["ts"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), '42')")
def search_companies(spark, sf_dir):
    return M.search_any(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), " 42", ["c_name", "c_mktsegment"])


@query("""WITH r AS (SELECT p_brand AS b, p_partkey AS pos, p_name AS name, p_size % 4 AS depth, p_size % 5 = 0 AS h FROM part)
  SELECT b, pos FROM r WHERE contains(lower(name), 'red') UNION SELECT x.b, x.pos FROM r x JOIN r y ON y.b = x.b AND y.pos > x.pos AND contains(lower(y.name), 'red') AND y.depth > x.depth WHERE x.h""")
def search_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("canonical_name"), (F.col("p_size") % 4).alias("depth"), (F.col("p_size") % 5 == 0).alias("is_header"))
    return M.search_keep_headers(rows, "RED", ["b"]).select("b", "pos")


@query("""SELECT c_custkey, n_name, round(c_acctbal * 0.92, 4) AS price_in_eur, CAST(coalesce(n, 0) AS BIGINT) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def company_directory(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    companies = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"), "n_name")
    coverage = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("slug")).agg(F.count(F.lit(1)).alias("n_orders")).withColumn("name", F.lit(""))
    market = c.select(F.col("c_custkey").cast("string").alias("slug"), F.lit("T").alias("ticker"), F.col("c_acctbal").alias("price"), F.lit("USD").alias("currency"), F.lit(None).cast("double").alias("market_cap"), F.lit(0.0).alias("shares_outstanding_m"))
    return M.directory(companies, coverage, market).select(F.col("slug").cast("long").alias("c_custkey"), "n_name", F.round("price_in_eur", 4).alias("price_in_eur"), F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))


@query("SELECT page_id, contains(substr(html, 1, 50000), '{{') OR contains(substr(html, 1, 50000), 'ng-app') OR contains(substr(html, 1, 50000), 'ng-controller') OR contains(substr(html, 1, 50000), 'data-reactroot') OR contains(substr(html, 1, 50000), '__nuxt') OR contains(substr(html, 1, 50000), '__next') AS shell FROM pages")
def script_shells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.is_script_shell(F.col("html"), F.lit(0), F.lit(0)).alias("shell"))


# A customer's orders are addresses; those of finished orders are configured, and come before crawled ones of the same name.
@query("""WITH c AS (SELECT o_custkey AS s, o_orderpriority AS u, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS source FROM orders)
  SELECT CAST(s AS VARCHAR) AS source_name, u AS url, ord, source FROM (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY source, ord) AS k FROM c) WHERE k = 1""")
def url_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_name"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return C.url_candidates(p.where("o_orderstatus = 'F'"), p.where("o_orderstatus <> 'F'")).select("source_name", "url", "ord", "source")


@query("""WITH q AS (SELECT unnest(['customer#000000012', ' 0001 ', 'nobody', 'MACHINERY']) AS needle),
  h AS (SELECT needle, c_custkey, row_number() OVER (PARTITION BY needle ORDER BY c_custkey) AS k FROM q JOIN customer ON lower(c_mktsegment) = lower(trim(needle)) OR contains(lower(c_name), lower(trim(needle))))
  SELECT needle, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM h WHERE k = 1""")
def cik_lookup(spark, sf_dir):
    needles = spark.createDataFrame([("customer#000000012",), (" 0001 ",), ("nobody",), ("MACHINERY",)], "needle string")
    register = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_mktsegment").alias("ticker"), F.col("c_name").alias("title"), F.col("c_custkey").alias("ord"))
    return C.cik_lookup(needles, register).select("needle", "cik")


@query("SELECT c_custkey, CASE WHEN e AND f = 0 THEN 'failed' WHEN d THEN CASE WHEN e THEN 'partial' ELSE 'ok' END WHEN x = 0 AND NOT e THEN 'ok' WHEN g = 0 THEN 'failed' ELSE 'partial' END AS status FROM (SELECT c_custkey, c_custkey % 2 = 0 AS d, c_custkey % 3 AS f, c_custkey % 4 AS g, c_custkey % 5 AS x, c_custkey % 7 = 0 AS e FROM customer)")
def scrape_status(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", L.scrape_status(k % 2 == 0, k % 3, k % 4, k % 5, k % 7 == 0).alias("status"))


@query("SELECT url, arg_min(strategy, ord) AS strategy FROM (SELECT o_custkey AS url, o_orderpriority AS strategy, o_orderkey AS ord, 200 + (o_orderkey % 3) * 150 AS status FROM orders) WHERE status < 400 GROUP BY 1")
def fetch_cascade(spark, sf_dir):
    tries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("strategy_ord"), (200 + F.col("o_orderkey") % 3 * 150).alias("status"))
    return C.fetch_cascade(tries).select("url", "strategy")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS urls FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def appended_urls(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return turns.select("conv_id", F.array_join(C.appended_urls(F.slice("r", 1, 1), F.col("r")), ",").alias("urls"))


@query("""WITH c AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier) SELECT s_suppkey AS slug, round(s_acctbal * CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 4 END * 1e6, 2) AS market_cap, CAST(s_suppkey % 4 AS DOUBLE) AS shares FROM c WHERE s_suppkey % 10 <> 3""")
def market_records(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    companies = s.select(k.alias("slug"), F.when(k % 10 != 3, F.col("s_name")).alias("ticker"), F.lit(None).cast("string").alias("market_ticker"), F.when(k % 4 != 0, (k % 4).cast("double")).alias("shares_outstanding_m"))
    quotes = s.select(F.col("s_name").alias("ticker"), F.col("s_acctbal").alias("price"), F.lit("EUR").alias("currency"), F.lit(None).cast("double").alias("previous_close"), F.array(F.lit(1.0)).alias("sparkline"))
    return M.market_records(quotes, companies, F.lit(0)).select("slug", F.round("market_cap", 2).alias("market_cap"), F.col("shares_outstanding_m").alias("shares"))


RELATIVE_SQL = "CASE s_suppkey % 7 WHEN 0 THEN '../y/./z?q=1' WHEN 1 THEN 'b' WHEN 2 THEN '/c/../d' WHEN 3 THEN '//h.example/e' WHEN 4 THEN 'mailto:x' WHEN 5 THEN '?p=2' ELSE '#f' END"


@query(f"""SELECT s_suppkey, {RELATIVE_SQL} AS url, CASE s_suppkey % 7 WHEN 0 THEN b || '/y/z?q=1' WHEN 1 THEN b || '/x/b' WHEN 2 THEN b || '/d' WHEN 3 THEN 'https://h.example/e' WHEN 4 THEN 'mailto:x' WHEN 5 THEN b || '/x/p' || s_suppkey || '?p=2' ELSE b || '/x/p' || s_suppkey || '?q#f' END AS resolved
  FROM (SELECT s_suppkey, 'https://s' || s_suppkey || '.example' AS b FROM supplier)""")
def resolved_links(spark, sf_dir):
    base = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example/x/p"), F.col("s_suppkey").cast("string"), F.lit("?q"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(RELATIVE_SQL).alias("url")).select("s_suppkey", "url", L.resolve(base, F.col("url")).alias("resolved"))


# Pages get links of an investor site: documents, drill-downs with and without fragments, foreign ones.
SITE_SQL = "html || '<a href=\"/reports/' || (2000 + page_id % 25) || '#t\" title=\"Report ' || page_id || '\">x</a><a href=\"/reports/' || (2000 + page_id % 25) || '\"></a><a href=\"/files/' || page_id || '.pdf\" aria-label=\" AR \">y</a><a href=\"/files/' || page_id || '.pdf\">z</a><a href=\"https://other.org/a.pdf\">w</a><a href=\"/financials/q' || page_id % 4 || '\">v</a>'"


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example/ir")).alias("page_url"), F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example")).alias("seed_url"), F.expr(SITE_SQL.replace('\\"', '"')).alias("html"))


@query("""SELECT page_id, 'https://p' || page_id || '.example/' || p AS url, k AS nth FROM pages, (VALUES ('r', 1), ('f', 2)) v(w, k), LATERAL (SELECT CASE w WHEN 'r' THEN 'reports/' || (2000 + page_id % 25) ELSE 'financials/q' || page_id % 4 END AS p)""")
def drilldown_links(spark, sf_dir):
    """Drill-down pages without fragments, each once, in the order of their links."""
    from ledgerloom.operators.selection import numbered

    pages = site(spark, sf_dir)
    found = numbered(C.drilldown_links(pages), ["page_url"], [F.col("ord")], "nth")
    return found.join(pages.select("page_url", "page_id"), "page_url").select("page_id", "url", "nth")


# Pages have up to 90 documents, with and without titles, and up to 60 pages to look into: more than are shown.
@query(r"""WITH p AS (SELECT page_id, 'https://p' || page_id || '.example' AS h, coalesce(nullif(substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 160), ''), '(no title)') AS title, least(60, page_id * 7 % 91) AS docs, least(40, page_id * 3 % 61) AS deeper FROM pages)
  SELECT page_id, 'Title: ' || title || chr(10) || 'Documents (' || docs || '):' || chr(10) || array_to_string(list_transform(range(0, docs), lambda j: '- ' || CASE WHEN j % 3 = 0 THEN '(IR page anchor)' ELSE 'Report ' || j END || ': ' || h || '/files/' || j || '.pdf'), chr(10)) || chr(10)
    || 'Drill-downs (' || deeper || '):' || chr(10) || array_to_string(list_transform(range(0, deeper), lambda j: '- ' || h || '/reports/y' || j), chr(10)) AS text FROM p""")
def distilled_pages(spark, sf_dir):
    """The short text of a page that a model sees: its title, documents and pages to look into, each up to a cap in the order of the links."""
    i = F.col("page_id")
    many = lambda n, link: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), link), "")
    documents = many(i * 7 % 91, lambda j: F.concat(F.lit('<a href="/files/'), j.cast("string"), F.lit('.pdf"'), F.when(j % 3 == 0, "").otherwise(F.concat(F.lit(' title="Report '), j.cast("string"), F.lit('"'))), F.lit(">x</a>")))
    deeper = many(i * 3 % 61, lambda j: F.concat(F.lit('<a href="/reports/y'), j.cast("string"), F.lit('#t"></a><a href="/reports/y'), j.cast("string"), F.lit('"></a>')))
    host = F.concat(F.lit("https://p"), i.cast("string"), F.lit(".example"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(host, F.lit("/ir")).alias("page_url"), host.alias("seed_url"), F.concat("html", documents, deeper).alias("html"))
    return C.distilled(pages).join(pages.select("page_url", "page_id"), "page_url").select("page_id", "text")


TAG_SQL = r"""(?i)<a\b[^>]*?\bhref\s*=\s*[''"][^''"]+[''"][^>]*>"""
LABEL_SQL = r"""(?i)\b(?:aria-label|title|download)\s*=\s*[''"]([^''"]+)[''"]"""


@query(f"""WITH t AS (SELECT page_id, regexp_extract_all({SITE_SQL}, '{TAG_SQL}') AS tags FROM pages)
  SELECT page_id, n, substr(trim(regexp_extract(tag, '{LABEL_SQL}', 1)), 1, 160) AS label FROM (SELECT page_id, unnest(range(0, len(tags))) AS n, unnest(tags) AS tag FROM t)""")
def anchor_labels(spark, sf_dir):
    """The labels of all links of each page."""
    tags = site(spark, sf_dir).select("page_id", F.posexplode(L.anchors(F.col("html"))).alias("n", "tag"))
    return tags.select("page_id", F.col("n").cast("long").alias("n"), L.anchor_label(F.col("tag")).alias("label"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages".replace(r"\s", r"\s"))
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.html_text(F.col("html"))).alias("text"))


@query("""SELECT o_orderkey, o_orderkey % 5 < 3 AND o_orderkey % 3 <> 0 AS document, o_orderkey % 2 = 0 AND o_orderkey % 4 < 3 AS logo FROM orders""")
def response_gates(spark, sf_dir):
    """Which answers are documents, and which are logos: by status, type and size."""
    k = F.col("o_orderkey")
    status, kind = F.when(k % 5 < 3, 200 + k % 5).otherwise(404), F.when(k % 3 == 0, "Text/HTML; x").when(k % 3 == 1, "application/pdf")
    image, size = F.when(k % 2 == 0, "image/png").otherwise("text/plain"), F.when(k % 4 < 3, F.lit(2 * 1024 * 1024)).otherwise(2 * 1024 * 1024 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.is_document_response(status, kind).alias("document"), C.is_logo(image, size).alias("logo"))


# Sorted within each nation, by price in one currency; customers without a price come last.
@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY price * CASE WHEN c_custkey % 2 = 0 THEN 0.92 ELSE 1.0 END DESC NULLS LAST, CAST(c_custkey AS VARCHAR)) AS by_price, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name NULLS LAST, CAST(c_custkey AS VARCHAR)) AS by_name
  FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS price FROM customer)""")
def directory_order(spark, sf_dir):
    from ledgerloom.operators.selection import numbered

    k = F.col("c_custkey")
    companies = table(spark, sf_dir, "customer").select(k, k.cast("string").alias("slug"), F.col("c_name").alias("name"), "c_nationkey", "c_acctbal")
    market = companies.select("slug", F.lit("T").alias("ticker"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("price"), F.when(k % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.lit(None).cast("double").alias("market_cap"), F.lit(0.0).alias("shares_outstanding_m"))
    rows = M.directory(companies.drop("c_acctbal"), companies.select("slug", "name", F.lit(1).alias("n_statements")), market)
    placed = numbered(numbered(rows, ["c_nationkey"], M.grid_order("price", descending=True), "by_price"), ["c_nationkey"], M.grid_order("name"), "by_name")
    return placed.select("c_custkey", "by_price", "by_name")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'header' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'grand-total' WHEN p_size % 2 = 0 THEN 'total' ELSE 'line' END AS kind,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'From the ' || (2000 + p_size) || ' report' || CASE WHEN p_size % 4 = 0 THEN ', restated' ELSE '' END END AS tooltip, CASE WHEN p_size % 3 = 0 THEN 'USD' WHEN p_size % 3 = 1 THEN 'EUR' ELSE 'CHF' END AS currency FROM part""")
def display_rows(spark, sf_dir):
    from ledgerloom.functions.numbers import display_currency

    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", M.display_row(s % 5 == 0, s % 2 == 0, s % 3).alias("kind"), M.cell_tooltip(F.when(s % 7 != 0, s), 2000 + s, s % 4 == 0).alias("tooltip"), display_currency(F.when(s % 3 == 0, "usd").when(s % 3 == 1, "SEK").otherwise("CHF")).alias("currency"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'T' ELSE '' END AS ticker, '' AS exchange, c_mktsegment AS sector, '' AS headquarters, '' AS description, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_custkey || '.example' END AS site FROM customer""")
def company_cards(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    companies = table(spark, sf_dir, "customer").select(k.cast("string").alias("slug"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "T").alias("ticker"), none.alias("exchange"), F.col("c_mktsegment").alias("sector"), none.alias("headquarters"), none.alias("description"), F.when(k % 3 != 0, F.concat(F.lit("https://www.C"), k.cast("string"), F.lit(".example/x"))).alias("website"))
    return M.company_card(companies)


@query("""SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'furniture') OR contains(lower(c_mktsegment), 'furniture') OR len(list_filter(string_split(lower(c_name), ' '), lambda w: levenshtein(w, 'furnitur') <= 2)) > 0 OR levenshtein(lower(c_mktsegment), 'furnitur') <= 2""")
def palette_search(spark, sf_dir):
    return M.fuzzy_search(table(spark, sf_dir, "customer"), " Furnitur ", ["c_name", "c_mktsegment"]).select("c_custkey")


# As many values as the supplier's number modulo 60 and one; every second place from the length modulo 7 on, none twice.
@query("""WITH v AS (SELECT s_suppkey AS k, s_suppkey % 60 + 1 AS n FROM supplier), o AS (SELECT *, list_transform(range(0, 2 * n), lambda i: (n % 7 + 2 * i) % n) AS l FROM v)
  SELECT k, array_to_string(CASE WHEN n <= 5 THEN range(0, n) ELSE list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] END, ',') AS picked FROM o""")
def stride_samples(spark, sf_dir):
    values = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 60).cast("int")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array_join(M.stride_sample(values, 5), ",").alias("picked"))
