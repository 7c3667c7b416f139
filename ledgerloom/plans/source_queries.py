"""Sources, sinks, providers and model stages, over strings and JSON rendered from the tables; providers are deterministic stand-ins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import links as L
from ledgerloom.functions import periods as P
from ledgerloom.operators import crawl as C
from ledgerloom.operators import extract as E
from ledgerloom.operators import market as M
from ledgerloom.operators import models
from ledgerloom.operators import providers as V
from ledgerloom.operators import selection as S
from ledgerloom.operators import taxonomy as X
from ledgerloom.plans.registry import query, table
from ledgerloom.plans.structure_queries import ROWS_SQL, report_rows, source_rows
from ledgerloom.sources import files, html_tables


def no_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.MODEL_CACHE)


# The nations as configured companies; the first gets another address, the second is added again under a new name.
@query("""SELECT lower(n_name) AS slug, CASE WHEN n_nationkey = 1 THEN 'Renamed' ELSE n_name END AS name, 'u' || n_nationkey || CASE WHEN n_nationkey = 0 THEN ',u0b' ELSE '' END AS urls FROM nation""")
def configured_companies(spark, sf_dir):
    nations = [(r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a configuration is a small file
    text = json.dumps({"companies": {n.lower(): {"name": n, "sources": [{"name": "s", "direct_urls": [f"u{k}"]}]} for k, n in nations}})
    text = files.append_direct_urls(text, nations[0][1].lower(), ["u0", "u0b", "u0b"])
    text = files.upsert_company_yaml(text, nations[1][1].lower(), {"name": "Renamed"})
    return files.companies_from_yaml(spark, text).select("slug", "name", F.array_join(F.get("sources", F.lit(0))["direct_urls"], ",").alias("urls"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS sha256, CAST(o_custkey AS VARCHAR) AS company_slug, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'é "' || o_orderkey || '"' END AS link_text, o_orderkey * 10 AS size_bytes FROM orders""")
def stage_files(spark, sf_dir):
    """A stage's JSON, written and read again by its schema."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.cast("string").alias("sha256"), F.lit("u").alias("source_url"), F.lit("p").alias("local_path"), F.lit("x").alias("company_slug"), F.lit("annual").alias("kind"), F.year("o_orderdate").alias("fiscal_year"), F.lit(0.5).alias("confidence"), F.lit("rules").alias("classified_by"), F.when(k % 3 != 0, F.concat(F.lit('é "'), k.cast("string"), F.lit('"'))).alias("link_text"), (k * 10).alias("size_bytes"), F.lit(0).alias("ord"), "o_custkey")
    path = files.scratch(spark, "stage")
    # A document belongs to the company that its stage runs for, whatever it said before.
    files.write_stage(S.of_company(docs, "y").withColumn("company_slug", F.col("o_custkey").cast("string")).drop("o_custkey"), path)
    return files.read_stage(spark, path, schemas.CLASSIFIED).select("sha256", "company_slug", "fiscal_year", "link_text", "size_bytes")


@query("SELECT c_custkey, 'acme' AS company_slug FROM customer")
def assigned_company(spark, sf_dir):
    return S.of_company(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("company_slug")), "acme")


@query("""SELECT s_suppkey AS slug, s_acctbal AS price, CAST(s_suppkey % 5 + 1 AS DOUBLE) AS shares, array_to_string([s_suppkey, s_suppkey + 1], ',') AS sparkline, 0 AS missing FROM supplier""")
def market_file(spark, sf_dir):
    """Market records, written and read again; a file that isn't there is no table."""
    k = F.col("s_suppkey")
    records = table(spark, sf_dir, "supplier").select(k.cast("string").alias("slug"), F.lit("T").alias("ticker"), F.col("s_acctbal").alias("price"), F.lit("EUR").alias("currency"), F.lit(None).cast("double").alias("previous_close"), F.lit(None).cast("double").alias("change_pct"), F.lit(1.0).alias("market_cap"), (k % 5 + 1).cast("double").alias("shares_outstanding_m"), F.array(k.cast("double"), k + 1.0).alias("sparkline"), F.lit(7).cast("long").alias("fetched_at"))
    path = files.scratch(spark, "market")
    missing = files.read_or_none(lambda: files.read_market(spark, path))
    files.write_market(records, path)
    return files.read_market(spark, path).select(F.col("slug").cast("long").alias("slug"), "price", F.col("shares_outstanding_m").alias("shares"), F.array_join(F.transform("sparkline", lambda x: x.cast("long").cast("string")), ",").alias("sparkline"), F.lit(int(missing is not None)).alias("missing"))


# Two tables follow the heading of each part: the first one on ties, else the one with more of a balance sheet's labels. The empty, header-like (a cell with a year, which some numbers look like) and short rows go.
@query(r"""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
  SELECT CAST(k AS VARCHAR) AS sha256, CASE WHEN s % 2 = 0 THEN 'millions' ELSE 'thousands' END AS unit, label, CAST(period AS VARCHAR) || '-12-31' AS period_end, CAST(v AS BIGINT) AS value FROM (
    SELECT k, s, CASE WHEN s % 3 = 0 THEN 'Total assets' ELSE 'Plain' END AS label, 2024 AS period, 1000 + s AS v FROM p
    UNION ALL SELECT k, s, CASE WHEN s % 3 = 0 THEN 'Total assets' ELSE 'Plain' END, 2023, -s FROM p
    UNION ALL SELECT k, s, 'Goodwill', 2024, NULL FROM p WHERE k NOT BETWEEN 1900 AND 2099 UNION ALL SELECT k, s, 'Goodwill', 2023, k FROM p WHERE k NOT BETWEEN 1900 AND 2099)""")
def html_statements(spark, sf_dir):
    """Statements from HTML: headings, the next tables, unit from the texts before, rows through their gates."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td> "), c if not isinstance(c, str) else F.lit(c), F.lit("</td>"))], F.lit("</tr>"))
    grid = lambda label: F.concat(F.lit("<table><tr><th>Item</th><th>Dec 31, 2024</th><th>2023</th></tr>"), row(label, F.format_number(1000 + s, 0), F.concat(F.lit("("), s.cast("string"), F.lit(")"))), row("Goodwill", "—", k), row("", "1", "2"), row("As at", "2024", "2023"), row("alone"), F.lit("</table>"))
    heading = F.lit("<h2>Consolidated <b>balance</b> sheets</h2>")
    unit = F.concat(F.lit("<p>(in "), F.when(s % 2 == 0, "millions").otherwise("thousands"), F.lit(" of euros)</p>"))
    html = F.concat(F.lit("<html><p>Analysis of consolidated balance sheets</p><table><tr><td>x</td></tr></table>"), unit, heading, grid("Plain"), heading, grid(F.when(s % 3 == 0, "Total assets").otherwise("Other")), F.lit("</html>"))
    # A small file of keys is one partition, but its files are many: they are dealt before they are made.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(8 * spark.sparkContext.defaultParallelism)
    scanned = html_tables.scanned(parts.select(k.alias("sha256"), html.alias("html")), files.scratch(spark, "scan"))
    rows = E.statements_of(html_tables.statement_headings(scanned), E.rows_of_tables(html_tables.table_cells(scanned)))
    return rows.select("sha256", "unit", F.col("raw_label").alias("label"), F.explode("values_by_period_end").alias("period_end", "v")).select("sha256", "unit", "label", "period_end", F.col("v").cast("long").alias("value"))


# Each order has grids on its heading's page, the next one and a far one, of 2 to 8 rows; one wide as a statement of changes.
@query(r"""WITH t AS (SELECT o_orderkey AS k, x AS page, 2 + (o_orderkey + 3 * x) % 7 AS n, CASE WHEN (o_orderkey + x) % 4 = 0 THEN 6 ELSE 3 END AS w FROM orders, range(0, 3) r(x)),
  g AS (SELECT *, 1000 * CAST(page = 0 AS INTEGER) + 500 * (2 / w) + 20 + n * (w - 1) + n AS score FROM t WHERE n >= 3 AND page <= 1),
  b AS (SELECT k, arg_min(page, (-score, page)) AS page, arg_min(n, (-score, page)) AS n FROM g GROUP BY k)
  SELECT CAST(k AS VARCHAR) AS sha256, CAST(page AS INTEGER) AS table_idx, CAST(n AS BIGINT) AS n_rows, CAST(sum(v) AS BIGINT) AS total FROM (SELECT k, page, n, unnest(range(1, n + 1)) * 10 + 1 AS v FROM b WHERE n >= 5) GROUP BY ALL""")
def grid_statements(spark, sf_dir):
    k, x = F.col("o_orderkey"), F.col("x")
    grids = table(spark, sf_dir, "orders").select(k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("x")).select(k, x, (2 + (k + 3 * x) % 7).alias("n"), F.when((k + x) % 4 == 0, 6).otherwise(3).alias("w"))
    header = F.concat(F.array(F.lit("Note"), F.lit("2024"), F.lit("2023")), F.array_repeat(F.lit("Reserves"), F.col("w") - 3))
    line = F.concat(F.array(F.concat(F.lit("line "), F.chr(96 + F.col("r")))), F.transform(F.sequence(F.lit(1), F.col("w") - 1), lambda c: (F.col("r") * 10 + c).cast("string")))
    cells = grids.select(k.cast("string").alias("sha256"), x.alias("page_idx"), x.alias("table_idx"), "w", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("r")).select("sha256", "page_idx", "table_idx", F.col("r").alias("row_idx"), F.when(F.col("r") == 0, header).otherwise(line).alias("cells"))
    pages = table(spark, sf_dir, "orders").select(k.cast("string").alias("sha256"), F.lit("income").alias("kind"), F.lit(0).alias("page_idx"))
    rows = E.grid_statements(cells, S.first_pages(pages))
    return rows.groupBy("sha256", "table_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.element_at("values_by_period_end", "2024-12-31").cast("long")).alias("total"))


# Each order has three pages: the first has its title on one of its first eight lines, the second has it on top or is a table of contents. Tables have their header on one of the first eight rows.
@query(r"""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, 0 AS page FROM o WHERE k % 8 < 6 UNION ALL SELECT k, 1 FROM o WHERE k % 5 <> 0),
  t AS (SELECT k, x AS page, 2 + (k + 3 * x) % 9 AS n, (k + x) % 8 AS h FROM o, range(0, 3) r(x)), g AS (SELECT k, page, n, h, n + 1 + 3 * greatest(0, n - h - 1) - CAST(h < 5 AND n > 5 AS INTEGER) AS score FROM t WHERE n >= 3 AND h < 6 AND h < n),
  b AS (SELECT p.k, p.page AS source, arg_min(g.page, (-score, g.page)) AS page, arg_min(n, (-score, g.page)) AS n, arg_min(h, (-score, g.page)) AS h FROM p JOIN g ON g.k = p.k AND g.page BETWEEN p.page AND p.page + 1 GROUP BY ALL),
  r AS (SELECT k, source, page, unnest(range(h + 1, n)) AS r FROM b), w AS (SELECT * FROM r WHERE r % 6 <> 5), f AS (SELECT k, min(source) AS source FROM w GROUP BY k)
  SELECT CAST(k AS VARCHAR) AS sha256, CAST(source AS INTEGER) AS source_page, CAST(page AS INTEGER) AS table_idx, count(*) AS n_rows, CAST(sum(r * 10 + 1) AS BIGINT) AS total, CASE WHEN source = 0 THEN 'thousands' ELSE 'units' END AS unit FROM w JOIN f USING (k, source) GROUP BY ALL""")
def pdf_statements(spark, sf_dir):
    """Statements of page-oriented documents: titles on the first lines, the best table of this page and the next."""
    k, x, r = F.col("o_orderkey"), F.col("x"), F.col("r")
    orders = table(spark, sf_dir, "orders").select(k)
    lines = lambda n: F.repeat(F.lit("words of the report\n"), n.cast("int"))
    title = F.lit("Consolidated income statement\n")
    texts = F.array(F.concat(lines(k % 8), title, F.lit("(in thousands)")), F.concat(title, F.when(k % 5 == 0, "Consolidated balance sheet\n").otherwise("")), F.lit("notes"))
    pages = orders.select(k.cast("string").alias("sha256"), F.posexplode(texts).alias("page_idx", "text"))
    tables = orders.select(k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("x")).select(k, x, F.explode(F.sequence(F.lit(0), (1 + (k + 3 * x) % 9).cast("int"))).alias("r"))
    at = (k + x) % 8
    number = lambda c: (r * 10 + c).cast("string")
    row = F.when(r < at, F.array(F.lit("Group"), F.lit(None), F.lit(" "))).when(r == at, F.array(F.lit("Note"), F.lit(" 2024 "), F.lit("change"))).otherwise(F.array(F.when(r % 6 == 5, " ").otherwise(F.concat(F.lit("line "), r.cast("string"))), number(1), number(2)))
    cells = tables.select(k.cast("string").alias("sha256"), x.alias("page_idx"), x.alias("table_idx"), r.alias("row_idx"), row.alias("cells"))
    rows = E.pdf_statements(pages, cells)
    return rows.groupBy("sha256", "source_page", "table_idx", "unit").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.element_at("values_by_period_end", "2024-12-31").cast("long")).alias("total"))


@query("""SELECT o_custkey AS source_sha256, o_orderpriority AS statement, max(o_orderkey) AS row_idx, 1 AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
  UNION ALL SELECT o_custkey, o_orderpriority, max(o_orderkey), 0 FROM orders WHERE o_orderstatus = 'O' AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
def merged_extractors(spark, sf_dir):
    """One extractor's statements, and another's for the kinds that it lacks."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_sha256"), F.col("o_orderpriority").alias("statement"), "o_orderstatus").agg(F.max("o_orderkey").alias("row_idx"))
    part = lambda status, mark: found.where(F.col("o_orderstatus") == status).drop("o_orderstatus").withColumn("first", F.lit(mark))
    return S.merge_extractors(part("F", 1), part("O", 0))


@query("""SELECT user_id AS ticker, i AS ord, value FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS value FROM events)""")
def chart_series(spark, sf_dir):
    """Closing prices of chart answers in JSON."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.round("value", 2)).alias("v"))
    close = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: F.coalesce(x["v"].cast("string"), F.lit("null"))).alias("c"))
    body = F.concat(F.lit('{"chart":{"result":[{"meta":{},"indicators":{"quote":[{"close":['), F.array_join("c", ","), F.lit("]}]}}]}}"))
    return M.chart_points(close.select(F.col("user_id").alias("ticker"), body.alias("body"))).withColumn("ord", F.col("ord").cast("long"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 404 ELSE 200 END AS status FROM orders)
  SELECT 'https://e.example/' || o_custkey AS original, CAST(min(o_orderkey) AS VARCHAR) AS timestamp, 'https://w.example/web/' || min(o_orderkey) || 'id_/https://e.example/' || o_custkey || '/' || min(o_orderkey) || '/' AS raw FROM c WHERE status = 200 GROUP BY o_custkey""")
def archived_captures(spark, sf_dir):
    """The first good capture of each address, and the address of its bytes as they were."""
    k, original = F.col("o_orderkey").cast("string"), F.concat(F.lit("https://e.example/"), F.col("o_custkey").cast("string"))
    captures = table(spark, sf_dir, "orders").select(original.alias("original"), k.alias("timestamp"), F.when(F.col("o_orderkey") % 4 == 0, "404").otherwise("200").alias("statuscode"), F.lpad(k, 12, "0").alias("padded"))
    first = C.archived_captures(captures.withColumn("timestamp", F.col("padded"))).withColumn("timestamp", F.regexp_replace("timestamp", "^0+(?=.)", ""))
    framed = F.concat(F.lit("https://w.example/web/"), F.col("timestamp"), F.lit("/"), F.col("original"), F.lit("/"), F.col("timestamp"), F.lit("/"))
    return first.select("original", "timestamp", L.archive_raw_url(framed, F.col("timestamp")).alias("raw"))


# The last digit tells how a server answers: some refuse HEAD, some serve pages, some are gone but archived; of the archive's copies every third fails.
@query("""WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT k, k % 10 IN (0, 1, 2, 3) AS direct, k % 10 IN (4, 5, 6, 7) AND k % 3 <> 0 AND k % 5 <> 0 AS copy FROM u)
  SELECT k, direct AS reachable, CASE WHEN NOT direct AND copy THEN 'https://w.example/web/2020id_/https://e.example/' || k END AS snapshot_url FROM a""")
def reachable_documents(spark, sf_dir):
    def probe(method: str, url: str) -> tuple[int, str]:
        k = int(url.rsplit("/", 1)[1])
        if "/web/" in url:
            return (200, "application/pdf") if k % 3 else (503, "")
        if k % 10 == 9:
            raise OSError("no such host")
        if k % 10 in (2, 3) and method == "HEAD":
            return 403, "text/html"
        return (200, "application/pdf") if k % 10 < 4 else (200, "text/html; charset=x") if k % 10 < 6 else (404, "")

    k = F.col("o_custkey").cast("string")
    picks = table(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", F.concat(F.lit("https://e.example/"), k).alias("url"))
    known = F.when(F.col("o_custkey") % 5 == 0, '{"archived_snapshots": {}}').otherwise(F.concat(F.lit('{"archived_snapshots": {"closest": {"available": true, "timestamp": "2020", "url": "https://w.example/web/2020/'), F.col("url"), F.lit('"}}}')))
    snapshots = C.closest_snapshots(picks.where("o_custkey % 10 between 4 and 7").select("url", known.alias("body")))
    return V.reachable_documents(picks, snapshots, probe).select(F.col("o_custkey").alias("k"), "reachable", "snapshot_url")


@query("""SELECT 'company ' || c_custkey AS query, CAST(h AS INTEGER) AS ord, 'https://hit.example/' || c_custkey || '/' || h AS url FROM customer, range(0, 3) r(h) WHERE c_custkey % 7 <> 0 AND h <> c_custkey % 4""")
def search_hits(spark, sf_dir):
    """Hits of a search: those without an address go, a search that fails has none."""

    class Client:
        def search(self, text: str, most: int) -> list[dict[str, str]]:
            k = int(text.split()[1])
            if k % 7 == 0:
                raise OSError("quota")
            return [{"title": "t", "url": "" if h == k % 4 else f"https://hit.example/{k}/{h}"} for h in range(3)]

    queries = table(spark, sf_dir, "customer").select(F.concat(F.lit("company "), F.col("c_custkey").cast("string")).alias("query"))
    return queries.mapInPandas(V.search_rows(Client(), 3), V.SEARCH_SCHEMA).select("query", "ord", "url")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS url, CASE c_custkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'browser' END AS strategy, CASE c_custkey % 3 WHEN 2 THEN 'browser: no' END AS error FROM customer""")
def fetched_pages(spark, sf_dir):
    """The first strategy that fetches each address."""

    class Strategy:
        def __init__(self, name: str, rests: tuple[int, ...]):
            self.name, self.rests = name, rests

        def fetch(self, url: str) -> tuple[int, str, bytes]:
            if int(url) % 3 not in self.rests:
                raise OSError(f"{self.name}: no")
            return 200, "text/html", url.encode()

    urls = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"))
    return urls.mapInPandas(V.fetch_first([Strategy("plain", (0,)), Strategy("browser", (1,))]), V.FETCH_SCHEMA).select("url", "strategy", "error")


# A request is a priority and a status: each is asked once, some are in the cache, some fail.
@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'cached ' || o_orderpriority WHEN o_orderpriority LIKE '5%' THEN NULL ELSE upper(o_orderpriority || o_orderstatus) END AS response, 1 AS asked_once FROM orders""")
def cached_calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat("o_orderpriority", "o_orderstatus").alias("request"))
    keyed = o.withColumn("key", V.request_key(F.lit("m"), F.col("request"), F.lit("s")))
    cache = keyed.where("o_orderstatus = 'P'").select("key", F.concat(F.lit("cached "), "o_orderpriority").alias("response")).distinct()
    answers, new = V.cached_calls(keyed.select("key", "request"), cache, lambda batch: [None if x.startswith("5") else x.upper() for x in batch])
    once = new.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).cast("int").alias("asked_once"))
    got = answers.select("key", "response").distinct()
    return keyed.join(got, "key", "left").crossJoin(F.broadcast(once)).select("o_orderkey", "response", "asked_once")


@query("""SELECT CAST(doc_id AS VARCHAR) AS sha256, CASE WHEN doc_id % 2 = 0 THEN 'annual' ELSE 'interim' END AS kind, CAST(2000 + doc_id % 20 AS INTEGER) AS fiscal_year, CAST(least(1.0, (doc_id % 15) / 10.0) AS DOUBLE) AS confidence FROM labels WHERE doc_id % 5 NOT IN (3, 4)""")
def model_classes(spark, sf_dir):
    """Classification by a model, which fails for some documents and invents kinds for others."""

    def respond(batch: list[str]) -> list[str | None]:
        ids = [int(json.loads(x)["link_text"]) for x in batch]
        return [None if k % 5 == 3 else json.dumps({"kind": "odd" if k % 5 == 4 else "annual" if k % 2 == 0 else "interim", "fiscal_year": 2000 + k % 20, "confidence": k % 15 / 10}) for k in ids]

    d = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "labels").select(d.alias("sha256"), d.alias("link_text"))
    got, _ = models.classify_by_model(docs, docs.select("sha256", F.lit("front").alias("text")), no_cache(spark), respond)
    return got.select("sha256", "kind", "fiscal_year", "confidence")


# A brand's labels that fit no name: the model maps some to the first name in capitals, some to names that don't exist.
@query("WITH " + ROWS_SQL + """, resolved AS (SELECT k.*, i.canonical_name AS by_label, b.name AS by_key FROM keyed k LEFT JOIN items i ON i.company_slug = k.company_slug AND i.exact_key = lower(k.clean) LEFT JOIN by_key b ON b.company_slug = k.company_slug AND b.fuzzy = k.fuzzy),
  f AS (SELECT company_slug, arg_min(canonical_name, row_idx) AS name FROM items GROUP BY 1)
  SELECT DISTINCT company_slug, clean AS old, f.name AS canonical FROM resolved JOIN f USING (company_slug) WHERE by_label IS NULL AND by_key IS NULL AND length(clean) % 3 <> 0""")
def model_drift(spark, sf_dir):
    def respond(batch: list[str]) -> list[str | None]:
        asked = [json.loads(x) for x in batch]
        return [json.dumps({"mappings": [{"old_label": o, "canonical_label": "no such name" if len(o) % 3 == 0 else a["names"][0].upper()} for o in [*a["old"], "not asked"]]}) for a in asked]

    rows = report_rows(spark, sf_dir)
    got, _ = models.drift_by_model(rows, X.taxonomy(source_rows(rows)), no_cache(spark), respond)
    return got.select("company_slug", "old", "canonical")


# Reports of even customers are confirmed by the model, with two values for one period; the model fails for the others.
@query("""SELECT CAST(o_custkey AS VARCHAR) AS company_slug, CAST(r AS INTEGER) AS row_idx, CASE WHEN o_custkey % 2 = 0 THEN 'Model ' || o_orderkey ELSE 'Line ' || o_orderkey END AS label,
   CASE WHEN o_custkey % 2 = 0 THEN 'later' ELSE CAST(CAST(o_orderkey AS DECIMAL(30,4)) AS VARCHAR) END AS value, CASE WHEN o_custkey % 2 = 0 THEN 'model' ELSE 'rules' END AS confirmed_by, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS depth
  FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)""")
def model_confirmed(spark, sf_dir):
    def respond(batch: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for asked in map(json.loads, batch):
            lines = [json.loads(x) for x in asked["lines"]]
            cells = [{"period_end": "2024-12-31", "value": "first"}, {"period_end": "2024-12-31", "value": "later"}]
            rows = [{"label": x["raw_label"].replace("Line", "Model"), "cells": cells, "depth": 1, "is_header": False, "is_total": False} for x in lines]
            out.append(None if asked["statement"] == "odd" else json.dumps({"correct_kind": True, "rows": rows}))
        return out

    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    numbered = S.numbered(o, ["o_custkey"], [k], "r").withColumn("row_idx", F.col("r") - 1)
    rows = numbered.select(F.col("o_custkey").cast("string").alias("company_slug"), F.lit("s").alias("source_sha256"), F.lit(2024).alias("source_fiscal_year"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("statement"), F.lit("EUR").alias("currency"), F.lit("units").alias("unit"), F.lit(12).alias("period_months"), "row_idx", F.concat(F.lit("Line "), k.cast("string"), F.lit("x")).alias("label0"), F.create_map(F.lit("2024-12-31"), k.cast("decimal(30,4)")).alias("values_by_period_end"))
    # A footnote marker would be cut off: the label ends in a letter.
    got, _ = models.confirm_by_model(rows.withColumn("raw_label", F.col("label0")).drop("label0"), no_cache(spark), respond)
    return got.select("company_slug", "row_idx", F.regexp_replace("label", "x$", "").alias("label"), F.element_at("values_by_period_end", "2024-12-31").alias("value"), "confirmed_by", "depth")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_sha256, CASE WHEN doc_id % 3 = 0 THEN 'thousands' ELSE 'millions' END AS unit, 'line ' || doc_id AS raw_label, CAST(-doc_id AS BIGINT) AS value FROM labels WHERE doc_id % 4 <> 3""")
def model_extracted(spark, sf_dir):
    """Statements that a model finds on pages; its unit counts unless it says none."""

    def respond(batch: list[str]) -> list[str | None]:
        ids = [int(json.loads(x)["text"].split()[-1]) for x in batch]
        return [json.dumps({"found": k % 4 != 3, "unit": "units" if k % 3 == 0 else "millions", "rows": [{"label": f"line {k}", "cells": [{"period_end": "2024-12-31", "value": f"({k})"}]}]}) for k in ids]

    pages = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sha256"), F.lit("income").alias("kind"), F.concat(F.lit("in thousands of euros "), F.col("doc_id").cast("string")).alias("text"))
    got, _ = models.extract_by_model(pages, no_cache(spark), respond)
    return got.select("source_sha256", "unit", "raw_label", F.element_at("values_by_period_end", "2024-12-31").cast("long").alias("value"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey || '.co.uk' WHEN 1 THEN 'c.org' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.x.ck' ELSE NULL END AS domain FROM customer""")
def registered_domains(spark, sf_dir):
    """Registered domains by a table of public suffixes with a wildcard and an exception."""
    k = F.col("c_custkey")
    rules = spark.createDataFrame([("com",), ("org",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "rule string")
    host = F.when(k % 5 == 0, F.concat(F.lit("ir.c"), k.cast("string"), F.lit(".co.uk"))).when(k % 5 == 1, "a.b.c.org").when(k % 5 == 2, "x.www.ck").when(k % 5 == 3, "b.a.x.ck").otherwise("co.uk")
    return C.registered_domains(table(spark, sf_dir, "customer").select(k.alias("k"), host.alias("host")), rules).select("k", "domain")


@query("SELECT o_orderkey, year(o_orderdate) + o_orderkey % 60 BETWEEN 1990 AND 2030 AS valid FROM orders")
def valid_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_valid_year(F.year("o_orderdate") + F.col("o_orderkey") % 60).alias("valid"))


# A model that looks for each customer's documents: it searches once, then submits what it found; some never submit before they must, for some the search fails.
@query("""SELECT CAST(c_custkey AS VARCHAR) AS company_slug, c_custkey % 3 > 0 AND c_custkey % 4 <> 0 AS found, CAST(CASE WHEN c_custkey % 5 = 0 THEN 4 WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END AS INTEGER) AS rounds,
  CASE WHEN c_custkey % 7 <> 0 OR c_custkey % 5 = 0 THEN 'https://c' || c_custkey || '.example/2024.pdf' END AS url FROM customer""")
def discovery_rounds(spark, sf_dir):
    """Bounded rounds of tool calls in tasks, a company a row; a claim that its page refutes doesn't count."""

    def step(messages: list[dict], last: bool) -> dict:
        k, tools = int(messages[0]["content"]), [m for m in messages if m["role"] == "tool"]
        picks = [json.loads(m["content"]).get("url") for m in tools]
        if last or (tools and k % 5) or k % 7 == 0 and k % 5:
            return {"submit": {"found": k % 3 > 0, "rounds": len(tools) + 1, "url": next((p for p in picks if p), None)}}
        return {"calls": [{"tool": "search", "arguments": {"company": k}}]}

    def search(company: int) -> dict:
        if company % 7 == 0 and company % 5:
            raise OSError("quota")
        return {"url": f"https://c{company}.example/2024.pdf"}

    loop = V.Rounds(step, {"search": search}, most=4)
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("request"))
    got = asked.mapInPandas(V.run_rounds(loop), V.ROUNDS_SCHEMA).select("key", V.parsed(F.col("submission"), "found boolean, rounds int, url string").alias("s"))
    found = S.found_gate(F.col("s.found"), F.lit(True), F.lit(0), F.col("key").cast("long") % 4 != 0)
    return got.select(F.col("key").alias("company_slug"), found.alias("found"), "s.rounds", "s.url")
