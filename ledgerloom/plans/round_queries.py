"""Work in rounds and growing tables: pages asked for within a budget, staged tiers, crawls by levels, contents that are stored once. Models are deterministic stand-ins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import crawl, frontier, ingest, rounds
from ledgerloom.operators.calls import CallTable
from ledgerloom.plans.registry import query, table
from ledgerloom.sources import files, incremental

KINDS = ("income", "balance", "cashflow")

# A conversation is a document, and its turns are pages: candidates for two or all kinds. The model answers by the text's length; sometimes it fails.
PAGES_SQL = """pages AS (SELECT conv_id AS d, k, turn, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS place, (length(text) + k) % 4 = 0 AND length(text) % 9 <> 0 AS good
    FROM (SELECT conv_id, turn, any_value(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL), range(0, 3) r(k) WHERE (turn + conv_id + k) % 3 <> 0 OR conv_id % 2 = 0)"""


# One candidate after the other, as a machine with a state: which kinds are found, and how many calls were made.
@query(f"""WITH RECURSIVE {PAGES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k, place) AS n FROM pages WHERE place <= 12),
  w AS (SELECT d, 0 AS n, 0 AS k, 0 AS place, false AS asked, false AS good, 0 AS calls, -1 AS last_found FROM (SELECT DISTINCT d FROM c)
    UNION ALL SELECT c.d, c.n, c.k, c.place, c.k <> w.last_found AND w.calls < 6, c.good, w.calls + CAST(c.k <> w.last_found AND w.calls < 6 AS INTEGER), CASE WHEN c.k <> w.last_found AND w.calls < 6 AND c.good THEN c.k ELSE w.last_found END FROM w JOIN c ON c.d = w.d AND c.n = w.n + 1)
  SELECT CAST(d AS VARCHAR) AS sha256, CASE k WHEN 0 THEN 'income' WHEN 1 THEN 'balance' ELSE 'cashflow' END AS kind, CAST(place AS INTEGER) AS place, CAST(calls AS INTEGER) AS round, good AS found FROM w WHERE asked""")
def asked_pages(spark, sf_dir):
    """Six calls a document and twelve pages a kind at most: which page of which kind each round asks for, and where a statement was found."""
    return asked(spark, sf_dir).select("sha256", "kind", "place", "round", "found")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def respond(batch: list[str]) -> list[str | None]:
        asked = [json.loads(x) for x in batch]
        return [None if len(a["text"]) % 9 == 0 else json.dumps({"found": (len(a["text"]) + KINDS.index(a["kind"])) % 4 == 0}) for a in asked]

    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    k = F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("kind")) - 1
    pages = turns.select("conv_id", "turn", "text", F.explode(F.array(*[F.lit(x) for x in KINDS])).alias("kind")).where(((F.col("turn") + F.col("conv_id") + k) % 3 != 0) | (F.col("conv_id") % 2 == 0))
    candidates = pages.select(F.col("conv_id").cast("string").alias("sha256"), "kind", F.col("turn").alias("place"), "text")
    found = F.from_json("response", "found boolean")["found"]
    return rounds.ask_pages(candidates, F.struct("kind", "text"), found, CallTable(spark, files.scratch(spark, "calls")), respond)


# An order is a document. Which kinds a tier has, and what its verdict says, follows from the key.
TIERS_SQL = """w AS (SELECT o_orderkey AS d, k FROM orders, range(0, 3) r(k)),
  h AS (SELECT d, k, (d + k) % 4 <> 0 AS has, (d + k) % 5 = 1 AS none, (d + k) % 3 <> 0 AND ((d // 3) + k) % 7 <> 2 AS good FROM w), a1 AS (SELECT d, k FROM h WHERE has AND (none OR good)), w2 AS (SELECT * FROM w EXCEPT SELECT * FROM a1),
  v AS (SELECT d, k FROM w2 WHERE (d + 2 * k) % 3 <> 1), a2 AS (SELECT d, k FROM v WHERE d % 11 = 0 OR (d + k) % 2 = 0), w3 AS (SELECT * FROM w2 EXCEPT SELECT * FROM a2), a3 AS (SELECT d, k FROM w3 WHERE d % 2 = 0)"""
KIND_SQL = "CASE k WHEN 0 THEN 'income' WHEN 1 THEN 'balance' ELSE 'cashflow' END"


@query(f"""WITH {TIERS_SQL}, t AS (SELECT 'heuristic' AS tier, d, k, false AS asked FROM a1 UNION ALL SELECT 'vision', d, k, false FROM a2 UNION ALL SELECT 'text', d, k, false FROM a3
    UNION ALL SELECT 'heuristic', d, k, true FROM w UNION ALL SELECT 'vision', d, k, true FROM w2 UNION ALL SELECT 'text', d, k, true FROM w3)
  SELECT tier, CAST(d AS VARCHAR) AS source_sha256, {KIND_SQL} AS statement, asked FROM t""")
def staged_tiers(spark, sf_dir):
    """Statements from three tiers, and what each of them was asked for: what the ones before lack, or gave with a bad verdict."""
    d = F.col("source_sha256").cast("long")
    k = F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("statement")) - 1

    def verify(found: DataFrame) -> DataFrame:
        heuristic = F.when((d + k) % 5 == 1, None).otherwise(F.when((d + k) % 3 == 0, 0.4).otherwise(0.5))
        severity = F.when((F.floor(d / 3) + k) % 7 == 2, "critical").otherwise("minor")
        vision = F.when(d % 11 == 0, None).otherwise(F.when((d + k) % 2 == 0, 0.9).otherwise(0.1))
        confidence = F.when(F.col("tier") == "vision", vision).otherwise(heuristic)
        issues = F.when(F.col("tier") == "heuristic", F.array(F.struct(severity.alias("severity")))).otherwise(F.array().cast("array<struct<severity:string>>"))
        return found.select("source_sha256", "statement", F.lit(True).alias("is_correct_kind"), issues.alias("issues"), confidence.alias("confidence")).where("confidence is not null")

    def of_tier(name: str) -> rounds.Verify:
        return lambda found: verify(found.withColumn("tier", F.lit(name)))

    verdicts = iter([of_tier("heuristic"), of_tier("vision")])
    tiers = [
        rounds.Tier("heuristic", lambda work: work.where((d + k) % 4 != 0)),
        rounds.Tier("vision", lambda work: work.where((d + 2 * k) % 3 != 1)),
        rounds.Tier("text", lambda work: work.where(d % 2 == 0), verified=False),
    ]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_sha256"))
    taken, asked = rounds.escalate(orders, tiers, lambda found: next(verdicts)(found), KINDS)
    return taken.select("tier", "source_sha256", "statement", F.lit(False).alias("asked")).unionByName(asked.withColumn("asked", F.lit(True)))


# Each host is a source whose pages link to two others each, to a document, and to what they have anyway; the host's number tells its patterns and depth.
HOST = r"^[a-z]+://([^/?#]+)"
LINKED_SQL = f"""p AS (SELECT page_id AS i, url, html, regexp_extract(url, '{HOST}', 1) AS h, count(*) OVER () AS n FROM pages),
  s AS (SELECT h, length(h) + ascii(h) AS k, min_by(url, i) AS first, max_by(url, i) AS last FROM p GROUP BY h),
  l AS (SELECT url AS page, unnest(list_concat(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[''"]([^''"]+)[''"][^>]*>', 1), ['/files/' || i || '.pdf'])) AS href FROM p
    UNION ALL SELECT a.url, b.url FROM p a JOIN p b ON b.i IN ((2 * a.i + 1) % a.n, (3 * a.i + 2) % a.n)),
  r AS (SELECT DISTINCT page, CASE WHEN href LIKE '%://%' THEN href ELSE regexp_extract(page, '^[a-z]+://[^/?#]+') || href END AS link FROM l),
  j AS (SELECT h, k % 4 AS most, page, link, regexp_matches(link, CASE WHEN k % 2 = 0 THEN '\\.pdf$' ELSE '/(files|the)' END) AS doc, CASE k % 3 WHEN 0 THEN regexp_matches(link, '/(en|fr)/') WHEN 1 THEN regexp_matches(link, 'example\\.(com|org)/') ELSE false END AS follow FROM r, s)"""


@query(f"""WITH RECURSIVE {LINKED_SQL}, w AS (SELECT h, first AS url, 0 AS depth FROM s UNION SELECT h, last, 0 FROM s UNION SELECT j.h, j.link, w.depth + 1 FROM w JOIN j ON j.h = w.h AND j.page = w.url AND j.follow AND NOT j.doc AND w.depth < j.most),
  v AS (SELECT h, url, min(depth) AS depth FROM w GROUP BY ALL)
  SELECT h AS source_name, url, CAST(depth AS INTEGER) AS depth, 'page' AS kind FROM v UNION ALL SELECT v.h, j.link, CAST(min(v.depth) AS INTEGER), 'document' FROM v JOIN j ON j.h = v.h AND j.page = v.url AND j.doc GROUP BY v.h, j.link
  UNION ALL SELECT h, 'https://' || h || '/direct', NULL, 'document' FROM s""")
def site_crawl(spark, sf_dir):
    """From entry pages to documents: levels over a page store, links judged by each source's own patterns."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), "url", "html")
    n = F.broadcast(pages.agg(F.count(F.lit(1)).alias("n")))
    to = pages.crossJoin(n).select("i", F.explode(F.array((2 * F.col("i") + 1) % F.col("n"), (3 * F.col("i") + 2) % F.col("n"))).alias("j"))
    added = to.join(pages.select(F.col("i").alias("j"), F.col("url").alias("target")), "j").groupBy("i").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    links = F.concat(F.array_join(F.transform(F.coalesce("targets", F.array()), lambda t: F.concat(F.lit('<a href="'), F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit('">page</a>'))), ""), F.lit("<a href='/files/"), F.col("i").cast("string"), F.lit(".pdf'>a <b>report</b></a>"))
    # An address may have several pages, and a fetch answers once: with all of them, one after the other.
    rendered = pages.join(added, "i", "left").select("url", "i", F.concat(F.coalesce("html", F.lit("")), links).alias("html"))
    web = rendered.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "html"))), lambda p: p["html"]), "").alias("html"))
    path = files.scratch(spark, "web")
    web.write.parquet(path)
    web = spark.read.parquet(path)

    def fetch(urls: DataFrame) -> DataFrame:
        return urls.join(web, "url", "left").select("url", "html", F.when(F.col("html").isNull(), "status 404").alias("error"))

    hosts = pages.withColumn("slug", F.regexp_extract("url", HOST, 1)).groupBy("slug").agg(F.min_by("url", "i").alias("first"), F.max_by("url", "i").alias("last"))
    k = F.length("slug") + F.ascii("slug")
    sources = hosts.select(
        "slug", F.col("slug").alias("source_name"), F.array("first", "last").alias("entry_urls"), F.array(F.concat(F.lit("https://"), "slug", F.lit("/direct"))).alias("direct_urls"), F.when(k % 2 == 0, r"\.pdf$").otherwise("/(files|the)").alias("link_filter"),
        F.when(k % 3 == 0, "/(en|fr)/").when(k % 3 == 1, r"example\.(com|org)/").alias("follow_links"), (k % 4).alias("max_follow_depth"),
    )
    candidates, visited = frontier.crawl_sources(sources, frontier.PageStore(spark, files.scratch(spark, "page-store"), fetch))
    return candidates.select("source_name", "url", "depth", F.lit("document").alias("kind")).unionByName(visited.select("source_name", "url", "depth", F.lit("page").alias("kind")))


@query("""SELECT md5(text) AS name, CAST(count(DISTINCT doc_id) AS BIGINT) AS copies, CAST(max(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE 2 END) AS INTEGER) AS last_run, CAST(1 AS BIGINT) AS stored FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def growing_store(spark, sf_dir):
    """Three runs over overlapping contents: each content is stored once, and the manifest names its last run."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    root = files.scratch(spark, "contents")
    manifest = None
    for run in range(3):
        own = docs.where(F.col("doc_id") % 3 == run).select(F.sha2("text", 256).alias("sha256"), F.encode("text", "utf-8").alias("content"), F.md5("text").alias("name"), F.lit(run).alias("last_run"), F.col("doc_id").alias("ord"))
        staged = rounds.written(own, files.scratch(spark, "downloads"))
        ingest.add_contents(staged.select("sha256", "content"), root)
        rows = staged.drop("content")
        manifest = rounds.written(crawl.merge_manifest(manifest if manifest is not None else rows.limit(0), rows), files.scratch(spark, "manifest"))
    stored = spark.read.parquet(root).groupBy("sha256").agg(F.count(F.lit(1)).alias("stored"))
    copies = docs.groupBy(F.md5("text").alias("name")).agg(F.count_distinct("doc_id").alias("copies"))
    return manifest.join(stored, "sha256", "left").join(copies, "name").select("name", "copies", "last_run", "stored")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'later' END AS folder, CAST(o_totalprice AS DOUBLE) AS price FROM orders""")
def changed_files(spark, sf_dir):
    """Files of records in a folder that grows: the second run opens what came after the first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    root = files.scratch(spark, "incoming")
    folder = incremental.IncrementalFolder(spark, f"{root}/in", f"{root}/state", records, "*.json")
    for name, part in (("first", F.col("o_orderstatus") == "F"), ("later", F.col("o_orderstatus") != "F")):
        orders.where(part).drop("o_orderstatus").write.json(f"{root}/in/{name}")
        folder.refresh()
    if folder.refresh():
        raise ValueError("files that haven't changed were opened again")
    return folder.rows().select("o_orderkey", F.regexp_extract("path", "/in/([a-z]+)/", 1).alias("folder"), "price")


def records(opened: DataFrame) -> DataFrame:
    """JSON lines of opened files."""
    lines = opened.select("path", F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).where("line <> ''")
    return lines.select("path", F.from_json("line", "o_orderkey long, price double").alias("r")).select("path", "r.*")
