"""Searches of whole tables of questions, and links judged by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import crawl as C
from ledgerloom.operators import search
from ledgerloom.plans.registry import query, table

# Every customer and part is a title, and asks three questions: a run of its own characters of one to twelve, its whole name in capitals with spaces around, and something that few have.
TITLES_SQL = "t AS (SELECT c_custkey * 2 AS ord, c_name AS title, c_mktsegment || c_custkey % 50 AS ticker FROM customer UNION ALL SELECT p_partkey * 2 + 1, p_name, p_brand || p_partkey FROM part)"
NEEDLES_SQL = "n AS (SELECT substr(title, CAST(ord % 11 + 1 AS INTEGER), CAST(1 + ord % 12 AS INTEGER)) AS needle FROM t UNION SELECT ' ' || upper(title) || ' ' FROM t UNION SELECT lower(ticker) FROM t UNION SELECT 'none ' || ord FROM t)"


@query(f"""WITH {TITLES_SQL}, {NEEDLES_SQL}, q AS (SELECT needle, lower(trim(needle)) AS a FROM n), d AS (SELECT DISTINCT a FROM q),
  h AS (SELECT a, min(ord) AS ord FROM d JOIN t ON contains(lower(title), a) OR lower(ticker) = a GROUP BY a) SELECT needle, lpad(CAST(ord AS VARCHAR), 10, '0') AS cik FROM q JOIN h USING (a)""")
def many_needles(spark, sf_dir):
    """Each question's first company by ticker or by a part of its title."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    titles = c.select((F.col("c_custkey") * 2).alias("ord"), F.col("c_name").alias("title"), F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("ticker")).unionByName(
        p.select((F.col("p_partkey") * 2 + 1).alias("ord"), F.col("p_name").alias("title"), F.concat("p_brand", F.col("p_partkey").cast("string")).alias("ticker"))
    )
    o = F.col("ord")
    needles = titles.select(F.explode(F.array(F.substring("title", (o % 11 + 1).cast("int"), (1 + o % 12).cast("int")), F.concat(F.lit(" "), F.upper("title"), F.lit(" ")), F.lower("ticker"), F.concat(F.lit("none "), o.cast("string")))).alias("needle")).distinct()
    return C.cik_lookup(needles, titles.withColumn("cik", o)).select("needle", "cik")


# Each customer asks for its segment with a character missing, doubled or exchanged, and the begin of its nation.
TYPO_SQL = "CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN substr(c_mktsegment, 1, 2) || substr(c_mktsegment, 4) WHEN 2 THEN substr(c_mktsegment, 1, 5) || substr(c_mktsegment, 5) ELSE substr(c_mktsegment, 1, 3) || 'x' || substr(c_mktsegment, 5) END"


@query(f"""WITH r AS (SELECT c_custkey AS key, list_distinct(list_filter(regexp_split_to_array(lower(c_mktsegment || ' ' || n_name || ' k' || c_custkey % 100), '[^a-z0-9]+'), lambda w: w <> '')) AS words, lower({TYPO_SQL}) || ' ' || lower(substr(n_name, 1, CAST(1 + c_custkey % 3 AS INTEGER))) || CASE WHEN c_custkey % 7 = 0 THEN ' k' || c_custkey % 100 ELSE '' END AS query FROM customer JOIN nation ON c_nationkey = n_nationkey),
  q AS (SELECT query, unnest(list_distinct(string_split(query, ' '))) AS a, len(list_distinct(string_split(query, ' '))) AS n FROM (SELECT DISTINCT query FROM r)), v AS (SELECT DISTINCT unnest(words) AS w FROM r), d AS (SELECT DISTINCT a FROM q),
  s AS (SELECT a, w, CASE WHEN a = w THEN 1.0 WHEN starts_with(w, a) THEN 0.9 WHEN contains(w, a) THEN 0.7 WHEN least(length(a), length(w)) >= 4 AND levenshtein(a, w) = 1 THEN 0.6 WHEN least(length(a), length(w)) >= 4 AND levenshtein(a, w) = 2 THEN 0.4 END AS s FROM d, v),
  h AS (SELECT query, n, key, a, max(s) AS s FROM q JOIN s USING (a) JOIN (SELECT key, unnest(words) AS w FROM r) x USING (w) WHERE s IS NOT NULL GROUP BY ALL), g AS (SELECT query, key, CAST(round(sum(s) / any_value(n), 6) AS DOUBLE) AS score FROM h GROUP BY query, key HAVING count(*) = any_value(n))
  SELECT query, key, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS place FROM g QUALIFY place <= 10""")
def ranked_palette(spark, sf_dir):
    """The best ten customers for each question, by how well their words answer its words."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat(F.lit("k"), (F.col("c_custkey") % 100).cast("string"))
    asked = F.concat(F.lower(F.expr(TYPO_SQL)), F.lit(" "), F.lower(F.expr("substr(n_name, 1, CAST(1 + c_custkey % 3 AS INTEGER))")), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" "), code)).otherwise(""))
    rows = c.select("c_custkey", "c_mktsegment", "n_name", code.alias("code"), asked.alias("query"))
    return search.ranked_search(rows.select("query"), rows.drop("query"), "c_custkey", ["c_mktsegment", "n_name", "code"])


# Hosts under a suffix of which anyone can have a name, under a wildcard and its exception, and under two labels that no list of a few has.
SUFFIXES = ("com", "io", "github.io", "uk", "co.uk", "*.ck", "!city.ck", "zz", "gov.zz")


@query("""WITH p AS (SELECT page_id, page_id % 5 AS a, page_id % 7 AS b, page_id % 4 AS k FROM pages)
  SELECT page_id, 'https://' || CASE k WHEN 0 THEN 'n' || b || '.github.io' WHEN 1 THEN 'files.n' || b || '.co.uk' WHEN 2 THEN 'x.n' || b || '.m.ck' ELSE 'ir.n' || b || '.gov.zz' END || '/r/' || page_id || '.pdf' AS url FROM p WHERE a = b UNION ALL SELECT page_id, 'https://city.ck/' || page_id || '.pdf' FROM p WHERE k = 2 AND page_id % 3 = 0""")
def suffix_links(spark, sf_dir):
    """Documents of the seed's organisation, told by a table of public suffixes."""
    rules = spark.createDataFrame([(r,) for r in SUFFIXES], "rule string")
    i = F.col("page_id")
    host = lambda sub, n: F.concat(*[F.when(i % 4 == k, F.concat(F.lit(sub[k]), F.lit("n"), (i % n).cast("string"), F.lit(tail))).otherwise("") for k, tail in enumerate((".github.io", ".co.uk", ".m.ck", ".gov.zz"))])
    exception = (i % 4 == 2) & (i % 3 == 0)
    link = lambda target: F.concat(F.lit('<a href="https://'), target, F.lit('.pdf">x</a>'))
    html = F.concat(link(F.concat(host(("", "files.", "x.", "ir."), 7), F.lit("/r/"), i.cast("string"))), F.when(exception, F.concat(F.lit('<form action="https://city.ck/'), i.cast("string"), F.lit('.pdf"></form>'))).otherwise(""))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.concat(F.lit("https://www."), host(("", "", "", ""), 5), F.lit("/ir/"), i.cast("string")).alias("page_url"), F.concat(F.lit("https://www."), host(("", "", "", ""), 5)).alias("seed_url"))
    own = C.pdf_links(pages, rules)
    other = C.pdf_links(pages.where(exception).withColumn("seed_url", F.lit("https://a.b.city.ck")), rules)
    found = own.unionByName(other)
    return found.select(F.regexp_extract("url", r"(\d+)\.pdf$", 1).cast("long").alias("page_id"), "url")
