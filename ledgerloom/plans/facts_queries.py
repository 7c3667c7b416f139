"""The store's queries over ``events``: a user is a company, an event type a statement line, a day a period, an event a filing.

Values are cents; every eleventh is missing, so that a newest filing without a value hides an older one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts as O
from ledgerloom.plans.registry import query, table

KEYS = ["company_slug", "statement", "canonical_name", "period_end"]

FACTS_SQL = """
facts AS (SELECT CAST(user_id AS VARCHAR) AS company_slug, CASE WHEN user_id % 2 = 0 THEN 'income' ELSE 'balance' END AS statement,
  event_type AS canonical_name, CAST(ts AS DATE) AS period_end, ts, event_id AS seq,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS value,
  CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN event_id % 5 = 0 THEN 'millions' ELSE 'thousands' END AS unit
  FROM events)"""
CELLS_SQL = FACTS_SQL + """,
cells AS (SELECT f.company_slug, f.statement, f.canonical_name, f.period_end, f.value, f.currency, f.unit, f.seq,
    (g.n >= 2 AND g.hi - g.lo > 0.01) AS is_restated
  FROM facts f JOIN (SELECT company_slug, statement, canonical_name, period_end, count(value) n, max(value) hi, min(value) lo, max(ts) newest
    FROM facts GROUP BY ALL) g ON f.company_slug = g.company_slug AND f.statement = g.statement AND f.canonical_name = g.canonical_name
    AND f.period_end = g.period_end AND f.ts = g.newest
  WHERE NOT EXISTS (SELECT 1 FROM facts x WHERE x.company_slug = f.company_slug AND x.canonical_name = f.canonical_name AND x.period_end = f.period_end AND x.ts = f.ts AND x.seq > f.seq))"""
ITEMS_SQL = """,
items AS (SELECT company_slug, statement, canonical_name, CAST(d AS INTEGER) AS display_order FROM
  (SELECT DISTINCT company_slug, statement FROM facts) c,
  (VALUES ('signup', 0), ('Total signup', 1), ('view', 2), ('click', 3), ('Total traffic', 4), ('purchase', 5), ('error', 6)) v(canonical_name, d))"""


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("company_slug"), F.when(F.col("user_id") % 2 == 0, "income").otherwise("balance").alias("statement"),
        F.col("event_type").alias("canonical_name"), F.to_date("ts").alias("period_end"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") * 100)).alias("value"),
        F.when(F.col("event_id") % 3 == 0, "USD").otherwise("EUR").alias("currency"), F.when(F.col("event_id") % 5 == 0, "millions").otherwise("thousands").alias("unit"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.consolidated(filed(spark, sf_dir).withColumn("filing", F.col("seq")), KEYS, [F.col("ts").desc_nulls_last(), F.col("seq").desc_nulls_last()])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["signup", "Total signup", "view", "click", "Total traffic", "purchase", "error"]
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("canonical_name"), F.lit(k).alias("display_order")) for k, n in enumerate(names)])).alias("l")
    return filed(spark, sf_dir).select("company_slug", "statement").distinct().select("company_slug", "statement", lines).select("company_slug", "statement", "l.*", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_header"), F.col("l.canonical_name").startswith("Total").alias("is_total"))


def printed(df: DataFrame) -> DataFrame:
    return df.withColumn("period_end", F.col("period_end").cast("string"))


@query("WITH " + CELLS_SQL + " SELECT company_slug, statement, canonical_name, CAST(period_end AS VARCHAR) AS period_end, value, currency, unit, is_restated FROM cells")
def consolidated_latest(spark, sf_dir):
    return printed(cells(spark, sf_dir)).select(*KEYS, "value", "currency", "unit", "is_restated")


@query("WITH " + CELLS_SQL + ITEMS_SQL + """ SELECT i.company_slug, i.statement, i.canonical_name, i.display_order, CAST(c.period_end AS VARCHAR) AS period_end, c.value, c.is_restated
  FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name""")
def consolidated_rows(spark, sf_dir):
    return printed(O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir))).select("company_slug", "statement", "canonical_name", "display_order", "period_end", "value", "is_restated")


@query("WITH " + CELLS_SQL + ITEMS_SQL + """ SELECT * FROM (SELECT i.company_slug, i.statement, i.canonical_name, CAST(c.period_end AS VARCHAR) AS period_end,
  row_number() OVER (PARTITION BY i.company_slug, i.statement ORDER BY i.display_order NULLS LAST, c.period_end DESC NULLS LAST) AS place
  FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name) WHERE place <= 60""")
def ordered_rows_top(spark, sf_dir):
    """What a verifier is shown of each statement: its first 60 rows."""
    from ledgerloom.operators.selection import MOST_LINES, first_rows

    rows = O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir))
    return printed(first_rows(rows, ["company_slug", "statement"], [F.col("display_order").asc_nulls_last(), F.col("period_end").desc_nulls_last()], MOST_LINES)).select("company_slug", "statement", "canonical_name", "period_end", "place")


@query("WITH " + CELLS_SQL + ITEMS_SQL + """ SELECT i.company_slug, i.statement, i.canonical_name, CAST(c.period_end AS VARCHAR) AS period_end,
  row_number() OVER (PARTITION BY i.company_slug, i.statement ORDER BY i.display_order NULLS LAST, c.period_end DESC NULLS LAST) AS place
  FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name""")
def ordered_rows(spark, sf_dir):
    """The place of every row, from the first to the last of its statement."""
    rows = O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir))
    from ledgerloom.operators.selection import numbered

    return printed(numbered(rows, ["company_slug", "statement"], [F.col("display_order").asc_nulls_last(), F.col("period_end").desc_nulls_last()], "place")).select("company_slug", "statement", "canonical_name", "period_end", "place")


@query("WITH " + FACTS_SQL + " SELECT company_slug, statement, count(*) AS n FROM facts GROUP BY 1, 2")
def statement_summary(spark, sf_dir):
    return O.statement_summary(filed(spark, sf_dir))


@query("WITH " + FACTS_SQL + """ SELECT company_slug, canonical_name, CAST(period_end AS VARCHAR) AS period_end, max(seq) AS seq, arg_max(currency, seq) AS currency FROM facts
  GROUP BY company_slug, canonical_name, period_end""")
def upsert_last_wins(spark, sf_dir):
    """All facts into an empty store: of equal keys the last one written."""
    f = filed(spark, sf_dir).select("company_slug", "canonical_name", "period_end", "seq", "currency")
    return printed(O.upsert(None, f, ["company_slug", "canonical_name", "period_end"]))


# Every event is in one of the two inputs; an incoming row wins over an existing one, whatever its number.
@query("WITH " + FACTS_SQL + """ SELECT company_slug, canonical_name, CAST(period_end AS VARCHAR) AS period_end,
  coalesce(max(seq) FILTER (seq % 4 = 1), max(seq)) AS seq, coalesce(arg_max(currency, seq) FILTER (seq % 4 = 1), arg_max(currency, seq)) AS currency
  FROM facts GROUP BY company_slug, canonical_name, period_end""")
def upsert_merged(spark, sf_dir):
    f = filed(spark, sf_dir).select("company_slug", "canonical_name", "period_end", "seq", "currency")
    return printed(O.upsert(f.where("seq % 4 <> 1"), f.where("seq % 4 = 1"), ["company_slug", "canonical_name", "period_end"]))


# The company is loaded again from what it has anyway, with later numbers; the others keep their rows.
@query("WITH " + FACTS_SQL + """ SELECT company_slug, canonical_name, CASE WHEN company_slug = '7' THEN seq + 1000000 ELSE seq END AS seq FROM facts""")
def reset_company(spark, sf_dir):
    f = filed(spark, sf_dir).select("company_slug", "canonical_name", "seq")
    return O.reset_company(f, O.statement_rows(f.withColumn("statement", F.lit("all")), "7", "all").drop("statement").withColumn("seq", F.col("seq") + 1_000_000), "7")


@query("WITH " + CELLS_SQL + ITEMS_SQL + """ SELECT i.canonical_name, CAST(c.period_end AS VARCHAR) AS period_end, c.value FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name
  WHERE i.company_slug = '8' AND i.statement = 'income'""")
def one_statement(spark, sf_dir):
    """The point lookup of a viewer: one company's statement."""
    return printed(O.statement_rows(O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir)), "8", "income")).select("canonical_name", "period_end", "value")


@query("WITH " + FACTS_SQL + """, touched AS (SELECT DISTINCT company_slug FROM facts WHERE seq % 97 = 0)
  SELECT company_slug, canonical_name, seq FROM facts WHERE seq % 97 = 0 OR company_slug NOT IN (SELECT company_slug FROM touched)""")
def reset_merged(spark, sf_dir):
    f = filed(spark, sf_dir).select("company_slug", "canonical_name", "seq")
    return O.reset_company(f.where("seq % 97 <> 0"), f.where("seq % 97 = 0"))


@query("WITH " + CELLS_SQL + ITEMS_SQL + """, joined AS (SELECT i.company_slug, i.statement, i.canonical_name, i.display_order, c.* EXCLUDE (company_slug, statement, canonical_name)
   FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name)
  SELECT company_slug, statement, string_agg(DISTINCT CAST(period_end AS VARCHAR), ',' ORDER BY CAST(period_end AS VARCHAR) DESC) AS periods, count(DISTINCT canonical_name) AS n_rows,
    (SELECT currency FROM joined j WHERE j.company_slug = o.company_slug AND j.statement = o.statement AND currency IS NOT NULL ORDER BY display_order, period_end DESC LIMIT 1) AS currency,
    (SELECT unit FROM joined j WHERE j.company_slug = o.company_slug AND j.statement = o.statement AND unit IS NOT NULL ORDER BY display_order, period_end DESC LIMIT 1) AS unit
  FROM joined o GROUP BY company_slug, statement""")
def document_headers(spark, sf_dir):
    head = O.document_header(O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir)))
    return head.select("company_slug", "statement", F.array_join("periods", ",").alias("periods"), "n_rows", "currency", "unit")


CELL_TEXT = "CAST(c.period_end AS VARCHAR) || '=' || coalesce(CAST(c.value AS VARCHAR), 'none') || '@' || c.seq || CASE WHEN c.is_restated THEN '!' ELSE '' END"


def cell_texts(values):
    """A map of cells as text, by period."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["value"], F.lit("none")), F.lit("@"), e["value"]["source_fiscal_year"].cast("string"), F.when(e["value"]["is_restated"], "!").otherwise(""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), entry), ",")


@query("WITH " + CELLS_SQL + ITEMS_SQL + f""" SELECT i.company_slug, i.statement, i.canonical_name, coalesce(string_agg({CELL_TEXT}, ',' ORDER BY c.period_end), '') AS cells
  FROM items i LEFT JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name GROUP BY ALL""")
def pivoted_cells(spark, sf_dir):
    p = O.pivot_cells(O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir).withColumnRenamed("filing", "source_fiscal_year")))
    return p.select("company_slug", "statement", "canonical_name", cell_texts(F.col("values")).alias("cells"))


# Companies without any statement are there too.
@query("WITH " + FACTS_SQL + """, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS slug FROM customer UNION SELECT company_slug FROM facts)
  SELECT slug, string_agg(DISTINCT statement, ',' ORDER BY statement) AS statements, string_agg(DISTINCT strftime(period_end, '%Y-%m'), ',' ORDER BY strftime(period_end, '%Y-%m') DESC) AS periods,
   CASE WHEN count(period_end) > 0 THEN min(year(period_end)) || '–' || max(year(period_end)) || ' · ' || count(DISTINCT year(period_end)) || ' yrs' END AS coverage FROM c LEFT JOIN facts ON company_slug = slug GROUP BY 1""")
def company_coverage(spark, sf_dir):
    f = filed(spark, sf_dir)
    index = f.groupBy("company_slug", "statement").agg(F.array_sort(F.collect_set(F.date_format("period_end", "yyyy-MM"))).alias("periods"))
    companies = f.select(F.col("company_slug").alias("slug")).union(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"))).distinct().withColumn("name", F.col("slug"))
    return O.company_coverage(companies, index).select("slug", F.array_join("statements", ",").alias("statements"), F.array_join("periods", ",").alias("periods"), "coverage")


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed(spark, sf_dir).select(F.col("company_slug").alias("slug"), F.concat(F.lit("Company "), F.col("company_slug")).alias("name"), F.lit("T").alias("ticker"), F.lit("X").alias("exchange")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.consolidated_rows(items(spark, sf_dir), cells(spark, sf_dir).withColumnRenamed("filing", "source_fiscal_year"))
    return O.statement_documents(rows, company_names(spark, sf_dir))


# Every statement has the same lines: two sections end in totals and get headers, what follows the last total has none.
@query("WITH " + CELLS_SQL + ITEMS_SQL + f""", lines AS (SELECT * FROM (VALUES (0, 'Signup', 0, true, false), (1, 'signup', 1, false, false), (2, 'Total signup', 1, false, true), (3, 'Traffic', 0, true, false), (4, 'view', 1, false, false), (5, 'click', 1, false, false), (6, 'Total traffic', 1, false, true), (7, 'purchase', 0, false, false), (8, 'error', 0, false, false)) v(display_order, canonical_name, depth, is_header, is_total)),
  s AS (SELECT DISTINCT company_slug, statement FROM facts), o AS (SELECT i.display_order, c.* FROM items i JOIN cells c ON i.company_slug = c.company_slug AND i.statement = c.statement AND i.canonical_name = c.canonical_name),
  h AS (SELECT company_slug, statement, arg_min(currency, (display_order, -epoch(period_end))) AS currency, arg_min(unit, (display_order, -epoch(period_end))) AS unit, string_agg(DISTINCT CAST(period_end AS VARCHAR), ',' ORDER BY CAST(period_end AS VARCHAR) DESC) AS periods FROM o GROUP BY 1, 2)
  SELECT s.company_slug, s.statement, 'Company ' || s.company_slug AS company, h.currency, h.unit, coalesce(h.periods, '') AS periods, l.display_order, l.canonical_name, l.depth, l.is_header, l.is_total, coalesce(string_agg({CELL_TEXT}, ',' ORDER BY c.period_end), '') AS cells
  FROM s CROSS JOIN lines l LEFT JOIN h ON h.company_slug = s.company_slug AND h.statement = s.statement LEFT JOIN cells c ON c.company_slug = s.company_slug AND c.statement = s.statement AND c.canonical_name = l.canonical_name GROUP BY ALL""")
def statement_documents(spark, sf_dir):
    """Nested documents for all companies in one job, as JSON; read again and laid out a line a row."""
    docs = documents(spark, sf_dir)
    texts = docs.select("company_slug", "statement", "company", "currency", "unit", F.array_join("periods", ",").alias("periods"), F.to_json("rows").alias("json"))
    lines = texts.withColumn("r", F.explode(F.from_json("json", docs.schema["rows"].dataType)))
    return lines.select("company_slug", "statement", "company", "currency", "unit", "periods", "r.display_order", "r.canonical_name", "r.depth", "r.is_header", "r.is_total", cell_texts(F.col("r.values")).alias("cells"))


@query("WITH " + FACTS_SQL + """, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS slug FROM customer UNION SELECT company_slug FROM facts)
  SELECT slug, CAST(count(DISTINCT statement) AS BIGINT) AS n_statements, count(statement) > 0 AS has_data, coalesce(string_agg(DISTINCT 'Company ' || slug || ':T:' || statement || ':9', ',' ORDER BY 'Company ' || slug || ':T:' || statement || ':9'), '') AS entries FROM c LEFT JOIN facts ON company_slug = slug GROUP BY 1""")
def document_index(spark, sf_dir):
    """The index of exported documents, written and read again: every company, and an entry for each document."""
    from ledgerloom.sources import files

    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slug")).union(filed(spark, sf_dir).select("company_slug")).distinct().select("slug", F.col("slug").alias("name"), F.lit(None).cast("string").alias("sources"), F.lit(None).cast("double").alias("shares_outstanding_m"), F.lit(None).cast("string").alias("market_ticker"))
    path = files.scratch(spark, "index")
    if files.read_index(spark, path) is not None:
        raise ValueError("a new path has no index")
    files.write_index(*O.document_index(everyone, documents(spark, sf_dir)), path)
    companies, entries = files.read_index(spark, path)
    own = entries.groupBy(F.col("company_slug").alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "company_name", "ticker", "statement", F.col("rows").cast("string")))), ",").alias("entries"))
    return companies.join(own, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).cast("long").alias("n_statements"), "has_data", F.coalesce("entries", F.lit("")).alias("entries"))
