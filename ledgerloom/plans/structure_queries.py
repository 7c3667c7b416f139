"""Taxonomies, hierarchies and choices, over ``part``, ``orders``, ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as Y
from ledgerloom.operators import selection as S
from ledgerloom.operators import taxonomy as X
from ledgerloom.plans.registry import query, table

# A brand is a company; parts with p_partkey % 3 = r are the report of year 2020 + r.
ROWS_SQL = """rows_ AS (SELECT p_brand AS company_slug, 'income' AS statement, 2020 + p_partkey % 3 AS fy, p_partkey AS row_idx, p_name || CASE p_size % 4 WHEN 0 THEN ' (1)' WHEN 1 THEN ',' WHEN 2 THEN '' ELSE ' ' || p_size || 'xx' END AS label FROM part),
keyed AS (SELECT *, trim(regexp_replace(label, '\\s*\\(?\\d{1,2}\\)?$', '')) AS clean, replace(lower(trim(regexp_replace(label, '\\s*\\(?\\d{1,2}\\)?$', ''))), ',', '') AS fuzzy FROM rows_),
counts AS (SELECT company_slug, fy, count(*) AS n FROM rows_ GROUP BY 1, 2),
source AS (SELECT company_slug, coalesce(max(CASE WHEN n >= 30 THEN fy END), max(fy)) AS fy FROM counts GROUP BY 1),
own AS (SELECT k.* FROM keyed k JOIN source USING (company_slug, fy)),
items AS (SELECT company_slug, arg_min(clean, row_idx) AS canonical_name, lower(clean) AS exact_key, arg_min(fuzzy, row_idx) AS fuzzy, min(row_idx) AS row_idx FROM own GROUP BY company_slug, lower(clean)),
by_key AS (SELECT company_slug, fuzzy, arg_min(canonical_name, row_idx) AS name FROM items GROUP BY 1, 2)"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("p_size") % 4 == 0, " (1)").when(F.col("p_size") % 4 == 1, ",").when(F.col("p_size") % 4 == 2, "").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("xx")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("company_slug"), F.lit("income").alias("statement"), (2020 + F.col("p_partkey") % 3).alias("source_fiscal_year"), F.col("p_partkey").alias("row_idx"), F.concat("p_name", note).alias("label"))


def source_rows(rows: DataFrame) -> DataFrame:
    reports = rows.groupBy(*X.GROUP, "source_fiscal_year").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("ord"))
    return rows.join(X.taxonomy_source(reports, 30).select(*X.GROUP, "source_fiscal_year"), [*X.GROUP, "source_fiscal_year"], "left_semi")


@query("WITH " + ROWS_SQL + " SELECT company_slug, canonical_name, row_idx AS display_order FROM items")
def taxonomy_items(spark, sf_dir):
    return X.taxonomy(source_rows(report_rows(spark, sf_dir))).select("company_slug", "canonical_name", "display_order")


RESOLVED_SQL = ", resolved AS (SELECT k.*, i.canonical_name AS by_label, b.name AS by_key FROM keyed k LEFT JOIN items i ON i.company_slug = k.company_slug AND i.exact_key = lower(k.clean) LEFT JOIN by_key b ON b.company_slug = k.company_slug AND b.fuzzy = k.fuzzy)"


@query("WITH " + ROWS_SQL + RESOLVED_SQL + """ SELECT row_idx, coalesce(by_label, by_key, CASE WHEN clean LIKE 'small%' THEN m.n END) AS canonical_name,
  CASE WHEN by_label IS NOT NULL THEN 'exact' WHEN by_key IS NOT NULL THEN 'fuzzy' WHEN clean LIKE 'small%' THEN 'model' ELSE 'missed' END AS match_type
  FROM resolved LEFT JOIN (SELECT company_slug, min(canonical_name) AS n FROM items GROUP BY 1) m USING (company_slug)""")
def resolve_labels(spark, sf_dir):
    rows = report_rows(spark, sf_dir)
    items = X.taxonomy(source_rows(rows))
    names = items.groupBy(*X.GROUP).agg(F.min("canonical_name").alias("canonical"))
    asked = X.drift_candidates(rows, items).where("label like 'small%'").join(names, X.GROUP).select(*X.GROUP, F.col("label").alias("old"), F.upper("canonical").alias("canonical"))
    return X.resolve_labels(rows, items, X.validated_drift(asked, items)).select("row_idx", "canonical_name", "match_type")


@query("WITH " + ROWS_SQL + RESOLVED_SQL + " SELECT DISTINCT company_slug, clean AS label FROM resolved WHERE by_label IS NULL AND by_key IS NULL")
def drift_candidates(spark, sf_dir):
    rows = report_rows(spark, sf_dir)
    return X.drift_candidates(rows, X.taxonomy(source_rows(rows))).select("company_slug", "label")


@query("WITH " + ROWS_SQL + RESOLVED_SQL + " SELECT company_slug, CASE WHEN by_label IS NOT NULL THEN 'exact' WHEN by_key IS NOT NULL THEN 'fuzzy' ELSE 'missed' END AS match_type, count(*) AS n FROM resolved GROUP BY 1, 2")
def match_statistics(spark, sf_dir):
    rows = report_rows(spark, sf_dir)
    return X.match_statistics(X.resolve_labels(rows, X.taxonomy(source_rows(rows)))).select("company_slug", "match_type", "n")


LINES_SQL = """lines AS (SELECT p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, CASE WHEN p_size % 11 = 0 THEN '   ' ELSE '' END || p_name || ' ' || p_partkey AS label, p_size % 6 = 0 AS h, p_size % 6 <> 0 AND p_size % 5 = 0 AS t FROM part)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    label = F.concat(F.when(F.col("p_size") % 11 == 0, "   ").otherwise(""), "p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    own = p.select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("pos"), label.alias("label"), (F.col("p_size") % 6 == 0).alias("is_header"), ((F.col("p_size") % 6 != 0) & (F.col("p_size") % 5 == 0)).alias("is_total"))
    return own


# A stack of labels walked row by row, independent of the windows.
@query("WITH RECURSIVE " + LINES_SQL + """, walk AS (SELECT b, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS label, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_label FROM (SELECT DISTINCT b FROM lines)
  UNION ALL SELECT l.b, l.pos, CASE WHEN l.h THEN list_append(w.stack, l.label) WHEN l.t AND len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END, l.label,
    CAST(len(w.stack) AS INTEGER) + CASE WHEN NOT l.h AND l.label LIKE '  %' THEN 1 ELSE 0 END, CASE WHEN len(w.stack) > 0 THEN w.stack[len(w.stack)] END
  FROM walk w JOIN lines l ON l.b = w.b AND l.pos = w.pos + 1)
  SELECT b, label, depth, parent_label FROM walk WHERE pos > 0""")
def infer_hierarchy(spark, sf_dir):
    return Y.infer_hierarchy(marked_lines(spark, sf_dir), ["b"]).select("b", "label", "depth", "parent_label")


SECTION_NAME = "CASE WHEN p_size % 10 = 0 THEN 'Total ' || p_name WHEN p_size % 17 = 0 THEN 'Net income ' || p_name ELSE p_name END"


# Each row finds the total that ends its section by looking ahead, instead of counting the ones before.
@query("""WITH r AS (SELECT p_brand AS b, p_partkey AS pos, """ + SECTION_NAME + """ AS name, p_size % 13 = 0 AND p_size % 10 <> 0 AND p_size % 17 <> 0 AS h, p_size % 4 AS depth, p_size % 10 = 0 AS t, p_size % 10 <> 0 AND p_size % 17 = 0 AS g FROM part),
  e AS (SELECT a.*, (SELECT min(z.pos) FROM r z WHERE z.b = a.b AND z.pos >= a.pos AND (z.t OR z.g)) AS endpos FROM r a),
  s AS (SELECT e.*, x.t AS named, substr(x.name, 7) AS section, min(CASE WHEN NOT e.t AND NOT e.g THEN e.pos END) OVER (PARTITION BY e.b, e.endpos) AS first_pos, min(CASE WHEN NOT e.t AND NOT e.g THEN e.depth END) OVER (PARTITION BY e.b, e.endpos) AS low FROM e LEFT JOIN r x ON x.b = e.b AND x.pos = e.endpos),
  f AS (SELECT s.*, coalesce(named, false) AND first_pos IS NOT NULL AND NOT (SELECT h FROM r z WHERE z.b = s.b AND z.pos = s.first_pos) AS opens FROM s),
  u AS (SELECT b, pos, 1 AS k, name, CASE WHEN g THEN 0 WHEN t THEN 1 WHEN opens THEN depth + 1 - low ELSE depth END AS depth, h AS is_header FROM f
    UNION ALL SELECT b, pos, 0, upper(substr(section, 1, 1)) || substr(section, 2), 0, true FROM f WHERE opens AND pos = first_pos AND NOT t AND NOT g)
  SELECT b, name, CAST(depth AS INTEGER) AS depth, is_header, CAST(row_number() OVER (PARTITION BY b ORDER BY pos, k) - 1 AS INTEGER) AS display_order FROM u""")
def inject_sections(spark, sf_dir):
    total, grand = F.col("p_size") % 10 == 0, (F.col("p_size") % 10 != 0) & (F.col("p_size") % 17 == 0)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), F.expr(SECTION_NAME).alias("canonical_name"), F.col("p_partkey").alias("display_order"), (F.col("p_size") % 4).alias("depth"), (~total & ~grand & (F.col("p_size") % 13 == 0)).alias("is_header"), (total | grand).alias("is_total"))
    return Y.inject_sections(rows, ["b"]).select("b", F.col("canonical_name").alias("name"), "depth", "is_header", "display_order")


DOCS_SQL = """docs AS (SELECT o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS slug, year(o_orderdate) AS fy, CASE WHEN o_orderkey % 4 = 0 THEN 'Annual Report' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'results' END AS link,
  CASE WHEN o_orderkey % 5 = 0 THEN 'x_eng.pdf' ELSE 'x.pdf' END AS path, (o_orderkey % 3) / 2.0 AS confidence, o_orderkey * 1000 AS size, CASE WHEN o_orderkey % 6 = 0 THEN 'interim' ELSE 'annual' END AS kind FROM orders)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("sha256"), F.concat(F.lit("https://e.example/"), k.cast("string")).alias("source_url"), F.when(k % 5 == 0, "x_eng.pdf").otherwise("x.pdf").alias("local_path"),
        F.col("o_custkey").cast("string").alias("company_slug"), F.when(k % 6 == 0, "interim").otherwise("annual").alias("kind"), F.year("o_orderdate").alias("fiscal_year"), (k % 3 / 2).alias("confidence"),
        F.when(k % 4 == 0, "Annual Report").when(k % 4 != 1, "results").alias("link_text"), (k * 1000).alias("size_bytes"), k.alias("ord"),
    )


RANK_SQL = DOCS_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY slug, fy ORDER BY coalesce(lower(link) LIKE '%annual report%', false) DESC, path LIKE '%_eng%' DESC, confidence DESC, size > 8388608 DESC, ord) AS rank FROM docs WHERE kind = 'annual')"


@query("WITH " + RANK_SQL + " SELECT slug AS company_slug, CAST(fy AS INTEGER) AS fiscal_year, ord, rank FROM ranked")
def candidate_rank(spark, sf_dir):
    return S.rank_candidates(classified(spark, sf_dir)).select("company_slug", "fiscal_year", "ord", "rank")


@query("WITH " + RANK_SQL + " SELECT slug AS company_slug, CAST(fy AS INTEGER) AS fiscal_year, arg_min(ord, rank) AS ord FROM ranked WHERE ord % 3 <> 0 GROUP BY ALL")
def first_success(spark, sf_dir):
    docs = classified(spark, sf_dir)
    extracted = docs.select("sha256", (F.col("ord") % 3).alias("n_statements"))
    return S.first_success(S.rank_candidates(docs), extracted).select("company_slug", "fiscal_year", "ord")


@query("WITH " + DOCS_SQL + """ SELECT CAST(c_custkey AS VARCHAR) AS company_slug, CAST(y AS INTEGER) AS fiscal_year FROM customer, range(1992, 2002) r(y)
  EXCEPT SELECT slug, CAST(fy AS INTEGER) FROM docs WHERE kind = 'annual'""")
def coverage_gaps(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slug"))
    return S.coverage_gaps(classified(spark, sf_dir), companies, 2002)


@query("WITH " + DOCS_SQL + " SELECT slug AS company_slug, kind, count(*) AS n, coalesce(string_agg(DISTINCT CASE WHEN kind = 'annual' THEN CAST(fy AS VARCHAR) END, ',' ORDER BY CASE WHEN kind = 'annual' THEN CAST(fy AS VARCHAR) END), '') AS years FROM docs GROUP BY 1, 2")
def kind_summary(spark, sf_dir):
    return S.kind_summary(classified(spark, sf_dir)).withColumn("years", F.array_join("years", ","))


TIER_SQL = "t AS (SELECT doc_id, tier, quality = 1 AS ok, CASE WHEN toxic = 1 THEN 'critical' ELSE 'minor' END AS severity, (doc_id % 10) / 10.0 AS confidence FROM labels, (VALUES ('heuristic', 0), ('vision', 1), ('text', 2)) x(tier, p) WHERE (doc_id + p) % 2 = 0 OR p = 2)"


@query("WITH " + TIER_SQL + """ SELECT doc_id, arg_min(tier, CASE tier WHEN 'heuristic' THEN 0 WHEN 'vision' THEN 1 ELSE 2 END) AS tier FROM t
  WHERE tier = 'text' OR (ok AND severity <> 'critical' AND confidence >= 0.5) GROUP BY doc_id""")
def tier_merge(spark, sf_dir):
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(p).alias("p")) for p, t in enumerate(S.TIERS)]))
    rows = table(spark, sf_dir, "labels").select("*", tiers.alias("x")).where("(doc_id + x.p) % 2 = 0 or x.p = 2")
    issue = F.struct(F.when(F.col("toxic") == 1, "critical").otherwise("minor").alias("severity"), F.lit("").alias("field"), F.lit("").alias("detail"))
    verdicts = rows.select(F.col("doc_id").alias("source_sha256"), F.lit("income").alias("statement"), "x.tier", (F.col("quality") == 1).alias("is_correct_kind"), F.array(issue).alias("issues"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return S.merge_tiers(verdicts).select(F.col("source_sha256").alias("doc_id"), "tier")


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'balance,cashflow' WHEN 1 THEN 'balance,cashflow,income' WHEN 2 THEN 'cashflow,income' ELSE 'balance,cashflow,income' END AS missing FROM customer""")
def missing_kinds(spark, sf_dir):
    accepted = F.when(F.col("c_custkey") % 4 == 1, F.array(F.lit("balance"))).when(F.col("c_custkey") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("income"), F.lit("balance")))
    again = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("balance"))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("balance"))).when(F.col("c_custkey") % 4 == 2, F.array(F.lit("income"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(S.missing_kinds(accepted, again), ",").alias("missing"))


@query("""WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS slug, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS fy, 'u' || (o_orderkey % 5) AS url, o_orderkey AS ord FROM orders WHERE o_orderkey % 4 <> 0),
  q AS (SELECT * FROM p WHERE fy IS NULL OR fy IN (1996, 1997, 1998)), d AS (SELECT *, row_number() OVER (PARTITION BY slug, url ORDER BY fy DESC NULLS LAST, ord) AS k FROM q)
  SELECT slug AS company_slug, url, ord, row_number() OVER (PARTITION BY slug ORDER BY fy DESC NULLS LAST, ord) AS position FROM d WHERE k = 1""")
def order_picks(spark, sf_dir):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("u"), (k % 5).cast("string"))
    picks = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("company_slug"), F.when(k % 7 != 0, F.year("o_orderdate")).alias("fiscal_year"), url.alias("url"), (k % 4 > 1).alias("reachable"), F.when(k % 4 == 1, url).alias("snapshot_url"), k.alias("ord"))
    return S.order_picks(picks, [1996, 1997, 1998]).select("company_slug", "url", "ord", "position")


#: Labels that income statements have; a table has the first few of them, by its number.
INCOME_LABELS = ("revenue", "sales", "cost of", "gross profit", "operating", "net income", "profit for", "earnings per share")
HITS_SQL = " + ".join(f"CAST(contains(t, '{x}') AS INTEGER)" for x in INCOME_LABELS)


# A customer's orders are the tables of a document: scores tie often, and the first table counts.
@query(f"""WITH l AS (SELECT o_custkey, o_orderkey, list_transform(range(0, o_orderkey % 4), lambda i: CASE (o_orderkey // 4 + i) % 9 {" ".join(f"WHEN {k} THEN 'our {x}'" for k, x in enumerate(INCOME_LABELS))} ELSE 'other' END) AS labels FROM orders),
  s AS (SELECT *, 10 * ({HITS_SQL.replace("contains(t,", "contains(array_to_string(labels, ' '),")}) + len(labels) AS score FROM l)
  SELECT o_custkey AS doc_id, arg_min(o_orderkey, (-score, o_orderkey)) AS ord, CAST(max(score) AS INTEGER) AS score FROM s GROUP BY 1""")
def table_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(f"Our {x}") for x in INCOME_LABELS], F.lit("Other"))
    labels = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), lambda i: F.get(names, ((F.floor(k / 4) + i) % 9).cast("int")))).otherwise(F.array().cast("array<string>"))
    best = S.best_tables(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), F.lit("income").alias("kind"), k.alias("ord"), labels.alias("labels")))
    return best.select(F.col("sha256").alias("doc_id"), "ord", F.col("score").cast("int").alias("score"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def preferred_input(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return S.preferred_input(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("""WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'annual' ELSE 'other' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 20 END AS fy, CASE WHEN quality = 1 THEN 0.75 WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0.0 END AS c,
    CASE WHEN doc_id % 4 = 0 THEN 'interim' ELSE 'other' END AS sk, CASE WHEN doc_id % 5 < 3 THEN 2010 END AS sy, CASE WHEN doc_id % 4 = 0 THEN 0.95 ELSE 0.3 END AS sc, doc_id % 7 = 0 AS has_m FROM labels),
  e AS (SELECT *, (c < 0.5 OR fy IS NULL) AND (sc > c OR (fy IS NULL AND sy IS NOT NULL)) AS t FROM d),
  f AS (SELECT *, CASE WHEN t AND sc > c THEN sk ELSE kind END AS k2, CASE WHEN t THEN coalesce(sy, fy) ELSE fy END AS y2, CASE WHEN t THEN greatest(c, sc) ELSE c END AS c2 FROM e)
  SELECT doc_id, CASE WHEN c2 < 0.5 AND has_m THEN 'quarterly' ELSE k2 END AS kind, CAST(CASE WHEN c2 < 0.5 AND has_m THEN NULL ELSE y2 END AS INTEGER) AS fiscal_year, CASE WHEN c2 < 0.5 AND has_m THEN 'model' WHEN t THEN 'rules+sniff' ELSE 'rules' END AS classified_by FROM f""")
def classify_cascade(spark, sf_dir):
    d, own = F.col("doc_id"), table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    docs = own.select(d.alias("sha256"), F.when(good, "annual").otherwise("other").alias("kind"), F.when(d % 3 == 0, 2000 + d % 20).cast("int").alias("fiscal_year"), F.when(good, 0.75).when(d % 3 == 0, 0.3).otherwise(0.0).alias("confidence"), F.lit("p").alias("local_path"))
    sniffed = own.select(d.alias("sha256"), F.when(d % 4 == 0, "interim").otherwise("other").alias("kind"), F.when(d % 5 < 3, 2010).alias("fiscal_year"), F.when(d % 4 == 0, 0.95).otherwise(0.3).alias("confidence"))
    model = own.where(d % 7 == 0).select(d.alias("sha256"), F.lit("quarterly").alias("kind"), F.lit(None).cast("int").alias("fiscal_year"), F.lit(0.9).alias("confidence"))
    return S.classify_cascade(docs, sniffed, model).select(F.col("sha256").alias("doc_id"), "kind", "fiscal_year", "classified_by")


@query("""SELECT k, claimed, search, pdfs, reachable, CASE WHEN NOT claimed AND NOT search THEN false WHEN pdfs > 0 THEN true WHEN NOT reachable THEN false ELSE claimed END AS found
  FROM (SELECT c_custkey AS k, c_custkey % 2 = 0 AS claimed, c_custkey % 3 = 0 AS search, c_custkey % 4 AS pdfs, c_custkey % 5 < 3 AS reachable FROM customer)""")
def found_gate(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 2 == 0).alias("claimed"), (k % 3 == 0).alias("search"), (k % 4).alias("pdfs"), (k % 5 < 3).alias("reachable"))
    return rows.withColumn("found", S.found_gate(F.col("claimed"), F.col("search"), F.col("pdfs"), F.col("reachable")))


@query("SELECT o_custkey AS sha256, o_orderstatus AS kind, CAST(min(o_orderkey) AS BIGINT) AS page_idx FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def first_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), F.col("o_orderkey").alias("page_idx"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("kind"))
    return S.first_pages(pages)


@query("""SELECT o_custkey AS sha256, coalesce(min(CASE WHEN n <= 6 AND o_orderkey % 5 = 0 THEN n END) - 1, 0) AS header_row
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def header_rows(spark, sf_dir):
    numbered = S.numbered(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], "n")
    cells = F.array(F.lit("x"), F.when(F.col("o_orderkey") % 5 == 0, "FY 2024").otherwise("12345"))
    rows = numbered.select(F.col("o_custkey").alias("sha256"), F.lit(0).alias("page_idx"), F.lit(0).alias("table_idx"), (F.col("n") - 1).cast("long").alias("row_idx"), cells.alias("cells"))
    return S.header_rows(rows, 6, True).select("sha256", F.col("header_row").cast("long").alias("header_row"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS period, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_custkey END AS BIGINT) AS amount FROM orders
  UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) - 1 AS VARCHAR) || '-12-31', NULL FROM orders""")
def values_by_period(spark, sf_dir):
    from ledgerloom.functions.periods import values_by_period as by_period

    # Two columns of one year: the last one counts, if it is the later.
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    last = F.when(k % 2 == 0, F.concat(F.lit("("), k.cast("string"), F.lit(")"))).otherwise(F.col("o_custkey").cast("string"))
    values = by_period(F.array(F.lit("label"), F.lit("7"), F.lit("—"), last), F.array(F.lit(None).cast("int"), y, y - 1, y))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(values).alias("period", "v")).select("o_orderkey", "period", F.col("v").cast("long").alias("amount"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, unnest([2020, 2021]) AS y FROM orders WHERE o_orderkey % 10 <> 0)
  SELECT o_orderkey AS row_idx, CAST(y AS VARCHAR) || '-12-31' AS period_end, CASE WHEN y = 2020 THEN CAST(o_orderkey AS BIGINT) END AS value, y < 2021 AS is_restated FROM f""")
def facts_of_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    values = F.create_map(F.lit("2020-12-31"), k.cast("decimal(30,4)"), F.lit("2021-12-31"), F.lit(None).cast("decimal(30,4)"), F.lit("2021"), k.cast("decimal(30,4)"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("company_slug"), F.lit("income").alias("statement"), F.when(k % 10 != 0, k.cast("string")).alias("canonical_name"), values.alias("values_by_period_end"), F.lit(12).alias("period_months"), F.lit("EUR").alias("currency"), F.lit("units").alias("unit"), F.lit("s").alias("source_sha256"), F.lit(2021).alias("source_fiscal_year"), k.alias("row_idx"))
    return X.to_facts(rows).select(F.col("canonical_name").cast("long").alias("row_idx"), F.col("period_end").cast("string").alias("period_end"), F.col("value").cast("long").alias("value"), "is_restated")


@query("WITH " + ROWS_SQL + """ SELECT company_slug, count(*) AS lines, count(*) FILTER (p_size % 6 = 0) AS headers, count(*) FILTER (p_size % 6 <> 0 AND p_size % 5 = 0) AS totals FROM items JOIN part ON p_partkey = row_idx GROUP BY 1""")
def taxonomy_statistics(spark, sf_dir):
    marks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), (F.col("p_size") % 6 == 0).alias("is_header"), ((F.col("p_size") % 6 != 0) & (F.col("p_size") % 5 == 0)).alias("is_total"))
    items = X.taxonomy(source_rows(report_rows(spark, sf_dir))).join(marks, "row_idx")
    return X.taxonomy_statistics(items).select("company_slug", "lines", "headers", "totals")


@query("WITH " + DOCS_SQL + " SELECT ord, dense_rank() OVER (PARTITION BY slug ORDER BY fy DESC) AS turn FROM docs")
def newest_first(spark, sf_dir):
    return S.newest_first(classified(spark, sf_dir)).select("ord", F.col("turn").cast("long").alias("turn"))


# Caps: twelve pages of a document, twenty filings of a company go on.
@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 12""")
def first_pages_of_documents(spark, sf_dir):
    return S.first_rows(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], S.MOST_PAGES).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT s_suppkey AS k, s_suppkey % 5 >= 3 AND s_suppkey % 3 >= 2 AND s_suppkey % 2 >= 1 AS gate, round(1000 * (s_suppkey % 2) + 500 * ((s_suppkey % 4) / (s_suppkey % 4 + 2)) + 10 * (s_suppkey % 4) + s_suppkey % 7 + s_suppkey % 5, 6) AS score FROM supplier""")
def grid_scores(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), S.table_gate(k % 5, k % 3, k % 2).alias("gate"), F.round(S.grid_score(k % 2 == 1, k % 4, k % 4 + 2, k % 7, k % 5), 6).alias("score"))


# Lines of a brand with their values: a stack walked row by row decides depth and parent; labels lose their footnotes.
CONFIRM_SQL = """lines AS (SELECT p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_partkey AS k, CASE WHEN p_size % 11 = 0 THEN '   ' ELSE '' END || CASE WHEN p_size % 6 <> 0 AND p_size % 5 = 0 THEN 'Total ' ELSE '' END || 'n' || p_partkey || ' ' || p_name AS label, p_size % 6 = 0 AS h, p_size % 5 = 0 AND p_size % 6 <> 0 AS t FROM part WHERE p_size % 13 <> 0)"""


@query("WITH RECURSIVE " + CONFIRM_SQL + """, walk AS (SELECT b, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS label, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_label, false AS h, false AS t FROM (SELECT DISTINCT b FROM lines)
  UNION ALL SELECT l.b, l.pos, l.k, CASE WHEN l.h THEN list_append(w.stack, l.label) WHEN l.t AND len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END, l.label,
    CAST(len(w.stack) AS INTEGER) + CASE WHEN NOT l.h AND l.label LIKE '  %' THEN 1 ELSE 0 END, CASE WHEN len(w.stack) > 0 THEN w.stack[len(w.stack)] END, l.h, l.t
  FROM walk w JOIN lines l ON l.b = w.b AND l.pos = w.pos + 1)
  SELECT k AS row_idx, trim(label) AS label, CAST(depth AS INTEGER) AS depth, parent_label, h AS is_header, t AS is_total, CASE WHEN NOT h THEN CAST(CAST(k AS DECIMAL(30,4)) AS VARCHAR) END AS value FROM walk WHERE pos > 0""")
def confirmed_rows(spark, sf_dir):
    """Confirmation by rule: rows without a value are headers, totals are told by their labels, empty labels go."""
    from ledgerloom.operators.extract import confirm_rows

    s, k = F.col("p_size"), F.col("p_partkey")
    label = F.when(s % 13 == 0, " ").otherwise(F.concat(F.when(s % 11 == 0, "   ").otherwise(""), F.when((s % 6 != 0) & (s % 5 == 0), "Total ").otherwise(""), F.lit("n"), k.cast("string"), F.lit(" "), "p_name"))
    values = F.create_map(F.lit("2024-12-31"), F.when(s % 6 != 0, k.cast("decimal(30,4)")))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("company_slug"), F.lit("s").alias("source_sha256"), F.lit(2024).alias("source_fiscal_year"), F.lit("income").alias("statement"), k.alias("row_idx"), label.alias("raw_label"), values.alias("values_by_period_end"))
    return confirm_rows(rows).select("row_idx", "label", "depth", "parent_label", "is_header", "is_total", F.element_at("values_by_period_end", "2024-12-31").alias("value"))
