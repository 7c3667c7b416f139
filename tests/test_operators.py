"""The store, hierarchies, choices and providers on small cases."""

import random
import re
from datetime import date
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import crawl, extract, facts, hierarchy, market, providers, selection
from ledgerloom.sources import files, html_tables
from ledgerloom.streaming import restatements


def fact(value, fy, period="2023-12-31", unit="millions", seq=0, slug="testco"):
    return (slug, "income", "Revenue", date.fromisoformat(period), 12, None if value is None else Decimal(value), "EUR", unit, f"s{fy}", fy, False, seq)


def cells(spark, *rows, **kw):
    got = facts.consolidated(spark.createDataFrame(rows, schemas.FACTS), **kw).collect()
    return {str(r.period_end): (r.value, r.source_fiscal_year, r.is_restated) for r in got}


def test_newest_filing_wins(spark):
    assert cells(spark, fact(100, 2023), fact(105, 2024)) == {"2023-12-31": (105, 2024, True)}
    got = cells(spark, fact(100, 2023), fact(102, 2024), fact(120, 2024, "2024-12-31"))
    assert got["2023-12-31"][0] == 102 and got["2024-12-31"] == (120, 2024, False)


def test_newest_null_hides_and_tolerance_is_strict(spark):
    assert cells(spark, fact(100, 2023), fact(None, 2024)) == {"2023-12-31": (None, 2024, False)}
    assert cells(spark, fact("1.00", 2023), fact("1.01", 2024))["2023-12-31"][2] is False
    assert cells(spark, fact("1.00", 2023), fact("1.0101", 2024))["2023-12-31"][2] is True


def test_units_are_compared_raw_unless_asked(spark):
    rows = [fact(1000, 2023, unit="thousands"), fact(1, 2024)]
    assert cells(spark, *rows)["2023-12-31"][2] is True
    assert cells(spark, *rows, unit_aware=True)["2023-12-31"][2] is False


def test_upsert_last_writer_wins(spark):
    old = spark.createDataFrame([fact(1, 2023, seq=5)], schemas.FACTS)
    new = spark.createDataFrame([fact(2, 2023, seq=0), fact(3, 2023, seq=1)], schemas.FACTS)
    assert [r.value for r in facts.upsert(old, new).collect()] == [3]


def test_line_without_facts_survives_and_sorts(spark):
    items = spark.createDataFrame([("testco", "income", "Revenue", 0, None, False, False, 1), ("testco", "income", "Other", 0, None, False, False, None)], schemas.LINE_ITEMS)
    joined = facts.consolidated_rows(items, facts.consolidated(spark.createDataFrame([fact(1, 2023), fact(2, 2024, "2024-12-31")], schemas.FACTS)))
    rows = facts.in_display_order(joined).collect()
    assert facts.statement_rows(joined, "testco", "income").count() == 3 and facts.statement_rows(joined, "testco", "balance").count() == 0
    assert [(r.canonical_name, r.value) for r in rows] == [("Revenue", 2), ("Revenue", 1), ("Other", None)]


def stack_walk(rows):
    open_, out = [], []
    for label, header, total in rows:
        out.append((len(open_) + (1 if not header and label.startswith("  ") else 0), open_[-1] if open_ else None))
        if header:
            open_.append(label)
        elif total and open_:
            open_.pop()
    return out


def test_hierarchy_equals_a_stack(spark):
    r = random.Random(5)
    reports = [[(f"{'  ' * (r.random() < 0.3)}l{k}", r.random() < 0.3, r.random() < 0.3) for k in range(r.randint(1, 25))] for _ in range(60)]
    rows = [(g, k, *x) for g, rep in enumerate(reports) for k, x in enumerate(rep)]
    df = spark.createDataFrame(rows, "g int, pos int, label string, is_header boolean, is_total boolean")
    got = {(x.g, x.pos): (x.depth, x.parent_label) for x in hierarchy.infer_hierarchy(df, ["g"]).collect()}
    assert got == {(g, k): w for g, rep in enumerate(reports) for k, w in enumerate(stack_walk(rep))}


def test_classified_rows(spark):
    df = spark.createDataFrame([(0, "Revenue", True), (1, "Split between:", False), (2, "Equity holders", True), (3, "Minority holders", True)], "pos int, label string, has_value boolean").withColumn("g", F.lit(1))
    got = hierarchy.infer_hierarchy(hierarchy.classify_rows(df), ["g"]).orderBy("pos").collect()
    assert [(x.depth, x.is_header, x.parent_label) for x in got] == [(0, False, None), (0, True, None), (1, False, "Split between:"), (1, False, "Split between:")]


INJECT = [
    ([("Cloud", 1, 0, 0), ("Tree nursery", 1, 0, 0), ("Total revenue", 1, 0, 1)], [("Revenue", 0), ("Cloud", 1), ("Tree nursery", 1), ("Total revenue", 1)]),
    ([("Total revenue", 1, 0, 1), ("Gross profit", 0, 0, 1)], [("Total revenue", 1), ("Gross profit", 0)]),
    ([("Revenues", 1, 1, 0), ("Cloud", 1, 0, 0), ("Total revenue", 1, 0, 1)], [("Revenues", 1), ("Cloud", 1), ("Total revenue", 1)]),
    ([("Outer", 0, 0, 0), ("Inner", 2, 0, 0), ("Total foo", 0, 0, 1)], [("Foo", 0), ("Outer", 1), ("Inner", 3), ("Total foo", 1)]),
    ([("Total revenue", 5, 0, 1), ("EPS", 1, 0, 0)], [("Total revenue", 1), ("EPS", 1)]),
]


@pytest.mark.parametrize(("rows", "expected"), INJECT)
def test_section_headers(spark, rows, expected):
    df = spark.createDataFrame([("g", n, d, bool(h), bool(t), 10 * k) for k, (n, d, h, t) in enumerate(rows)], "g string, canonical_name string, depth int, is_header boolean, is_total boolean, display_order int")
    got = hierarchy.inject_sections(df, ["g"]).orderBy("display_order").collect()
    assert [(x.canonical_name, x.depth) for x in got] == expected and [x.display_order for x in got] == list(range(len(got)))


HTML = """<h2>Analysis of consolidated statements of operations</h2><p>Consolidated statements of operations</p><p>(in millions)</p>
<table><tr><th>Item</th><th>2024</th><th>2023</th></tr><tr><td>Revenue</td><td>1,200</td><td>(100)</td></tr><tr><td>Cost of sales</td><td>—</td><td>5</td></tr><tr><td></td><td>1</td></tr></table>"""


def test_html_tables_to_confirmed_rows(spark):
    df = spark.createDataFrame([("a", HTML), ("b", None)], "sha256 string, html string")
    cells_ = html_tables.table_cells(df)
    heads = html_tables.statement_headings(df)
    assert [(h.kind, h.table_idx) for h in heads.collect()] == [("income", 0)]
    rows = extract.statements_of(heads, extract.rows_of_tables(cells_))
    got = {r.raw_label: r.values_by_period_end for r in rows.collect()}
    assert got == {"Revenue": {"2024-12-31": Decimal(1200), "2023-12-31": Decimal(-100)}, "Cost of sales": {"2024-12-31": None, "2023-12-31": Decimal(5)}}
    named = rows.withColumn("company_slug", F.lit("c")).withColumnRenamed("sha256", "source_sha256").withColumn("source_fiscal_year", F.lit(2024))
    assert {r.label: (r.depth, r.is_header) for r in extract.confirm_rows(named).collect()} == {"Revenue": (0, False), "Cost of sales": (0, False)}


def test_pages_give_documents_and_drilldowns(spark):
    html = '<title>IR</title><a href="/files/1" title="AR">x</a><a href="/en/reports/2024#t"></a><a href="/en/reports/2024"></a><form action="/f.pdf"></form><a href="https://other.org/a.pdf"></a>'
    pages = spark.createDataFrame([("https://ir.acme.com/x", "https://www.acme.com", html)], "page_url string, seed_url string, html string")
    assert [(r.url, r.title) for r in crawl.pdf_links(pages).orderBy("source").collect()] == [("https://ir.acme.com/files/1", "AR"), ("https://ir.acme.com/f.pdf", "(IR form/embed)")]
    assert [r.url for r in crawl.drilldown_links(pages).collect()] == ["https://ir.acme.com/en/reports/2024"]
    text = crawl.distilled(pages).first().text
    assert text.startswith("Title: IR") and "Documents (2)" in text and "Drill-downs (1)" in text


def test_tiers_without_a_model_take_the_heuristic(spark):
    rows = spark.createDataFrame([("a", "income", "heuristic", False, None, 0.1), ("a", "income", "text", None, None, None)], "source_sha256 string, statement string, tier string, is_correct_kind boolean, issues array<struct<severity:string>>, confidence double")
    assert [r.tier for r in selection.merge_tiers(rows, with_model=False).collect()] == ["heuristic"]
    assert [r.tier for r in selection.merge_tiers(rows).collect()] == ["text"]


def test_cached_calls_ask_once(spark):
    requests = spark.createDataFrame([("k1", "r1"), ("k1", "r1"), ("k2", "r2"), ("k3", "bad")], "key string, request string")
    cache = spark.createDataFrame([("k2", "cached")], schemas.MODEL_CACHE)
    answers, new = providers.cached_calls(requests, cache, lambda batch: [None if x == "bad" else x.upper() for x in batch])
    assert sorted((r.key, r.response) for r in answers.collect()) == [("k1", "R1"), ("k1", "R1"), ("k2", "cached"), ("k3", None)]
    assert new.count() == 1


def test_fetch_falls_through(spark):
    class Bad:
        name = "bad"

        def fetch(self, url):
            raise OSError("no")

    class Good:
        name = "good"

        def fetch(self, url):
            return 200, "text/html", b"x"

    out = next(providers.fetch_first([Bad(), Good()])(iter([pd.DataFrame({"url": ["u"]})])))
    assert out.strategy[0] == "good" and next(providers.fetch_first([Bad()])(iter([pd.DataFrame({"url": ["u"]})]))).error[0] == "no"


def test_rounds_end(spark):
    seen = []
    loop = providers.Rounds(lambda messages, last: {"submit": {"n": len(messages)}} if last or len(messages) > 2 else {"calls": [{"tool": "t"}]}, {"t": lambda: seen.append(1)})
    assert loop.run([{"role": "user"}]) == {"n": 3} and len(seen) == 2


def test_market_series(spark):
    points = spark.createDataFrame([(1, k, float(k)) for k in range(130)], "s int, t int, value double")
    got = [r.value for r in market.downsample(points, ["s"], ["t"]).orderBy("point").collect()]
    assert got == [float(int(k * 130 / 60)) for k in range(60)]
    assert market.fuzzy_search(spark.createDataFrame([("Spotify",), ("Adyen",)], "name string"), "spotfy", ["name"]).count() == 1


def test_configuration(spark):
    text = "companies:\n  sap:\n    name: SAP\n    sources:\n      - {name: s, direct_urls: [u1]}\n"
    assert files.companies_from_yaml(spark, text).first().sources[0].direct_urls == ["u1"]
    assert "u2" in files.append_direct_urls(text, "sap", ["u1", "u2"]) and files.append_direct_urls(text, "sap", ["u1"]).count("u1") == 1
    with pytest.raises(ValueError):
        files.companies_from_yaml(spark, "companies:\n  a:\n    name: A\n    sources:\n      - {name: s}\n")


def test_restatement_stream(spark, tmp_path):
    incoming, store, out = (str(tmp_path / x) for x in ("in", "store", "cells"))
    for k, row in enumerate([fact(100, 2023, seq=0), fact(105, 2024, seq=1)]):
        spark.createDataFrame([row], schemas.FACTS).write.mode("append").parquet(incoming)
        q = restatements.restatement_stream(spark, incoming, store, out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        got = spark.read.parquet(out).first()
        assert (got.value, got.is_restated) == ((100, False), (105, True))[k]


def test_every_needle_is_looked_up(spark):
    register = spark.createDataFrame([(0, 7, "AB", "Abacus Öl Corp"), (1, 8, "corp", "Zeta"), (2, 9, None, "Title only"), (3, 10, "T4", None), (4, 11, "AB", "twice")], "ord int, cik int, ticker string, title string")
    asked = [" ab ", "CORP", "öl", "zeta", "t4", "only", "nothing", None, "", "AB", "AB", "a longer needle than any title of the register"]
    needles = spark.createDataFrame([(x,) for x in asked], "needle string").unionByName(spark.range(12_000).select(F.concat(F.lit("none "), "id").alias("needle"))).unionByName(spark.range(12_000).select(F.concat(F.lpad(F.lit(""), F.col("id").cast("int"), " "), F.lit("zeta")).alias("needle")))
    got = {r.needle: int(r.cik) for r in crawl.cik_lookup(needles, register).collect()}
    assert len({x for x in got if x.strip() == "zeta"}) == 12_000 and not any(x.startswith("none") for x in got)
    plain = {}
    for x in asked:
        for o in register.orderBy("ord").collect():
            if x is not None and (x.strip().lower() == (o.ticker or "\0").lower() or (o.title is not None and x.strip().lower() in o.title.lower())):
                plain.setdefault(x, o.cik)
    assert plain == {k: v for k, v in got.items() if k in asked}


def test_crawl_equals_brute_force(spark):
    ways = [(0, k) for k in range(1, 60)] + [(k, 0) for k in range(1, 60, 2)] + [(k, (7 * k) % 60) for k in range(60)] + [(3, 61), (61, 62), (62, 63), (3, 3)]
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in ways], "page string, url string")
    plain = set()
    for seed in range(65):
        seen = level = {seed}
        plain |= {(str(seed), str(seed), 0)}
        for depth in (1, 2, 3):
            level = {b for a, b in ways if a in level} - seen
            seen = seen | level
            plain |= {(str(seed), str(x), depth) for x in level}
    got = [tuple(r) for r in crawl.crawl(spark.createDataFrame([(str(k),) for k in range(65)], "seed string"), edges, F.lit(True), 3).collect()]
    assert len(got) == len(plain) and set(got) == plain


def test_all_filings_of_a_company_come_out(spark):
    n = 75
    arrays = (["10-K", "6-K", "20-F"] * 25, [f"1-{k}" for k in range(n)], ["d.htm"] * n, ["2024-01-01"] * n)
    rows = spark.createDataFrame([("0000000007", *arrays)], "cik string, form array<string>, accessionNumber array<string>, primaryDocument array<string>, filingDate array<string>")
    found = sorted((r.ord, r.form, r.url) for r in crawl.filings(rows).collect())
    assert found == [(k, arrays[0][k], f"https://www.sec.gov/Archives/edgar/data/7/1{k}/d.htm") for k in range(n) if k % 3 != 1]


def test_cells_are_dealt_once_for_grids(spark):
    cells = spark.createDataFrame([("d", p, t, r, ["Note" if r == 0 else f"line {'abcdefg'[r]}", "2024" if r == 0 else f"{p}{t}{r}"]) for p, t in ((0, 0), (0, 1), (1, 2), (3, 3)) for r in range(7 - t % 2)], "sha256 string, page_idx int, table_idx int, row_idx int, cells array<string>")
    rows = extract.grid_statements(cells, spark.createDataFrame([("d", "income", 0), ("d", "balance", 1)], "sha256 string, kind string, page_idx int"))
    assert {(x.statement, x.table_idx, x.source_page): int(sum(v["2024-12-31"] for v in x.v)) for x in rows.groupBy("statement", "table_idx", "source_page").agg(F.collect_list("values_by_period_end").alias("v")).collect()} == {("income", 0, 0): 21, ("balance", 2, 1): 741}
    plan = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search(r"Exchange hashpartitioning\(sha256#\d+, page_idx", plan)


def test_steps_of_a_number_are_computed_once(spark):
    from ledgerloom.functions.numbers import parse_number

    text = str(spark.range(1).select(parse_number(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed())
    assert text.lower().count("regexp_replace") <= 8


def test_cells_are_dealt_once_for_pages(spark):
    title = "Consolidated income statement\n(in thousands)"
    pages = spark.createDataFrame([("d", 0, "words"), ("d", 1, title), ("d", 2, title), ("d", 3, None)], "sha256 string, page_idx int, text string")
    cells = spark.createDataFrame([("d", p, t, r, ["Note" if r == 0 else f"line {r}", "2024" if r == 0 else f"{p}{t}{r}"]) for p, t, n in ((0, 0, 9), (1, 1, 4), (2, 2, 6), (3, 3, 8)) for r in range(n)], schemas.TABLE_CELLS)
    rows = extract.pdf_statements(pages, cells)
    assert {(x.statement, x.unit, x.source_page, x.table_idx): x["count"] for x in rows.groupBy("statement", "unit", "source_page", "table_idx").count().collect()} == {("income", "thousands", 1, 2): 5}
    assert not re.search(r"Exchange hashpartitioning\(sha256#\d+, page_idx", rows._jdf.queryExecution().toString())


def test_a_heading_is_collapsed_once(spark):
    from ledgerloom.functions.headings import match_statement, statement_kinds

    text = str(spark.range(1).select(match_statement(F.col("id").cast("string")), statement_kinds(F.col("id").cast("string")))._jdf.queryExecution().analyzed())
    assert text.lower().count("regexp_replace") <= 8


def test_plain_tags_are_read_as_the_parser_reads_them(monkeypatch):
    r = random.Random(4)
    plain = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<th class="a b">', "</th>", "<p>", "</p>", '<div style="x: y" id="q">', "</div>", "<H3>", "</H3>", "<b>", "</b>", "<br>", "a &amp; b", "x &lt y", "&#39;&nb", "&nbsp;text ", " \n", "> ", "&", "</td >"]
    odd = [*plain, "<!-- c -->", "<td", "<td/>", "<script>var a = '<b>';</script>", "<title>a</title>", "<title>", "<style>p{}</style>", "< b", "<p x='1'>", "</ p>", "<!DOCTYPE html>", '<p x="a>b">', "<td>\x00", "<?x?>", '<tr x="1"y="2">']

    def parsed(html):
        scan = html_tables._Scan()
        scan.feed(html)
        scan.close()
        return scan.tables, scan.headings

    texts = ["".join(r.choice(plain if k % 2 else odd) for _ in range(r.randint(0, 40))) for k in range(3000)]
    want = [parsed(x) for x in texts]
    assert [(s.tables, s.headings) for s in map(html_tables._scan, texts)] == want
    monkeypatch.setattr(html_tables._Scan, "feed", None)  # plain ones don't need it
    for x in ["", None, *texts[1::2]]:
        html_tables._scan(x)


def test_files_made_of_a_small_table_are_scanned_by_many_tasks(spark, monkeypatch):
    from ledgerloom.plans.source_queries import html_statements

    seen = []
    monkeypatch.setattr(html_tables, "scanned", lambda files, *a, f=html_tables.scanned: seen.append(files.rdd.getNumPartitions()) or f(files, *a))
    html_statements(spark, "/root/testdata/sf0.001")
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_headers_are_kept_in_one_pass_over_long_lists(spark):
    lines = spark.range(150_000, numPartitions=1).select(F.lit("b").alias("b"), F.col("id").alias("pos"), F.when(F.col("id").isin(5, 149_000), "A Red line").otherwise("other").alias("canonical_name"), (F.col("id") % 5).alias("depth"), (F.col("id") % 1000 < 2).alias("is_header"))
    found = market.search_keep_headers(lines.withColumn("depth", F.when(F.col("pos") == 149_000, 1).otherwise(F.col("depth"))), "red", ["b"])
    assert "UnboundedFollowing" not in found._jdf.queryExecution().toString() and "unboundedfollowing" not in found._jdf.queryExecution().toString()
    assert sorted(x.pos for x in found.collect()) == sorted({5, 149_000} | set(range(0, 149_000, 1000)))
