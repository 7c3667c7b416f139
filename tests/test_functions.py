"""Cases for the column functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import headings as H
from ledgerloom.functions import links as L
from ledgerloom.functions import numbers as N
from ledgerloom.functions import periods as P
from ledgerloom.functions import reports as R
from ledgerloom.functions import text as T


def one(spark, f, *values, types=None):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(values), strict=True)))
    return df.select(f(*[F.col(n) for n in names])).first()[0]


def many(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


NUMBERS = [
    ("1,234", 1234), ("1,234.5", Decimal("1234.5")), ("(1,234)", -1234), ("(1,234.5)", Decimal("-1234.5")), ("—", None), ("–", None), ("-", None), ("", None), ("n/a", None), ("NM", None),
    ("1\u20092\u2009345", None if False else 12345), ("1\u00a0234", 1234), ("1,234 *", 1234), ("1,234 (a)", 1234), ("567b", 567), ("€1,234", 1234), ("$1,234.5", Decimal("1234.5")), ("£567", 567),
    (None, None), ("nothing useful", None), ("1e5", 100000), (".5", Decimal("0.5")), ("+5", 5), ("––", None),
]


def test_parse_number(spark):
    assert many(spark, N.parse_number, [x for x, _ in NUMBERS]) == [None if y is None else Decimal(y) for _, y in NUMBERS]


def test_model_number_parsers(spark):
    assert many(spark, N.parse_number_plain, ["(1,5)", "12 b", "n/a", "1\u00a0000", "(7"]) == [-15, None, None, 1000, None]
    assert many(spark, N.parse_number_vision, ["€(5)", "(€5)", "1 2", "nm", "£1,000"]) == [None, -5, None, None, 1000]


def test_market_figures(spark):
    assert one(spark, N.market_cap, 2.0, 3.0, types=["double"] * 2) == 6e6
    assert one(spark, N.market_cap, 2.0, 0.0, types=["double"] * 2) is None
    assert one(spark, N.change_pct, 2.0, None, types=["double"] * 2) is None
    assert one(spark, lambda c: N.fx_rate(c, "USD"), "GBp") == pytest.approx(1.17 / 0.92)
    assert one(spark, lambda c: N.format_market_cap(c, F.lit("USD")), 486.14e9, types=["double"]) == "$486.1B"
    assert one(spark, lambda c: N.format_amount(c, "€"), -1234.5, types=["double"]) == "-€1,234.5"
    assert one(spark, N.split_market_cap, 486.14e9, types=["double"]).suffix == "B"


def test_labels(spark):
    assert many(spark, T.clean_label, ["Cash\u200b at\u00a0 bank (1)", "Revenue **", "Cash at year-end 2024", "a\tb"]) == ["Cash at bank", "Revenue", "Cash at year-end 20", "ab"]
    assert many(spark, T.fuzzy_key, ["Trade, receivables: (a)", "Trade receivables"]) == ["trade receivables"] * 2
    assert many(spark, T.is_total, ["TOTAL", "AB", "Operating income", "Net cash provided by operating activities of the group", "Cash of note", "Cash x at end of year"]) == [True, False, True, True, False, True]
    assert many(spark, T.leading_indent, ["  a", "\ta", "\u200b a", "a"]) == [2, 4, 1, 0]
    assert many(spark, T.section_label, ["Total cost of sales", "total  x", "Totals", "Total "]) == ["Cost of sales", "X", None, None]
    assert many(spark, T.slugify, ["Dassault Systèmes SE", "--", "A&B"]) == ["dassault-syst-mes-se", "company", "a-b"]
    assert many(spark, T.label_slug, ["orchard:annual-filings", "quarry", None, ""]) == ["orchard", "quarry", "", ""]
    assert many(spark, T.repair_null_escapes, ["a\x00e9b", "x\x00y", None]) == ["aéb", "xy", None]


def test_headings(spark):
    cases = {"Consolidated Statements of Operations": "income", "CONSOLIDATED  STATEMENTSOF OPERATIONS": "income", "Consolidated statement of profit or loss": "income", "Consolidated balance sheets": "balance", "Consolidated\u00a0statement of financial position": "balance", "Consolidated statements of cash flows": "cashflow", "Management's discussion": None}
    assert many(spark, H.match_statement, list(cases)) == list(cases.values())
    assert many(spark, H.heading_line, ["4.1.1 Consolidated income statement", "as reported in our consolidated income statement for the year", "x" * 130]) == ["income", None, None]
    toc = "Consolidated income statement\nConsolidated balance sheet\nConsolidated cash flow statement"
    assert one(spark, H.statement_kinds, toc) == 3 and one(spark, H.is_contents_page, toc)
    assert many(spark, H.detect_unit, ["(in millions of €)", "in thousands", "€ million, thousands of", "(billion", ""]) == ["millions", "thousands", "millions", "billions", "units"]
    assert many(spark, H.is_discussion, ["  4.2 Analysis of consolidated", "Summary of x", "Consolidated"]) == [True, True, False]


def test_periods(spark):
    cells = F.array(F.lit("Line item"), F.lit("Note"), F.lit("Year ended December 31, 2024"), F.lit("2022"))
    assert spark.range(1).select(P.year_headers(cells)).first()[0] == [None, None, 2024, 2022]
    values = P.values_by_period(F.array(F.lit("x"), F.lit("1"), F.lit("2")), F.array(F.lit(None).cast("int"), F.lit(2024), F.lit(2024)))
    assert spark.range(1).select(values).first()[0] == {"2024-12-31": Decimal(2)}
    assert [str(x) for x in many(spark, P.iso_date, ["2024-01-05", "2024", "2024-1-5", "2024-02-31"])] == ["2024-01-05", "None", "None", "None"]


FILES = [
    ("orchard-20231231x20f.htm", None, "annual", 2023), ("quarry_annual_report2017.pdf", None, "annual", 2017), ("quarry_2021_URD_final.pdf", "Registration Document", "annual", 2021),
    ("our-corporate-report-2020.pdf", "The corporate report of 2020", "annual", 2020), ("sustainability-report-2023.pdf", None, "sustainability", 2023), ("press-release-june-2024.pdf", None, "other", 2024),
]


def test_report_classification(spark):
    rows = spark.createDataFrame([(k, f, t) for k, (f, t, _, _) in enumerate(FILES)], "k int, f string, t string")
    text = rows.withColumn("h", R.haystack(F.concat(F.lit("https://x.example/"), "f"), F.col("f"), F.col("t"))).withColumn("r", R.matched_rule(F.col("h")))
    got = text.withColumn("c", R.classify(F.col("h"), F.col("r"))).orderBy("k").select("c.*").collect()
    assert [(g.kind, g.fiscal_year) for g in got] == [(k, y) for _, _, k, y in FILES] and got[-1].confidence == 0.3


def plain_near_year(text, rule, nearest):
    import re

    if not (m := re.search(R.RULES[rule][1], text, re.IGNORECASE)):
        return None
    base = max(0, m.start() - 80)
    shift = base if nearest else 0
    found = [(y.start() + shift, int(y[0])) for y in re.finditer(R.YEAR, text[base : m.end() + 80]) if 1990 <= int(y[0]) <= 2030]
    return min(((abs(m.start() - at - 4 if at + 4 <= m.start() else at - m.end()), y) for at, y in found), default=(0, None))[1]


def test_near_year_as_is_and_corrected(spark):
    import random

    r = random.Random(1)
    bits = ["annual report", "2019", "2021", "1985", "x", "-", "report ", "half-year report", "corporate report", "esg", "q3 ", " 1999 ", "20-f", "urd", "_", "/", "lorem ipsum dolor sit amet ", "2035", " 12 ", "financial statements", "é"]
    texts = ["x" * 150 + "2019 annual report " + "y" * 60 + " 2022 z", "2021 annual report 2023", "annual report"] + ["".join(r.choices(bits, k=r.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("r", R.matched_rule(F.col("t"))).where("r is not null")
    rows = df.select("k", "t", "r", R.near_year(F.col("t"), F.col("r")).alias("literal"), R.near_year(F.col("t"), F.col("r"), nearest=True).alias("nearest")).orderBy("k").collect()
    assert all((x.literal, x.nearest) == (plain_near_year(x.t, x.r, False), plain_near_year(x.t, x.r, True)) for x in rows)
    # The year beside the match is in a window that begins later than the text: the far one wins, as distances are taken; corrected, the near one does.
    assert (rows[0].literal, rows[0].nearest) == (2022, 2019) and (rows[1].literal, rows[1].nearest) == (2021, 2021) and rows[2].literal is None
    plan = df.select(R.classify(F.col("t"), F.col("r")), L.resolve(F.col("t"), F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_links_are_resolved_as_browsers_do(spark):
    import random
    from urllib.parse import urljoin

    r = random.Random(2)
    bases = ["https://a.com", "https://a.com/", "https://a.com/x/y?q=1", "https://a.com/x/y/", "https://a.com/x/../y/z#f", "HTTP://A.com//p//q"]
    cases = [(b, u) for b in bases for u in ("", "  /x", "mailto:a@b", "ftp://z/y/../q", "//d.com/e", "https://f.com/a/../b", "?", "#", "?h", "#g", "a\n/b")]
    for _ in range(300):
        path = "/".join(r.choices(["a", "b", "..", ".", "", "c.d", "é", "x y", "..."], k=r.randint(0, 5))).lstrip("/")
        cases.append((r.choice(bases), r.choice(["", "/"]) + path + r.choice(["", "?q=2", "#f", "?a=/../b#/..", "?", "#"])))
    got = spark.createDataFrame(cases, "b string, u string").select("b", "u", L.resolve(F.col("b"), F.col("u")).alias("r")).collect()
    assert [x.r for x in got] == [urljoin(x.b, x.u) for x in got]


SAME = [("https://investors.acme.com", "https://brand.acme.com", True), ("https://www.bmw.com", "https://annual-report.bmw.group", False), ("https://a.com", "https://a.co.uk", False), ("https://x.a.co.uk", "https://a.co.uk", True), ("", "https://a.com", False), ("http://10.0.0.1/a", "http://10.0.0.1/b", True)]


def test_links(spark):
    for a, b, same in SAME:
        assert one(spark, L.same_org, a, b) is same
    assert many(spark, L.looks_like_pdf, ["https://a/x.PDF?v=1", "https://a/dam/jcr:1", "https://a/x.html", "https://a/files/1"]) == [True, True, False, True]
    paths = ["/financials/2024", "/en/financials/2024", "/reports/q1-2024", "/financials", "/about"]
    assert many(spark, L.is_drilldown, ["https://a.com" + p for p in paths]) == [True, True, True, False, False]
    joins = [("https://a.com/x/y?q", u) for u in ("../z", "b", "/c", "//d.com/e", "https://f.com", "#g", "?h", "")]
    from urllib.parse import urljoin

    rows = spark.createDataFrame(joins, "b string, u string").select(L.resolve(F.col("b"), F.col("u"))).collect()
    assert [r[0] for r in rows] == [urljoin(b, u) for b, u in joins]
    html = '<a class="x" href="/r.pdf" aria-label=" Report "><!--[-->Label<!--]--></a><A HREF=\'b\'>'
    assert one(spark, L.anchors, html)[0].startswith("<a class") and len(one(spark, L.anchors, html)) == 2
    assert one(spark, lambda h: L.anchor_label(F.get(L.anchors(h), F.lit(0))), html) == "Report"
    assert one(spark, L.archive_raw_url, "http://w.example/web/2020/http://x/2020/", "2020") == "http://w.example/web/2020id_/http://x/2020/"


@pytest.mark.parametrize("line,kind", [(1, "balance"), (12, "balance"), (13, None), (15, None), (20, None)])
def test_titles_are_looked_for_in_twelve_lines(spark, line, kind):
    from ledgerloom.operators.extract import candidate_pages

    text = "\n".join(["words"] * (line - 1) + ["Consolidated balance sheet", "as at 31 December"])
    pages = spark.createDataFrame([("d", 3, text)], "sha256 string, page_idx int, text string")
    assert [r.kind for r in candidate_pages(pages).collect()] == ([kind] if kind else [])


def test_what_rules_need_is_in_all_their_matches(spark):
    """Texts made of the rules' words, in any case and with letters that fold to them: the first pattern that matches decides, as without a look beforehand."""
    import random

    r = random.Random(6)
    words = ["annual", "report", "2023", "20231231", "x20f", "20-F", "10k", "form", "urd", "universal", "registration", "document", "d’enregistrement", "universel", "financial", "consolidated", "statements", "integrated", "corporate", "half", "year", "interim", "h1", "Q3", "quarterly", "sustainability", "esg", "environmental", "social", "ethical", "climate", "responsible", "\u017focial", "cl\u0131mate", "10\u212a", "clİmate"]
    texts = ["".join(r.choice([w, w.upper()]) + r.choice(["-", "_", " ", "/", "", "."]) for w in r.choices(words, k=r.randint(1, 5))) for _ in range(1500)]
    plain = F.lit(None).cast("int")
    for k in reversed(range(len(R.RULES))):
        plain = F.when(F.col("t").rlike("(?iU)" + R.RULES[k][1]), k).otherwise(plain)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.matched_rule(F.col("t")).alias("got"), plain.alias("want"))
    wrong = rows.where("not got <=> want").collect()
    assert not wrong, wrong[:5]
    assert rows.select("want").distinct().count() > 15
