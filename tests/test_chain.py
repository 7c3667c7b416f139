"""The stages of the command line on each other's output, from fetched pages to exported documents."""

import json

import pytest

from ledgerloom import cli
from ledgerloom.sources import files

PAGE = """<html><body><h1>Annual report {year}</h1><p>(in millions of euros)</p>
<h2>Consolidated income statement</h2><table><tr><th>Item</th><th>{year}</th><th>{before}</th></tr>{income}</table>
<h2>Consolidated balance sheets</h2><table><tr><th>Item</th><th>{year}</th></tr>{balance}</table></body></html>"""
LINES = ["Revenue", "Cost of sales (1)", "Gross profit", "Research", "Marketing", "Administration", "Operating profit", "Net income"]


def page(year, shift, **labels):
    row = lambda k, name: f"<tr><td>{labels.get(name, name)}</td><td>{1000 * k + year:,}</td><td>{1000 * k + year - 1 + shift:,}</td></tr>"
    names = [n.split(" (")[0] for n in LINES]
    income = "".join(row(k, n) for k, n in enumerate(names, 1))
    balance = "<tr><td>Assets</td><td></td></tr><tr><td>Cash</td><td>5</td></tr><tr><td>Goodwill</td><td>(7)</td></tr><tr><td>Total assets</td><td>—</td></tr>"
    return PAGE.format(year=year, before=year - 1, income=income, balance=balance)


@pytest.fixture
def run(spark):
    return lambda stage, **kw: cli.main([stage, *[x for k, v in kw.items() for y in (v if isinstance(v, list) else [v]) for x in (f"--{k.rstrip('_')}", str(y))]], spark)


def test_from_pages_to_documents(spark, run, tmp_path):
    web, out, config = tmp_path / "web", tmp_path / "out", tmp_path / "companies.yaml"
    web.mkdir()
    (web / "annual-report-2023.htm").write_text(page(2023, 0))
    (web / "annual-report-2024.htm").write_text(page(2024, 50, Revenue="Revenue (2)", Marketing="Sales and marketing"))
    (web / "press-release.htm").write_text("<html><body>Nothing here</body></html>")
    config.write_text("companies:\n  acme:\n    name: Acme\n    ticker: ACM\n    exchange: X\n    reporting_currency: EUR\n    sources:\n      - {name: direct, direct_urls: [" + f"file://{web}/annual-report-2023.htm, file://{web}/gone.htm" + "]}\n  empty:\n    name: Empty\n    ticker: EMP\n    sources:\n      - {name: direct, direct_urls: [" + f"file://{web}/press-release.htm" + "]}\n")
    run("add", companies=config, slug="acme", url=[f"file://{web}/annual-report-2024.htm", f"file://{web}/annual-report-2023.htm"])
    run("scrape", companies=config, out=out / "scraped")
    run("classify", in_=out / "scraped", out=out / "classified")
    kinds = {r.source_url.split("/")[-1]: (r.company_slug, r.kind, r.fiscal_year) for r in spark.read.json(str(out / "classified")).collect()}
    assert kinds == {"annual-report-2023.htm": ("acme", "annual", 2023), "annual-report-2024.htm": ("acme", "annual", 2024), "press-release.htm": ("empty", "other", None)}
    run("parse", in_=out / "scraped", classified=out / "classified", companies=config, out=out / "parsed")
    run("confirm", in_=out / "parsed", out=out / "confirmed")
    run("normalize", in_=out / "confirmed", out=out / "normalized")
    for _ in range(2):  # building again changes nothing
        run("build", in_=out / "normalized", out=out / "store")
    run("export", in_=out / "store", companies=config, out=out / "exports")

    text = files.read_statement(spark, str(out / "exports/documents"), "acme", "income").first().value
    doc = json.loads(text)
    assert (doc["company"], doc["ticker"], doc["currency"], doc["unit"], doc["periods"]) == ("Acme", "ACM", "EUR", "millions", ["2024-12-31", "2023-12-31", "2022-12-31"])
    rows = {r["canonical_name"]: r for r in doc["rows"]}
    assert list(rows)[:2] == ["Revenue", "Cost of sales"] and "Sales and marketing" in rows and "Marketing" not in rows
    # 2023 as the report of 2024 has it (restated by 50), 2022 as the one of 2023 has it.
    revenue = rows["Revenue"]["values"]
    assert revenue["2023-12-31"] == {"value": "3073.0000", "source_fiscal_year": 2024, "is_restated": True}
    assert revenue["2024-12-31"] == {"value": "3024.0000", "source_fiscal_year": 2024, "is_restated": False}
    assert revenue["2022-12-31"] == {"value": "3022.0000", "source_fiscal_year": 2023, "is_restated": False}
    assert list(rows["Sales and marketing"]["values"]) == ["2023-12-31", "2024-12-31"]  # the old label has no counterpart
    balance = json.loads(files.read_statement(spark, str(out / "exports/documents"), "acme", "balance").first().value)
    assert {r["canonical_name"]: (r["depth"], r["is_header"]) for r in balance["rows"]}["Cash"][0] >= 1
    assert files.read_statement(spark, str(out / "exports/documents"), "acme", "cashflow") is None

    companies, statements = files.read_index(spark, str(out / "exports/index"))
    assert {r.slug: r.has_data for r in companies.collect()} == {"acme": True, "empty": False}
    assert sorted((r.company_slug, r.statement) for r in statements.collect()) == [("acme", "balance"), ("acme", "income")]
    assert files.read_index(spark, str(out / "nowhere")) is None

    run("research", in_=out / "classified", companies=config, year=2026, out=out / "gaps")
    gaps = sorted((r.company_slug, r.fiscal_year) for r in spark.read.json(str(out / "gaps")).collect())
    assert gaps == sorted([("acme", y) for y in range(2016, 2026) if y not in (2023, 2024)] + [("empty", y) for y in range(2016, 2026)])
    run("research", in_=out / "nothing", companies=config, year=2026, out=out / "gaps")
    assert spark.read.json(str(out / "gaps")).count() == 20

    (tmp_path / "quotes").mkdir()
    (tmp_path / "quotes/q.json").write_text(json.dumps({"ticker": "ACM", "price": 2.0, "currency": "EUR", "previous_close": 1.0, "sparkline": [1.0, 2.0]}))
    run("market", in_=tmp_path / "quotes", companies=config, out=out / "market")
    assert [(r.slug, r.price, r.change_pct) for r in files.read_market(spark, str(out / "market")).collect()] == [("acme", 2.0, 100.0)]
    run("companies", companies=config, out=out / "companies")
    assert spark.read.json(str(out / "companies")).count() == 2


ANSWERS = """
import json


def respond(batch):
    out = []
    for asked in map(json.loads, batch):
        if "old" in asked:
            out.append(json.dumps({"mappings": [{"old_label": o, "canonical_label": "sales and marketing" if o == "Marketing" else "no such name"} for o in asked["old"]]}))
        elif "lines" in asked:
            rows = [{"label": x["raw_label"] + " (confirmed)" if x["raw_label"] == "Research" else x["raw_label"], "cells": [{"period_end": k, "value": v} for k, v in x["values"].items()]} for x in map(json.loads, asked["lines"])]
            out.append(None if asked["statement"] == "balance" else json.dumps({"correct_kind": True, "rows": rows}))
        else:
            out.append(json.dumps({"kind": "interim", "fiscal_year": 2022, "confidence": 0.9}))
    return out
"""


def test_a_model_in_the_chain(spark, run, tmp_path, monkeypatch):
    """Classification, confirmation and drift by a model; what it doesn't answer goes by rule, and a second run asks nothing."""
    (tmp_path / "chain_model.py").write_text(ANSWERS)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "chain_model.py"))
    web, out, config, calls = tmp_path / "web", tmp_path / "out", tmp_path / "companies.yaml", tmp_path / "calls"
    web.mkdir()
    (web / "annual-report-2023.htm").write_text(page(2023, 0))
    (web / "annual-report-2024.htm").write_text(page(2024, 50, Marketing="Sales and marketing"))
    (web / "paper.htm").write_text("<html><body>Nothing here</body></html>")
    config.write_text(json.dumps({"companies": {"acme": {"name": "Acme", "reporting_currency": "EUR", "sources": [{"name": "s", "direct_urls": [f"file://{web}/{n}" for n in ("annual-report-2023.htm", "annual-report-2024.htm", "paper.htm")]}]}}}))
    model = {"model": "chain_model:respond", "calls": calls}
    run("scrape", companies=config, out=out / "scraped")
    run("classify", in_=out / "scraped", out=out / "classified", **model)
    kinds = {r.source_url.split("/")[-1]: (r.kind, r.fiscal_year, r.classified_by) for r in spark.read.json(str(out / "classified")).collect()}
    assert kinds["paper.htm"] == ("interim", 2022, "model") and kinds["annual-report-2024.htm"][:2] == ("annual", 2024)
    run("parse", in_=out / "scraped", classified=out / "classified", companies=config, out=out / "parsed")
    run("confirm", in_=out / "parsed", out=out / "confirmed", **model)
    rows = spark.read.parquet(str(out / "confirmed/rows")).collect()
    assert {(r.statement, r.confirmed_by) for r in rows} == {("income", "model"), ("balance", "rules")} and sum(r.label == "Research (confirmed)" for r in rows) == 2
    run("normalize", in_=out / "confirmed", out=out / "normalized", **model)
    facts = spark.read.parquet(str(out / "normalized/facts")).where("statement = 'income'").collect()
    # The report of 2023 calls it otherwise: the mapping joins its years.
    assert {(r.period_end.year, r.source_fiscal_year) for r in facts if r.canonical_name == "Sales and marketing"} == {(2024, 2024), (2023, 2024), (2023, 2023), (2022, 2023)}
    before = spark.read.parquet(str(calls)).count()
    run("classify", in_=out / "scraped", out=out / "classified", **model)
    run("normalize", in_=out / "confirmed", out=out / "normalized", **model)
    assert spark.read.parquet(str(calls)).count() == before == 1 + 2 + 1
