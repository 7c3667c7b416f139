"""Calls that are asked once, budgets, staged tiers, crawls by levels and stores that grow."""

import base64
import json
import os
import random
import re
import uuid
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli, schemas
from ledgerloom.operators import crawl, frontier, ingest, models, providers, rounds
from ledgerloom.operators.calls import CallTable
from ledgerloom.sources import files


def noting(folder, answer, fails=lambda batch: False):
    """A model that notes every request it gets in a folder, from whatever worker; ``asked`` tells them. Workers can't import this module: hence nested."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    def respond(batch):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(x.replace("\n", " ") for x in batch))
        if fails(batch):
            raise OSError("service down")
        return [answer(x) for x in batch]

    respond.asked = lambda: sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n"))
    return respond


def test_each_key_is_asked_once_and_failures_again(spark, tmp_path):
    requests = spark.createDataFrame([(f"{k % 256:02x}{k}", f"r{k}") for k in range(60)] * 3 + [("07same", "b"), ("07same", "a"), (None, "no key")], "key string, request string").repartition(5)
    calls = CallTable(spark, str(tmp_path / "calls"), each=20, at_once=4)
    down = noting(tmp_path / "first", str.upper, lambda batch: any(x.endswith("7") for x in batch))
    answers, new = providers.cached_calls(requests, calls, down)
    for _ in range(3):  # reading asks nothing
        assert answers.count() == 183
    assert len(down.asked()) == 61 and set(down.asked()) == {f"r{k}" for k in range(60)} | {"a"}
    first = {r.key: r.response for r in new.collect()}
    assert 0 < len(first) < 61 and new.count() == len(first)
    up = noting(tmp_path / "second", str.lower)
    answers, new = providers.cached_calls(requests, CallTable(spark, str(tmp_path / "calls")), up)
    got = {(r.key, r.response) for r in answers.collect()}
    assert len(up.asked()) == 61 - len(first) == new.count()
    assert {k: v for k, v in got if k in first} == first and dict(got)[None] is None and all(v for k, v in got if k)
    again = noting(tmp_path / "third", str.lower)
    assert providers.cached_calls(requests, calls, again)[1].count() == 0 and again.asked() == []
    assert dict(got)["07same"] in ("A", "a")


def test_prefixes_of_digits_stay_texts(spark, tmp_path):
    calls = CallTable(spark, str(tmp_path / "calls"), digits=2)
    keys = ["07aa", "7aaa", "1e5x", "00bb", "10cc"]
    calls.add(spark.createDataFrame([(k, k.upper()) for k in keys], "key string, response string"), "r")
    assert {(r.prefix, r.key) for r in calls.read().collect()} == {(k[:2], k) for k in keys}
    assert calls.answers(spark.createDataFrame([(k,) for k in keys], "key string")).count() == 5


def test_a_stage_asks_its_model_once_for_each_report(spark, tmp_path):
    rows = [("c", f"d{k}", 2024, "income", "EUR", "units", 12, n, f"Line {n}", {"2024-12-31": None}) for k in range(6) for n in range(3)]
    extracted = spark.createDataFrame(rows, "company_slug string, source_sha256 string, source_fiscal_year int, statement string, currency string, unit string, period_months int, row_idx int, raw_label string, values_by_period_end map<string,decimal(30,4)>")
    fickle = noting(tmp_path / "asked", lambda x: json.dumps({"correct_kind": True, "rows": [{"label": uuid.uuid4().hex, "cells": []}]}) if "Line 0" in x else None)
    calls = CallTable(spark, str(tmp_path / "calls"))
    result, new = models.confirm_by_model(extracted, calls, fickle)
    labels = [sorted(r.label for r in result.collect()) for _ in range(2)]
    # All six reports have equal requests: one call, whose answer all reads see.
    assert labels[0] == labels[1] and len(fickle.asked()) == 1 and new.count() == 1 and result.count() == 6
    other = extracted.withColumn("raw_label", F.concat("source_sha256", F.lit(" "), "raw_label"))
    result, new = models.confirm_by_model(other, calls, fickle)
    result.count(), result.count()
    assert len(fickle.asked()) == 1 + 6 and new.count() == 6


def plain_search(pages, found, kinds=schemas.STATEMENT_KINDS, most_calls=6, most_pages=12):
    out = []
    for doc in sorted({d for d, *_ in pages}):
        calls = 0
        for kind in kinds:
            for place, page in enumerate(sorted(p for d, k, p in pages if d == doc and k == kind)[:most_pages], 1):
                if most_calls is not None and calls >= most_calls:
                    break
                calls += 1
                good = found(doc, kind, page)
                out.append((doc, kind, place, calls, good))
                if good:
                    break
    return out


@pytest.mark.parametrize("most_calls,most_pages", [(6, 12), (2, 12), (None, 3)])
def test_pages_are_asked_within_the_budget(spark, tmp_path, most_calls, most_pages):
    r = random.Random(3)
    pages = sorted({(f"d{r.randrange(9)}", r.choice(schemas.STATEMENT_KINDS), r.randrange(40)) for _ in range(160)})
    good = {p: r.random() < 0.15 for p in pages}
    model = noting(tmp_path / "asked", lambda x: None if json.loads(x)["page"] % 7 == 3 else json.dumps({"found": good[tuple(json.loads(x).values())]}))
    df = spark.createDataFrame([(*p, p[2]) for p in pages] + [("d1", "income", None, 1), (None, "income", 1, 1), ("d1", "other", 1, 1)], "sha256 string, kind string, place int, page int")
    calls = CallTable(spark, str(tmp_path / "calls"))
    run = lambda: rounds.ask_pages(df, F.struct("sha256", "kind", "page"), F.from_json("response", "found boolean")["found"], calls, model, most_calls=most_calls, most_pages=most_pages)
    want = plain_search(pages, lambda *p: p[2] % 7 != 3 and good[p], most_calls=most_calls, most_pages=most_pages)
    got = sorted((x.sha256, x.kind, x.place, x.round, x.found) for x in run().collect())
    assert got == sorted(want) and len(model.asked()) == len(want)
    if most_calls != 2:
        return
    failed = sum(1 for _ in model.asked() if json.loads(_)["page"] % 7 == 3)
    assert sorted((x.sha256, x.kind, x.place, x.round, x.found) for x in run().collect()) == sorted(want)
    assert len(model.asked()) == len(want) + failed  # a second run repeats failed calls only


def test_tiers_see_only_what_is_left(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}",) for k in range(10)] + [("d0",), (None,)], "source_sha256 string")
    n = F.substring("source_sha256", 2, 9).cast("int")
    seen = {}

    def tier(name, keeps, **kw):
        def extract(work):
            seen[name] = sorted((r.source_sha256, r.statement) for r in work.collect())
            return work.where(keeps).withColumn("row_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("from", F.lit(name))

        return rounds.Tier(name, extract, **kw)

    def verify(found):
        bad = (F.col("statement") == "income") & (n % 2 == 0)
        issues = F.array().cast("array<struct<severity:string>>")
        return found.where(n != 9).select("source_sha256", "statement", (~bad).alias("is_correct_kind"), issues.alias("issues"), F.when(n != 8, 0.9).alias("confidence"))

    tiers = [tier("heuristic", F.col("statement") != "cashflow"), tier("vision", n < 5), tier("text", n != 6, verified=False)]
    taken, asked = rounds.escalate(docs, tiers, verify)
    kinds = schemas.STATEMENT_KINDS
    every = sorted((f"d{k}", s) for k in range(10) for s in kinds)
    passes = lambda d, s: not (s == "income" and int(d[1:]) % 2 == 0 and d != "d8")  # noqa: E731 - d8's verdict is empty
    first = [x for x in every if x[1] != "cashflow" and passes(*x)]
    left = [x for x in every if x not in first]
    second = [x for x in left if int(x[0][1:]) < 5 and passes(*x)]
    rest = [x for x in left if x not in second]
    assert seen == {"heuristic": every, "vision": left, "text": rest}
    got = {t: sorted((r.source_sha256, r.statement) for r in taken.where(F.col("tier") == t).select("source_sha256", "statement").distinct().collect()) for t in seen}
    assert got == {"heuristic": first, "vision": second, "text": [x for x in rest if x[0] != "d6"]}
    assert asked.count() == sum(map(len, seen.values())) and taken.count() == 2 * sum(map(len, got.values()))
    seen.clear()
    taken, _ = rounds.escalate(docs, tiers, None)
    assert list(seen) == ["heuristic"] and taken.count() == 40
    seen.clear()
    rounds.escalate(docs, [tier("all", F.lit(True)), tier("idle", F.lit(True))], lambda found: verify(found).limit(0))
    assert list(seen) == ["all"]


def test_a_tier_of_pages_asks_for_wanted_kinds_only(spark, tmp_path):
    pages = spark.createDataFrame([("a", k, p) for k in schemas.STATEMENT_KINDS for p in (1, 2)], "sha256 string, kind string, place int")
    model = noting(tmp_path / "asked", lambda x: json.dumps({"found": json.loads(x)["place"] == 2}))
    rows_of = lambda calls: calls.select(F.col("sha256").alias("source_sha256"), F.col("kind").alias("statement"), "place")
    text = rounds.page_tier("text", pages, F.struct("kind", "place"), F.from_json("response", "found boolean")["found"], CallTable(spark, str(tmp_path / "c")), model, rows_of, verified=False)
    heuristic = rounds.Tier("heuristic", lambda work: work.where("statement = 'balance'").withColumn("place", F.lit(0)))
    taken, _ = rounds.escalate(spark.createDataFrame([("a",)], "source_sha256 string"), [heuristic, text], lambda found: found.select("*", F.lit(True).alias("is_correct_kind"), F.array().cast("array<struct<severity:string>>").alias("issues"), F.lit(1.0).alias("confidence")))
    assert sorted((r.statement, r.tier, r.place) for r in taken.collect()) == [("balance", "heuristic", 0), ("cashflow", "text", 2), ("income", "text", 2)]
    assert len(model.asked()) == 4 and not any("balance" in x for x in model.asked())


def test_three_tiers_with_models(spark, tmp_path):
    """Rows by rule, a verdict on them, images for what is missing, texts for the rest; each call once."""
    docs = [f"d{k}" for k in range(4)]
    statement = lambda label: json.dumps({"found": True, "unit": "units", "rows": [{"label": label, "cells": [{"period_end": "2024-12-31", "value": "1"}]}]})
    heuristic = spark.createDataFrame([(d, "income", "millions", n, f"{d} line {n}", None) for d in docs for n in range(70)], "source_sha256 string, statement string, unit string, row_idx int, raw_label string, values_by_period_end map<string,decimal(30,4)>")
    pages = spark.createDataFrame([(d, k, p, f"{d} {k} {p}".encode() if p > 1 else b"the same cover", f"in thousands of euros {d} {k} {p} " + "x" * 13_000) for d in docs for k in schemas.STATEMENT_KINDS for p in range(1, 8)], "sha256 string, kind string, place int, image binary, text string")
    calls = CallTable(spark, str(tmp_path / "calls"))
    verdict = noting(tmp_path / "verdicts", lambda x: None if "d3" in x else json.dumps({"is_correct_kind": "d0" not in x, "confidence": 0.8}))
    sees = noting(tmp_path / "images", lambda x: statement("seen") if json.loads(x)["kind"] == "balance" and base64.b64decode(json.loads(x)["image"]).endswith(b"3") else json.dumps({"found": False}))
    reads = noting(tmp_path / "texts", lambda x: statement("read") if " 5 " in json.loads(x)["text"] else None if " 4 " in json.loads(x)["text"] else json.dumps({"found": False, "rows": []}))
    tiers = [rounds.Tier("heuristic", lambda work: heuristic), models.vision_tier(pages, calls, sees), models.text_tier(pages, calls, reads)]
    taken, _ = rounds.escalate(spark.createDataFrame([(d,) for d in docs], "source_sha256 string"), tiers, models.verifier(calls, verdict))
    got = {(r.source_sha256, r.statement): (r.tier, r.n, r.unit) for r in taken.groupBy("source_sha256", "statement", "tier", "unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(d, "income"): ("heuristic", 70, "millions") for d in docs[1:]} | {(d, "balance"): ("vision", 1, "thousands") for d in docs} | {(d, "cashflow"): ("text", 1, "thousands") for d in docs[1:]} | {("d0", "income"): ("text", 1, "thousands")}
    assert got == want  # d0 has no call left for its cash flows: five went to its income
    assert len(verdict.asked()) == len(set(verdict.asked())) == 4 + 1 and all(len(json.loads(x)["lines"]) in (1, 60) for x in verdict.asked())
    seen = [(json.loads(x)["kind"], base64.b64decode(json.loads(x)["image"])) for x in sees.asked()]
    # Three images a kind: the cover is one call a kind, for all documents.
    assert len(seen) == len(set(seen)) and sorted(seen) == sorted({(k, i) for k, ds in (("income", docs[:1]), ("balance", docs), ("cashflow", docs)) for d in ds for i in (b"the same cover", f"{d} {k} 2".encode(), f"{d} {k} 3".encode())})
    assert len(reads.asked()) == 6 + 3 * 5 and all(len(json.loads(x)["text"]) == 12_000 for x in reads.asked())


def plain_crawl(source, web):
    """A queue, as a person would write it."""
    slug, name, entries, direct, link, follow, most = source
    found = {u: (u, None, None) for u in direct}
    queue, visited = [(u, 0) for u in entries], {}
    while queue:
        url, depth = queue.pop(0)
        if url in visited:
            continue
        visited[url] = depth
        for href, text in re.findall(r"""<a href="([^"]*)">(.*?)</a>""", web.get(url, "")):
            to = urljoin(url, href.replace("&amp;", "&"))
            if re.search(link, to):
                found.setdefault(to, (url, re.sub("<[^>]*>", "", text).strip() or None, depth))
            elif follow and re.search(follow, to) and depth < most:
                queue.append((to, depth + 1))
    return [(slug, name, u, *x) for u, x in found.items()], {(slug, name, u, d) for u, d in visited.items()}


@pytest.mark.parametrize("seed", [2])
def test_crawl_by_levels_equals_a_queue(spark, tmp_path, seed):
    r = random.Random(seed)
    address = lambda k: f"https://s{k % 3}.example/{['year', 'en'][k % 2]}/{k}"
    link = lambda k: r.choice([address(k), f"/year/{k}", f"../en/{k}?a=1&amp;b={k}", f"/files/{k % 11}.pdf", f"doc{k % 5}.PDF", f"https://other.example/{k % 4}.pdf", "mailto:x@y", "#top"])
    web = {address(k): "<p>" + " ".join(f'<a href="{link(r.randrange(40))}">{r.choice(["A <b>report</b>", "", " x "])}</a>' for _ in range(6)) for k in range(40)}
    sources = [(f"c{k % 4}", f"s{k}", [address(r.randrange(45)) for _ in range(r.randrange(1, 4))], [f"/files/{k}.pdf", "u"][: k % 3], r.choice([r"\.pdf$", r"(?i)\.pdf", "files"]), r.choice([None, "", "year", "/(en|year)/", "/(en|year)/"]), k % 4) for k in range(12)]
    fetched = []

    def fetch(urls):
        asked = [x.url for x in urls.collect()]
        fetched.extend(asked)
        return spark.createDataFrame([(u, web.get(u), None if u in web else "404") for u in asked], frontier.PAGES)

    df = spark.createDataFrame([(s, n, e, d, lf, f or None, m) for s, n, e, d, lf, f, m in sources], "slug string, source_name string, entry_urls array<string>, direct_urls array<string>, link_filter string, follow_links string, max_follow_depth int")
    store = frontier.PageStore(spark, str(tmp_path / "pages"), fetch)
    candidates, visited = frontier.crawl_sources(df, store)
    got = {}
    for x in candidates.orderBy("slug", "source_name", *frontier.in_order()).collect():
        got.setdefault((x.slug, x.source_name), []).append((x.slug, x.source_name, x.url, x.page_url, x.link_text, x.depth))
    pages = set()
    for s in sources:
        want, seen = plain_crawl(s, web)
        assert got.get((s[0], s[1]), []) == want
        pages |= seen
    assert {(x.slug, x.source_name, x.url, x.depth) for x in visited.collect()} == pages and visited.count() == len(pages)
    assert sorted(fetched) == sorted({p[2] for p in pages}) and max(p[3] for p in pages) == 3
    assert {x.url for x in visited.where("error is not null").collect()} == {p[2] for p in pages} - set(web)
    fetched.clear()
    assert frontier.crawl_sources(df, store)[0].count() == candidates.count() and fetched == []  # the store has all pages


def test_a_crawl_without_entries(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", [], ["u"], "x", None, 2)], "slug string, source_name string, entry_urls array<string>, direct_urls array<string>, link_filter string, follow_links string, max_follow_depth int")
    candidates, visited = frontier.crawl_sources(df, frontier.PageStore(spark, str(tmp_path / "pages"), lambda urls: urls.selectExpr("url", "'' as html", "'' as error")))
    assert [tuple(r)[:5] for r in candidates.collect()] == [("a", "s", "u", "u", None)] and visited.count() == 0


def test_contents_are_stored_once(spark, tmp_path):
    def staged(rows):
        return rounds.written(spark.createDataFrame(rows, "sha256 string, content binary"), files.scratch(spark, "t"))

    path = str(tmp_path / "store")
    assert ingest.add_contents(staged([("aa1", b"x"), ("aa1", b"x"), ("bb2", b"y")]), path).count() == 2
    before = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for f in (f"{d}/{n}" for n in names) if "part-" in f}
    assert sorted(r.sha256 for r in ingest.add_contents(staged([("bb2", b"y"), ("01c", b"z"), (None, None)]), path).collect()) == ["01c"]
    assert sorted((r.sha256, bytes(r.content)) for r in spark.read.schema(ingest.STORE).parquet(path).collect()) == [("01c", b"z"), ("aa1", b"x"), ("bb2", b"y")]
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    plan = ingest.stored_names(spark, path)._jdf.queryExecution().toString()
    assert "content" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_scrape_follows_entry_pages_and_keeps_what_it_has(spark, tmp_path):
    web, out, config = tmp_path / "web", tmp_path / "out", tmp_path / "companies.yaml"
    web.mkdir()
    (web / "ir.htm").write_text('<a href="annual-report-2023.htm">Annual report 2023</a> <a href="more.htm">More</a> <a href="gone-report.htm">Gone</a>')
    (web / "more.htm").write_text('<a href="annual-report-2022.htm">Older</a> <a href="annual-report-2023.htm">again</a> <a href="copy-report.htm">Copy</a>')
    (web / "annual-report-2023.htm").write_text("<html>2023</html>")
    (web / "annual-report-2022.htm").write_text("<html>2022</html>")
    (web / "copy-report.htm").write_text("<html>2023</html>")

    def configure(**more):
        source = {"name": "site", "entry_urls": [f"file://{web}/ir.htm"], "link_filter": "report", "follow_links": "more|missing", "max_follow_depth": 1, **more}
        config.write_text(json.dumps({"companies": {"acme": {"name": "Acme", "sources": [source, {"name": "other", "direct_urls": [f"file://{web}/annual-report-2022.htm"]}]}}}))

    def scrape(*more):
        cli.main(["scrape", "--companies", str(config), "--out", str(out), *more], spark)
        record = {r.source_name: r for r in spark.read.schema(ingest.RUN).json(f"{out}/runs").orderBy("started_at").collect()}
        return {k: (v.status, v.pages, v.found, v.downloaded, v.failed) for k, v in record.items()}

    configure()
    assert scrape("--discover-only") == {"site": ("ok", 2, 4, 0, 0), "other": ("ok", 0, 1, 0, 0)}
    assert spark.read.schema(schemas.SCRAPED).json(f"{out}/manifest").count() == 0
    assert scrape("--limit", "1") == {"site": ("ok", 2, 4, 1, 0), "other": ("ok", 0, 1, 1, 0)}
    assert scrape() == {"site": ("partial", 2, 4, 3, 1), "other": ("ok", 0, 1, 1, 0)}
    manifest = files.read_stage(spark, f"{out}/manifest", schemas.SCRAPED)
    assert sorted(r.source_url.split("/")[-1] for r in manifest.collect()) == ["annual-report-2022.htm", "copy-report.htm"]  # by content, the last row counts
    assert spark.read.schema(ingest.STORE).parquet(f"{out}/contents").count() == 2
    (web / "annual-report-2023.htm").write_text("<html>2023, corrected</html>")
    configure(entry_urls=[f"file://{web}/ir.htm", f"file://{web}/missing.htm"])
    assert scrape()["site"] == ("partial", 3, 4, 3, 1)
    manifest = {r.source_url.split("/")[-1]: r for r in files.read_stage(spark, f"{out}/manifest", schemas.SCRAPED).collect()}
    assert set(manifest) == {"annual-report-2023.htm", "annual-report-2022.htm", "copy-report.htm"} and manifest["annual-report-2023.htm"].link_text == "Annual report 2023"
    contents = spark.read.schema(ingest.STORE).parquet(f"{out}/contents")
    assert contents.count() == 3 == contents.select("sha256").distinct().count()
    errors = spark.read.schema(ingest.ERRORS).json(f"{out}/errors").collect()
    assert {(e.stage, e.url.split("/")[-1]) for e in errors} == {("download_pdf", "gone-report.htm"), ("fetch_page", "missing.htm")}
    cli.main(["classify", "--in", str(out), "--out", str(tmp_path / "classified")], spark)
    assert spark.read.json(str(tmp_path / "classified")).count() == 3


def test_manifest_merge_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "sha256 string, source_url string, ord int")
    new = spark.createDataFrame([("b", "new", 0), ("b", "newer", 1), ("c", "new", 0)], "sha256 string, source_url string, ord int")
    assert sorted((r.sha256, r.source_url) for r in crawl.merge_manifest(old, new).collect()) == [("a", "old"), ("b", "newer"), ("c", "new")]
