"""Indexes against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import crawl, search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_words_within_two_edits_share_a_deletion(spark):
    r = random.Random(1)
    pairs = set()
    for _ in range(300):
        a = b = "".join(r.choice("abc") for _ in range(r.randint(4, 12)))
        for _ in range(2):
            at = r.randrange(len(b) + 1)
            b = r.choice([b[:at] + b[at + 1 :], b[:at] + r.choice("abc") + b[at:], b[:at] + r.choice("abc") + b[at + 1 :]])
        pairs.add((a, b))
    rows = spark.createDataFrame(sorted(pairs), "a string, b string")
    assert rows.where(~F.arrays_overlap(search.deletions(F.col("a")), search.deletions(F.col("b")))).count() == 0


@pytest.mark.parametrize("slices", [(0.001, 0.03, 1.0), (0.5, 1.0)])
def test_first_title_that_contains_a_needle(spark, monkeypatch, slices):
    monkeypatch.setattr(search, "SLICES", slices)
    r = random.Random(2)
    titles = ["".join(r.choice("ab ") for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "zzzzzzzzzzzz", "über alles"]
    needles = {"", "a", "ab", "aba", "zzzzzzzzzzzz", "zzzz", "ber all", "no such", "x"} | {t[i : i + n] for t in titles[:60] for i, n in [(r.randrange(20), r.randint(1, 14))]} | {"".join(r.choice("ab ") for _ in range(9)) for _ in range(60)}
    got = {x.asked: x.ord for x in search.first_containing(spark.createDataFrame([(n,) for n in needles] + [(None,)], "asked string"), spark.createDataFrame(list(enumerate(titles)), "ord int, title string")).collect()}
    want = {n: k for n in needles if (k := next((k for k, t in enumerate(titles) if t is not None and n in t), None)) is not None}
    assert got == want
    nothing = spark.createDataFrame([], "ord int, title string")
    assert search.first_containing(spark.createDataFrame([("abcd",)], "asked string"), nothing).count() == 0


def plain_hits(query, rows, most):
    words = lambda t: list(dict.fromkeys(w for w in __import__("re").split(r"[^\w]+|_", t.lower()) if w))
    out = []
    for key, text in rows:
        total = 0
        for a in words(query):
            best = None
            for w in words(text or ""):
                d = edits(a, w)
                s = 1.0 if a == w else 0.9 if w.startswith(a) else 0.7 if a in w else {1: 0.6, 2: 0.4}.get(d) if min(len(a), len(w)) >= 4 else None
                best = max(filter(None, (best, s)), default=None)
            if best is None:
                break
            total += best
        else:
            if words(query):
                out.append((-round(total / len(words(query)), 6), key))
    return [(k, -s) for s, k in sorted(out)[:most]]


def test_ranked_hits_equal_a_plain_search(spark):
    r = random.Random(3)
    names = ["Spotify", "Adyen", "Siemens Energy", "Siemens Healthineers", "Schneider Electric", "Stellantis", "Capgemini", "Dassault Systèmes", "Ferrari", "Heineken", "Nokia", "Orange", "Unilever", "Wolters Kluwer"]
    rows = [(k, f"{r.choice(names)} {r.choice(names)}" if k % 9 else r.choice(names)) for k in range(150)] + [(150, None), (151, "")]
    queries = ["spotfy", "Spotify", "simens enrgy", "nok", "o", "electric sch", "kluver", "systemes", "systèmes", "nothing like it", "", "  ", "ora ora", "Wolters kluwr nokia"]
    found = search.ranked_search(spark.createDataFrame([(q,) for q in queries * 2] + [(None,)], "query string"), spark.createDataFrame(rows, "id int, name string"), "id", ["name"], most=7)
    got = {}
    for x in found.orderBy("query", "place").collect():
        got.setdefault(x.query, []).append((x.key, x.score))
    assert got == {q: w for q in queries if (w := plain_hits(q, rows, 7))}


def test_suffix_table_decides_what_belongs_together(spark):
    html = '<a href="https://b.github.io/files/1.pdf">x</a><a href="https://sub.a.github.io/files/2.pdf">x</a><a href="/reports/2024"></a><a href="https://github.io/files/3.pdf">y</a>'
    pages = spark.createDataFrame([("https://a.github.io/ir", "https://a.github.io", html), ("https://github.io/x", "https://github.io", html)], "page_url string, seed_url string, html string")
    rules = spark.createDataFrame([("io",), ("github.io",)], "rule string")
    by_page = lambda df: {p: sorted(r.url for r in df.collect() if r.page_url == p) for p in ("https://a.github.io/ir", "https://github.io/x")}
    assert by_page(crawl.pdf_links(pages, rules)) == {"https://a.github.io/ir": ["https://sub.a.github.io/files/2.pdf"], "https://github.io/x": ["https://github.io/files/3.pdf"]}
    assert len(by_page(crawl.pdf_links(pages))["https://a.github.io/ir"]) == 3  # without a table all of github.io is one
    assert by_page(crawl.drilldown_links(pages, rules)) == {"https://a.github.io/ir": ["https://a.github.io/reports/2024"], "https://github.io/x": ["https://github.io/reports/2024"]}
    assert "Documents (1)" in crawl.distilled(pages, rules=rules).where("page_url like '%a.github%'").first().text


def test_rows_with_the_same_words_are_searched_once(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("Fund "), (F.col("id") % 4).cast("string"), F.when(F.col("id") % 2 == 0, " fund").otherwise("")).alias("name"), F.when(F.col("id") == 7, "Odd").alias("other"))
    twice = rows.unionByName(rows.where("id = 9").withColumn("name", F.lit("Other words")))
    sets = {tuple(x.words): ([k.key for k in x["keys"]], x.first.key) for x in search.sets_of_words(twice, "id", ["name", "other"], 3).collect()}
    assert {w: sorted(k) for w, (k, _) in sets.items()} == {("0", "fund"): [0, 4, 8], ("1", "fund"): [1, 5, 13], ("2", "fund"): [2, 6, 10], ("3", "fund"): [3, 11, 15], ("3", "fund", "odd"): [7], ("1", "fund", "other", "words"): [9]}
    assert all(first == min(keys) for keys, first in sets.values())
    found = search.ranked_search(spark.createDataFrame([("fund",), ("fnud 1",), ("odd fund",), ("fund nowhere",)], "query string"), twice, "id", ["name", "other"], most=4)
    assert sorted((x.query, x.place, x.key) for x in found.collect()) == [("fnud 1", p, k) for p, k in enumerate((1, 5, 9, 13), 1)] + [("fund", p, k) for p, k in enumerate(range(4), 1)] + [("odd fund", 1, 7)]
