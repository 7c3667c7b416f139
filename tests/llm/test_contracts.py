"""Every opN query on one small table, row by row: names, types and values of its columns, against plain code."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality, queries

SPACES = " \t\n\x0b\x0c\r"


def edge_text(r):
    """Words of a few letters between any of the six spaces, with letters that escapes could be taken for at both ends."""
    words = [r.choice(["f", "n", "t", "r", "b", "ff", "of", "not", "for", "x1", "#", "A%", "<b>", "naïve", "end."]) for _ in range(r.choice([0, 1, 2, 5, 19, 20, 40]))]
    ends = ["".join(r.choices(SPACES, k=r.randint(0, 3))) for _ in range(2)]
    return ends[0] + "".join(w + r.choice([" ", " ", "\n", "\t", "\x0b", "\x0c", "\r\n", "  "]) for w in words[:-1]) + "".join(words[-1:]) + ends[1]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    texts = [edge_text(r) for _ in range(150)] + ["f a b", "f", "for all of f", "of the f f f", "a b\x0c", None, "", "\x0c"]
    lines = "\n".join(["for one of the many people who live off"] * 3)
    prose = ["".join(r.choice(["the river ", "a stone ", "of seven ", "green cloud. ", "people walk "]) for _ in range(r.randint(20, 200))) for _ in range(120)]
    spam = [("BUY #%d NOW! " % (k % 3)) * 40 for k in range(20)]
    secret = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" é", "PassWord:'abcdefgh' AKIAABCDEFGHIJKL12", "ключ " + "9f" * 20]
    texts += [lines, *prose, *spam, *prose[:5], *secret, "one two three " * 3000]
    kinds = [r.choice(["de", "en", None]) for _ in texts]
    return [(k if k % 40 else None, t, kinds[k - 1], "s", None) for k, t in enumerate(texts, 1)]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame([(1, "green cloud. people walk the river a stone"), (2, None), (None, "x")], "item_id long, text string")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def result(spark, tables, name, types):
    df = queries.QUERIES[name](spark, tables)
    found = dict(df.dtypes)
    assert {c: found.get(c) for c in types} == types
    return [tuple(r) for r in df.select(*types).collect()]


def plain_features(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    letters = sum(c.isalpha() for c in t)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
        "n_lines": len(lines), "n_stops": sum(c in ".!?" for c in t), "n_upper": sum("A" <= c <= "Z" for c in t), "n_letters": letters, "n_distinct": len(set(w)),
    }


def plain_vote(rule, x):
    good = {"length": x["n_words"] >= 100, "sentences": x["n_stops"] > 0 and x["n_words"] <= 30 * x["n_stops"]}
    bad = {
        "length": x["n_words"] < 20, "sentences": x["n_words"] > 150 * max(x["n_stops"], 1), "repeated_words": 10 * x["n_repeat_words"] >= 3 * x["n_words"], "repeated_lines": 5 * x["n_dup_lines"] >= 2 * x["n_lines"],
        "symbols": 4 * x["n_symbols"] >= x["n_words"], "letters": 10 * x["n_letters"] < 7 * x["word_chars"], "word_length": x["word_chars"] < 2 * x["n_words"] or x["word_chars"] > 14 * x["n_words"],
        "case": 2 * x["n_upper"] >= x["n_letters"], "variety": 8 * x["n_distinct"] < x["n_words"] and x["n_distinct"] < 200,
    }
    return 1 if good.get(rule) else -1 if bad[rule] else 0


def plain_posteriors(votes, rounds=400):
    """A document at a time, with products instead of logarithms."""
    n_rules, prior = len(votes[0]), 0.8
    p = {c: [{1: a, -1: b, 0: 1 - a - b} for _ in range(n_rules)] for c, a, b in ((1, 0.4, 0.01), (-1, 0.3, 0.3))}

    def posterior(v):
        g, b = prior, 1 - prior
        for k, x in enumerate(v):
            g, b = g * p[1][k][x], b * p[-1][k][x]
        return g / (g + b)

    for _ in range(rounds):
        post = [posterior(v) for v in votes]
        prior = (sum(post) + 1) / (len(votes) + 2)
        for c in (1, -1):
            weight = post if c == 1 else [1 - x for x in post]
            for k in range(n_rules):
                mass = {x: 1 + sum(w for w, v in zip(weight, votes, strict=True) if v[k] == x) for x in (1, 0, -1)}
                share = {x: m / sum(mass.values()) for x, m in mass.items()}
                if c == 1 and share[-1] > 0.01:
                    share = {x: 0.01 if x == -1 else s * 0.99 / (1 - share[-1]) for x, s in share.items()}
                p[c][k] = share
    return [posterior(v) for v in votes]


def test_op6(spark, tables, rows):
    types = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "p_good": "double"}
    got = result(spark, tables, "op6_quality", types)
    features = [plain_features(t) for _, t, *_ in rows]
    posts = plain_posteriors([tuple(plain_vote(rule, x) for rule in quality.RULES) for x in features])
    expected = []
    for (doc_id, *_), x, post in zip(rows, features, posts, strict=True):
        failed = x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]
        expected.append((doc_id, x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], failed, not failed and post >= 0.5, post))
    order = lambda x: tuple(str(v) for v in x[:7])
    for g, e in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert g[:8] == e[:8] and math.isclose(g[8], e[8], abs_tol=1e-4)
    words = {t: x["n_words"] for (_, t, *_), x in zip(rows, features, strict=True)}
    assert [words[t] for t in ("f a b", "f", "for all of f", "of the f f f", "a b\x0c")] == [3, 1, 4, 5, 2]
    assert {g[7] for g in got} == {True, False}


def test_op6_likelihood_never_falls(spark):
    r = random.Random(5)
    patterns = spark.createDataFrame([(r.choice([1, 0, -1]), r.choice([0, 0, -1]), r.choice([1, 0, -1]), float(r.randint(1, 50))) for _ in range(40)], "a int, b int, c int, n double")
    state = quality.fit_accuracies(patterns, ["a", "b", "c"], most_errors=0.05)
    trace = state["likelihoods"]
    assert len(trace) < 500 and all(y >= x - 1e-6 for x, y in zip(trace, trace[1:], strict=False))
    assert all(t[1][-1] <= 0.05 + 1e-12 and abs(sum(t[c].values()) - 1) < 1e-9 for t in state["votes"].values() for c in (1, -1))


def test_op2(spark, tables, rows):
    got = result(spark, tables, "op2_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    held = {d: d is None or zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    assert collections.Counter((d, h) for d, h, *_ in got) == collections.Counter((d, held[d]) for d, *_ in rows)
    und = {d for d, t, *_ in rows if not any(map(str.isalpha, t or ""))}
    assert all((p == "und") == (d in und or d is None) or d is None and p in ("de", "en") for d, _, p, _ in got)
    assert {p for *_, p, _ in got} == {"und", "de", "en"} and all(0 <= s <= 1 and (s == 0) == (p == "und") for *_, p, s in got)


def plain_spans(t):
    t = t or ""
    found = [(m.start(), "assign", m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda x: (x[0], order.index(x[1])))


def test_op1(spark, tables, rows):
    types = {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    got = collections.Counter(result(spark, tables, "op1_secret_scan", types))
    expected = []
    for doc_id, t, *_ in rows:
        spans = plain_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        expected.append((doc_id, *(sum(k == x for _, x, _ in spans) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == collections.Counter(expected)


@pytest.mark.parametrize("name", ["secret_base", "quality_base", "op5_minhash"])
def test_sql(spark, tables, name):
    import duckdb

    duck = duckdb.connect()
    for path in ("/root/testdata/sf0.001/documents.parquet", f"{tables}/documents.parquet/*.parquet"):
        duck.sql(f"create or replace view documents as select * from '{path}' where doc_id is not null")  # SQL tells rows apart by their ids
        expected = duck.sql(queries.ORACLE_SQL[name])
        df = queries.QUERIES[name](spark, path.partition("/documents.parquet")[0]).where("doc_id is not null")
        assert sorted(df.columns) == sorted(expected.columns)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, df.select(*expected.columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


def plain_cuts(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i, v in enumerate(cover) if v and (i == 0 or not cover[i - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(bytes(b for b, v in zip(t, cover, strict=True) if not v)).hexdigest()))
    return out


def test_op3(spark, tables, rows):
    got = result(spark, tables, "op3_suffix_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    assert collections.Counter(got) == collections.Counter((d, *cut) for (d, *_), cut in zip(rows, plain_cuts([t for _, t, *_ in rows]), strict=True))


@pytest.fixture(scope="module")
def library():
    from ledgerloom.llm.bpe_units import load_tokenizer

    known = {name: load_tokenizer(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    return lambda name, text: known[name].encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op4(spark, tables, rows, library):
    got = sorted(result(spark, tables, "op4_token_store", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}), key=lambda r: r[1])
    at = 0
    for doc_id, start, n, _ in got:
        assert start == at
        at += n
    assert [d for d, *_ in got] == sorted((d for d, *_ in got), key=lambda d: (d is not None, d))
    ids = [(d, [*library("byte_bpe_50k.json", t), 0]) for d, t, *_ in rows]
    assert collections.Counter((d, n, c) for d, _, n, c in got) == collections.Counter((d, len(x), zlib.crc32(packed(x))) for d, x in ids)


def test_op5(spark, tables, rows):
    got = result(spark, tables, "op5_minhash", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    sets = []
    for _, t, *_ in rows:
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    ids = [d for d, *_ in rows]
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                comp[max(x, y)] = min(x, y)
    assert sorted(g for g in got if g[0] is not None) == sorted((d, len(s), find(d), find(d) == d) for d, s in zip(ids, sets, strict=True) if d is not None)
    assert len(got) == len(rows)


def test_op7(spark, tables, rows, library):
    got = result(spark, tables, "op7_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    expected = collections.Counter()
    for d, t, *_ in rows:
        ids = [*library("word_bpe_49k.json", t), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            expected[d, k, at, len(piece), zlib.crc32(packed(piece))] += 1
    assert collections.Counter(g[:5] for g in got) == expected
    by = collections.defaultdict(list)
    for *_, length, _, sequence, offset in got:
        by[sequence].append((offset, length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(g[3] for g in got)
    assert len(by) <= -(-total // 4096) + 1


def test_op8(spark, tables, rows, library):
    got = result(spark, tables, "op8_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    counts = [(d, len((t or "").encode()), len(library("byte_bpe_50k.json", t))) for d, t, *_ in rows]
    assert collections.Counter(got) == collections.Counter((d, b, n, n > 1024) for d, b, n in counts)
    assert any(g[3] for g in got)


def test_op9(spark, tables, rows):
    types = {"doc_id": "bigint", "text": "string", **{f"n_{t}": "bigint" for t in ("email", "phone", "card", "ip", "ssn", "iban", "name")}}
    got = result(spark, tables, "op9_pii", types)
    assert collections.Counter(g[:2] for g in got) == collections.Counter((d, t) for d, t, *_ in rows)  # nothing personal in this table
    spark.conf.set("spark.ledgerloom.surrogateKey", "too short")
    try:
        with pytest.raises(ValueError, match="key"):
            queries.QUERIES["op9_pii"](spark, tables)
    finally:
        spark.conf.unset("spark.ledgerloom.surrogateKey")


def test_op10(spark, tables, rows):
    got = result(spark, tables, "op10_decontaminate", {"doc_id": "bigint", "item_id": "bigint", "bm25": "double", "question_overlap": "double", "answer_overlap": "double"})
    items = [(1, "green cloud. people walk the river a stone"), (None, "x")]
    least, most = collections.Counter(), collections.Counter()
    for item, text in items:
        w = re.findall(r"\w+", text.lower())
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        size = len(next(iter(own)))
        for d, t, *_ in rows:
            v = re.findall(r"\w+", (t or "").lower())
            held = lambda words: len(own & {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}) >= 0.8 * len(own)
            most[d, item] += held(v)
            # Any sixteen words (an item's, at least) are in one passage.
            least[d, item] += any(held(v[k : k + 16]) for k in range(max(1, len(v) - 15)))
    found = collections.Counter(g[:2] for g in got)
    assert all(least[k] <= found[k] <= most[k] for k in {*found, *most}) and sum(least.values()) > 3
