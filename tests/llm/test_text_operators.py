"""Secret scans, language identification, quality, decontamination and surrogates."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, pii, quality, secret_scan


def base_spans(t):
    t = t or ""
    found = [(m.start(), "assign", m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda x: (x[0], order.index(x[1]))))


CASES = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" é", "API_KEY:'abcdefgh' PassWord =short", "AKIAABCDEFGHIJKL12 AKIA123", "secret: secret=tokentoken token", "", None, "ſecret = abcdefghij", "api key = abcdefghij apikey==abcdefghi"]


def test_base_spans_equal_plain_patterns(spark, sample, odd):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").unionByName(sample[0].select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    found = secret_scan.find_secrets(df).select("doc_id", secret_scan.written(F.col("base")).alias("b"), secret_scan.written(F.col("spans")).alias("s")).collect()
    assert collections.Counter((r.doc_id, r.b) for r in found) == collections.Counter((r.doc_id, base_spans(r.text)) for r in df.collect())
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in found)


def test_random_tokens_are_told_from_words(spark):
    r = random.Random(6)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(r.choice(alnum) for _ in range(40)) for _ in range(40)]
    words = ["internationalization", "getCustomerAccountByIdentifier", "the-quick-brown-fox-jumps-over", "aaaaaaaaaaaaaaaaaaaaaaaa1", "com/example/project/module/file", "VERY_LONG_CONSTANT_NAME_HERE", "00000000000000000000001", "abcabcabcabcabcabcabcabc1"] * 5
    texts = [f"see {w} here" for w in secrets + words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = {x.doc_id for x in secret_scan.find_secrets(df).where("size(spans) > size(base)").collect()}
    assert len(hit & set(range(40))) >= 36 and not hit & set(range(40, len(texts)))
    clean = {x.doc_id: x.text for x in secret_scan.redact(df).collect()}
    assert all(clean[k] == "see [SECRET] here" for k in hit) and clean[41] == texts[41]


ALPHABETS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789"}
WRITTEN = "the quick model of international organization accounts receivable manager configuration default template customer service request handler abstract interface payment gateway session identifier history report annual statement consolidated balance sheet network security protocol buffer stream".split()


@pytest.mark.parametrize("name", ALPHABETS)
def test_keys_of_one_case_and_of_digits_are_found(spark, name):
    r = random.Random(12)
    # Digits of 32 and more are spans of the pattern for hexadecimal symbols anyway.
    keys = ["".join(r.choices(ALPHABETS[name], k=30 if name == "digits" else 40)) for _ in range(60)]
    join = [lambda w: "".join(w), lambda w: "".join(w).upper(), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "_".join(w), lambda w: "/".join(w), lambda w: "".join(f"{x}{r.randint(0, 99)}" for x in w)]
    words = [r.choice(join)(r.sample(WRITTEN, 5)) for _ in range(150)]
    numbers = ["20240131" * 5, "1000000" * 6, "7" * 40, "100200300400500600700800900"]
    df = spark.createDataFrame(list(enumerate(f"see {w} here" for w in keys + words + numbers)), "doc_id long, text string")
    hit = {x.doc_id for x in secret_scan.find_secrets(df).where("size(spans) > size(base)").collect()}
    assert len(hit & set(range(60))) >= 54 and len(hit - set(range(60))) <= 1


def plain_benjamini_hochberg(ps, rate):
    """The indexes that are rejected."""
    order = sorted(range(len(ps)), key=lambda k: ps[k])
    last = max((i for i, k in enumerate(order, 1) if ps[k] <= rate * i / len(ps)), default=0)
    return {k for k in range(len(ps)) if last and ps[k] <= ps[order[last - 1]]}


def test_random_spans_are_what_the_control_rejects(spark):
    """Every tested token counts in its family, also those that aren't random."""
    r = random.Random(11)
    words = ["river", "stone", "Green", "cloud", "people", "Walk", "engine", "Result", "value", "Index", "buffer", "Node"]
    written = lambda: r.choice(["", "_", "-", "/"]).join(r.choices(words, k=r.randint(4, 12)))
    drawn = lambda: "".join(r.choices(r.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]), k=r.choice([20, 24, 30, 31])))
    tokens = [written() for _ in range(600)] + [drawn() for _ in range(60)] + ["a" * 25, "abcabcabcabcabcabcabcabc", "x+y_" * 8]
    df = spark.createDataFrame([(k, f"so {t} it is") for k, t in enumerate(tokens)], "doc_id long, text string").repartition(3)
    tested = {}
    for k, t in enumerate(tokens):
        if len(t) >= 20 and not secret_scan.HEX.search(t) and (ps := secret_scan.battery(t)):
            tested.setdefault(min(12, int(2 * math.log2(len(t) / 20))), {})[k] = [10 ** (-secret_scan.BIN * secret_scan.binned(p)) for p in ps]
    want, left_out = set(), 0
    for own in tested.values():
        keys = list(own)
        not_random = plain_benjamini_hochberg([own[k][1] for k in keys], secret_scan.DRAWN_RATE)
        found = plain_benjamini_hochberg([1.0 if i in not_random else own[k][0] for i, k in enumerate(keys)], 0.01)
        want |= {keys[i] for i in found - not_random}
        left_out += len(not_random)
    hit = {x.doc_id for x in secret_scan.find_secrets(df).where("size(spans) > size(base)").collect()}
    assert hit == want and len(want) > 40 and left_out > 100
    assert len([k for k in hit if k < 600]) <= 0.01 * len(hit) + 1
    assert {x.doc_id for x in secret_scan.redact(df).where("text like '%[SECRET]%'").collect()} == want | {k for k, t in enumerate(tokens) if secret_scan.HEX.search(t)}


def test_battery_accepts_uniform_strings():
    r = random.Random(1)
    ps = [secret_scan.fisher([secret_scan.chi_squared_p(v, 16), secret_scan.runs_p(v), secret_scan.serial_p(v)]) for v in ([r.randrange(16) for _ in range(40)] for _ in range(400))]
    assert sum(p < 0.05 for p in ps) < 50 and sum(p < 0.001 for p in ps) < 6


def test_scan_of_nothing(nothing):
    assert secret_scan.find_secrets(nothing).count() == 0 and secret_scan.redact(nothing).columns == nothing.columns


def test_language_held_out_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, language_id.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark, odd, nothing):
    model = language_id.fit(spark.createDataFrame([("the cat and the dog are here with the house " * 30, "en"), ("der hund und die katze sind hier mit dem haus " * 30, "de"), (None, "xx"), ("abc", None)], "text string, lang string"))
    assert set(model) == {"en", "de"}
    got = collections.defaultdict(set)
    for r in language_id.identify(odd, model).collect():
        got[r.doc_id].add((r.lang_pred == "und", r.rejected))
    letterless = {1, 2, 3, 9}
    assert all((d in letterless) == (True in {u for u, _ in s}) for d, s in got.items())
    assert language_id.identify(odd, {}).where("lang_pred = 'und'").count() == odd.count()
    assert language_id.identify(nothing, model).count() == 0
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {r.doc_id for r in kept.collect()} & letterless
    assert language_id.identify(spark.createDataFrame([(1, "the dog"), (2, "die katze")], "doc_id long, text string"), model).orderBy("doc_id").collect()[1].lang_pred == "de"


def test_narrow_margins_are_rejected():
    words = "the cat and the dog are here with the house " * 20
    alike = language_id.Classifier({"a": words.encode(), "b": words.encode(), "c": b"der hund und die katze sind hier mit dem haus " * 20})
    for text in ("the dog", "the cat and the dog are here", words):
        assert alike.predict(text, 0.004)[3]
    apart = language_id.Classifier({"a": words.encode(), "c": b"der hund und die katze sind hier mit dem haus " * 20})
    assert [apart.predict(t, 0.004)[::3] for t in ("the dog", "die katze", "the cat and the dog are here", "der hund und")] == [("a", False), ("c", False), ("a", False), ("c", False)]


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_features(spark, sample, odd):
    df = sample[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(100_000, "a b c d e f g h " * 3), (100_001, "a b c d e f g h i a b c d e f g h"), (100_002, "x\nx\n\n \nx y")], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(df).collect())
    assert got == collections.Counter((r.doc_id, *plain_quality(r.text)) for r in df.collect())


def test_quality_keeps_edge_letters_and_trims_form_feeds(spark):
    line = "for one of the many people who live off"
    texts = ["\n".join([line] * 3), "\f" + " ".join([line] * 2) + "\f", "fff", "f x", "x f", "\f", "\x0b\f a \f\x0b", "f\ff"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(df).collect()}
    assert got == {k: plain_quality(t) for k, t in enumerate(texts)}
    assert [got[k][0] for k in range(8)] == [27, 18, 1, 2, 2, 0, 1, 2] and got[0][4] == 27


def test_quality_verdicts(spark, nothing):
    r = random.Random(9)
    prose = lambda: " ".join(f"{r.choice(['the', 'of', 'model', 'data', 'river', 'stone', 'cloud', 'green', 'walk', 'seven'])}{'.' if k % 9 == 8 else ''}" for k in range(120))
    rows = [(k, prose(), True) for k in range(160)] + [(200 + k, " ".join(f"{x}*#&" for x in prose().split()), False) for k in range(20)] + [(300 + k, ("BUY NOW " * 3 + "\n") * 20, False) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = quality.judge(df).join(df.select("doc_id", "good"), "doc_id").collect()
    assert all(x.kept for x in got if x.good) and not any(x.kept for x in got if not x.good)
    assert quality.judge(nothing).count() == 0


def test_quality_uses_no_python(sample):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        quality.features(sample[0]).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def plain_leaks(docs, items):
    words = lambda s: re.findall(r"\w+", (s or "").lower())
    out = set()
    for i in items:
        w = words(i.text)
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for d in docs:
            v = words(d.text)
            size = len(next(iter(own))) if own else 0
            there = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if own else set()
            if own and len(own & there) >= 0.8 * len(own):
                out.add((d.doc_id, i.item_id))
    return out


def test_leaks_equal_brute_force(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(sample[0], items).collect()}
    assert got == plain_leaks(sample[1], items.collect()) and got


def test_block_bounds_lose_no_item():
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    items = [(k, " ".join(r.choices(vocabulary, weights, k=r.randint(3, 40))), None) for k in range(60)]
    index = decontaminate.Index(items, 0.8, 5, block=4)
    reached = lambda words: {i for i, own in enumerate(index.own) if sum(x for t, x in own.items() if t in {index.term.get(w) for w in words}) >= index.threshold[i] - 1e-9}
    for _ in range(60):
        words = r.choices(vocabulary, weights, k=r.randint(1, 400))
        if r.random() < 0.7:
            at = r.randint(0, len(words))
            words[at:at] = items[r.randrange(60)][1].split()
        got = {i for i, *_ in index.query(words)}
        short = set().union(*(reached(words[k : k + index.longest]) for k in range(len(words))))
        assert short <= got <= reached(words)


def test_question_and_answer_both_count(spark):
    items = spark.createDataFrame([(1, "what is the tallest mountain of the whole wide world? it is mount everest in the himalaya range")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "pad " * 30 + "What is the tallest mountain of the whole wide world? It is Mount Everest, in the Himalaya range! " + "pad " * 30), (2, "what is the tallest mountain of the whole wide world? nobody knows"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, items).collect()] == [1]
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, items).collect()) == [2, 3]


def test_leaks_of_odd_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text here twice"), (None, "x"), (4, "same text here twice")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()), key=str) == [(4, 3), (4, 3), (4, 4), (4, 4), (5, 3), (5, 4), (8, None)]
    assert sorted(str(r.doc_id) for r in decontaminate.remove_leaks(odd, items).collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (4, 5, 8))
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.remove_leaks(odd, items).columns == odd.columns


TEXT = "Mail Ann.Lee@Mail.Example.com or ann.lee@mail.example.com, call +1 (017) 555-7713, card 4111 1111 1111 1111 and 4111111111111112, host 97.51.17.173 not 999.1.1.1, v1.2.3.4.5. SSN 123-45-6789, IBAN GB82 WEST 1234 5698 7654 32. Mrs. Ada Byron met Mr Ivan Byron; Ada Byron left. г-жа Анна Иванова."


KEY = b"sixteen bytes or more"


def test_surrogates(spark, odd, nothing):
    key = KEY
    df = spark.createDataFrame([(1, TEXT), (2, "again 97.51.17.173 and ANN.LEE@MAIL.EXAMPLE.COM"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.surrogate_texts(df, key).collect()}
    one = got[1].text
    assert (got[1].n_email, got[1].n_phone, got[1].n_card, got[1].n_ip, got[1].n_ssn, got[1].n_iban, got[1].n_name) == (2, 1, 1, 1, 1, 1, 4)
    for gone in ("ann.lee", "Ann.Lee", "555-7713", "4111 1111", "97.51.17.173", "123-45-6789", "WEST", "Ada Byron", "Ivan Byron", "Анна"):
        assert gone not in one
    assert "4111111111111112" in one and "999.1.1.1" in one and "v1.2.3.4.5" in one
    mails = re.findall(r"\S+@\S+\.com", one)
    assert mails[0] == mails[1] and got[2].text.split()[-1] == mails[0].upper()
    assert re.search(r"host (\S+) ", one)[1] == got[2].text.split()[1]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and pii.luhn(re.search(r"card (\d{4} \d{4} \d{4} \d{4}) ", one)[1].replace(" ", "")) and pii.iban_holds(re.search(r"IBAN (GB[\w ]+)\.", one)[1].replace(" ", ""))
    women = re.search(r"Mrs\. (\w+ \w+) met Mr (\w+ \w+); (\w+ \w+) left", one)
    assert women[1] == women[3] != women[2] and women[1].split()[0].endswith("a") and re.search(r"г-жа [А-Я][а-я]+а [А-Я]", one) or re.search(r"г-жа [А-Я][а-я]+(я|а) ", one)
    assert got[3].text is None and got[4].text == ""
    assert pii.surrogate_texts(odd, key).count() == odd.count() and pii.surrogate_texts(nothing, key).count() == 0
    assert [r.text for r in pii.surrogate_texts(df, key).orderBy("doc_id").collect()] == [got[k].text for k in (1, 2, 3, 4)]


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "drawn", lambda found, key: found.select("kind", "canonical", "attempt").withColumn("surrogate", F.concat(F.lit("s"), (F.hash("canonical", "attempt") % 40).cast("string"))))
    found = spark.createDataFrame([("ip", f"c{k}") for k in range(25)], "kind string, canonical string")
    rows = pii.assignment(found, b"k").collect()
    assert len(rows) == 25 and len({r.surrogate for r in rows}) == 25 and any(r.attempt for r in rows)


def test_names_are_compared_as_they_are_written(spark, monkeypatch):
    bare = F.substring("canonical", 3, 99)
    monkeypatch.setattr(pii, "drawn", lambda found, key: found.select("kind", "canonical", "attempt").withColumn("surrogate", F.concat(F.substring("canonical", 1, 2), F.when((bare == "A") & (F.col("attempt") == 0), "B").when(F.col("attempt") < 2, "Same").otherwise(F.concat(F.lit("New"), bare)))))
    found = spark.createDataFrame([("name", x) for x in ("m:A", "x:B", "f:C", "x:D")], "kind string, canonical string")
    rows = pii.assignment(found, b"k").collect()
    names = [r.surrogate[2:] for r in rows]
    assert len(rows) == 4 and len(set(names)) == 4 and not set(names) & set("ABCD")


def test_titles_of_other_documents_tell_the_gender(spark, monkeypatch):
    texts = ["Mr Smith", "Dr Smith", "Mrs Jones", "Prof Jones", "Dr Alone", "Mr Lee", "Mrs Lee", "Dr Lee", "Dr Kay and Mrs Kay", "Dr Kay"]
    df = spark.createDataFrame([(None if k == 1 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: re.sub(r"\b(Mrs?|Dr|Prof) ", "", r.text) for r in pii.surrogate_texts(df, KEY).collect()}
    assert got[0] == got[None] and got[2] == got[3] and got[8] == f"{got[9]} and {got[9]}"
    assert got[2].endswith("a") and got[9].endswith("a") and len({got[k] for k in (0, 2, 4, 5, 6, 7, 9)}) == 7
    monkeypatch.setattr(pii, "BROADCAST_REDRAWN", 0)
    assert got == {r.doc_id: re.sub(r"\b(Mrs?|Dr|Prof) ", "", r.text) for r in pii.surrogate_texts(df, KEY).collect()}


def test_surrogates_don_t_depend_on_the_document():
    assert pii.surrogate(b"k", "ip", "1.2.3.4") == pii.surrogate(b"k", "ip", "1.2.3.4") != pii.surrogate(b"j", "ip", "1.2.3.4")
    assert hashlib.sha256(pii.surrogate(b"k", "email", "a.b1@x.com").encode()).hexdigest() and re.fullmatch(r"[a-z]\.[a-z]\d@[a-z]\.com", pii.surrogate(b"k", "email", "a.b1@x.com"))


def test_names_without_a_title_and_last_names_alone(spark, monkeypatch):
    texts = [
        "Mrs Ada Byron wrote. Byron then left, and Mr Ivan Lee came; Lee stayed.", "Ada Byron without a title.", "Here Ivan Lee and Ada Byron meet; nobody names Green Field.", "Lee alone in another document stays.",
        "Mr John Smith met Mr Smith. Smith left.", "Mr Karl Ott and Mrs Ina Ott: Ott first, then Karl Ott and Ott again.", "Ada Byronic is another.", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.surrogate_texts(df, KEY).collect()}
    ada, byron, ivan, lee = re.fullmatch(r"Mrs (\w+ (\w+)) wrote. \2 then left, and Mr (\w+ (\w+)) came; \4 stayed.", got[0]).groups()
    assert got[1] == f"{ada} without a title." and got[2] == f"Here {ivan} and {ada} meet; nobody names Green Field."
    assert got[3] == texts[3] and got[6] == texts[6] and got[7] is None
    assert re.fullmatch(r"Mr \w+ (\w+) met Mr \1. \1 left.", got[4]) and "Smith" not in got[4]
    karl, ott = re.match(r"Mr (\w+ (\w+)) and", got[5]).groups()
    ina = re.search(r"Mrs \w+ (\w+):", got[5])[1]
    assert got[5].endswith(f": {ina} first, then {karl} and {ott} again.") and ott != ina
    monkeypatch.setattr(pii, "BROADCAST_REDRAWN", 0)
    assert got == {r.doc_id: r.text for r in pii.surrogate_texts(df, KEY).collect()}


def test_surrogates_of_a_corpus_are_distinct_and_corefer(spark, sample):
    """All mentions of the small tables against a plain map of entities to what stands in their place."""
    df = sample[0].unionByName(spark.createDataFrame([(10**6 + k, f"{chr(97 + k % 26)}@{chr(97 + k // 26)}.co from Dr {'AEIOU'[k % 5]}{'abc'[k % 3]}{'lmn'[k // 5 % 3]}", None, None, None) for k in range(676)], sample[0].schema))
    texts = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.text}
    new = {r.doc_id: r.text for r in pii.surrogate_texts(df, KEY).collect()}
    forms, mentions = {}, 0
    for doc_id, text in texts:
        at, out = 0, new[doc_id]
        for start, end, kind, canonical in pii.detect(text):
            between = text[at:start]
            assert out.startswith(between)
            out = out[len(between):]
            rest = text[end:][:1]
            written = re.match(r"[^\s,;]+(?: [A-Z]\w+)?" if kind == "name" and " " in canonical and not canonical.startswith("~") else r"\+?[\w@.+%()-]+(?:[ .-]\(?[\dA-Z]+\)?)*" if kind in ("phone", "card", "iban") else r"[\w@.+%-]+", out)[0]
            while rest and written.endswith(rest):
                written = written[: -len(rest)]
            if kind in ("email", "ip", "ssn"):
                forms.setdefault((kind, canonical), set()).add(written.lower().rstrip("."))
                mentions += 1
            out, at = out[len(written):], end
            nxt = text[end : end + 3]
            out = out[out.index(nxt):] if nxt and not out.startswith(nxt) and nxt in out else out
    assert mentions > 676 and all(len(x) == 1 for x in forms.values())
    made = [(k, next(iter(x))) for (k, _), x in forms.items()]
    assert len(set(made)) == len(made) and not set(made) & set(forms)


def test_exhausted_formats_end(spark, monkeypatch):
    monkeypatch.setattr(pii, "drawn", lambda found, key: found.select("kind", "canonical", "attempt").withColumn("surrogate", F.lit("the only one")))
    monkeypatch.setattr(pii, "MOST_DRAWS", 3)
    with pytest.raises(ValueError, match="ip"):
        pii.assignment(spark.createDataFrame([("ip", "a"), ("ip", "b")], "kind string, canonical string"), KEY)
    with pytest.raises(ValueError, match="key"):
        pii.surrogate_texts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), b"short")


def test_titles_are_no_names_and_names_have_many_forms():
    new = lambda text: pii.replaced(text, pii.detect(text), KEY, {})
    spans = lambda text: [text[a:b] for a, b, *_ in pii.detect(text)]
    assert spans("Herr Müller und Frau Dr. Schmidt. Dr Wong and Dr Lee.") == ["Müller", "Schmidt", "Wong", "Lee"]
    assert re.fullmatch(r"Herr \w+ und Frau Dr\. \w+\. Dr \w+ and Dr \w+\.", new("Herr Müller und Frau Dr. Schmidt. Dr Wong and Dr Lee."))
    assert spans("Mr. O'Brien met Mr JOHN SMITH and Mrs. Jean-Luc McDonald; John Smith left.") == ["O'Brien", "JOHN SMITH", "Jean-Luc McDonald", "John Smith"]
    one = new("Mr JOHN SMITH. John Smith.")
    assert one[3 : one.index(".")].isupper() and one[3 : one.index(".")].title() == one.split(". ")[1].rstrip(".")
    assert spans("Herr Prof. Dr. von der Leyen; Mr Jan van der Berg. Berg said") == ["von der Leyen", "Jan van der Berg", "Berg"]
    assert re.fullmatch(r"Mr (\w+) van der (\w+)\. \2 said", new("Mr Jan van der Berg. Berg said"))
    assert spans("Dr. Prof. is here. Frau Doktor. At 12:30:45 it was ::1 or 01.02.2024, 0:1 and 3:2") == ["Doktor"]


def test_every_form_of_each_type_is_found():
    """Generated mentions between words: what is found is what was put there."""
    r = random.Random(21)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    iban = lambda: next(x for n in range(2, 99) if pii.iban_holds(x := f"DE{n:02}{digits_of}")) if (digits_of := digits(18)) else ""
    card = lambda: next(x + c for c in "0123456789" if pii.luhn(x + c)) if (x := "4" + digits(14)) else ""
    first, last = ["Anna", "Jean-Luc", "José", "Иван", "Γιώργος"], ["Smith", "O'Brien", "McDonald", "Müller-Lüdenscheidt", "Петров", "Παπάς", "D’Angelo"]
    make = {
        "email": lambda: r.choice(["a.b", "x_1", "info+y"]) + "@" + r.choice(["exämple.com", "x-y.co.uk", "mail.example.org"]),
        "phone": lambda: r.choice(["+49 30 " + digits(3) + " " + digits(4), "0" + " ".join([digits(1), digits(2), digits(2), digits(2), digits(2)]), "030 " + digits(7), "0171/" + digits(7), "(212) 555-" + digits(4), "0" + digits(1) + "." + ".".join(digits(2) for _ in range(4))]),
        "card": lambda: (lambda c: r.choice([c, " ".join(c[k : k + 4] for k in range(0, 16, 4))]))(card()),
        "ip": lambda: r.choice([".".join(str(r.randint(1, 255)) for _ in range(4)), "2001:db8::" + digits(4), ":".join(digits(4) for _ in range(8)), "FE80::" + digits(2) + ":A"]),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: (lambda i: r.choice([i, i.lower(), " ".join(i[k : k + 4] for k in range(0, 22, 4))]))(iban()),
        "name": lambda: r.choice([r.choice(first) + " ", ""]) + r.choice(["", "van der ", "de "]) + r.choice(last),
    }
    titles = ["Mr ", "Mrs. ", "Herr ", "Frau Dr. ", "Herr Prof. Dr. ", "Monsieur ", "Dr "]
    seen = set()
    for _ in range(400):
        kind = r.choice(list(make))
        text, mention = "on 12.05.2024 at 10:15 they wrote 1,234.56 of ", make[kind]()
        before = text + (r.choice(titles) if kind == "name" else "")
        whole = before + mention + r.choice([".", ", and so on", " is it", "\n"])
        found = [(a, b, k) for a, b, k, _ in pii.detect(whole)]
        seen.add(kind)
        assert found == [(len(before), len(before) + len(mention), kind)], (whole, found)
    assert seen == set(make)


def test_scores_do_not_depend_on_how_items_are_dealt_into_indexes(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(words, k=r.randint(6, 40))) + ("? " + " ".join(r.choices(words, k=3)) if k % 3 == 0 else "")) for k in range(40)] + [(None, "null id item with some words"), (99, None), (98, "...")]
    docs = [(k, " ".join(r.choices(words, k=r.randint(0, 300))) + " " + (items[k % 40][1] if k % 2 else "") + " " + " ".join(r.choices(words, k=30))) for k in range(80)]
    run = lambda: sorted(tuple(x) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3)).collect())
    one = run()
    kept = set(x[0] for x in one)
    assert kept >= {k for k, _ in docs if k % 2}
    for chars in (0, 300):
        monkeypatch.setattr(decontaminate, "INDEX_CHARS", chars)
        assert run() == one
        left = decontaminate.remove_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        if chars:
            assert {x.doc_id for x in left.collect()} == {k for k, _ in docs} - kept
