"""License scans against a plain search: every run of words, and edits counted by the textbook recurrence."""

import random
import re

import pytest

from ledgerloom.llm import license_scan, queries
from ledgerloom.llm.license_scan import BASE, NOTICES, Scanner, edits_allowed, pieces, scan_text


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_occurrences(words):
    """(notice, first word, number of words): edits, for all runs."""
    found = {}
    for k, (_, phrase, rest) in enumerate(NOTICES):
        e, tail = edits_allowed(phrase), rest.split()
        for i in range(len(words)):
            for n in range(1, len(words) - i + 1):
                run = " ".join(words[i : i + n])
                if len(run) > len(phrase) + e:
                    break
                if len(run) >= len(phrase) - e and words[i + n : i + n + len(tail)] == tail and (d := edits_between(run, phrase)) <= e:
                    found[k, i, n + len(tail)] = d
    return found


def plain_base(words):
    found = []
    for phrase, label in BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(found)


def spoilt(r, text, n):
    for _ in range(n):
        at = r.choice([0, 0, len(text) - 1, *range(len(text))])
        text = r.choice([text[:at] + text[at + 1 :], text[:at] + r.choice("aeiou lnrs") + text[at:], text[:at] + r.choice("aeiou lnrs") + text[at + 1 :]])
    return text


def written(r, notice):
    """A notice as a document may hold it: any case, any separators."""
    words = [r.choice([w, w.upper(), w.capitalize()]) for w in notice.split()]
    return "".join(w + r.choice([" ", ", ", "\n", " - ", ".  "]) for w in words)


def spoilt_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            _, phrase, rest = r.choice(NOTICES)
            parts.append(r.choice(["Ein schöner Tag. ", "over the hills ", "", "the ", "license version 2 3 "]))
            parts.append(written(r, spoilt(r, f"{phrase} {rest}", r.choice([0, 0, 1, 2, 3, 4, 5]))))
            if r.random() < 0.3:
                parts.append(written(r, r.choice(BASE)[0]))
        yield "".join(parts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_occurrence_is_found(scanner, seed):
    hits = 0
    for text in spoilt_texts(seed, 60):
        words = plain_words(text)
        n, base, spans, score = scan_text(text, scanner)
        want = plain_occurrences(words)
        assert n == len(words) and [(b["first_word"], b["label"]) for b in base] == plain_base(words)
        best = {}
        for (k, *_), d in want.items():
            best[scanner.whole[k]] = min(d, best.get(scanner.whole[k], 99))
        got = {}
        for s in spans:
            k = scanner.whole.index(s["notice"])
            assert want[k, s["first_word"], s["n_words"]] == s["edits"] and s["label"] == NOTICES[k][0]
            assert plain_words(text[s["start"] : s["end"]]) == words[s["first_word"] : s["first_word"] + s["n_words"]]
            got[s["notice"]] = min(s["edits"], got.get(s["notice"], 99))
            assert not any(o is not s and o["notice"] == s["notice"] and o["start"] < s["end"] and s["start"] < o["end"] for o in spans)
        assert got == best, text
        assert score == (max([1.0 * bool(base), *(1 - d / len(w) for w, d in best.items())]))
        hits += len(spans)
    assert hits > 60


def test_pieces_are_whole_and_one_survives_the_edits():
    r = random.Random(5)
    for _, phrase, _ in NOTICES:
        e = edits_allowed(phrase)
        parts = pieces(phrase, e)
        assert "".join(p for _, p in parts) == phrase and len(parts) == e + 1
        for _ in range(50):
            changed = spoilt(r, phrase, e)
            assert any(p in changed for _, p in parts)


def test_notices_that_resemble_each_other_stay_apart(scanner):
    labels = lambda text: {s["label"] for s in scan_text(text, scanner)[2]}
    assert labels("Licensed under the Apache Licence, Version 2.0") == {"apache-2"} and labels("Licensed under the Apache License, Version 1.1") == set()
    assert labels("the GNU General Public License, version 3.") == {"gpl-3"} and labels("the GNU Lesser General Public License version 3") == {"lgpl-3"}
    assert labels("Licensed under CC BY-SA 4.0") == {"cc-by-sa"} and labels("released under the ISC license") == set() and labels("mall rights reserved") == {"all-rights-reserved"}
    assert labels("The river and the stone were reserved for all. " * 50) == set()


def test_query_on_odd_rows(spark, tmp_path):
    long = "word " * 300_000 + "Licensed under the Apache Licence, Version 2.0. " + "ünder " * 1000 + "cc-by-nc"
    texts = [None, "", " \n", "x", long, "Released under the MIT License. " * 3000, "Ä under the mit license Ä", "All rihts reserved", "All rihts reserved"]
    rows = [(k, t, 7, "s") for k, t in enumerate(texts)] + [(None, "cc by nc", 1, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_license_scan"](spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    none = (0, None, None, "", "", 0.0)
    assert got[0] == got[1] == got[2] == (0, *none[:]) and got[3] == (1, *none)
    assert got[4] == (300_000 + 8 + 1000 + 3, 1, 301_008, 301_008, "cc-by-nc", "apache-2,cc-by-nc", 1.0)
    assert got[5] == (15_000, 3000, 1, 14_996, "mit", "mit", 1.0) and got[6] == (6, 1, 1, 1, "mit", "mit", 1.0)
    assert got[7] == got[8] == (3, 0, None, None, "", "all-rights-reserved", 1 - 1 / 19) and got[None][:6] == (3, 1, 0, 0, "cc-by-nc", "cc-by-nc")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_spans(empty).count() == 0


def test_whole_table_against_plain_words(spark, sample, scanner):
    df, rows = sample
    got = {r.doc_id: r for r in license_scan.license_spans(df).collect()}
    assert len(got) == len(rows)
    for row in rows:
        words = plain_words(row.text)
        assert got[row.doc_id].n_words == len(words) and [(b.first_word, b.label) for b in got[row.doc_id].base] == plain_base(words)
