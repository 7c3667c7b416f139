"""License scans: short notices found with a bounded number of edits.

Texts are read as words: ASCII letters in lower case, digits and all characters beyond ASCII; words are joined by single spaces.
A notice is a phrase that may be misspelt, and behind it words that must stand as they are (versions, and short names that
one edit would turn into each other). A run of whole words is an occurrence if it is the phrase with at most e edits (insertions, deletions and
substitutions of characters; e grows with the phrase) followed by those words.

The phrase is cut into e + 1 pieces: an edit spoils one piece at most, so that every occurrence holds one of them unchanged. One
automaton finds the pieces of all notices in one pass. Each piece found names the window in which its occurrence must
lie, and the regex library's bounded-error matching looks for the best one there. A piece without an occurrence around it has no
effect; no occurrence is missed. Of overlapping occurrences of a notice those with the fewest edits stay, of equal ones the first.

Three base phrases are counted wherever their words stand one behind the other; their labels stay.

Edge cases: a null or empty text has no words; texts of any length are scanned whole, window by window; rows that repeat are scanned each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, table, whole_text, worker_object

# The base phrases and labels of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, phrase, and what follows it without an edit.
NOTICES = (
    ("mit", "released under the", "mit license"),
    ("mit", "licensed under the terms of the", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ""),
    ("apache-2", "licensed under the apache license version", "2"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license", "2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ""),
    ("bsd", "licensed under the", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("gpl-2", "the gnu general public license version", "2"),
    ("gpl-3", "the gnu general public license version", "3"),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version", "2"),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version", "3"),
    ("lgpl-2.1", "the gnu lesser general public license version", "2 1"),
    ("lgpl-3", "the gnu lesser general public license version", "3"),
    ("agpl-3", "the gnu affero general public license version", "3"),
    ("mpl-2", "subject to the terms of the mozilla public license", "v 2 0"),
    ("mpl-2", "the mozilla public license version", "2 0"),
    ("epl-2", "the eclipse public license version", "2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("cc0", "dedicated to the public domain under creative commons zero", ""),
    ("cc-by", "licensed under a creative commons attribution", "4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", ""),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike", ""),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives", ""),
    ("cc-by-nc", "licensed under cc by", "nc"),
    ("cc-by-sa", "licensed under cc by", "sa"),
    ("cc-by-nd", "licensed under cc by", "nd"),
    ("cc-by", "licensed under cc by", "4 0"),
    ("all-rights-reserved", "all rights reserved", ""),
)
#: Characters of a phrase for each edit, and edits at most.
CHARS_AN_EDIT, MOST_EDITS = 12, 4

#: Every ASCII byte that is no letter or digit becomes a space, capitals become small; bytes of other characters stay.
TO_WORDS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = "struct<label:string,notice:string,start:int,end:int,first_word:int,n_words:int,edits:int>"
SCAN_SCHEMA = f"doc_id long, n_words long, base array<struct<label:string,first_word:int>>, spans array<{SPAN}>, score double"


def edits_allowed(phrase: str) -> int:
    return min(MOST_EDITS, len(phrase) // CHARS_AN_EDIT)


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of about equal length and where they begin."""
    cuts = [len(phrase) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in itertools.pairwise(cuts)]


class Scanner:
    """The notices' pieces in an automaton, and a pattern for each notice."""

    def __init__(self, notices: tuple[tuple[str, str, str], ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        self.edits = [edits_allowed(phrase) for _, phrase, _ in notices]
        self.whole = [f"{phrase} {rest}".strip() for _, phrase, rest in notices]
        ends = [regex.escape(whole[len(phrase) :], literal_spaces=True) for whole, (_, phrase, _) in zip(self.whole, notices, strict=True)]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={e}}}{end}(?![^ ])") for (_, phrase, _), e, end in zip(notices, self.edits, ends, strict=True)]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for k, (_, phrase, _) in enumerate(notices):
            for at, piece in pieces(phrase, self.edits[k]):
                wanted.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in wanted.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.best = functools.lru_cache(1 << 14)(self.match)

    def match(self, k: int, window: str) -> tuple[int, int] | None:
        """End and edits of the best occurrence of a notice in whole words from the begin of ``window``."""
        found = self.patterns[k].match(window)
        return (found.end(), sum(found.fuzzy_counts)) if found else None

    def occurrences(self, words: str) -> list[tuple[int, int, int, int]]:
        """Begin, end, notice and edits of the occurrences in ``words``, by begin and notice."""
        found, tried = set(), set()
        for last, (length, places) in self.automaton.iter(words):
            for k, at in places:
                e = self.edits[k]
                middle = last + 1 - length - at  # an occurrence begins at most e characters from here
                hi = middle + 2 * e + len(self.whole[k])
                if hi < len(words) and words[hi] != " ":  # to the last word that ends before
                    hi = words.rfind(" ", 0, hi)
                begin = max(0, middle - e)
                if begin and words[begin - 1] != " ":
                    begin = words.find(" ", begin, hi) + 1 or hi
                while begin <= middle + e and begin < hi:
                    if (k, begin, hi) not in tried:
                        tried.add((k, begin, hi))
                        if best := self.best(k, words[begin:hi]):
                            found.add((best[1], begin, begin + best[0], k))
                    begin = words.find(" ", begin, hi) + 1 or hi
        chosen: list[tuple[int, int, int, int]] = []
        for _, group in itertools.groupby(sorted(found, key=lambda f: (f[3], f[1])), key=lambda f: f[3]):
            run: list[tuple[int, int, int, int]] = []
            run_end = 0
            for f in group:
                if f[1] >= run_end:
                    chosen += settle(run)
                    run = []
                run.append(f)
                run_end = max(run_end, f[2])
            chosen += settle(run)
        return sorted((begin, end, k, edits) for edits, begin, end, k in chosen)


def settle(run: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of a run of overlapping occurrences of a notice the best ones that don't overlap."""
    kept: list[tuple[int, int, int, int]] = []
    for f in sorted(run):
        if all(f[2] <= begin or end <= f[1] for _, begin, end, _ in kept):
            kept.append(f)
    return kept


def normalized(text: str) -> tuple[str, int]:
    """The words of ``text`` joined by single spaces, and how many they are."""
    words = text.encode().translate(TO_WORDS).split()
    return b" ".join(words).decode(), len(words)


def places_of(words: str, phrase: str) -> list[int]:
    """Where ``phrase`` begins in ``words``, at word bounds."""
    found, at = [], words.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (not at or words[at - 1] == " ") and (end == len(words) or words[end] == " "):
            found.append(at)
        at = words.find(phrase, at + 1)
    return found


def word_numbers(words: str, places: list[int]) -> dict[int, int]:
    """The number of the word that begins, or ends, at each place."""
    out, last, n = {}, 0, 0
    for p in sorted(set(places)):
        n += words.count(" ", last, p)
        out[p], last = n, p
    return out


def characters(text: str, numbers: set[int]) -> dict[int, tuple[int, int]]:
    """Begin and end of some words in ``text``, by number."""
    out, most = {}, max(numbers)
    for n, m in enumerate(WORD.finditer(text)):
        if n in numbers:
            out[n] = m.span()
        if n == most:
            break
    return out


def scan_text(text: str, scanner: Scanner) -> tuple[int, list[dict], list[dict], float]:
    """Number of words, base places, spans of notices, and the score: 1 for a base phrase or an unchanged notice, less for edits, 0 without any."""
    words, n = normalized(text)
    base = [(at, label) for phrase, label in BASE if phrase in words for at in places_of(words, phrase)]
    found = scanner.occurrences(words)
    if not base and not found:
        return n, [], [], 0.0
    number = word_numbers(words, [at for at, _ in base] + [x for begin, end, _, _ in found for x in (begin, end)])
    at = characters(text, {x for begin, end, _, _ in found for x in (number[begin], number[end])}) if found else {}
    spans = [
        {"label": scanner.notices[k][0], "notice": scanner.whole[k], "start": at[number[begin]][0], "end": at[number[end]][1], "first_word": number[begin], "n_words": number[end] - number[begin] + 1, "edits": edits}
        for begin, end, k, edits in found
    ]
    score = max([1.0 * bool(base), *(1 - edits / len(scanner.whole[k]) for _, _, k, edits in found)])
    return n, [{"label": label, "first_word": number[p]} for p, label in sorted(base)], spans, score


def license_spans(docs: DataFrame, notices: tuple[tuple[str, str, str], ...] = NOTICES) -> DataFrame:
    """``SCAN_SCHEMA`` for each row of ``docs``: places in words (from 0) and, for notices, in code points, ends exclusive. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_object(("licenses", notices), lambda: Scanner(notices))
        base = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), *[(c, pa.int32()) for c in ("start", "end", "first_word", "n_words", "edits")]]))
        for batch in batches:
            columns = [list(c) for c in zip(*(scan_text(t.as_py(), scanner) for t in batch.column(1)), strict=True)] or [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), base, span, pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "base", "spans", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), run, SCAN_SCHEMA, keeps="licenses")


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(table(spark, sf_dir, "documents"))
    base, words = F.col("base.label"), F.col("base.first_word")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).cast("long").alias("first_word"), F.array_max(words).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("spans.label"))).alias("labels"), "score",
    )
