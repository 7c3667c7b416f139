"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control for everything else.

Long tokens outside the patterns' spans are candidates. For each, an encoding (alphabet) is inferred, and two
questions are asked. Is it consistent with uniform draws from the alphabet? A chi-squared test of the symbol
counts, a runs test about the median symbol and a lag-1 serial correlation answer that, combined by Fisher's method. And how probable would it
be as written words, identifiers or numbers? There symbols repeat more, letters that are rare in writing are rare, and character classes
change less; the tails are combined by Fisher's method, too.

Both p-values are under false-discovery control, by length class: short tokens, of which most are words, don't lend their false discoveries
to long ones. Benjamini-Hochberg over the first p-values of all candidates of a class decides which aren't random (at ``DRAWN_RATE``, so that few random ones are
lost). In the second family all candidates count again, those that aren't random with a p-value of 1; what is rejected there, at ``rate``,
is neither written nor other than random: a secret. Candidates without an alphabet aren't tested. Only the two histograms of p-values, of bounded size, come to the driver.

Edge cases: a null or empty text has no spans; a text of any length is scanned whole; rows that repeat are scanned
each; an empty table gives an empty result; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, table, whole_text

# The patterns of the contract and the order of kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

SHORTEST = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: From the smallest alphabet. Letters in one case, but for a first capital, and digits alone have alphabets of their own.
ENCODINGS = (
    ("digits", re.compile(r"[0-9]+"), 10, "0123456789"),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, "0123456789abcdef"),
    ("letters", re.compile(r"[A-Za-z][a-z]*|[A-Z]+"), 26, "abcdefghijklmnopqrstuvwxyz"),
    ("base32", re.compile(r"[A-Z2-7]+"), 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36, "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 62, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+"), 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+"), 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FOLDED = ("hex", "letters", "base36")
#: Written words: chance that two symbols agree, that three agree, and that neighbours differ in class. Written numbers: the first two.
AGREE_2, AGREE_3, CLASS_CHANGE = 0.065, 0.0055, 0.15
NUMBERS_AGREE_2, NUMBERS_AGREE_3 = 0.22, 0.052
#: About how often, in per mille, European languages in Latin script write each letter.
WRITTEN = dict(zip("abcdefghijklmnopqrstuvwxyz", (83, 14, 33, 42, 145, 14, 17, 27, 75, 4, 9, 45, 27, 78, 65, 24, 4, 68, 72, 72, 36, 12, 9, 3, 9, 6), strict=True))
BITS = {c: -math.log2(n / sum(WRITTEN.values())) for c, n in WRITTEN.items()}
MEAN_BITS = sum(n * BITS[c] for c, n in WRITTEN.items()) / sum(WRITTEN.values())
#: Letters of one token are not independent, and languages differ: the variance counts so many times.
OVERDISPERSED = 2
BITS_VARIANCE = OVERDISPERSED * sum(n * (BITS[c] - MEAN_BITS) ** 2 for c, n in WRITTEN.items()) / sum(WRITTEN.values())
#: Bins of -log10 p, and their width.
BINS, BIN = 400, 0.05
#: Share of random tokens among those that are taken to be not random.
DRAWN_RATE = 0.01

SCAN_SCHEMA = "doc_id long, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,length_class:int,bin:int,drawn:int>>"
Base = list[tuple[int, int, int]]
Candidates = list[tuple[int, int, int, int, int]]


def above(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(values: list[int], size: int) -> float:
    """Upper tail of the chi-squared statistic against uniform counts; gamma-matched, so that short strings are not misjudged."""
    n = len(values)
    x = size / n * sum(c * c for c in Counter(values).values()) - n
    mean, variance = size - 1, max(1e-9, 2 * (size - 1) * (n - 1) / n)
    df = 2 * mean * mean / variance
    return above(((max(x, 1e-9) / mean) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def runs_p(values: list[int]) -> float:
    """Two-sided runs test about the median."""
    median = sorted(values)[len(values) // 2]
    high = [v >= median for v in values]
    a = sum(high)
    b, n = len(high) - a, len(high)
    if not a or not b:
        return 0.0
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    variance = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    return 2 * above(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(variance))


def serial_p(values: list[int]) -> float:
    """Two-sided lag-1 serial correlation."""
    n = len(values)
    mean = sum(values) / n
    d = [v - mean for v in values]
    power = sum(x * x for x in d)
    if not power:
        return 0.0
    r = sum(x * y for x, y in zip(d, d[1:], strict=False)) / power
    return 2 * above(abs(r + 1 / n) * math.sqrt(n))


def fisher(ps: list[float]) -> float:
    """Fisher's combination; the chi-squared tail with an even number of degrees has a closed form."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def binomial_at_least(k: int, n: int, p: float) -> float:
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, n + 1))) if n <= 400 else above((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))


def infer_encoding(token: str) -> tuple[str, int, str] | None:
    """Name, alphabet size and alphabet, or None."""
    return next(((name, size, letters) for name, pattern, size, letters in ENCODINGS if pattern.fullmatch(token)), None)


def few_repeats_p(token: str, agree_2: float, agree_3: float) -> float:
    """How probable so few equal pairs of symbols are in writing."""
    n = len(token)
    equal = sum(c * (c - 1) // 2 for c in Counter(token).values())
    mean = n * (n - 1) / 2 * agree_2
    variance = mean * (1 - agree_2) + n * (n - 1) * (n - 2) * (agree_3 - agree_2**2)
    return above((mean - equal - 0.5) / math.sqrt(variance))


def rare_letters_p(token: str) -> float:
    """How probable letters as rare as the token's are in writing; 1 with few letters."""
    bits = [BITS[c] for c in token if c in BITS]
    return above((sum(bits) - len(bits) * MEAN_BITS) / math.sqrt(len(bits) * BITS_VARIANCE)) if len(bits) >= SHORTEST // 2 else 1.0


def battery(token: str) -> tuple[float, float] | None:
    """The p-values of ``token`` as writing and as random symbols, or None if it has no encoding."""
    token = token.rstrip("=")
    encoding = infer_encoding(token)
    if not encoding:
        return None
    name, size, letters = encoding
    values = [letters.index(c) for c in (token.lower() if name in FOLDED else token)]
    return as_writing(token, name), fisher([chi_squared_p(values, size), runs_p(values), serial_p(values)])


def as_writing(token: str, name: str) -> float:
    """How probable a token of this encoding is as words, identifiers or numbers."""
    folded = token.lower()
    if name == "digits":
        return few_repeats_p(token, NUMBERS_AGREE_2, NUMBERS_AGREE_3)
    # Both look at how often which symbol occurs: they count as one test.
    symbols = min(1.0, 2 * min(few_repeats_p(folded, AGREE_2, AGREE_3), rare_letters_p(folded)))
    if name == "letters":
        return symbols
    # Separators stand between words: they don't count as a class.
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 for c in token if c.isalnum()]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    return fisher([symbols, binomial_at_least(changes, max(1, len(classes) - 1), CLASS_CHANGE)])


def binned(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN))


def find(text: str) -> tuple[Base, Candidates]:
    """Base spans by start and kind, and candidates outside them with their length class and the bins of both p-values."""
    base: Base = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    candidates: Candidates = []
    if max(map(len, text.split()), default=0) >= SHORTEST:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        taken = bytearray(len(text) if base else 0)
        for s, _, e in base:
            taken[s:e] = b"\1" * (e - s)
        for m in CANDIDATE.finditer(text):
            if taken.find(1, *m.span()) < 0 and (ps := battery(m[0])) is not None:
                candidates.append((m.start(), m.end(), min(12, int(2 * math.log2(len(m[0]) / SHORTEST))), *map(binned, ps)))
    return sorted(base), candidates


def scan(docs: DataFrame) -> DataFrame:
    """``SCAN_SCHEMA`` for each row of ``docs``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32 = pa.int32()
        base_type = pa.list_(pa.struct([("start", i32), ("kind", i32), ("end", i32)]))
        candidate_type = pa.list_(pa.struct([("start", i32), ("end", i32), ("length_class", i32), ("bin", i32), ("drawn", i32)]))
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in found], base_type), pa.array([c for _, c in found], candidate_type)], names=["doc_id", "base", "candidates"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), run, SCAN_SCHEMA)


Cuts = dict[int, int]


def rejected(counts: dict[int, int], rate: float) -> int:
    """The smallest bin that Benjamini-Hochberg rejects at ``rate``, each p-value taken as the largest of its bin; ``BINS`` if none is."""
    total, so_far, cut = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        so_far += counts[b]
        if 10 ** (-b * BIN) <= rate * so_far / total:
            cut = b
    return cut


def cuts_of(binned_: DataFrame, rate: float) -> Cuts:
    """For each length class the smallest bin that is rejected. ``binned_``: length_class, bin; at most 13 x BINS counts come to the driver."""
    counts: dict[int, dict[int, int]] = {}
    for r in binned_.groupBy("length_class", "bin").count().collect():
        counts.setdefault(r.length_class, {})[r.bin] = r["count"]
    return {k: rejected(own, rate) for k, own in counts.items()}


def at_least(bin_: Column, length_class: Column, cuts: Cuts) -> Column:
    """Whether a bin is rejected in its length class."""
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), length_class) if cuts else F.lit(None).cast("int")
    return bin_ >= F.coalesce(cut, F.lit(BINS))


def discoveries(scanned: DataFrame, rate: float = 0.01) -> tuple[Cuts, Cuts]:
    """For each length class the smallest bins that count: of p-values as random symbols (not random), and as writing (not written)."""
    tested = scanned.select(F.explode("candidates").alias("c")).select("c.length_class", "c.bin", "c.drawn")
    drawn = cuts_of(tested.select("length_class", F.col("drawn").alias("bin")), DRAWN_RATE)
    return drawn, cuts_of(tested.select("length_class", F.when(at_least(F.col("drawn"), F.col("length_class"), drawn), 0).otherwise(F.col("bin")).alias("bin")), rate)


def is_secret(cuts: tuple[Cuts, Cuts], length_class: int, bin_: int, drawn: int) -> bool:
    return drawn < cuts[0].get(length_class, BINS) and bin_ >= cuts[1].get(length_class, BINS)


def chosen(cuts: tuple[Cuts, Cuts]) -> Column:
    """The candidates that ``cuts`` accept."""
    return F.filter("candidates", lambda c: ~at_least(c["drawn"], c["length_class"], cuts[0]) & at_least(c["bin"], c["length_class"], cuts[1]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, kind, end) in code points, ends exclusive, by start and kind; ``kind`` indexes ``KINDS``."""
    scanned = saved(scan(docs), "secret-scan")
    found = F.transform(chosen(discoveries(scanned, rate)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", found)).alias("spans"))


def redact(docs: DataFrame, rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of all kinds replaced in ``text``; other columns stay.

    The corpus is scanned once for the cuts and once to replace: nothing but the histogram is shuffled.
    """
    cuts = discoveries(saved(scan(docs).where("size(candidates) > 0"), "secret-candidates"), rate)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            texts = []
            for text in (t.as_py() for t in batch.column(column)):
                if text:
                    base, candidates = find(text)
                    spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, *tested in candidates if is_secret(cuts, *tested)])
                    merged: list[list[int]] = []
                    for s, e in spans:
                        if merged and s < merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                    at, parts = 0, []
                    for s, e in merged:
                        parts += [text[at:s], mark]
                        at = e
                    text = "".join(parts) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(column).type) if k == column else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_batches(docs, clean, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
