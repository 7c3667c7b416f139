"""Kind and fiscal year of a report by its names, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first pattern that matches decides; a group is the fiscal year.
RULES = (
    ("annual", r"(?:^|[-_./])(\d{4})\d{4}x?20-?f"),
    ("annual", r"form[-_\s]*20-?f|form[-_\s]*10-?k"),
    ("annual", r"20-?f\b|10-?k\b"),
    ("annual", r"document\s+d['’‘]enregistrement\s+universel\s+(\d{4})"),
    ("annual", r"document\s+d['’‘]enregistrement\s+universel"),
    ("annual", r"[-_/\s](\d{4})[-_/\s]urd[-_/\s]?"),
    ("annual", r"universal[-_\s]+registration[-_\s]+document"),
    ("annual", r"[-_/\s]urd[-_/\s]"),
    ("annual", r"\burd\b"),
    ("annual", r"registration[-_\s]+document"),
    ("annual", r"annual[-_\s]+report[-_\s]+(\d{4})"),
    ("annual", r"(\d{4})[-_\s]+annual[-_\s]+report"),
    ("annual", r"annual[-_\s]+report"),
    ("annual", r"annual[-_\s]+financial[-_\s]+report"),
    ("annual", r"integrated[-_\s]+report"),
    ("annual", r"(annual[-_\s]+|consolidated[-_\s]+)?financial[-_\s]+statements"),
    ("annual", r"corporate[-_\s]+report"),
    ("interim", r"half[-_\s]?year[-_\s]?(?:report|financial)(?:[-_\s]?(\d{4}))?"),
    ("interim", r"interim[-_\s]?(?:financial|report)(?:[-_\s]?(\d{4}))?"),
    ("interim", r"h[12][-_\s]?(\d{4})"),
    ("quarterly", r"q[1-4][-_\s]?(\d{4})"),
    ("quarterly", r"(\d{4})[-_\s]?q[1-4]"),
    ("quarterly", r"quarterly[-_\s]?(?:report|statement)?"),
    ("sustainability", r"sustainab(?:le|ility)"),
    ("sustainability", r"\besg\b"),
    ("sustainability", r"environment(?:al)?[-_\s]+report"),
    ("sustainability", r"social[-_\s]+report"),
    ("sustainability", r"\bethical\b"),
    ("sustainability", r"climate"),
    ("sustainability", r"corporate[-_\s]+responsib(?:le|ility)"),
)
#: What a text must hold, one of them, for the rule of the same place to match: looked for before its pattern is tried.
NEEDS = (
    ("20f", "20-f"), ("form",), ("20f", "20-f", "10k", "10-k"), ("enregistrement",), ("enregistrement",), ("urd",), ("universal",), ("urd",), ("urd",), ("registration",), ("annual",), ("annual",), ("annual",), ("annual",), ("integrated",),
    ("statements",), ("corporate",), ("half",), ("interim",), ("h1", "h2"), ("q1", "q2", "q3", "q4"), ("q1", "q2", "q3", "q4"), ("quarterly",), ("sustainab",), ("esg",), ("environment",), ("social",), ("ethical",), ("climate",), ("corporate",),
)
YEAR = r"(?<!\d)(199\d|20[0-3]\d)(?!\d)"
WITH_YEAR, NO_YEAR, YEAR_ONLY, NOTHING = 0.95, 0.75, 0.3, 0.0
ESCALATE_BELOW = 0.5
NEAR = 80


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def haystack(source_url: Column, local_path: Column, link_text: Column) -> Column:
    """What the rules look at: names of URL and file, link text, URL; lower case."""
    return F.lower(F.concat_ws(" | ", basename(source_url), basename(local_path), F.coalesce(link_text, F.lit("")), source_url))


def latest_year(text: Column) -> Column:
    """The largest year from 1990 to 2030 without digits beside it."""
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(1990, 2030)))


def matched_rule(text: Column) -> Column:
    """The number of the first rule that matches, from 0."""

    def first(x: Column) -> Column:
        found = F.lit(None).cast("int")
        for k in reversed(range(len(RULES))):
            holds = F.lit(False)
            for need in NEEDS[k]:
                holds = holds | x["plain"].contains(need)
            found = F.when(holds & x["text"].rlike("(?iU)" + RULES[k][1]), k).otherwise(found)
        return found

    # The letters besides a-z and A-Z that patterns take for one of a-z in any case.
    return let(F.struct(text.alias("text"), F.lower(F.translate(text, "\u017f\u212a\u0131\u0130", "skii")).alias("plain")), first)


def rule_kind(rule: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(k) for k, _ in RULES]), rule), F.lit("other"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matched_text(text: Column, rule: Column) -> Column:
    """Struct of where the rule's match starts (from 0), its length, and its first group; null where no rule matches. Each rule's pattern is a constant, compiled once."""
    found = F.lit(None)
    for k, (_, rule_pattern) in reversed(list(enumerate(RULES))):
        pattern = F.lit(f"(?iU){rule_pattern}")
        group = F.regexp_extract(text, f"(?iU){rule_pattern}", 1) if r"(\d{4})" in rule_pattern else F.lit("")
        place = F.struct((F.regexp_instr(text, pattern) - 1).alias("start"), F.length(F.regexp_substr(text, pattern)).alias("length"), group.alias("group"))
        found = F.when(rule == k, place).otherwise(found)
    return found


def year_in(match: Column) -> Column:
    """The valid year in the matched rule's group."""
    year = F.nullif(match["group"], F.lit("")).try_cast("int")
    return F.when(year.between(1990, 2030), year)


def year_beside(text: Column, match: Column, nearest: bool) -> Column:
    """See ``near_year``."""
    start = match["start"]
    places = F.struct(start.alias("start"), (start + match["length"]).alias("end"), F.greatest(start - NEAR, F.lit(0)).alias("base"))

    def of_window(at: Column) -> Column:
        window = F.substring(text, at["base"] + 1, at["end"] + NEAR - at["base"])
        cut = F.struct(F.split(window, YEAR).alias("parts"), F.regexp_extract_all(window, F.lit(YEAR), F.lit(1)).alias("years"))

        def candidates(w: Column) -> Column:
            def candidate(year: Column, k: Column) -> Column:
                first = F.aggregate(F.slice(w["parts"], 1, k + 1), F.lit(0), lambda sum_, x: sum_ + F.length(x)) + 4 * k + (at["base"] if nearest else 0)
                return F.struct(F.abs(F.when(first + 4 <= at["start"], at["start"] - first - 4).otherwise(first - at["end"])).alias("distance"), year.cast("int").alias("year"))

            return F.array_min(F.filter(F.transform(w["years"], candidate), lambda c: c["year"].between(1990, 2030)))["year"]

        return let(cut, candidates)

    return F.when(match["length"] > 0, let(places, of_window))


def near_year(text: Column, rule: Column, *, nearest: bool = False) -> Column:
    """The valid year within 80 characters of the rule's match that is the least distance away, the smaller one on ties.

    By default the distance compares a year's place in the window around the match with the match's place in the whole text, so that in
    windows that don't begin at the text's start a year far to the right may win; ``nearest`` compares places in the whole text. The window
    is cut at its years: the lengths of the parts between them are their places.
    """
    return let(matched_text(text, rule), lambda m: year_beside(text, m, nearest))


def classify(text: Column, rule: Column, *, near: bool = True) -> Column:
    """Struct of kind, fiscal_year, confidence. The year is the one in the rule's match, else (``near``) one beside it, else the text's latest."""

    def of_rule(known: Column) -> Column:
        years = let(matched_text(text, known["rule"]), lambda m: F.coalesce(year_in(m), *([year_beside(text, m, False)] if near else []), latest_year(text)))

        def of_year(found: Column) -> Column:
            confidence = F.when(known["rule"].isNotNull(), F.when(found["year"].isNotNull(), WITH_YEAR).otherwise(NO_YEAR)).otherwise(F.when(found["year"].isNotNull(), YEAR_ONLY).otherwise(NOTHING))
            return F.struct(rule_kind(known["rule"]).alias("kind"), found["year"].alias("fiscal_year"), confidence.alias("confidence"))

        return let(F.struct(years.alias("year")), of_year)

    return let(F.struct(rule.alias("rule")), of_rule)


def needs_sniff(confidence: Column, fiscal_year: Column, local_path: Column) -> Column:
    return ((confidence < ESCALATE_BELOW) | fiscal_year.isNull()) & local_path.isNotNull()


def needs_model(confidence: Column) -> Column:
    return confidence < ESCALATE_BELOW
