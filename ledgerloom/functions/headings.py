"""Headings, units and pages of financial statements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.reports import let
from ledgerloom.functions.text import collapse, starts_with_any

# Fixed values.
STATEMENTS = {
    "income": (
        "consolidated income statement",
        "consolidated statement of income",
        "consolidated statements of income",
        "consolidated statements of operations",
        "consolidated statement of operations",
        "consolidated statement of profit or loss",
        "consolidated statement of profit and loss",
        "consolidated profit and loss account",
        "consolidated statement of comprehensive income",
    ),
    "balance": (
        "consolidated statement of financial position",
        "consolidated statements of financial position",
        "consolidated balance sheet",
        "consolidated balance sheets",
    ),
    "cashflow": (
        "consolidated statement of cash flows",
        "consolidated statements of cash flows",
        "consolidated cash flow statement",
        "consolidated cash flows statement",
    ),
}
UNITS = {
    "millions": r"(?iU)in\s+million|\(\s*million|€\s*million|\bmillions of\b",
    "thousands": r"(?iU)in\s+thousand|\(\s*thousand|€\s*thousand|\bthousands of\b",
    "billions": r"(?iU)in\s+billion|\(\s*billion",
}
DISCUSSION = (
    "analysis of", "classification in", "presentation in", "reconciliation of", "change in", "changes in",
    "summary of", "notes to", "note to",
)
TABLE_HINTS = (
    "year ended", "period ended", "as at", "as of", "(in million", "(in thousand", "(in € million",
    "in millions", "in thousands", "in euros",
)
PAGE_PHRASES = (
    "income statement", "statement of operations", "statement of profit", "profit and loss", "statement of comprehensive income",
    "balance sheet", "statement of financial position", "statement of cash flows", "cash flow statement",
)
PAGE_KINDS = {"income": ("income", "operations", "profit", "comprehensive"), "balance": ("balance", "financial position"), "cashflow": ("cash flow",)}
ROW_SIGNALS = {
    "income": ("revenue", "sales", "cost of", "gross profit", "operating", "net income", "profit for", "earnings per share"),
    "balance": ("cash and cash equivalents", "trade receivables", "goodwill", "intangible assets", "total assets", "total liabilities", "total equity", "retained earnings"),
    "cashflow": ("depreciation", "net cash", "cash flows from operating", "cash flows from investing", "cash flows from financing", "proceeds from", "purchases of"),
}
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "p", "span", "b", "strong", "div")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def named_kinds(text: Column) -> Column:
    """The kinds of which a heading occurs in ``text``, with blanks or, as old text layers have it, without: an array in the order of ``STATEMENTS``, null for null."""

    def of(x: Column) -> Column:
        found = [F.when(contains_any(x["low"], phrases) | contains_any(x["tight"], tuple(p.replace(" ", "") for p in phrases)), kind) for kind, phrases in STATEMENTS.items()]
        return F.when(x["low"].isNotNull(), F.filter(F.array(*found), lambda k: k.isNotNull()))

    return let(F.lower(collapse(text)), lambda low: let(F.struct(low.alias("low"), F.replace(low, F.lit(" "), F.lit("")).alias("tight")), of))


def match_statement(text: Column) -> Column:
    """The first of income, balance, cashflow with a heading in ``text``."""
    return F.get(named_kinds(text), F.lit(0))


def statement_kinds(text: Column) -> Column:
    """How many kinds are named: two or more make a table of contents."""
    return let(named_kinds(text), lambda kinds: F.when(kinds.isNotNull(), F.size(kinds)))


def detect_unit(text: Column) -> Column:
    found = F.lit("units")
    for unit, pattern in reversed(UNITS.items()):
        found = F.when(text.rlike(pattern), unit).otherwise(found)
    return found


def is_discussion(heading: Column) -> Column:
    """A heading that talks about a statement instead of being its title."""
    return starts_with_any(F.regexp_replace(F.lower(heading), r"(?U)^[\s/()\[\]⚫•.0-9]+", ""), DISCUSSION)


def heading_line(line: Column) -> Column:
    """The statement that a line is the title of: short, and nothing but numbering besides the title's words."""
    low = F.lower(collapse(line))
    kind = match_statement(line)
    fits = F.lit(False)
    for k, patterns in STATEMENTS.items():
        own = F.lit(None).cast("string")
        for p in reversed(patterns):
            at = F.instr(low, p)
            left = F.trim(F.concat(F.substring(low, F.lit(1), at - 1), F.substring(low, at + len(p), F.lit(1 << 20))))
            own = F.when(at > 0, left).otherwise(own)
        fits = F.when(kind == k, F.coalesce((F.length(own) <= 10) | ~own.rlike(r"\p{L}"), F.lit(False))).otherwise(fits)
    return F.when((F.length(low) > 0) & (F.length(low) <= 120) & fits, kind)


#: Lines of a page among which its title is, and those that tell a table of contents. Fixed values.
TITLE_LINES, CONTENTS_LINES = 12, 20


def first_heading_line(text: Column, lines: int = TITLE_LINES) -> Column:
    """The first such line's statement among the first ``lines``."""
    kinds = F.transform(F.slice(F.split(text, r"\r\n|\r|\n"), 1, lines), heading_line)
    return F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))


def has_table_hint(text: Column) -> Column:
    return contains_any(F.lower(F.substring(text, 1, 3000)), TABLE_HINTS)


def is_contents_page(text: Column) -> Column:
    return statement_kinds(F.array_join(F.slice(F.split(text, r"\r\n|\r|\n"), 1, CONTENTS_LINES), "\n")) >= 2


def page_kind(text: Column) -> Column:
    """The bucket of a page: only the first phrase that occurs counts."""
    low = F.lower(text)
    tight = F.replace(low, F.lit(" "), F.lit(""))
    found = F.lit(None).cast("string")
    for phrase in reversed(PAGE_PHRASES):
        kind = next(k for k, marks in PAGE_KINDS.items() if any(m in phrase for m in marks))
        found = F.when(low.contains(phrase) | tight.contains(phrase.replace(" ", "")), kind).otherwise(found)
    return found


def signal_hits(labels: Column, kind: str) -> Column:
    """How many of a statement's usual row labels occur in the joined, lower-case labels."""
    return sum((labels.contains(s).cast("int") for s in ROW_SIGNALS[kind]), F.lit(0))


def front_matter(text: Column, most: int = 2000) -> Column:
    return F.substring(collapse(text), 1, most)


def text_pages(text: Column, size: int = 8000) -> Column:
    """A text in pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def html_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " ")


# Screens that a browser has to fill: fixed values.
SHELL_MARKS = ("{{", "ng-app", "ng-controller", "data-reactroot", "__nuxt", "__next")


def is_script_shell(html: Column, pdf_links: Column, drilldowns: Column) -> Column:
    """A page without links whose first 50,000 characters have a client-side framework's marks."""
    return (pdf_links == 0) & (drilldowns == 0) & contains_any(F.substring(html, 1, 50_000), SHELL_MARKS)
