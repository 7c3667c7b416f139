"""Labels of statement lines, as column expressions. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONTROL = r"[\x00-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202f]"
FOOTNOTE = r"(?iU)(\s*\(?[0-9]{1,2}\)?|\s*\([a-z]\)|\s*\*+)\z"
FUZZY_PUNCTUATION = r"[,.;:'\u2019\u2018\u201c\u201d]"
TOTAL = (
    r"(?iU)^\s*(total|gross profit|gross margin|operating (income|profit|loss|margin)"
    r"|net (income|profit|loss|cash|revenue|revenues|sales)|income before|earnings before|profit before"
    r"|cash .*? (?:at|end of) (?:year|period|the period)|(?:net )?cash (?:provided by|used in))\b"
)
GRAND_TOTALS = (
    "gross profit", "operating profit", "operating income", "income from operations", "income before", "profit before",
    "net income", "net profit", "net loss", "profit for", "loss for", "profit attributable", "comprehensive income",
)
TOTAL_OF = r"(?isU)^total\s+(.+)$"
ZERO_WIDTH_SPACE = "\u200b"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean_label(label: Column) -> Column:
    """Control characters are deleted, white space collapsed, one trailing footnote marker cut off."""
    return strip(F.regexp_replace(collapse(F.regexp_replace(label, CONTROL, "")), FOOTNOTE, ""))


def fuzzy_key(label: Column) -> Column:
    """What labels of one concept have in common across reports."""
    again = strip(F.regexp_replace(F.lower(clean_label(label)), FOOTNOTE, ""))
    return F.regexp_replace(F.regexp_replace(again, FUZZY_PUNCTUATION, ""), r"(?U)\s+", " ")


def leading_indent(label: Column) -> Column:
    """Leading blanks count one, tabs four; zero-width spaces don't count."""
    lead = F.regexp_extract(F.replace(label, F.lit(ZERO_WIDTH_SPACE), F.lit("")), r"^[ \t]*", 0)
    return F.length(lead) + 3 * F.length(F.regexp_replace(lead, " ", ""))


def is_total(label: Column) -> Column:
    """Three or more letters, all upper case, or a phrase that totals begin with."""
    clean = clean_label(label)
    letters = F.regexp_replace(clean, r"\P{L}", "")
    return F.coalesce(((F.length(letters) >= 3) & letters.rlike(r"^\p{Lu}+$")) | clean.rlike(TOTAL), F.lit(False))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return text.rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def is_grand_total(name: Column) -> Column:
    return starts_with_any(F.lower(name), GRAND_TOTALS)


def section_label(total_name: Column) -> Column:
    """The section that a "Total X" line closes: X with a capital; null for other names."""
    rest = strip(F.regexp_extract(strip(total_name), TOTAL_OF, 1))
    return F.when(rest != "", F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30)))


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("company")).otherwise(slug)


def label_slug(label: Column) -> Column:
    """The part of a source label before its first colon; empty for null."""
    return F.coalesce(F.split_part(label, F.lit(":"), F.lit(1)), F.lit(""))


def repair_null_escapes(text: Column) -> Column:
    """NUL and two hexadecimal digits stand for a character of Latin-1; other NULs go. Null stays null."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?s)(\x00[0-9a-fA-F]{2}|.)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.when(F.length(p) == 3, F.chr(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).when(p == "\x00", "").otherwise(p)), "")
