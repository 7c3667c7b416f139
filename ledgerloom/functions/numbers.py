"""Printed numbers, market figures and their display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.reports import let
from ledgerloom.functions.text import strip

DECIMAL = "decimal(30,4)"
# What cells print for a missing number; rates to the euro (illustrative); currency signs.
BLANK = ("", "-", "—", "–", "n/a", "na", "nm", "*")
BLANK_PLAIN = ("", "-", "—", "–", "n/a", "NA")
BLANK_VISION = ("", "-", "—", "–", "n/a", "NA", "nm", "*")
TO_EUR = {"EUR": 1.0, "USD": 0.92, "GBP": 1.17, "CHF": 1.04, "CAD": 0.67}
GLYPHS = {"EUR": "€", "USD": "$", "GBP": "£", "CHF": "CHF "}
DASH = "—"


def _signed(text: Column, negative: Column) -> Column:
    """A decimal of digits that Spark reads; what isn't a number is null. Underscores between digits are not accepted."""
    return let(text.try_cast(DECIMAL), lambda value: F.when(negative, -value).otherwise(value))


def parse_number(raw: Column) -> Column:
    """Statement cells: parentheses are negative; dashes, n/a and nm are missing; footnote letters, separators and currency signs are dropped.

    Each step is computed once, and plain digits, which most cells are, need none of them.
    """

    def of_text(s: Column) -> Column:
        missing = F.lower(s).isin(*BLANK) | s.rlike("^[–—]+$")
        return F.when(missing, None).otherwise(let(strip(F.regexp_replace(s, r"(?iU)\s*\(?[a-z*]\)?\z", "")), of_noted))

    def of_noted(noted: Column) -> Column:
        return let(F.struct(noted.alias("text"), noted.rlike(r"^\(.+\)\z").alias("negative")), of_signed)

    def of_signed(x: Column) -> Column:
        inner = F.when(x["negative"], strip(F.regexp_extract(x["text"], r"^\((.+)\)\z", 1))).otherwise(x["text"])
        digits = F.regexp_replace(F.regexp_replace(inner, r"[, \u00a0\u2009]", ""), "^[€$£¥]+", "")
        return let(digits, lambda d: F.when(~d.isin("", "-"), _signed(d, x["negative"])))

    return F.when(raw.rlike(r"\A[0-9,]+\z"), F.replace(raw, F.lit(",")).try_cast(DECIMAL)).otherwise(let(strip(raw), of_text))


def _in_parentheses(s: Column) -> tuple[Column, Column]:
    negative = s.startswith("(") & s.endswith(")")
    return negative, F.when(negative, F.substring(s, 2, 1 << 30)).otherwise(s)


def parse_number_plain(raw: Column) -> Column:
    """Values as a text model gives them: no footnotes or currency signs are dropped."""
    s = strip(raw)
    negative, inner = _in_parentheses(s)
    digits = F.regexp_replace(F.when(negative, F.regexp_replace(inner, r"\)\z", "")).otherwise(inner), r"[, \u00a0]", "")
    return F.when(~s.isin(*BLANK_PLAIN), _signed(digits, negative))


def parse_number_vision(raw: Column) -> Column:
    """Values as a vision model gives them: currency signs go anywhere, blanks inside stay (and make the value null)."""
    s = strip(raw)
    negative, inner = _in_parentheses(s)
    digits = strip(F.regexp_replace(F.when(negative, F.regexp_replace(inner, r"\)\z", "")).otherwise(inner), r"[,\u00a0\u2009$€£¥]", ""))
    return F.when(~s.isin(*BLANK_VISION) & ~digits.rlike(r"\s"), _signed(digits, negative))


def market_cap(price: Column, shares_m: Column) -> Column:
    """Price times shares (in millions); null without a price or with no shares. Prices in pence are taken as they are."""
    return price * F.nullif(shares_m, F.lit(0.0)) * 1e6


def change_pct(price: Column, previous: Column) -> Column:
    return F.try_divide(price - previous, F.nullif(previous, F.lit(0.0))) * 100


def _lookup(code: Column, values: dict, default: object) -> Column:
    found = F.lit(default)
    for key, value in values.items():
        found = F.when(code == key, F.lit(value)).otherwise(found)
    return found


def fx_rate(source: Column, target: str | Column) -> Column:
    """Units of ``target`` for one of ``source``; an unknown source counts as the euro."""
    to = F.lit(target) if isinstance(target, str) else target
    return F.when(F.upper(source) == to, 1.0).otherwise(_lookup(F.upper(source), TO_EUR, 1.0) / _lookup(to, TO_EUR, None))


def convert(amount: Column, source: Column, target: str | Column) -> Column:
    return amount * fx_rate(source, target)


def display_currency(reported: Column) -> Column:
    """The reported currency where rates know it, else the euro."""
    return F.when(F.upper(reported).isin(*TO_EUR), F.upper(reported)).otherwise("EUR")


def glyph(currency: Column) -> Column:
    return _lookup(F.upper(currency), GLYPHS, "")


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def format_price(price: Column, currency: Column) -> Column:
    return F.when(price.isNull(), DASH).otherwise(F.concat(glyph(currency), F.format_number(price, 2)))


def format_market_cap(cap: Column, currency: Column) -> Column:
    """Trillions with two decimals, billions with one, millions and less with none."""
    text = F.when(cap >= 1e12, F.concat(_fixed(cap / 1e12, 2), F.lit("T"))).when(cap >= 1e9, F.concat(_fixed(cap / 1e9, 1), F.lit("B")))
    text = text.when(cap >= 1e6, F.concat(_fixed(cap / 1e6, 0), F.lit("M"))).otherwise(_fixed(cap, 0))
    return F.when(cap.isNull(), DASH).otherwise(F.concat(glyph(currency), text))


def split_market_cap(cap: Column) -> Column:
    """number, decimals and suffix of the short form."""
    part = lambda by, digits, suffix: F.struct((cap / by).alias("number"), F.lit(digits).alias("decimals"), F.lit(suffix).alias("suffix"))
    return F.when(cap.isNull(), None).when(cap >= 1e12, part(1e12, 2, "T")).when(cap >= 1e9, part(1e9, 1, "B")).when(cap >= 1e6, part(1e6, 0, "M")).otherwise(part(1.0, 0, ""))


def format_amount(value: Column, sign: str | Column = "") -> Column:
    """Thousands separated, up to two decimals, the minus sign before the currency sign."""
    mark = F.lit(sign) if isinstance(sign, str) else sign
    digits = F.regexp_replace(F.regexp_replace(F.format_number(F.abs(value), 2), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNull(), DASH).when(value == 0, F.concat(mark, F.lit("0"))).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), mark, digits))


def format_period(period_end: Column) -> Column:
    """"Dec 31, 2024"; text that isn't a date stays."""
    return F.coalesce(F.date_format(period_end.try_cast("date"), "MMM d, yyyy"), period_end)
