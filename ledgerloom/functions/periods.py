"""Period headers and cells of statement tables, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import parse_number
from ledgerloom.functions.reports import let

YEAR = r"(?U)\b((?:19|20)\d{2})\b"


def header_year(cell: Column) -> Column:
    found = F.nullif(F.regexp_extract(cell, YEAR, 1), F.lit("")).try_cast("int")
    return F.when(cell.contains("19") | cell.contains("20"), found)  # few cells need the pattern


def year_headers(cells: Column) -> Column:
    """A year or null for each cell."""
    return F.transform(cells, header_year)


def has_year(cells: Column) -> Column:
    return F.exists(year_headers(cells), lambda y: y.isNotNull())


def period_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd only; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def is_valid_year(year: Column) -> Column:
    return year.between(1990, 2030)


def restates(period: Column, source_fiscal_year: Column) -> Column:
    """A fact's own flag: its period ended before the year that its report is for."""
    return F.year(period) < source_fiscal_year


def values_by_period(cells: Column, years: Column) -> Column:
    """Map of period end to number; where a year has several columns the last one counts."""
    pairs = F.filter(F.arrays_zip(years.alias("y"), cells.alias("c")), lambda p: p["y"].isNotNull())
    periods = F.transform(pairs, lambda p: F.struct(F.concat(p["y"].cast("string"), F.lit("-12-31")).alias("period"), parse_number(p["c"]).alias("value")))
    return let(periods, lambda all_: F.map_from_entries(F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["period"] == p["period"]))))


def label_cell(cells: Column) -> Column:
    """The first cell."""
    return F.get(cells, F.lit(0))


def lettered_label_cell(cells: Column) -> Column:
    """The first cell that has a letter and is no number."""
    return F.get(F.filter(cells, lambda c: c.rlike(r"\p{L}") & parse_number(c).isNull()), F.lit(0))


def has_any_value(values: Column) -> Column:
    return F.exists(F.map_values(values), lambda v: v.isNotNull())


def keeps_row(cells: Column, years: Column, dated: Column | None = None) -> Column:
    """Two cells or more, a label, no header of its own (``dated`` has ``has_year`` if it is known), and at least one period column."""
    return (F.size(cells) >= 2) & (F.trim(F.coalesce(label_cell(cells), F.lit(""))) != "") & ~(has_year(cells) if dated is None else dated) & F.exists(years, lambda y: y.isNotNull())
