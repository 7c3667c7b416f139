"""Market records, sparklines, the directory and its searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import change_pct, convert, market_cap

MOST_POINTS = 60


def downsample(points: DataFrame, keys: list[str], order: list[str], value: str = "value", most: int = MOST_POINTS) -> DataFrame:
    """At most ``most`` values of each series, evenly spread: points ``floor(i * n / most)``; nulls are dropped first."""
    w = Window.partitionBy(*keys)
    ranked = points.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    # Point i is taken if some k < most has floor(k * n / most) = i, which is so if k = ceil(i * most / n) does.
    k = F.ceil(F.col("__i") * most / F.col("__n"))
    taken = (F.col("__n") <= most) | ((k < most) & (F.floor(k * F.col("__n") / most) == F.col("__i")))
    kept = ranked.where(taken)
    return kept.withColumn("point", F.row_number().over(w.orderBy("__i")) - 1).drop("__i", "__n")


def sparkline_xy(points: DataFrame, keys: list[str], width: float = 100.0, height: float = 30.0) -> DataFrame:
    """Places in a box for the points of each series, first to last; a flat series lies on the floor."""
    w = Window.partitionBy(*keys)
    n, low, high = F.count(F.lit(1)).over(w), F.min("value").over(w), F.max("value").over(w)
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return points.withColumn("x", F.col("point") * width / F.nullif(n - 1, F.lit(0))).withColumn("y", height - (F.col("value") - low) / span * height)


def sparkline_summary(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    o = F.struct(*order)
    return points.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", o).alias("first"), F.max_by("value", o).alias("last"))


def market_records(quotes: DataFrame, companies: DataFrame, fetched_at: Column) -> DataFrame:
    """One record for each company with a ticker. ``quotes``: ticker, price, currency, previous_close, sparkline."""
    own = companies.select("slug", F.coalesce("market_ticker", "ticker").alias("ticker"), "shares_outstanding_m").where("ticker is not null")
    price, shares = F.col("price"), F.coalesce("shares_outstanding_m", F.lit(0.0))
    return own.join(quotes, "ticker").select("slug", "ticker", "price", "currency", "previous_close", change_pct(price, F.col("previous_close")).alias("change_pct"), market_cap(price, shares).alias("market_cap"), shares.alias("shares_outstanding_m"), "sparkline", fetched_at.alias("fetched_at"))


def chart_points(charts: DataFrame) -> DataFrame:
    """``ticker, ord, value`` of chart answers in JSON (``ticker``, ``body``)."""
    schema = "chart struct<result:array<struct<indicators:struct<quote:array<struct<close:array<double>>>>>>>"
    closes = F.col("j.chart.result")[0]["indicators"]["quote"][0]["close"]
    return charts.select("ticker", F.from_json("body", schema).alias("j")).select("ticker", F.posexplode(closes).alias("ord", "value"))


def directory(companies: DataFrame, coverage: DataFrame, market: DataFrame, currency: str = "EUR") -> DataFrame:
    """Companies with their coverage and market record, and price and capitalisation in one currency to sort by."""
    sort = lambda c: convert(F.col(c), F.coalesce("currency", F.lit("EUR")), currency).alias(f"{c}_in_{currency.lower()}")
    joined = companies.join(coverage.drop("name"), "slug", "left").join(market.drop("ticker", "shares_outstanding_m"), "slug", "left")
    return joined.select("*", sort("price"), sort("market_cap"))


#: What the directory can be sorted by; money is compared in one currency.
SORTABLE = {"name": "name", "ticker": "ticker", "price": "price_in_eur", "market_cap": "market_cap_in_eur", "change": "change_pct", "statements": "n_statements"}


def grid_order(by: str, *, descending: bool = False) -> list[Column]:
    """The order of the directory's rows; missing values last either way, ties by slug."""
    key = F.col(SORTABLE[by])
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("slug")]


def cell_tooltip(value: Column, source_fiscal_year: Column, is_restated: Column) -> Column:
    """What a cell says about its origin."""
    from_ = F.concat(F.lit("From the "), source_fiscal_year.cast("string"), F.lit(" report"))
    return F.when(value.isNotNull(), F.when(is_restated, F.concat(from_, F.lit(", restated"))).otherwise(from_))


def company_card(companies: DataFrame) -> DataFrame:
    """Company metadata with empty texts for what is missing, and the site's host."""
    from ledgerloom.functions.links import host

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return companies.select("slug", "name", *[empty(c) for c in ("ticker", "exchange", "sector", "headquarters", "description")], F.coalesce(host(F.col("website")), F.lit("")).alias("site"))


def search_any(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with ``query`` in one of the columns, in any case; an empty query passes all."""
    needle = query.strip().lower()
    hit = F.lit(not needle)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return rows.where(hit)


def fuzzy_search(rows: DataFrame, query: str, columns: list[str], distance: int = 2) -> DataFrame:
    """As ``search_any``, and rows one of whose words is within ``distance`` edits of the query."""
    needle = query.strip().lower()
    near = F.lit(not needle)
    for c in columns:
        near = near | F.coalesce(F.lower(c).contains(needle), F.lit(False)) | F.coalesce(F.exists(F.split(F.lower(c), r"\s+"), lambda w: F.levenshtein(w, F.lit(needle)) <= distance), F.lit(False))
    return rows.where(near)


def search_keep_headers(lines: DataFrame, query: str, keys: list[str], name: str = "canonical_name", pos: str = "pos") -> DataFrame:
    """Matching lines and every earlier header that is less deep than a later match; with no match no line, with no query all."""
    needle = query.strip().lower()
    if not needle:
        return lines
    hit = F.coalesce(F.lower(name).contains(needle), F.lit(False))
    # From the last line back: a frame up to the end would be gone through again for each line.
    later = Window.partitionBy(*keys).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    deepest = F.max(F.when(hit, F.col("depth"))).over(later)
    return lines.withColumn("__keep", hit | (F.col("is_header") & F.coalesce(deepest > F.col("depth"), F.lit(False)))).where("__keep").drop("__keep")


def display_row(is_header: Column, is_total: Column, depth: Column) -> Column:
    """The class of a printed line."""
    return F.when(is_header, "header").when(is_total & (depth == 0), "grand-total").when(is_total, "total").otherwise("line")


def stride_sample(values: Column, most: int, step: int = 2) -> Column:
    """All of up to ``most`` values; of more the first ``most`` places met by steps of ``step`` from the length modulo 7 on, around the end, none twice.

    Where the step divides the length not all places are met, and fewer may come out.
    """
    n = F.size(values)
    order = F.array_distinct(F.transform(F.sequence(F.lit(0), 2 * n - 1), lambda i: (n % 7 + i * step) % n))
    return F.when(n > most, F.transform(F.slice(order, 1, most), lambda i: F.get(values, i))).otherwise(values)
