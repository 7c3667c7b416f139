"""One taxonomy per company and statement, and the resolution of other years' labels to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.periods import iso_date, restates
from ledgerloom.functions.text import clean_label, fuzzy_key

GROUP = ["company_slug", "statement"]
HEALTHY_ROWS = 8


def taxonomy_source(reports: DataFrame, least_rows: int = HEALTHY_ROWS) -> DataFrame:
    """The report whose labels are canonical: the newest with enough rows, else the newest. ``reports``: group, source_fiscal_year, n_rows, ord."""
    order = Window.partitionBy(*GROUP).orderBy((F.col("n_rows") >= least_rows).desc(), F.col("source_fiscal_year").desc_nulls_last(), "ord")
    return reports.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def taxonomy(rows: DataFrame) -> DataFrame:
    """Line items of the source report's rows (``row_idx``, ``label``, hierarchy): of equal labels, but for case, the first one; display_order keeps gaps."""
    named = rows.withColumn("canonical_name", clean_label(F.col("label"))).where("canonical_name <> ''")
    exact = named.withColumn("exact_key", F.lower("canonical_name")).withColumn("fuzzy", fuzzy_key(F.col("label")))
    first = exact.withColumn("__rank", F.row_number().over(Window.partitionBy(*GROUP, "exact_key").orderBy("row_idx"))).where("__rank = 1").drop("__rank")
    again = Window.partitionBy(*GROUP, "fuzzy").orderBy("row_idx")
    return first.withColumn("fuzzy_first", F.row_number().over(again) == 1).withColumn("display_order", F.col("row_idx"))


def resolve_labels(labels: DataFrame, items: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """Add ``canonical_name`` and ``match_type``: by label, else by fuzzy key, else by the validated drift mapping (``old``, ``canonical``), else missed.

    The taxonomy is small for each company and is joined by key; with many companies Spark chooses a shuffled join.
    """
    keyed = labels.withColumn("__clean", clean_label(F.col("label"))).withColumn("__exact", F.lower("__clean")).withColumn("__fuzzy", fuzzy_key(F.col("label")))
    exact = items.select(*GROUP, F.col("exact_key").alias("__exact"), F.col("canonical_name").alias("__by_label"))
    fuzzy = items.where("fuzzy_first").select(*GROUP, F.col("fuzzy").alias("__fuzzy"), F.col("canonical_name").alias("__by_key"))
    found = keyed.join(exact, [*GROUP, "__exact"], "left").join(fuzzy, [*GROUP, "__fuzzy"], "left")
    mapped = F.lit(None).cast("string")
    if drift is not None:
        own = drift.select(*GROUP, F.lower("old").alias("__exact"), F.col("canonical").alias("__mapped")).dropDuplicates([*GROUP, "__exact"])
        found = found.join(own, [*GROUP, "__exact"], "left")
        mapped = F.col("__mapped")
    kind = F.when(F.col("__by_label").isNotNull(), "exact").when(F.col("__by_key").isNotNull(), "fuzzy").when(mapped.isNotNull(), "model").otherwise("missed")
    out = found.withColumn("canonical_name", F.coalesce("__by_label", "__by_key", mapped)).withColumn("match_type", kind)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def drift_candidates(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct labels that neither match a canonical name nor its fuzzy key: two anti joins."""
    keyed = labels.select(*GROUP, clean_label(F.col("label")).alias("label"), fuzzy_key(F.col("label")).alias("fuzzy")).where("label <> ''").withColumn("exact_key", F.lower("label"))
    left = keyed.join(items.select(*GROUP, "exact_key"), [*GROUP, "exact_key"], "left_anti").join(items.select(*GROUP, "fuzzy"), [*GROUP, "fuzzy"], "left_anti")
    return left.select(*GROUP, "label").distinct()


def validated_drift(mapping: DataFrame, items: DataFrame) -> DataFrame:
    """Only mappings to a name that is in the taxonomy, but for case, with the taxonomy's spelling."""
    names = items.select(*GROUP, F.col("exact_key").alias("__key"), F.col("canonical_name").alias("__name"))
    return mapping.withColumn("__key", F.lower(F.trim("canonical"))).join(names, [*GROUP, "__key"]).withColumn("canonical", F.col("__name")).drop("__key", "__name")


def match_statistics(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(*GROUP, "match_type").agg(F.count(F.lit(1)).alias("n"))


def taxonomy_statistics(items: DataFrame) -> DataFrame:
    """Lines, headers and totals of each taxonomy."""
    return items.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_header").alias("headers"), F.count_if("is_total").alias("totals"))


def line_items(items: DataFrame) -> DataFrame:
    """``schemas.LINE_ITEMS`` of a taxonomy whose rows carry their hierarchy."""
    return items.select(*GROUP, "canonical_name", "depth", F.col("parent_label").alias("parent_name"), "is_header", "is_total", "display_order")


def to_facts(resolved: DataFrame) -> DataFrame:
    """One fact for each period of a resolved row; cells without an ISO date are skipped, later rows of one name win."""
    cells = resolved.where("canonical_name is not null").select("*", F.explode("values_by_period_end").alias("period_text", "value"))
    dated = cells.withColumn("period_end", iso_date(F.col("period_text"))).where("period_end is not null")
    seq = F.col("source_fiscal_year").cast("long") * -1_000_000 + F.col("row_idx")
    return dated.select(*GROUP, "canonical_name", "period_end", "period_months", F.col("value").cast("decimal(30,4)").alias("value"), "currency", "unit", "source_sha256", "source_fiscal_year", restates(F.col("period_end"), F.col("source_fiscal_year")).alias("is_restated"), seq.alias("seq"))
