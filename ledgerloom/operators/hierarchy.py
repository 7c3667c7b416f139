"""Depths, parents and section headers of statement lines, by windows instead of a stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import TOTAL_OF, is_grand_total, is_total, leading_indent, section_label


def classify_rows(rows: DataFrame, label: str = "label", has_value: str = "has_value") -> DataFrame:
    """Rows without any value are headers; totals are told by their labels."""
    return rows.withColumn("is_header", ~F.col(has_value)).withColumn("is_total", is_total(F.col(label)))


def infer_hierarchy(rows: DataFrame, keys: list[str], pos: str = "pos", label: str = "label") -> DataFrame:
    """Add ``depth`` and ``parent_label``: a header opens a level for the rows after it, a total that isn't a header closes one.

    A closing without an open level does nothing, so the number of open levels is a walk reflected at zero: the
    running sum less its running minimum below zero. A row's parent is the last header that opened the level it
    is in, found by a window over each level's rows. Three windows on one partitioning.
    """
    ordered = Window.partitionBy(*keys).orderBy(pos)
    through = ordered.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("is_header"), 1).when(F.col("is_total"), -1).otherwise(0)
    walk = rows.withColumn("__sum", F.sum(step).over(through))
    walk = walk.withColumn("__after", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(through)))
    walk = walk.withColumn("__before", F.coalesce(F.lag("__after").over(ordered), F.lit(0)))
    walk = walk.withColumn("depth", (F.col("__before") + F.when(~F.col("is_header") & (leading_indent(F.col(label)) >= 2), 1).otherwise(0)).cast("int"))
    # Each row asks at its own level; a header also answers at the level it opens, after its own question.
    asks = F.struct(F.col("__before").alias("level"), F.lit(0).alias("answers"))
    tells = F.struct(F.col("__after").alias("level"), F.lit(1).alias("answers"))
    events = walk.withColumn("__event", F.explode(F.when(F.col("is_header"), F.array(asks, tells)).otherwise(F.array(asks))))
    level = Window.partitionBy(*keys, "__event.level").orderBy(pos, "__event.answers").rowsBetween(Window.unboundedPreceding, 0)
    told = F.last(F.when(F.col("__event.answers") == 1, F.col(label)), ignorenulls=True).over(level)
    named = events.withColumn("parent_label", F.when(F.col("__event.level") > 0, told)).where("__event.answers = 0")
    return named.drop("__sum", "__after", "__before", "__event")


def inject_sections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Header rows before sections that end in a "Total X" line; depths follow and ``display_order`` is counted anew.

    A grand total ends a section without naming it and stands at depth 0, a "Total X" line stands at depth 1. A
    section that begins with a header, or is empty, gets none; the rows after the last total stay as they are.
    """
    order = Window.partitionBy(*keys).orderBy("display_order", "canonical_name")
    grand = F.col("is_total") & is_grand_total(F.col("canonical_name"))
    ends = rows.withColumn("__grand", F.coalesce(grand, F.lit(False)))
    ends = ends.withColumn("__total", ~F.col("__grand") & F.coalesce(F.col("is_total") & F.col("canonical_name").rlike(TOTAL_OF), F.lit(False)))
    ends = ends.withColumn("__pos", F.row_number().over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__section", F.coalesce(F.sum((F.col("__grand") | F.col("__total")).cast("int")).over(before), F.lit(0)))
    section = Window.partitionBy(*keys, "__section")
    inner = ~F.col("__grand") & ~F.col("__total")
    ends = ends.withColumn("__name", section_label(F.max(F.when(F.col("__total"), F.col("canonical_name"))).over(section)))
    first = F.min_by("is_header", F.when(inner, F.col("__pos"))).over(section)
    ends = ends.withColumn("__opens", F.col("__name").isNotNull() & F.coalesce(~first, F.lit(False)))
    shift = F.when(F.col("__opens"), 1 - F.min(F.when(inner, F.coalesce("depth", F.lit(0)))).over(section)).otherwise(0)
    lines = ends.withColumn("depth", F.when(F.col("__grand"), 0).when(F.col("__total"), 1).otherwise(F.col("depth") + shift).cast("int")).withColumn("__kind", F.lit(1))
    heads = ends.where(inner & F.col("__opens")).groupBy(*keys, "__section", "__name").agg(F.min("__pos").alias("__pos"))
    heads = heads.select(*keys, F.col("__name").alias("canonical_name"), F.lit(0).alias("depth"), F.lit(True).alias("is_header"), F.lit(False).alias("is_total"), "__pos", F.lit(0).alias("__kind"))
    both = lines.drop("__grand", "__total", "__section", "__name", "__opens").unionByName(heads, allowMissingColumns=True)
    again = Window.partitionBy(*keys).orderBy("__pos", "__kind")
    return both.withColumn("display_order", (F.row_number().over(again) - 1).cast("int")).drop("__pos", "__kind")
