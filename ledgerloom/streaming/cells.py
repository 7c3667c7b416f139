"""Consolidated cells kept as keyed state: each cell remembers the last value of every filing, and tells its new row when a batch touches it.

Filings of a cell are few (a row for each fiscal year), however large a company is; cells are dealt over all state partitions by their whole key.
A restatement may come years later, so nothing expires. The updates of a batch are a partition of a log, replaced if the batch runs again; the current cells are
each cell's last row in the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom import schemas
from ledgerloom.schemas import CELL_KEYS
from ledgerloom.sources import files

FILING = "seq long, value string, period_months int, currency string, unit string, source_sha256 string"
UPDATED = f"company_slug string, statement string, canonical_name string, period_end date, source_fiscal_year int, {FILING.removeprefix('seq long, ')}, is_restated boolean"
TOLERANCE = Decimal("0.01")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cell(StatefulProcessor):
    """State of a cell: for each fiscal year (as text; empty if unknown) the filing that was written last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filings = handle.getMapState("filings", "year string", FILING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        came: dict[str, tuple] = {}
        for batch in rows:
            for r in batch[["source_fiscal_year", "seq", "value", "period_months", "currency", "unit", "source_sha256"]].astype(object).itertuples(index=False):
                year, seq, value, months, *rest = (None if x is None or x is pd.NA or x != x else x for x in r)
                name = "" if year is None else str(int(year))
                filing = (None if seq is None else int(seq), None if value is None else str(value), None if months is None else int(months), *rest)
                if name not in came or (filing[0] is not None and (came[name][0] is None or filing[0] > came[name][0])):
                    came[name] = filing
        for name, filing in came.items():
            self.filings.updateValue((name,), filing)
        all_ = {name: tuple(filing) for (name,), filing in self.filings.iterator()}
        newest = max(all_, key=lambda name: (name != "", int(name or 0)))
        values = [Decimal(f[1]) for f in all_.values() if f[1] is not None]
        restated = len(values) >= 2 and max(values) - min(values) > TOLERANCE
        _, value, months, *rest = all_[newest]
        row = (*key, int(newest) if newest else None, value, months, *rest, restated)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in UPDATED.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def cell_updates(facts: DataFrame) -> DataFrame:
    """The new row of each cell that a micro-batch of the stream ``facts`` (``schemas.FACTS``) touches; in a batch the largest ``seq`` of a filing counts, later batches over earlier ones."""
    kept = facts.withColumn("value", F.col("value").cast("string")).select(*CELL_KEYS, "source_fiscal_year", "seq", "value", "period_months", "currency", "unit", "source_sha256")
    told = kept.groupBy(*CELL_KEYS).transformWithStateInPandas(statefulProcessor=Cell(), outputStructType=UPDATED, outputMode="Update", timeMode="None")
    return told.withColumn("value", F.col("value").cast("decimal(30,4)"))


def cell_stream(spark: SparkSession, incoming: str, log: str, checkpoint: str, files_each: int = 1000) -> StreamingQuery:
    """Runs all that is in ``incoming`` through the state, ``files_each`` files a batch, and stops; called again it goes on where it was."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    facts = spark.readStream.schema(schemas.FACTS).option("maxFilesPerTrigger", files_each).parquet(incoming)

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)

    return cell_updates(facts).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_cells(spark: SparkSession, log: str) -> DataFrame:
    """Each cell's last row, with the columns of ``facts.consolidated``."""
    schema = UPDATED.replace("value string", "value decimal(30,4)")
    found = files.read_or_none(lambda: spark.read.schema(f"{schema}, batch long").parquet(log))
    rows = spark.createDataFrame([], f"{schema}, batch long") if found is None else found
    rest = [c for c in rows.columns if c not in (*CELL_KEYS, "batch")]
    return rows.groupBy(*CELL_KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*CELL_KEYS, "r.*")
