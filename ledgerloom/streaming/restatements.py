"""A stream of filed facts that keeps the consolidated cells current.

A restatement may come years after the period it revises, so no watermark drops anything: each micro-batch
upserts its facts and recomputes the cells of the companies that it touches, whose partitions it replaces.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schemas
from ledgerloom.operators.facts import consolidated, upsert, write_facts


#: Companies of a batch that are looked up together: their names are literals of the filter that prunes the store's partitions.
TOGETHER = 500


def groups(batch: DataFrame) -> Iterator[list[str | None]]:
    """The companies of a batch, ``TOGETHER`` at a time."""
    names = (r.company_slug for r in batch.select("company_slug").distinct().toLocalIterator())
    while group := list(itertools.islice(names, TOGETHER)):
        yield group


def apply_batch(batch: DataFrame, store: str, cells: str) -> None:
    """Upsert one batch into ``store`` and refresh ``cells``; running a batch again changes nothing.

    Only the partitions of the batch's companies are read and replaced.
    """
    spark = batch.sparkSession
    try:
        stored = spark.read.schema(schemas.FACTS).parquet(store)
    except AnalysisException as error:  # the first batch finds no store
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    for companies in groups(batch):
        own = F.col("company_slug").isin(*[c for c in companies if c is not None])
        if None in companies:
            own = own | F.col("company_slug").isNull()
        # Written before the store's partitions are replaced: what is read from must not be what is written to.
        staging = f"{store.rstrip('/')}_staging"
        upsert(None if stored is None else stored.where(own), batch.where(own)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(staging)
        merged = spark.read.schema(schemas.FACTS).parquet(staging)
        write_facts(merged, store)
        write_facts(consolidated(merged), cells)


def restatement_stream(spark: SparkSession, incoming: str, store: str, cells: str, checkpoint: str) -> StreamingQuery:
    facts = spark.readStream.schema(schemas.FACTS).parquet(incoming)
    return facts.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, store, cells)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
