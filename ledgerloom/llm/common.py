"""What the operators of this subpackage share: tables on shared storage, tokenizer paths, text columns.

Long jobs cut their lineage with Parquet tables in the folder that the session names in
``spark.checkpoint.dir``; a lost executor then costs the tasks it ran, not the stages before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks the columns that operators add to a user's rows while they work on them.
INNER = "__loom_"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a new one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-loom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has had."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it from there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes and rows of a batch that goes to a Python worker: a few megabytes keep both sides small, and long texts come in few.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def map_batches(df: DataFrame, run: Callable, schema: object, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with small batches, by settings of the session. ``keeps`` names the kind of ``worker_object`` that ``run`` uses: others are let go first."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def lean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where the tokenizer file lies on this machine; executors look it up for themselves."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


T = TypeVar("T")
_kept: dict[tuple[str, Hashable], object] = {}


def worker_object(key: tuple[str, Hashable], make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, by kind and name: only the last such object, so that stages don't pile up their caches."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget(but: str | None) -> None:
    """Lets go what the worker keeps, unless it is of the kind ``but``."""
    if any(kind != but for kind, _ in _kept):
        _kept.clear()
