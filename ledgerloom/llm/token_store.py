"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_token_store`` deals the documents out by ranges of ``doc_id`` (and of a hash of the text, so that a common id doesn't end up in one
task), encodes each range in its tasks and writes one sorted ORC file for each. ORC keeps the ids as run-length encoded integers; each stripe carries a
row index (minimum and maximum for every so many rows) and a Bloom filter of ``doc_id``. Readers can take
stripes in parallel, and a filter on ``doc_id`` skips files, stripes and row groups by metadata alone.

Edge cases: a null or empty text gives the end id alone; a null ``doc_id`` sorts first; rows that repeat a
``doc_id`` are all kept, next to each other, within a file in the order of a hash of their ids; an empty table gives an
empty store; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe_units import encoder
from ledgerloom.llm.common import map_batches, saved, shared_path, whole_text

STORE_SCHEMA = "doc_id long, tokens array<int>"


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``doc_id, tokens``: each whole text's ids followed by ``end_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), enc.encode_all(batch.column(1), end_id)], names=["doc_id", "tokens"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), encode, STORE_SCHEMA, "encoder")


#: Bytes of text for a file of the store at least and at most; between, they grow with the square root of the input, as the number of files does.
FILE_BYTES = 16 << 20, 256 << 20


def file_count(total_bytes: int) -> int:
    least, most = FILE_BYTES
    return max(1, -(-total_bytes // min(most, max(least, math.isqrt(total_bytes << 16)))))


def in_file() -> list[Column]:
    """The order of a file's rows."""
    return [F.col("doc_id").asc_nulls_first(), F.xxhash64("tokens")]


def write_token_store(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, *, stripe_mb: int = 64, rows_per_index: int = 1000, false_positives: float = 0.01) -> None:
    """Write ``docs`` to ORC files under ``path`` in ascending ``doc_id`` order; the number of files follows from the texts' bytes.

    The texts are dealt out before they are encoded: Spark samples what it deals out by range, and the sample
    then reads texts instead of encoding them a second time.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(file_count(total), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20))  # small inputs keep all cores busy
    dealt = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (encode_documents(dealt, tokenizer, end_id).sortWithinPartitions(*in_file()).write
        .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_mb << 20)
        .option("orc.create.index", "true").option("orc.row.index.stride", rows_per_index)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives)
        .orc(path))


def read_token_store(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, tokens, file``; with ``doc_ids`` only those, found by the files' indexes and Bloom filters."""
    store = spark.read.schema(STORE_SCHEMA).orc(path).select("doc_id", "tokens", F.col("_metadata.file_name").alias("file"))
    return store if doc_ids is None else store.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def token_offsets(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a store: where each document's ids begin among all ids.

    Each file's ids are summed, the files (one row each) are put in the order of their documents, and within a file a window adds up
    the documents before: no step has more than one file's documents together.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            values, at = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), tokens.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_crc32", "file", "tie"])

    docs = saved(map_batches(store.select("doc_id", "tokens", "file", F.xxhash64("tokens").alias("tie")), digest, "doc_id long, n_tokens long, ids_crc32 long, file string, tie long"), "token-digests")
    # Ranges of ids only touch at their ends. Files' names don't tell the order: they sort as text, not as numbers.
    before = Window.orderBy(F.col("nulls").desc(), F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_offsets(read_token_store(spark, path))
