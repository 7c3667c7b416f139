"""Contents and manifests that grow from run to run.

Contents are kept by their SHA-256, in folders by its first two digits. A run reads the names in the store, not the contents, and appends what
the store lacks; a content that many addresses have is appended once. The manifest has a row for each content, the newest run's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import links as L
from ledgerloom.operators import crawl
from ledgerloom.operators.frontier import SOURCE, in_order
from ledgerloom.operators.selection import first_rows
from ledgerloom.sources import files

STORE = "prefix string, sha256 string, content binary"
RUN = "run string, slug string, source_name string, status string, pages int, found int, downloaded int, failed int, started_at string"
ERRORS = "run string, slug string, source_name string, url string, stage string, message string"


def stored_names(spark: SparkSession, path: str) -> DataFrame:
    """``prefix, sha256`` of the contents in the store: a scan of the names alone."""
    found = files.read_or_none(lambda: spark.read.schema(STORE).parquet(path))
    return (spark.createDataFrame([], STORE) if found is None else found).select("prefix", "sha256")


def add_contents(contents: DataFrame, path: str) -> DataFrame:
    """Appends to the store what it lacks of ``contents`` (sha256, content, of a written table); the names that were new.

    Names are compared first, on keys alone; contents are read for the new ones only. Of equal contents one is written.
    """
    spark = contents.sparkSession
    names = contents.select("sha256").where("sha256 is not null").distinct().withColumn("prefix", F.substring("sha256", 1, 2))
    staged = files.scratch(spark, "new-names")
    names.join(stored_names(spark, path), ["prefix", "sha256"], "left_anti").write.parquet(staged)
    new = spark.read.schema("sha256 string, prefix string").parquet(staged)
    # Equal names have equal contents: any of them does.
    contents.join(new, "sha256").select("prefix", "sha256", "content").dropDuplicates(["sha256"]).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    return new.select("sha256")


def merge_into_manifest(rows: DataFrame, path: str) -> DataFrame:
    """The stage file at ``path`` with ``rows`` of this run, by content: this run's rows over the earlier ones. Written beside it first."""
    spark = rows.sparkSession
    before = files.read_or_none(lambda: files.read_stage(spark, path, schemas.SCRAPED))
    merged = crawl.merge_manifest(spark.createDataFrame([], schemas.SCRAPED) if before is None else before, rows)
    staged = files.scratch(spark, "manifest")
    files.write_stage(merged, staged)
    files.write_stage(files.read_stage(spark, staged, schemas.SCRAPED), path)
    return files.read_stage(spark, path, schemas.SCRAPED)


def with_limit(candidates: DataFrame, limit: int | None) -> DataFrame:
    """``candidates`` with their number in the source (``ord``, from 0): all, or the first ``limit`` of each source."""
    numbered = first_rows(candidates, SOURCE, in_order(), (1 << 31) - 1 if limit is None else limit)
    return numbered.withColumn("ord", F.col("place") - 1).drop("place")


def scrape_run(sources: DataFrame, wanted: DataFrame, n_found: DataFrame, pages: DataFrame, fetched: DataFrame, out: str, *, discover_only: bool = False) -> DataFrame:
    """Stores what a run has fetched, merges the manifest and appends the run's record and errors; the record of each source.

    ``sources``: slug, source_name, label, n; ``wanted``: slug, source_name, url, page_url, link_text, ord of the documents to get; ``n_found``: slug, source_name, found;
    ``pages``: the crawl's pages; ``fetched``: a written table url, status, content_type, body, error, with a row for each wanted address.
    """
    spark, run = sources.sparkSession, uuid.uuid4().hex
    got = fetched.where("body is not null and coalesce(status, 200) < 400").withColumn("sha256", F.sha2("body", 256))
    files_path = files.scratch(spark, "downloads")
    got.write.parquet(files_path)
    got = spark.read.parquet(files_path)
    add_contents(got.select("sha256", F.col("body").alias("content")), f"{out}/contents")
    told = got.select("url", "sha256", "content_type", F.octet_length("body").cast("long").alias("size_bytes"))
    rows = wanted.join(told, "url").join(sources.select(*SOURCE, "label", "n"), SOURCE)
    name = F.concat("sha256", L.file_suffix(F.col("url"), F.col("content_type")))
    manifest = rows.select(
        "sha256", F.col("url").alias("source_url"), "page_url", "link_text", name.alias("local_path"), "size_bytes", "content_type", F.current_timestamp().cast("string").alias("discovered_at"), "source_name", "label",
        (F.col("n") * 10_000 + F.least("ord", F.lit(9_999))).cast("int").alias("ord"),
    )
    merge_into_manifest(manifest, f"{out}/manifest")

    lost = wanted.join(told.select("url"), "url", "left_anti")
    why = fetched.select("url", F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string")), F.lit("no answer")).alias("message"))
    page_errors = pages.where("error is not null").select(*SOURCE, "url", F.lit("fetch_page").alias("stage"), F.col("error").alias("message"))
    errors = page_errors if discover_only else page_errors.unionByName(lost.join(why, "url", "left").select(*SOURCE, "url", F.lit("download_pdf").alias("stage"), F.coalesce("message", F.lit("no answer")).alias("message")))
    errors.select(F.lit(run).alias("run"), *SOURCE, "url", "stage", "message").write.mode("append").json(f"{out}/errors")

    outcome = wanted.join(told.select("url", F.lit("downloaded").alias("o")).distinct(), "url", "left").select(*SOURCE, F.coalesce("o", F.lit("failed")).alias("outcome"))
    counted = outcome.groupBy(*SOURCE).agg(F.count_if(F.col("outcome") == "downloaded").alias("downloaded"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    seen = pages.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("pages"), F.count("error").alias("page_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    record = sources.select(*SOURCE).join(n_found, SOURCE, "left").join(counted, SOURCE, "left").join(seen, SOURCE, "left")
    status = L.scrape_status(F.lit(discover_only), zero("found"), zero("downloaded"), F.lit(0) if discover_only else zero("failed"), zero("page_errors") > 0)
    record.select(
        F.lit(run).alias("run"), *SOURCE, status.alias("status"), zero("pages").alias("pages"), zero("found").alias("found"), zero("downloaded").alias("downloaded"), (F.lit(0) if discover_only else zero("failed")).alias("failed"), F.current_timestamp().cast("string").alias("started_at")
    ).write.mode("append").json(f"{out}/runs")
    return spark.read.schema(RUN).json(f"{out}/runs").where(F.col("run") == run)
