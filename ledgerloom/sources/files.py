"""Stage files, configuration and viewer files as DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas


def companies_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """The configured companies; slugs must be unique and every source needs an address and regular expressions that compile."""
    import re

    import yaml

    config = yaml.safe_load(text) or {}
    entries = config.get("companies", config)
    rows = [{"slug": slug, **body} for slug, body in entries.items()] if isinstance(entries, dict) else list(entries or [])
    slugs = [r["slug"] for r in rows]
    if len(set(slugs)) < len(slugs):
        raise ValueError("company slugs must be unique")
    for r in rows:
        for s in r.get("sources") or []:
            if not (s.get("entry_urls") or s.get("direct_urls")):
                raise ValueError(f"{r['slug']}: a source needs an entry or a direct URL")
            if not 0 <= int(s.get("max_follow_depth") or 0) <= 3:
                raise ValueError(f"{r['slug']}: max_follow_depth must be 0 to 3")
            for pattern in filter(None, (s.get("link_filter"), s.get("follow_links"))):
                re.compile(pattern)
        if r.get("shares_outstanding_m") is not None:
            r["shares_outstanding_m"] = float(r["shares_outstanding_m"])
    return spark.createDataFrame(rows, schemas.COMPANY)


def upsert_company_yaml(text: str, slug: str, body: dict) -> str:
    """The configuration with one company added or replaced."""
    import yaml

    config = yaml.safe_load(text) or {}
    config.setdefault("companies", {})[slug] = {**config["companies"].get(slug, {}), **body}
    return yaml.safe_dump(config, sort_keys=False, allow_unicode=True)


def append_direct_urls(text: str, slug: str, urls: Iterable[str]) -> str:
    """New direct addresses of a company's first source, after those it has, each once."""
    import yaml

    config = yaml.safe_load(text) or {}
    source = config["companies"][slug]["sources"][0]
    source["direct_urls"] = list(dict.fromkeys([*(source.get("direct_urls") or []), *urls]))
    return yaml.safe_dump(config, sort_keys=False, allow_unicode=True)


def read_stage(spark: SparkSession, path: str | list[str], schema: str, *, whole_files: bool = False) -> DataFrame:
    """JSON stage files, a record a line or (``whole_files``) one document a file; a record that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def write_stage(df: DataFrame, path: str) -> None:
    """Overwrite a stage's JSON, fields in order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FACTS).parquet(path)


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with their content's SHA-256."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("sha256", F.sha2("content", 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in local mode, where it is unset, in a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-loom-", dir="/tmp")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def read_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The DataFrame that ``read`` gives, or None where its file is missing."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_statement(spark: SparkSession, path: str, company_slug: str, statement: str) -> DataFrame | None:
    """One exported document's text; None if there is none."""
    return read_or_none(lambda: spark.read.text(f"{path}/company_slug={company_slug}/statement={statement}"))


def write_index(companies: DataFrame, documents: DataFrame, path: str) -> None:
    """The index beside the documents: companies and statements, as JSON."""
    companies.write.mode("overwrite").json(f"{path}/companies")
    documents.write.mode("overwrite").json(f"{path}/statements")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Companies and statements of the index; None if there is none."""
    companies = read_or_none(lambda: spark.read.schema("slug string, name string, has_data boolean").json(f"{path}/companies"))
    return None if companies is None else (companies, spark.read.schema("company_slug string, company_name string, ticker string, statement string, periods array<string>, rows int").json(f"{path}/statements"))


def read_market(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MARKET).json(path)


def write_market(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)
