"""Folders whose files are parsed once: a file is parsed again only if its time or size has changed.

The state beside the folder has a row for each version of a file that was parsed, and the rows that came of it. What has changed is told by a listing, which
reads no contents; only changed files are opened. A run that breaks off leaves its last files without a record, and the next run parses those again.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import files

VERSION = "path string, modificationTime timestamp, length long"
KNOWN = f"{VERSION}, run string, at timestamp"
#: Files that are opened together: their names are literals of one read.
TOGETHER = 1000


class IncrementalFolder:
    """``parse`` takes files (path, modificationTime, length, content) and returns rows with ``path``, always of the same schema."""

    def __init__(self, spark: SparkSession, source: str, state: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*"):
        self.spark, self.source, self.state, self.parse, self.pattern = spark, source, state, parse, pattern

    def reader(self):
        return self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", True)

    def listing(self) -> DataFrame:
        """The files that are there now and have contents (Spark lists no empty ones): without ``content`` none is opened."""
        found = files.read_or_none(lambda: self.reader().load(self.source).select("path", "modificationTime", "length"))
        return self.spark.createDataFrame([], VERSION) if found is None else found

    def known(self) -> DataFrame:
        """The version of each file that was parsed last."""
        found = files.read_or_none(lambda: self.spark.read.schema(KNOWN).parquet(f"{self.state}/files"))
        rows = self.spark.createDataFrame([], KNOWN) if found is None else found
        return rows.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length", "run"), "at").alias("v")).select("path", "v.*")

    def refresh(self) -> int:
        """Parses the files that are new or have changed; how many those were."""
        staged = files.scratch(self.spark, "changed-files")
        self.listing().join(self.known(), ["path", "modificationTime", "length"], "left_anti").write.parquet(staged)
        changed = self.spark.read.schema(VERSION).parquet(staged)
        names, n = (r.path for r in changed.select("path").toLocalIterator()), 0
        while group := list(itertools.islice(names, TOGETHER)):
            run = uuid.uuid4().hex
            opened = self.reader().load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in group])
            self.parse(opened).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.state}/rows")
            done = changed.where(F.col("path").isin(group))
            done.select("*", F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.state}/files")
            n += len(group)
        return n

    def rows(self) -> DataFrame | None:
        """The rows of the files that are there, of the version that was parsed last; None before the first."""
        found = files.read_or_none(lambda: self.spark.read.parquet(f"{self.state}/rows"))
        current = self.known().join(self.listing().select("path"), "path", "left_semi").select("path", "run")
        return None if found is None else found.join(current, ["path", "run"], "left_semi").drop("run")
