"""Calls to models and other paid services, asked once: answers are a table that is written before anything reads it.

The table only grows. It is partitioned by the first digits of the key, so that a few requests read a few folders; what is asked is
the anti join of the requests' keys with the table's. Answers are written in rounds of at most about ``each`` calls, and a call
that fails has no answer and leaves the others alone: a run that is broken off, or whose service fails in between, repeats only what has no answer yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import files

#: A provider turns request texts into response texts (JSON), or None where it fails.
Respond = Callable[[list[str]], list[str | None]]
CALLS = "prefix string, key string, response string, run string"
#: Calls whose answers are written together, and how many go to the service at a time.
EACH, AT_ONCE = 10_000, 16


class CallTable:
    """Answers by key in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, each: int = EACH, at_once: int = AT_ONCE, digits: int = 1):
        """``digits`` of the key name a folder: the same number for all runs on a folder; two are for tables of many millions."""
        self.spark, self.path, self.each, self.at_once, self.digits = spark, path, each, at_once, digits

    def read(self) -> DataFrame:
        found = files.read_or_none(lambda: self.spark.read.schema(CALLS).parquet(self.path))
        return self.spark.createDataFrame([], CALLS) if found is None else found

    def answers(self, keys: DataFrame) -> DataFrame:
        """``key, response`` of those ``keys`` that have an answer; if two runs asked at the same time, the same one of both for every reader."""
        wanted = keys.select("key").where("key is not null").distinct().withColumn("prefix", F.substring("key", 1, self.digits))
        return self.read().join(wanted, ["prefix", "key"], "left_semi").groupBy("key").agg(F.min_by("response", "run").alias("response"))

    def add(self, rows: DataFrame, run: str) -> None:
        """Appends answers (key, response)."""
        rows.select(F.substring("key", 1, self.digits).alias("prefix"), "key", "response", F.lit(run).alias("run")).write.mode("append").partitionBy("prefix").parquet(self.path)

    def ask(self, requests: DataFrame, respond: Respond) -> str:
        """Asks once for each key of ``requests`` (key, request) that has no answer, and writes the answers; the name of this run.

        Of equal keys one request is asked, the smallest. Requests go to tasks by key, ``at_once`` at a time; an error of the service counts as a failure of those.
        """
        run, at_once = uuid.uuid4().hex, self.at_once
        once = requests.where("key is not null").groupBy("key").agg(F.min("request").alias("request"))
        missing = once.join(self.answers(once).select("key"), "key", "left_anti")
        path = files.scratch(self.spark, "requests")
        missing.write.parquet(path)  # the table grows below: what is missing is decided before
        missing = self.spark.read.schema("key string, request string").parquet(path)
        rounds = -(-missing.count() // self.each)
        tasks = min(16**self.digits, self.spark.sparkContext.defaultParallelism)

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), at_once):
                    part = batch.iloc[k : k + at_once]
                    try:
                        answers = respond(part["request"].tolist())
                    except Exception:  # noqa: BLE001 - a service that fails is asked again by the next run
                        answers = [None] * len(part)
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "response": pd.Series(answers, dtype=object).to_numpy()})

        for n in range(rounds):
            part = missing.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == n).repartition(tasks, F.substring("key", 1, self.digits))  # a file a prefix; nothing is shuffled behind the calls
            self.add(part.mapInPandas(call, "key string, response string").where("response is not null"), run)
        return run
