"""Work that is asked for in rounds, because what is asked next depends on the answers before: pages within a budget, and tiers of extractors.

Every round is a join over what is left, and its outcome is written before the next one starts.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.calls import CallTable, Respond
from ledgerloom.operators.selection import MOST_PAGES, first_of, first_rows, publishable
from ledgerloom.sources import files

#: Calls for a document at most, and pages of a kind that a vision model sees. Fixed values.
MOST_CALLS, MOST_IMAGES = 6, 3
ASKED = "sha256 string, kind string, place int, round int, found boolean, response string"


def written(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ask_pages(
    candidates: DataFrame, request: Column, is_found: Column, calls: CallTable, respond: Respond, kinds: tuple[str, ...] = schemas.STATEMENT_KINDS,
    most_calls: int | None = MOST_CALLS, most_pages: int = MOST_PAGES, model: str = "default", schema_name: str = "extraction", identity: Column | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``ASKED``, and the columns ``carry`` of ``candidates``: each call of a document's search for its kinds, in order.

    ``candidates``: sha256, kind, place (the best page of a kind first) and what ``request`` is made of. A document goes through
    its kinds in the order of ``kinds``, and through at most ``most_pages`` pages of each until ``is_found`` holds for the ``response``; after
    ``most_calls`` calls (None: no bound) it stops. A call that fails counts, and the next page is asked. Round k asks for the k-th call of all
    documents that still have one. ``place`` in the result counts a kind's pages from 1. Rows with a null document, kind or place are left out; of equal ones one counts.
    Calls are told apart by their request, or by ``identity`` where the request holds an image.
    """
    from ledgerloom.operators.providers import cached_calls, request_key

    spark = candidates.sparkSession
    kind_ord = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    known = candidates.where(F.col("sha256").isNotNull() & (kind_ord > 0) & F.col("place").isNotNull())
    text = F.to_json(request)
    known = known.select("sha256", "kind", F.col("place").alias("given"), text.alias("request"), (text if identity is None else F.to_json(identity)).alias("identity"), *carry)
    usable = first_rows(first_of(known, ["sha256", "kind", "given"], [F.col("identity"), F.col("request")]), ["sha256", "kind"], [F.col("given")], most_pages)
    key = request_key(F.lit(model), F.col("identity"), F.lit(schema_name))
    pages = written(usable.select("sha256", "kind", "place", kind_ord.alias("kind_ord"), key.alias("key"), "request", *carry), files.scratch(spark, "candidate-pages"))
    log, n = files.scratch(spark, "asked-pages"), 0
    empty = pages.limit(0).select("sha256", "kind", "place", F.lit(0).alias("round"), F.lit(False).alias("found"), F.lit("").alias("response"), *carry)
    empty.write.parquet(log)
    while most_calls is None or n < most_calls:
        n += 1
        asked = spark.read.schema(empty.schema).parquet(log)
        # What comes up next is known from keys; texts are read for the pages that are asked.
        left = pages.select("sha256", "kind", "place", "kind_ord").join(asked.select("sha256", "kind", "place"), ["sha256", "kind", "place"], "left_anti")
        left = left.join(asked.where("found").select("sha256", "kind").distinct(), ["sha256", "kind"], "left_anti")
        turn = left.groupBy("sha256").agg(F.min(F.struct("kind_ord", "place", "kind")).alias("t")).select("sha256", "t.kind", "t.place")
        work = written(pages.join(turn, ["sha256", "kind", "place"]).drop("kind_ord"), files.scratch(spark, "asking"))
        if work.isEmpty():
            break
        answers, _ = cached_calls(work.select("key", "request"), calls, respond)
        told = work.join(answers.select("key", "response").distinct(), "key", "left")
        told.select("sha256", "kind", "place", F.lit(n).alias("round"), F.coalesce(is_found, F.lit(False)).alias("found"), "response", *carry).write.mode("append").parquet(log)
    return spark.read.schema(empty.schema).parquet(log)


@dataclasses.dataclass
class Tier:
    """One way to get statements. ``extract`` takes the wanted (source_sha256, statement) and returns rows with these columns; a ``verified`` tier's statements need a good verdict."""

    name: str
    extract: Callable[[DataFrame], DataFrame]
    verified: bool = True


#: Takes the rows of extracted statements; returns (source_sha256, statement) of those for which there is a verdict, with is_correct_kind, issues and confidence.
Verify = Callable[[DataFrame], DataFrame]
KEYS = ["source_sha256", "statement"]


def escalate(documents: DataFrame, tiers: list[Tier], verify: Verify | None, kinds: tuple[str, ...] = schemas.STATEMENT_KINDS) -> tuple[DataFrame, DataFrame]:
    """Statements of ``documents`` (source_sha256), each from the first tier that gives a good one, and what each tier was asked for.

    The first tier is asked for all kinds; each further one only for those that are missing, or were sent back by their verdict. A statement
    without a verdict passes; tiers that aren't ``verified`` pass unseen. Without ``verify`` (no model) the first tier's statements are taken as they are,
    and no other tier is asked. A tier's work list, its rows and what is accepted are written before the next tier starts. The first result has the rows of the tiers with
    ``tier``; the second (source_sha256, statement, tier) has the work lists.
    """
    spark = documents.sparkSession
    work = documents.select("source_sha256").where("source_sha256 is not null").distinct().select("source_sha256", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("statement"))
    accepted: DataFrame | None = None
    asked: DataFrame | None = None
    for tier in tiers[: None if verify else 1]:
        work = written(work, files.scratch(spark, f"wanted-{tier.name}"))
        if accepted is not None and work.isEmpty():
            break
        rows = written(tier.extract(work).join(work, KEYS, "left_semi"), files.scratch(spark, f"extracted-{tier.name}"))  # what wasn't asked for isn't taken
        good = rows.select(*KEYS).distinct()
        if verify and tier.verified:
            verdicts = written(verify(rows).select(*KEYS, publishable(F.col("confidence").isNull()).alias("good")), files.scratch(spark, f"verdicts-{tier.name}"))
            good = good.join(verdicts.where("not coalesce(good, false)").select(*KEYS), KEYS, "left_anti")
        taken = written(rows.join(good, KEYS, "left_semi").withColumn("tier", F.lit(tier.name)), files.scratch(spark, f"accepted-{tier.name}"))
        list_ = work.withColumn("tier", F.lit(tier.name))
        accepted, asked = (taken, list_) if accepted is None else (accepted.unionByName(taken, allowMissingColumns=True), asked.unionByName(list_))
        work = work.join(taken.select(*KEYS).distinct(), KEYS, "left_anti")
    return accepted, asked


def page_tier(name: str, candidates: DataFrame, request: Column, is_found: Column, calls: CallTable, respond: Respond, rows_of: Callable[[DataFrame], DataFrame], **budget) -> Tier:
    """A tier that asks a model for the wanted kinds' pages: ``rows_of`` makes statement rows of the calls that found one. ``verified`` and ``ask_pages``' budgets pass through."""
    verified = budget.pop("verified", True)

    def extract(work: DataFrame) -> DataFrame:
        wanted = candidates.join(work.select(F.col("source_sha256").alias("sha256"), F.col("statement").alias("kind")), ["sha256", "kind"], "left_semi")
        return rows_of(ask_pages(wanted, request, is_found, calls, respond, **budget).where("found"))

    return Tier(name, extract, verified)
