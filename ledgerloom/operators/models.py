"""Stages that ask a model: requests are rows, answers are JSON that is parsed and validated by columns; what fails falls back to rules.

``respond`` (see ``operators.calls``) is the caller's; ``cache`` is a table of answers that grows, or the answers known so far. Each function asks, writes the
answers and returns its result, which reads them, and the answers it added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.headings import detect_unit
from ledgerloom.functions.text import clean_label
from ledgerloom.operators.calls import CallTable, Respond
from ledgerloom.operators.extract import REPORT, confirm_rows
from ledgerloom.operators.providers import cached_calls, parsed, request_key
from ledgerloom.operators.rounds import KEYS, MOST_IMAGES, Tier, Verify, page_tier
from ledgerloom.operators.selection import MOST_LINES, first_rows
from ledgerloom.operators.taxonomy import GROUP, drift_candidates, validated_drift

CLASSIFIED = "kind string, fiscal_year int, confidence double"
CELL = "struct<period_end:string,value:string>"
ROWS = f"rows array<struct<label:string,cells:array<{CELL}>,depth:int,parent_label:string,is_header:boolean,is_total:boolean>>"
CONFIRMED = f"correct_kind boolean, actual_kind string, notes string, {ROWS}"
EXTRACTED = f"found boolean, unit string, rows array<struct<label:string,cells:array<{CELL}>>>"
DRIFT = "mappings array<struct<old_label:string,canonical_label:string>>"


def asked(requests: DataFrame, body: Column, schema_name: str, cache: DataFrame | CallTable, respond: Respond, model: str) -> tuple[DataFrame, DataFrame]:
    """``requests`` with the model's ``response`` to ``body``: from the cache, else asked once for equal requests."""
    keyed = requests.withColumn("request", F.to_json(body)).withColumn("key", request_key(F.lit(model), F.col("request"), F.lit(schema_name)))
    answers, new = cached_calls(keyed.select("key", "request"), cache, respond)
    return keyed.join(answers.select("key", "response").dropDuplicates(["key"]), "key", "left").drop("key", "request"), new


def classify_by_model(docs: DataFrame, front: DataFrame, cache: DataFrame | CallTable, respond: Respond, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """``sha256, kind, fiscal_year, confidence`` for ``docs`` (sha256, link_text), shown ``front`` (sha256, text); kinds that don't exist and failed calls have no row."""
    shown = docs.join(front.select("sha256", "text"), "sha256", "left")
    answers, new = asked(shown, F.struct("link_text", "text"), "classification", cache, respond, model)
    got = answers.select("sha256", parsed(F.col("response"), CLASSIFIED).alias("c")).where(F.col("c.kind").isin(*schemas.REPORT_KINDS))
    return got.select("sha256", "c.kind", "c.fiscal_year", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c.confidence")).alias("confidence")), new


def cells_to_map(cells: Column) -> Column:
    """A list of (period_end, value) as a map; of equal periods the last one counts."""
    last = F.filter(cells, lambda c, k: c["period_end"].isNotNull() & ~F.exists(F.slice(cells, k + 2, F.size(cells)), lambda d: d["period_end"] == c["period_end"]))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(c["period_end"].alias("key"), c["value"].alias("value"))))


def confirm_by_model(extracted: DataFrame, cache: DataFrame | CallTable, respond: Respond, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """Confirmed rows: a report's as the model gives them, or by rule where it doesn't answer. ``extracted``: one row for each line, as ``confirm_rows`` takes them."""
    header = [*REPORT, "currency", "unit", "period_months"]
    line = F.struct("row_idx", "raw_label", F.transform_values("values_by_period_end", lambda _, v: v.cast("string")).alias("values"))
    reports = extracted.groupBy(*header).agg(F.array_sort(F.collect_list(F.struct("row_idx", F.to_json(line).alias("line")))).alias("lines"))
    answers, new = asked(reports, F.struct("statement", F.transform("lines", lambda x: x["line"]).alias("lines")), "confirmation", cache, respond, model)
    got = answers.select(*header, parsed(F.col("response"), CONFIRMED).alias("c")).where("size(c.rows) > 0")
    rows = got.select(*header, "c.correct_kind", "c.notes", F.posexplode("c.rows").alias("row_idx", "r"))
    confirmed = rows.select(
        *header, "row_idx", clean_label(F.col("r.label")).alias("label"), cells_to_map(F.col("r.cells")).alias("values_by_period_end"), F.coalesce("r.depth", F.lit(0)).alias("depth"), "r.parent_label",
        F.coalesce("r.is_header", F.lit(False)).alias("is_header"), F.coalesce("r.is_total", F.lit(False)).alias("is_total"), F.coalesce("correct_kind", F.lit(True)).alias("correct_kind"), F.lit("model").alias("confirmed_by"), "notes",
    )
    left = extracted.join(got.select(*REPORT), REPORT, "left_anti")
    return confirmed.unionByName(confirm_rows(left).withColumn("notes", F.lit(None).cast("string")).select(*confirmed.columns)), new


def has_statement() -> Column:
    """Whether a ``response`` has a statement's rows."""
    told = parsed(F.col("response"), EXTRACTED)
    return F.coalesce(told["found"] & (F.size(told["rows"]) > 0), F.lit(False))


def statement_rows(answers: DataFrame) -> DataFrame:
    """``source_sha256, statement, unit, row_idx, raw_label, values_by_period_end`` of ``answers`` (sha256, kind, unit, response): the model's unit counts unless it says none."""
    from ledgerloom.functions.numbers import parse_number_plain

    got = answers.where(has_statement()).select("sha256", "kind", "unit", parsed(F.col("response"), EXTRACTED).alias("e"))
    unit = F.coalesce(F.nullif("e.unit", F.lit("units")), F.col("unit"))
    rows = got.select(F.col("sha256").alias("source_sha256"), F.col("kind").alias("statement"), unit.alias("unit"), F.posexplode("e.rows").alias("row_idx", "r"))
    values = F.transform_values(cells_to_map(F.col("r.cells")), lambda _, v: parse_number_plain(v))
    return rows.select("source_sha256", "statement", "unit", "row_idx", F.col("r.label").alias("raw_label"), values.alias("values_by_period_end"))


def extract_by_model(pages: DataFrame, cache: DataFrame | CallTable, respond: Respond, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """``statement_rows`` of candidate ``pages`` (sha256, kind, text): all of them are asked. ``text_tier`` asks within a budget."""
    answers, new = asked(pages, F.struct("kind", "text"), "extraction", cache, respond, model)
    return statement_rows(answers.withColumn("unit", detect_unit(F.col("text")))), new


#: Characters of a page that a text model sees, and those that its unit is looked for in. Fixed values.
SHOWN, UNIT_SHOWN = 12_000, 2_000


def text_tier(pages: DataFrame, calls: CallTable, respond: Respond, model: str = "default") -> Tier:
    """Statements that a model reads from page texts, unverified: six calls a document and twelve pages a kind at most. ``pages``: sha256, kind, place, text."""
    shown = pages.select("sha256", "kind", "place", F.substring("text", 1, SHOWN).alias("text"), detect_unit(F.substring("text", 1, UNIT_SHOWN)).alias("unit"))
    return page_tier("text", shown, F.struct("kind", "text"), has_statement(), calls, respond, statement_rows, verified=False, model=model, carry=("unit",))


def vision_tier(pages: DataFrame, calls: CallTable, respond: Respond, model: str = "default") -> Tier:
    """Statements that a model sees on page images: three pages a kind at most. ``pages``: sha256, kind, place, image, text; equal images are one call."""
    shown = pages.select("sha256", "kind", "place", F.base64("image").alias("image"), F.substring(F.sha2("image", 256), 1, 24).alias("name"), detect_unit(F.substring("text", 1, UNIT_SHOWN)).alias("unit"))
    return page_tier("vision", shown, F.struct("kind", "image"), has_statement(), calls, respond, statement_rows, most_calls=None, most_pages=MOST_IMAGES, model=model, schema_name="vision", identity=F.struct("kind", "name"), carry=("unit",))


VERDICT = "is_correct_kind boolean, is_complete boolean, confidence double, issues array<struct<severity:string,field:string,detail:string>>, summary string"


def verifier(calls: CallTable, respond: Respond, model: str = "default") -> Verify:
    """Verdicts of a model on a tier's statements, of which it sees the first 60 lines; a failed call gives none."""
    line = F.struct("row_idx", "raw_label", F.to_json("values_by_period_end").alias("values"))

    def verify(rows: DataFrame) -> DataFrame:
        lines = first_rows(rows, KEYS, [F.col("row_idx")], MOST_LINES).groupBy(*KEYS).agg(F.array_sort(F.collect_list(line)).alias("lines"))
        answers, _ = asked(lines, F.struct("statement", "lines"), "verdict", calls, respond, model)
        told = answers.select(*KEYS, parsed(F.col("response"), VERDICT).alias("v")).where("v is not null")
        return told.select(*KEYS, "v.is_correct_kind", F.coalesce("v.issues", F.array()).alias("issues"), "v.confidence")

    return verify


def drift_by_model(labels: DataFrame, items: DataFrame, cache: DataFrame | CallTable, respond: Respond, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """The validated mapping (group, old, canonical) of the labels that neither match a name nor a key: one request for each company and statement."""
    names = items.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("display_order", "canonical_name"))), lambda x: x["canonical_name"]).alias("names"))
    old = drift_candidates(labels, items).groupBy(*GROUP).agg(F.array_sort(F.collect_list("label")).alias("old"))
    answers, new = asked(old.join(names, GROUP), F.struct("statement", "names", "old"), "drift", cache, respond, model)
    pairs = answers.select(*GROUP, "old", F.explode(parsed(F.col("response"), DRIFT)["mappings"]).alias("m")).where(F.array_contains("old", F.col("m.old_label")))
    return validated_drift(pairs.select(*GROUP, F.col("m.old_label").alias("old"), F.col("m.canonical_label").alias("canonical")), items), new
