"""Calls to models, fetchers and searches: pluggable, cached by key, and only for what the cache lacks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.calls import CallTable, Respond
from ledgerloom.sources import files

class FetchStrategy(Protocol):
    """Fetches one address; raises if it can't."""

    name: str

    def fetch(self, url: str) -> tuple[int, str, bytes]: ...


class SearchClient(Protocol):
    def search(self, query: str, most: int) -> list[dict[str, str]]: ...


class ModelClient(Protocol):
    def respond(self, requests: list[str]) -> list[str | None]: ...


class Extractor(Protocol):
    def extract(self, document: dict) -> list[dict]: ...


def request_key(model: Column, messages: Column, schema_name: Column) -> Column:
    """SHA-256 of the request's JSON with its fields in order of their names."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), model.alias("model"), schema_name.alias("schema"))), 256)


def cached_calls(requests: DataFrame, cache: DataFrame | CallTable, respond: Respond) -> tuple[DataFrame, DataFrame]:
    """Answers to ``requests`` (key, request) and the rows that this call added to the table of answers.

    Equal keys are asked once, failures aren't cached, and nothing is asked again when a result is read: both results read written answers.
    ``cache``: a ``CallTable``, which keeps them, or known answers (key, response) for this call only.
    """
    if isinstance(cache, CallTable):
        calls = cache
    else:
        calls = CallTable(requests.sparkSession, files.scratch(requests.sparkSession, "calls"))
        calls.add(cache.join(requests.select("key").distinct(), "key", "left_semi"), "")
    run = calls.ask(requests, respond)
    return requests.join(calls.answers(requests), "key", "left"), calls.read().where(F.col("run") == run).select("key", "response")


class UrlStrategy:
    """Plain requests by the standard library."""

    name = "urllib"

    def __init__(self, timeout: float = 10.0, agent: str = "Mozilla/5.0"):
        self.timeout, self.agent = timeout, agent

    def request(self, method: str, url: str, headers: dict[str, str] | None = None) -> tuple[int, str, bytes]:
        import urllib.error
        import urllib.request

        asked = urllib.request.Request(url, method=method, headers={"User-Agent": self.agent, **(headers or {})})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                return answer.status or 200, answer.headers.get("Content-Type", ""), answer.read()
        except urllib.error.HTTPError as error:
            return error.code, error.headers.get("Content-Type", ""), b""

    def fetch(self, url: str) -> tuple[int, str, bytes]:
        status, kind, body = self.request("GET", url)
        if status >= 400:
            raise OSError(f"status {status}")
        return status, kind, body


#: (method, url) -> status and content type; raises if the host doesn't answer.
Probe = Callable[[str, str], tuple[int, str]]


def is_reachable(url: str, probe: Probe, get_after: tuple[int, ...] | None = None, *, document: bool = False) -> bool:
    """HEAD, then GET if HEAD fails (with ``get_after``: only at those statuses). A ``document`` must not be a web page."""
    try:
        status, kind = probe("HEAD", url)
        if status >= 400 and (get_after is None or status in get_after):
            status, kind = probe("GET", url)
    except Exception:  # noqa: BLE001 - no answer is an answer
        return False
    return status < 400 and not (document and "html" in (kind or "").lower())


def reachable_documents(picks: DataFrame, snapshots: DataFrame, probe: Probe) -> DataFrame:
    """``picks`` (url) with ``reachable``, and ``snapshot_url`` where only an archived copy of ``snapshots`` (url, snapshot_url) answers. Each address is asked once."""
    schema = "asked string, answers boolean"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"asked": batch["asked"], "answers": [is_reachable(u, probe, document=True) for u in batch["asked"]]})

    direct = picks.select(F.col("url").alias("asked")).distinct().mapInPandas(ask, schema).select(F.col("asked").alias("url"), F.col("answers").alias("reachable"))
    archived = direct.where("not reachable").join(snapshots, "url").select(F.col("snapshot_url").alias("asked")).distinct().mapInPandas(ask, schema).where("answers").select(F.col("asked").alias("snapshot_url"))
    copies = snapshots.join(archived, "snapshot_url", "left_semi").join(direct.where("not reachable").select("url"), "url", "left_semi")
    return picks.join(direct, "url").join(copies.select("url", "snapshot_url"), "url", "left")


def fetch_first(strategies: list[FetchStrategy], tries: int = 3, wait: float = 0.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over ``url``: the first strategy that answers, or the last error. Between tries ``wait`` seconds, doubled each time and jittered."""
    import random
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                row = {"url": url, "strategy": None, "status": None, "content_type": None, "body": None, "error": None}
                for strategy in strategies:
                    for k in range(tries):
                        if k and wait:
                            time.sleep(wait * 2 ** (k - 1) * (0.5 + random.random()))
                        try:
                            status, kind, body = strategy.fetch(url)
                            row |= {"strategy": strategy.name, "status": status, "content_type": kind, "body": body, "error": None}
                            break
                        except Exception as error:  # noqa: BLE001 - any failure means the next strategy
                            row["error"] = str(error)
                    if row["strategy"]:
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["url", "strategy", "status", "content_type", "body", "error"])

    return run


FETCH_SCHEMA = "url string, strategy string, status int, content_type string, body binary, error string"
SEARCH_SCHEMA = "query string, ord int, title string, url string, snippet string"


def search_rows(client: SearchClient, most: int = 10) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over ``query``: hits with an address; a failing search has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query in batch["query"]:
                try:
                    hits = client.search(query, most)
                except Exception:  # noqa: BLE001 - a failed search is an empty one
                    hits = []
                rows += [(query, k, h.get("title", ""), h["url"], h.get("snippet", "")) for k, h in enumerate(hits) if h.get("url")]
            yield pd.DataFrame(rows, columns=["query", "ord", "title", "url", "snippet"])

    return run


def parsed(response: Column, schema: str) -> Column:
    """A response as a struct; what doesn't parse is null, and the callers fall back to their heuristics."""
    return F.from_json(response, schema)


class Rounds:
    """A bounded loop of tool calls on the driver: the model asks for tools until it submits, and must submit in the last round."""

    def __init__(self, step: Callable[[list[dict], bool], dict], tools: dict[str, Callable[..., object]], most: int = 25):
        self.step, self.tools, self.most = step, tools, most

    def run(self, messages: list[dict]) -> dict | None:
        for k in range(self.most):
            reply = self.step(messages, k == self.most - 1)
            if "submit" in reply:
                return reply["submit"]
            for call in reply.get("calls", []):
                try:
                    result = self.tools[call["tool"]](**call.get("arguments", {}))
                except Exception as error:  # noqa: BLE001 - the model is told
                    result = {"error": str(error)}
                messages = [*messages, {"role": "tool", "tool": call["tool"], "content": json.dumps(result, default=str)}]
        return None


ROUNDS_SCHEMA = "key string, submission string"


def run_rounds(loop: Rounds) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over (key, request): each row's own loop, and what it submits as JSON; null where it never does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            submitted = [loop.run([{"role": "user", "content": x}]) for x in batch["request"]]
            yield pd.DataFrame({"key": batch["key"], "submission": [None if x is None else json.dumps(x) for x in submitted]}, columns=["key", "submission"]).astype({"submission": object})

    return run
