"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated instead of trusted.

Each rule votes good (+1), bad (-1) or abstains (0). The rules' votes are counted by pattern over all documents,
a table of at most 3^rules rows that the driver reads once; expectation-maximisation on it estimates for each rule how often it
votes which way on good and on bad documents, and the share of good ones. A document is kept if the posterior probability of being good is
high enough, whatever a single rule says. Everything that touches documents is DataFrame and SQL functions.

Edge cases: a null or empty text has no words and fails the base test; features are counted over whole texts; rows that repeat
are judged each; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved, table, whole_text

SPACE = r"[ \t-\r]"
SPACE_CHARS = " \t\n\x0b\f\r"
WINDOW = 8
#: Votes: name -> (good if, bad if) over the features; neither is an abstention. Most rules only know bad signs.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 100", "n_words < 20"),
    "sentences": ("n_stops > 0 and n_words <= 30 * n_stops", "n_words > 150 * greatest(n_stops, 1)"),
    "repeated_words": ("false", "10 * n_repeat_words >= 3 * n_words"),
    "repeated_lines": ("false", "5 * n_dup_lines >= 2 * n_lines"),
    "symbols": ("false", "4 * n_symbols >= n_words"),
    "letters": ("false", "10 * n_letters < 7 * word_chars"),
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "case": ("false", "2 * n_upper >= n_letters"),
    "variety": ("false", "8 * n_distinct < n_words and n_distinct < 200"),
}


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules look at; one narrow pass of built-in functions."""
    # inline() makes each step's arrays once: as plain columns the optimizer would put their expressions
    # into the next step's lambdas, which then split the text again for every word.
    # Passed as a value: SQL text has no \f, it reads the letter f.
    trimmed = F.btrim("text", F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    step = docs.select("doc_id", whole_text().alias("text"))
    step = step.select("doc_id", "text", F.inline(F.array(F.struct(words.alias("words"), lines.alias("lines")))))
    windows = F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    step = step.select("*", F.inline(F.array(F.struct(F.size("words").cast("long").alias("n_words"), windows.alias("windows")))))
    # Only texts in which a window recurs have their windows sorted.
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))
    step = step.select("doc_id", "text", "words", "lines", "n_words", F.inline(F.array(F.struct(placed.alias("placed")))))
    step = step.withColumn("n_repeat_words", repeat_words().cast("long"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return step.select(
        "doc_id",
        "n_words",
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        without(".!?").cast("long").alias("n_stops"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def repeat_words() -> Column:
    """How many words lie in windows that occur more than once, by ``placed``: windows sorted by hash and place. Neighbours are compared, places joined."""
    alike = lambda x, k: F.get("placed", k)["h"] == x["h"]
    twice = F.filter("placed", lambda x, k: F.coalesce(alike(x, k - 1), F.lit(False)) | F.coalesce(alike(x, k + 1), F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, start, lambda acc, i: F.struct((acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered"), i.alias("last")), lambda acc: acc["covered"])


def votes() -> dict[str, Column]:
    return {name: F.when(F.expr(good), F.lit(1)).when(F.expr(bad), F.lit(-1)).otherwise(F.lit(0)).cast("byte") for name, (good, bad) in RULES.items()}


def bounded(counts: dict[int, float], most: float) -> dict[int, float]:
    """The likeliest distribution over votes for these counts among those with at most ``most`` bad ones: the excess goes to the others in proportion."""
    total = sum(counts.values())
    shares = {v: n / total for v, n in counts.items()}
    if shares[-1] <= most:
        return shares
    rest = 1 - shares[-1]
    return {v: most if v == -1 else x * (1 - most) / rest for v, x in shares.items()}


def log_odds(votes: tuple[int, ...], prior: float, tables: list[dict[int, dict[int, float]]]) -> tuple[float, float]:
    """Log probabilities of a pattern of votes together with being good, and with being bad."""
    good, bad = math.log(prior), math.log(1 - prior)
    for v, by_class in zip(votes, tables, strict=True):
        good += math.log(by_class[1][v])
        bad += math.log(by_class[-1][v])
    return good, bad


def fit_accuracies(patterns: DataFrame, rules: list[str], *, prior: float = 0.8, smoothing: float = 1.0, most_errors: float = 0.01, rounds: int = 500, settled: float = 1e-9) -> dict:
    """Expectation-maximisation over ``patterns`` (a column for each rule, and ``n``): at most 3^rules rows, which come to the driver once.

    Smoothing keeps rules that never vote one way from certainties. A rule is taken to condemn at most ``most_errors`` of the good
    documents: without that bound, a kind of bad documents that few rules know would count as a variety of the good ones. The
    maximisation is the exact one under the bound, so the penalised likelihood never falls; the rounds end when it gains less than ``settled`` a document.
    """
    counted = [(tuple(r[x] for x in rules), r["n"]) for r in patterns.select(*rules, "n").collect()]
    start = {1: {1: 0.4, -1: min(0.01, most_errors), 0: 0.59}, -1: {1: 0.3, -1: 0.3, 0: 0.4}}
    tables: list[dict[int, dict[int, float]]] = [{c: dict(v) for c, v in start.items()} for _ in rules]
    total, before, trace = sum(n for _, n in counted), -math.inf, []
    for _ in range(rounds if counted else 0):
        sums = {1: smoothing, -1: smoothing}
        seen = [{c: {v: smoothing for v in (1, 0, -1)} for c in (1, -1)} for _ in rules]
        likelihood = smoothing * (math.log(prior) + math.log(1 - prior) + sum(math.log(p) for t in tables for c in t.values() for p in c.values()))
        for votes, n in sorted(counted):
            good, bad = log_odds(votes, prior, tables)
            top = max(good, bad)
            both = top + math.log(math.exp(good - top) + math.exp(bad - top))
            likelihood += n * both
            for c, log_p in ((1, good), (-1, bad)):
                share = n * math.exp(log_p - both)
                sums[c] += share
                for own, v in zip(seen, votes, strict=True):
                    own[c][v] += share
        trace.append(likelihood)
        if likelihood - before < settled * total:
            break
        before, prior = likelihood, sums[1] / (sums[1] + sums[-1])
        tables = [{1: bounded(own[1], most_errors), -1: bounded(own[-1], 1.0)} for own in seen]
    return {"prior": prior, "votes": dict(zip(rules, tables, strict=True)), "likelihoods": trace}


def posterior(state: dict) -> Column:
    """The probability of being good, given the columns of votes."""
    odds = F.lit(math.log(state["prior"] / (1 - state["prior"])))
    for rule, by_class in state["votes"].items():
        ratio = {v: math.log(by_class[1][v] / by_class[-1][v]) for v in (1, 0, -1)}
        odds = odds + F.when(F.col(rule) == 1, ratio[1]).when(F.col(rule) == -1, ratio[-1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The features of each row of ``docs``, ``base_failed``, the posterior ``p_good`` and ``kept``."""
    rules = list(RULES)
    judged = saved(features(docs).select("*", *(v.alias(f"vote_{r}") for r, v in votes().items())), "quality-votes")
    names = [f"vote_{r}" for r in rules]
    state = fit_accuracies(judged.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")), names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("p_good", posterior(state)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
