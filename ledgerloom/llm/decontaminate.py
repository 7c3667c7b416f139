"""Benchmark decontamination: every training passage queries an index of the test items; what scores high is verified.

Spark counts in how many test items each term occurs, and their lengths; the items (few; larger sets are taken in blocks of bounded size, all with the same statistics) are put into a BM25 inverted index
whose items are grouped into blocks; a term knows its greatest impact in each block. An item's threshold is the
smallest score that a passage can have which verification would accept. Every passage of every document is a query.
As in block-max WAND, a block is opened only if the greatest impacts of the passage's terms in it could reach a
threshold, and its items are scored only then; the bound is exact, so all items above their threshold are
retrieved. Passages are tried from the whole document down, in overlapping halves: what a document's terms
can't reach, none of its passages can.

What is retrieved is verified: enough of the five-word shingles of the item's question, and of its answer, must occur
in the passage.

Edge cases: null or empty texts match nothing; an item of fewer than five words counts as one shingle of all its
words; an item without words is left out; an item without an id counts as any other; rows and items that repeat are matched each; empty tables give no
matches; other columns are ignored by ``leaks`` and kept by ``remove_leaks``.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, table, whole_text

K1, B = 1.2, 0.75
MATCH_SCHEMA = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double"
#: Characters of test items that one index holds; more items make more indexes, each queried by every passage. It decides about memory and passes, not about results.
INDEX_CHARS = 32 << 20
WORDS = re.compile(r"\w+")
#: Where an item's text has no column of its own for the answer: what follows the last question mark, if that is something.
ANSWER = re.compile(r"^(.*\?)([^?]*\w[^?]*)$", re.DOTALL)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


Item = tuple[int | None, str, str | None]


def parts_of(text: str, answer: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    if answer is None and (m := ANSWER.match(text)):
        text, answer = m[1], m[2]
    return words_of(text), words_of(answer or "")


@dataclasses.dataclass
class Corpus:
    """What the scores need to know of all test items: how many have words, their mean and greatest length, and in how many items each term occurs (of the terms at hand)."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """BM25 postings of test items, in blocks of items that are neighbours by id. ``corpus``: the statistics of all items, if these are some of them."""

    def __init__(self, items: list[Item], overlap: float, shingle: int, block: int = 2, corpus: Corpus | None = None):
        self.size, self.block = shingle, block
        kept = []
        for item_id, text, answer in items:
            question, answered = parts_of(text, answer)
            if question or answered:
                kept.append((item_id, question, answered))
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        self.ids = [x[0] for x in kept]
        self.parts = [(shingles(q, shingle), shingles(a, shingle)) for _, q, a in kept]
        counts = [Counter(q + a) for _, q, a in kept]
        lengths = np.array([sum(c.values()) for c in counts], float)
        if corpus is None:
            corpus = Corpus(len(kept), lengths.mean() if len(kept) else 1.0, int(lengths.max(initial=0)), Counter(t for c in counts for t in c))
        n, mean, df = corpus.n, corpus.mean, corpus.df
        self.longest = max(16, corpus.longest)
        self.term = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        self.own: list[dict[int, float]] = []
        self.threshold = np.zeros(len(kept))
        best: list[dict[int, float]] = [{} for _ in self.term]
        for i, c in enumerate(counts):
            own = {self.term[t]: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[i] / mean)) for t, f in c.items()}
            self.own.append(own)
            # Each word that a passage lacks takes a shingle at least with it: so many may lack, of the weightiest.
            lacking = sum(int((1 - overlap) * len(part) + 1e-9) for part in self.parts[i])
            self.threshold[i] = max(1e-6, sum(sorted(own.values())[: max(0, len(own) - lacking)]))
            for t, impact in own.items():
                best[t][i // block] = max(best[t].get(i // block, 0.0), impact / self.threshold[i])
        # Greatest impact of each term in each block, as a share of the threshold: CSR by term.
        self.at = np.cumsum([0, *map(len, best)])
        self.block_of = np.array([b for row in best for b in row], np.int64)
        self.gain = np.array([g for row in best for g in row.values()], float)

    def open_blocks(self, words: list[str]) -> tuple[set[int], list[int]]:
        """The known terms among ``words`` and the blocks that they could reach."""
        terms = {self.term[w] for w in set(words) if w in self.term}
        found = np.fromiter(terms, np.int64, len(terms))
        begin, n = self.at[found], self.at[found + 1] - self.at[found]
        flat = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        bound = np.bincount(self.block_of[flat], self.gain[flat]) if len(flat) else np.empty(0)
        return terms, np.flatnonzero(bound >= 1 - 1e-9).tolist()

    def query(self, words: list[str]) -> Iterator[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of every passage of a document that reaches an item's threshold.

        A passage has at most four times the longest item's words; any words no longer than that item lie in one whole passage.
        """
        ranges = [(0, len(words))] if words and self.ids else []
        while ranges:
            begin, end = ranges.pop()
            terms, blocks = self.open_blocks(words[begin:end])
            if blocks and end - begin > 4 * self.longest:
                middle = (begin + end) // 2
                ranges += [(begin, middle + self.longest), (middle, end)]
                continue
            own_shingles = None
            for i in (i for block in blocks for i in range(block * self.block, min(len(self.ids), (block + 1) * self.block))):
                score = sum(impact for t, impact in self.own[i].items() if t in terms)
                if score >= self.threshold[i] - 1e-9:
                    own_shingles = shingles(words[begin:end], self.size) if own_shingles is None else own_shingles
                    yield i, score, *(self.overlap(part, own_shingles, words[begin:end]) for part in self.parts[i])

    def overlap(self, part: set[tuple[str, ...]], passage: set[tuple[str, ...]], words: list[str]) -> float:
        """The share of a part's shingles in the passage; of a part shorter than a shingle, whether it occurs; 1 without the part."""
        if not part:
            return 1.0
        size = len(next(iter(part)))
        return len(part & (passage if size == self.size else shingles(words, size))) / len(part)


def item_terms(items: DataFrame) -> DataFrame:
    """``row, length, terms`` of the items that have words: how many, and which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w for part in parts_of(t, a) for w in part] for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["row", "length", "terms"])

    return map_batches(items.select("row", "text", "answer"), run, "row long, length int, terms array<string>").where("length > 0")


def item_blocks(items: DataFrame) -> Iterator[tuple[list[Item], Corpus]]:
    """The test items in blocks of about ``INDEX_CHARS`` characters, one (maybe empty) at least, with the statistics of all items. ``answer`` is used if the table has it.

    Spark counts in how many items each term occurs and gives each item the counts of its own terms: a block, and its scores, do not depend on how items are dealt into blocks.
    """
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    own = saved(items.select("item_id", whole_text().alias("text"), answer.alias("answer")).withColumn("row", F.monotonically_increasing_id()), "test-items")
    terms = saved(item_terms(own), "item-terms")
    each = terms.select("row", F.explode("terms").alias("term"))
    frequency = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(frequency, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("df"))
    n, mean, longest = terms.agg(F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    block: list[Item] = []
    corpus, chars = Corpus(n, mean or 1.0, longest or 0, {}), 0
    for row in own.join(counted, "row", "left").toLocalIterator():
        if chars > INDEX_CHARS:
            yield block, corpus
            block, corpus, chars = [], dataclasses.replace(corpus, df={}), 0
        block.append((row.item_id, row.text, row.answer))
        corpus.df.update((x.term, x.n) for x in row.df or ())
        chars += len(row.text) + len(row.answer or "")
    yield block, corpus


def matches(words: list[str], index: Index, overlap: float) -> dict[int, tuple[float, float, float]]:
    """number of the item in the index -> best (score, question overlap, answer overlap) among verified passages."""
    best: dict[int, tuple[float, float, float]] = {}
    for i, *found in index.query(words):
        if min(found[1:]) >= overlap and tuple(found) > best.get(i, (-1.0, 0.0, 0.0)):
            best[i] = tuple(found)
    return best


def leaks(docs: DataFrame, items: DataFrame, *, overlap: float = 0.8, shingle: int = 5) -> DataFrame:
    """``MATCH_SCHEMA``: one row for each document and test item that it holds."""
    found = None
    for block, corpus in item_blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, overlap, shingle, corpus=corpus))  # at most INDEX_CHARS of text

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                rows = [(d, own.ids[i], *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, x in sorted(matches(words_of(t.as_py()), own, overlap).items())]
                columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"])

        part = map_batches(docs.select("doc_id", whole_text().alias("text")), run, MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def remove_leaks(docs: DataFrame, items: DataFrame, *, overlap: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    for block, corpus in item_blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, overlap, shingle, corpus=corpus))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not matches(words_of(t.as_py() or ""), index.value, overlap) for t in batch.column(batch.schema.get_field_index("text"))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
