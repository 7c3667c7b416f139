"""Mining hard negatives with a pivot table.

A row's score is the inner product with the anchor. Augmenting every vector x by one component sqrt(M^2 - |x|^2), M
being the largest norm, and the anchor q by a zero turns that into a Euclidean distance d with d^2 = |q|^2 + M^2 - 2 score. The pivot table
stores each row's distances to a few pivots; by the triangle inequality they bracket d, and so the score, for every anchor
whose own distances to the pivots are known. Only rows whose bracket meets what is asked for are scored, exactly, in whole numbers.

1. The pivot table: rows are ordered by their nearest pivot and the distance to it, and packed into blocks of neighbours. Pivots are chosen
   far apart from each other among a sample of ``SAMPLE`` rows; they decide how much is scored, never what is found.
2. Anchors go through in groups of at most ``ANCHORS`` (the stated queries, in blocks); a group is what is broadcast, 16 MB at most for 64 components.
   For each group a sixteenth of the blocks gives each anchor a score that its positives reach at least; then all blocks are searched for the positives,
   and, once they are known, in the same two steps for the negatives between the two fractions of each positive's score.
3. A block none of whose brackets can hold an answer is passed over as a whole; in the others each row's bracket decides. A task sends
   its best rows for each question, and a window picks the best of all.

Edge cases: rows with a null label, id or vector, or a null, NaN or infinite component take no part, nor do those with a component of 2^19 or
more, whose products don't fit a long; a shorter vector counts as ending with zeros; rows that share an id are rows of their own, and none is another's
positive; of equal rows each is returned; a positive with a negative score has no negatives, one with score 0 those with score 0; anchors without positives
have none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, shared_path, table
from ledgerloom.llm.vectors import matrix, products, usable, whole

#: Pivots, rows they are chosen from, rows in a block, anchors in a group, anchors that meet a block at once.
PIVOTS, SAMPLE, BLOCK, ANCHORS, TOGETHER = 16, 512, 2048, 32768, 32
#: Which part of the blocks gives the first thresholds.
FIRST_PART = 16
#: Distances are taken to be off by this part of the norms: far more than their rounding, also as 4-byte floats.
SLACK = 1e-5
LEAST, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCK_SCHEMA = "n int, ids binary, labels binary, vectors binary, distances binary"
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Pivots:
    """Pivots in the augmented space, and the distances of rows and anchors to them."""

    def __init__(self, rows: np.ndarray, square: int, most: int):
        self.square = float(square)
        points = np.column_stack([rows, self.lift(rows)]).astype(np.float64) if len(rows) else np.zeros((1, rows.shape[1] + 1))
        chosen, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < min(most, len(points)) and gap.max() > 0:  # farthest first
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        self.points = points[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square - (x.astype(np.float64) ** 2).sum(axis=1)))

    def to(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        y = np.column_stack([x.astype(np.float64), last])
        return np.sqrt(np.maximum(0.0, (y * y).sum(axis=1)[:, None] - 2 * y @ self.points.T + (self.points**2).sum(axis=1)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self.to(x, self.lift(x))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self.to(q, np.zeros(len(q)))


class Best:
    """The ``k`` best (score, id) of each of ``keys`` questions: higher scores first, then smaller ids. ``floor``: scores that the answer reaches at least."""

    def __init__(self, keys: int, k: int, floor: np.ndarray | None = None):
        self.scores, self.ids = np.full((keys, k), LEAST), np.full((keys, k), NONE)
        self.floor = np.full(keys, LEAST) if floor is None else floor.copy()
        self.k = k

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.floor[keys]
        keys, scores, ids = keys[fits], scores[fits], ids[fits]
        if not len(keys):
            return
        asked = np.unique(keys)
        keys = np.concatenate([np.repeat(asked, self.k), keys])
        scores = np.concatenate([self.scores[asked].ravel(), scores])
        ids = np.concatenate([self.ids[asked].ravel(), ids])
        order = np.lexsort((ids, ~scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        first = np.searchsorted(keys, asked)[:, None] + np.arange(self.k)  # each question has k rows at least: its old ones
        self.scores[asked], self.ids[asked] = scores[first], ids[first]
        self.floor[asked] = np.maximum(self.floor[asked], scores[first[:, -1]])

    def rows(self) -> pa.RecordBatch:
        keys, at = np.nonzero(self.ids != NONE)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(self.scores[keys, at]), pa.array(self.ids[keys, at])], names=["question", "score", "id"])


class Search:
    """One group of anchors against blocks. Without positives it looks for those; with them (windows of scores, one a question) for negatives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, pivots: Pivots):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.distances = pivots.of_anchors(vectors)
        norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.sum_square = norm + pivots.square
        self.off = SLACK * (np.sqrt(norm) + np.sqrt(pivots.square)) + SLACK
        self.k, self.each = 5, 1
        self.low = self.high = self.floor = None

    def ask_positives(self, k: int) -> None:
        self.k, self.each, self.low, self.high, self.floor = k, 1, None, None, None

    def ask_negatives(self, k: int, low: np.ndarray, high: np.ndarray) -> None:
        """``low``, ``high``: for each anchor and positive the scores between which negatives are; an empty window where there is no positive."""
        self.k, self.each, self.low, self.high, self.floor = k, low.shape[1], low, high, None

    def bracket(self, nearest: np.ndarray, farthest: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score for distances of at least ``nearest`` and at most ``farthest``."""
        total, off = (v[anchors].reshape(-1, *[1] * (nearest.ndim - 1)) for v in (self.sum_square, self.off))
        rounding = 1 + total * 1e-12
        return (total - (farthest + off) ** 2) / 2 - rounding, (total - np.maximum(0.0, nearest - off) ** 2) / 2 + rounding

    def wanted(self, least: np.ndarray, greatest: np.ndarray, anchors: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether brackets of ``anchors`` can hold an answer to one of their questions."""
        shape = (-1, *[1] * (least.ndim - 1))
        if self.low is None:
            return greatest >= floor[anchors].reshape(shape)
        low, high = np.maximum(self.low, floor.reshape(-1, self.each))[anchors], self.high[anchors]
        return np.logical_or.reduce([(greatest >= low[:, k].reshape(shape)) & (least <= high[:, k].reshape(shape)) & (low[:, k] <= high[:, k]).reshape(shape) for k in range(self.each)])

    def best(self, blocks: Iterator[tuple[np.ndarray, ...]]) -> Best:
        found = Best(len(self.ids) * self.each, self.k, self.floor)
        everyone = np.arange(len(self.ids))
        for ids, labels, x, own in blocks:
            nearest = np.maximum(0.0, np.maximum(self.distances - own.max(axis=0), own.min(axis=0) - self.distances).max(axis=1))
            farthest = (self.distances + own.max(axis=0)).min(axis=1)
            open_ = np.flatnonzero(self.wanted(*self.bracket(nearest, farthest, everyone), everyone, found.floor))
            for anchors in np.split(open_, range(TOGETHER, len(open_), TOGETHER)):
                if len(anchors):
                    self.meet(anchors, ids, labels, x, own, found)
        return found

    def meet(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, own: np.ndarray, found: Best) -> None:
        """Some anchors and one block: the brackets of all rows, and the exact scores of those that are left."""
        nearest, farthest = np.zeros((len(anchors), len(ids))), np.full((len(anchors), len(ids)), np.inf)
        for p in range(own.shape[1]):
            a, b = self.distances[anchors, p][:, None], own[:, p].astype(np.float64)
            np.maximum(nearest, np.abs(a - b), out=nearest)
            np.minimum(farthest, a + b, out=farthest)
        same = self.labels[anchors][:, None] == labels
        fits = self.wanted(*self.bracket(nearest, farthest, anchors), anchors, found.floor)
        fits &= same & (self.ids[anchors][:, None] != ids) if self.low is None else ~same
        g, r = np.nonzero(fits)
        if not len(g):
            return
        if 8 * len(g) > fits.size:
            scores = products(self.vectors[anchors], x)[g, r]
        else:
            scores = np.einsum("ij,ij->i", self.vectors[anchors[g]], x[r])
        if self.low is None:
            found.add(anchors[g], scores, ids[r])
            return
        for k in range(self.each):
            inside = (scores >= self.low[anchors[g], k]) & (scores <= self.high[anchors[g], k])
            found.add(anchors[g[inside]] * self.each + k, scores[inside], ids[r[inside]])


def usable_rows(rows: DataFrame) -> DataFrame:
    """``id, label, v`` of the rows of ``rows`` (vec_id, label, embedding) that take part; labels of ids that 7 divides are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole(F.col("embedding")).alias("v"))


def pivot_table(rows: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """``BLOCK_SCHEMA``: rows with their distances to the pivots, in blocks of neighbours."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims)
            distances = pivots.of_rows(x).astype("<f4")
            cell = distances.argmin(axis=1)
            near = distances[np.arange(len(x)), cell]
            packed = [pa.array([row.tobytes() for row in y], pa.binary()) for y in (x.astype("<i4"), distances)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *packed, pa.array(cell, pa.int32()), pa.array(near)], names=["id", "label", "vector", "distances", "cell", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            bytes_of = lambda name: b"".join(rows.column(name).to_pylist())
            columns = [len(rows), rows.column("id").to_numpy().astype("<i8").tobytes(), rows.column("label").to_numpy().astype("<i8").tobytes(), bytes_of("vector"), bytes_of("distances")]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["n", "ids", "labels", "vectors", "distances"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield from (packed(rows.slice(k, BLOCK)) for k in range(0, len(rows) - BLOCK + 1, BLOCK))
                held = rows.slice(len(rows) // BLOCK * BLOCK).to_batches()
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held))

    measured = map_batches(rows.select("id", "label", "v"), measure, "id long, label long, vector binary, distances binary, cell int, near float")
    placed = measured.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id")  # ids tell apart what is equally near
    return saved(map_batches(placed.select("id", "label", "vector", "distances"), pack, BLOCK_SCHEMA), "pivot-table")


def blocks_of(batches: Iterator[pa.RecordBatch], dims: int, pivots: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for n, ids, labels, vectors, distances in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i4").reshape(n, dims).astype(np.int64), np.frombuffer(distances, "<f4").reshape(n, pivots)


def searched(blocks: DataFrame, search: Search) -> DataFrame:
    """``question, score, id, place``: the best answers of all blocks to each question of ``search``."""
    sent = blocks.sparkSession.sparkContext.broadcast(search)
    dims, pivots = search.vectors.shape[1], search.distances.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield sent.value.best(blocks_of(batches, dims, pivots)).rows()

    best = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    found = map_batches(blocks, run, "question int, score long, id long")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= search.k)


def first_part() -> Column:
    return F.pmod(F.xxhash64("ids"), F.lit(FIRST_PART)) == 0


def with_floor(blocks: DataFrame, search: Search) -> Search:
    """``search`` with the scores that the k-th answers have in a part of the blocks: those of all blocks reach them."""
    reached = searched(blocks.where(first_part()), search).where(F.col("place") == search.k).select("question", "score").toArrow()  # a row a question of one group
    search.floor = np.full(len(search.ids) * search.each, LEAST)
    search.floor[reached.column("question").to_numpy()] = reached.column("score").to_numpy()
    return search


def groups(anchors: DataFrame, dims: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors in groups of ``size``, one partition of their table at the driver at a time."""
    rows = iter(anchors.toLocalIterator())
    while group := list(itertools.islice(rows, size)):
        vectors = np.zeros((len(group), dims), np.int64)
        for k, r in enumerate(group):
            vectors[k, : len(r.v)] = r.v
        yield np.array([r.id for r in group]), np.array([r.label for r in group]), vectors


def hard_negatives(rows: DataFrame, is_anchor: Column, most_positives: int = 5, most_negatives: int = 10, percent: tuple[int, int] = (30, 90), anchors_each: int = ANCHORS) -> DataFrame:
    """``RESULT_SCHEMA`` for the anchors of ``rows`` (vec_id, label, embedding): those rows for which ``is_anchor`` (of ``id``) holds."""
    spark = rows.sparkSession
    taken = usable_rows(rows)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long"))
    dims, norm = taken.agg(F.max(F.size("v")), F.max(square)).first()
    dims, path = dims or 0, shared_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT_SCHEMA).write.parquet(path)
    if dims:
        sample = taken.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        pivots = Pivots(matrix(sample, dims), norm, PIVOTS)
        blocks = pivot_table(taken, pivots, dims)
        anchors = saved(taken.where(is_anchor), "anchors")
        for ids, labels, vectors in groups(anchors, dims, anchors_each):
            search = Search(ids, labels, vectors, pivots)
            search.ask_positives(most_positives)
            found = searched(blocks, with_floor(blocks, search)).toArrow()  # most_positives rows an anchor of one group
            question, place = found.column("question").to_numpy(), found.column("place").to_numpy() - 1
            positive, score = np.zeros((len(ids), most_positives), np.int64), np.full((len(ids), most_positives), -1)
            positive[question, place], score[question, place] = found.column("id").to_numpy(), found.column("score").to_numpy()
            low, high = np.where(score < 0, 1, -(-percent[0] * score // 100)), np.where(score < 0, 0, percent[1] * score // 100)
            search.ask_negatives(most_negatives, low, high)
            named = answers_named(searched(blocks, with_floor(blocks, search)), ids, positive, score)
            named.write.mode("append").parquet(path)
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def answers_named(found: DataFrame, ids: np.ndarray, positive: np.ndarray, score: np.ndarray) -> DataFrame:
    """``RESULT_SCHEMA`` of the answers to a group's questions."""
    each = positive.shape[1]
    sent = found.sparkSession.sparkContext.broadcast((ids, positive.ravel(), score.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positives, scores = sent.value
        for batch in batches:
            q = batch.column(0).to_numpy()
            columns = [pa.array(anchor[q // each]), pa.array(positives[q]), batch.column(3), batch.column(2), pa.array(scores[q]), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return map_batches(found.select("question", "score", "id", "place"), run, RESULT_SCHEMA)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
