"""Packing documents into sequences by patterns of lengths, fitted by non-negative least squares.

Only the histogram of piece lengths comes to the driver: ``capacity`` numbers at most, however many documents
there are. There, patterns of up to three different lengths that (almost) fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded, and what the rounded
patterns leave over is packed by best fit on the histogram. The plan says, for each length, which ranks go to
which sequences at which offset. Spark ranks the pieces of each length and places them by the plan.

Edge cases: a null or empty text is one piece that holds the end id alone; a document longer than the capacity
is cut, its last piece may be shorter; rows that repeat are pieces of their own; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe_units import encoder
from ledgerloom.llm.common import map_batches, saved, table, whole_text

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
#: Pieces of one length that one window ranks at most, about.
RANKED_TOGETHER = 200_000


def tokenized_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit integers)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = [(d, k, at // 4, len(blob := ids[at : at + 4 * capacity]) // 4, zlib.crc32(blob), blob) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for ids in (enc.encode(t.as_py()) + end,) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), cut, PIECE_SCHEMA + ", ids binary" * with_ids, "encoder")


def enumerate_patterns(present: np.ndarray, capacity: int, grid: int = 32, slack: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and multiplicities (rows of three, padded with 0) of patterns of ``present`` lengths that leave at most ``slack`` unused.

    The largest length runs over all that are present, the second over a grid of them, the third is the largest that still fits.
    """
    slack = capacity // 64 if slack is None else slack
    below = np.concatenate(([0], np.maximum.accumulate(np.where(np.isin(np.arange(1, capacity + 1), present), np.arange(1, capacity + 1), 0))))
    first = present[present < capacity]
    rows = [np.stack([first, np.zeros_like(first), np.zeros_like(first)], 1)]
    second = np.unique(present[np.linspace(0, len(present) - 1, min(grid, len(present))).astype(int)]) if len(present) else present
    rows.append(np.stack([first, below[capacity - first], np.zeros_like(first)], 1))
    a, b = (x.ravel() for x in np.meshgrid(first, second, indexing="ij"))
    fits = a + b < capacity
    rows.append(np.stack([a[fits], b[fits], below[capacity - a[fits] - b[fits]]], 1))
    times = capacity // np.maximum(first, 1)
    multiple = np.stack([first, below[capacity - first * times], np.zeros_like(first)], 1)
    lengths = np.concatenate([*rows, multiple])
    counts = (lengths > 0).astype(np.int64)
    counts[len(lengths) - len(multiple) :, 0] = times
    used = (lengths * counts).sum(1)
    keep = (used <= capacity) & (used >= capacity - slack)
    return lengths[keep], counts[keep]


def fit_repeats(lengths: np.ndarray, counts: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, where column k of A has pattern k's lengths: accelerated projected gradient."""
    x = np.zeros(len(lengths))
    if not len(x):
        return x
    size = len(histogram)

    def times(v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(lengths[:, j], counts[:, j] * v, size) for j in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(counts[:, j] * r[lengths[:, j]] for j in range(3))

    v = np.ones(len(x))
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * np.linalg.norm(back(times(v))))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


Group = tuple[list[tuple[int, int]], int]


def plan_patterns(histogram: np.ndarray, capacity: int) -> list[Group]:
    """Groups of equal sequences: ([(length, how many in each sequence), ...], how many sequences). ``histogram[n]`` counts pieces of length n.

    Every piece of the histogram has a place in one of the groups.
    """
    left = histogram.astype(np.int64).copy()
    done: list[Group] = []
    #: Unused tokens of a sequence -> groups of sequences that have so many.
    open_: dict[int, list[Group]] = {}
    spaces: list[int] = []

    def put(pattern: list[tuple[int, int]], n: int) -> None:
        space = capacity - sum(length * k for length, k in pattern)
        if not space:
            done.append((pattern, n))
            return
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append((pattern, n))

    lengths, counts = enumerate_patterns(np.flatnonzero(left), capacity)
    repeats = np.ceil(fit_repeats(lengths, counts, left.astype(float)) - 0.05).astype(np.int64)
    for k in np.lexsort((-repeats, -lengths[:, 0])) if len(repeats) else ():
        if repeats[k] > 0:
            pattern: dict[int, int] = {}
            for length, n in zip(lengths[k].tolist(), counts[k].tolist(), strict=True):
                if n:
                    pattern[length] = pattern.get(length, 0) + n
            n = min(int(repeats[k]), *(int(left[length]) // m for length, m in pattern.items()))
            if n > 0:
                put(list(pattern.items()), n)
                for length, m in pattern.items():
                    left[length] -= n * m
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if n >= each:
                    put([(length, each)], n // each)
                if n % each:
                    put([(length, n % each)], 1)
                break
            space = spaces[at]
            pattern, m = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[at]
            each = min(space // length, n)
            taken = min(m, n // each)
            if taken < m:
                put(pattern, m - taken)
            put([*pattern, (length, each)], taken)
            n -= taken * each
    return done + [g for groups in open_.values() for g in groups]


def plan_places(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each run of ranks of one length: ``key`` (length and first rank), first sequence, pieces a sequence, offset of the first."""
    rows, ranks, sequence = [], {}, 0
    for pattern, n in groups:
        offset = 0
        for length, each in pattern:
            rank = ranks.get(length, 0)
            rows.append((length << 40 | rank, sequence, each, offset))
            ranks[length] = rank + n * each
            offset += length * each
        sequence += n
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "sequence", "each", "offset"), columns.T.copy(), strict=True))


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``PIECE_SCHEMA``; read twice, so they should be a table).

    Pieces of a common length are ranked in parts, which the histogram sizes, and each part's ranks begin where those before it end.
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row for each length up to the capacity
        histogram[length] = n
    parts = max(1, int(-(-histogram.max() // RANKED_TOGETHER)))
    places = pieces.sparkSession.sparkContext.broadcast(plan_places(plan_patterns(histogram, capacity)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(plan["key"], length << 40 | rank, side="right") - 1
            k = rank - (plan["key"][at] & (1 << 40) - 1)
            each = plan["each"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(plan["sequence"][at] + k // each), pa.array(plan["offset"][at] + k % each * length)], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked.join(first, ["length", "part"]).select(*names, (F.col("first_rank") + F.col("rank")).alias("rank")), place, PLACED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenize, cut and pack ``docs``; see ``PLACED_SCHEMA``. ``sequences`` makes the sequences' ids of it."""
    return pack_pieces(saved(tokenized_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """``sequence_id, ids`` of packed documents; a sequence has ``capacity`` ids at most, so its group is small."""
    ids = tokenized_pieces(docs, tokenizer, end_id, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    found = placed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").join(ids, ["doc_id", "piece", "ids_crc32"])
    return found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
