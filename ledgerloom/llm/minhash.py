"""Near duplicates by min-max hashing: each permutation gives its minimum and its maximum to the signature.

1. Each document's set of word shingles is hashed under ``permutations`` functions; minimum and maximum of each
   make twice as many signature values, which are banded by fours. Documents with equal sets are one class from
   here on, so exact copies cost nothing more.
2. In each bucket of a band the members are held against one hub, on their full sets: the member with the most company
   over all bands. The links found are joined to components.
3. Documents in buckets that still hold several components are tried once more, exactly: a pair of similar sets
   must share one of its rarest shingles (see ``prefix_pairs``). So no link inside a bucket is lost, while a
   bucket of near copies costs about one comparison a member and not all pairs.

With the defaults (80 permutations, 40 bands of two minima and two maxima) a large pair at the threshold of 0.8 shares no bucket with a
probability of 6e-10; for sets of five, where minimum and maximum agree together less often, it is 1.8e-8.

Edge cases: documents without words (or text) have an empty set and are linked with nothing; documents with fewer
words than a shingle takes have the whole sequence as their one shingle; rows that share a ``doc_id`` are one node;
a null ``doc_id`` never is a representative unless its whole class has none; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, table, whole_text
from ledgerloom.llm.graph import components

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_id binary, bands array<long>"
SET_SCHEMA = "id long, n long, hashes array<long>"
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all their bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingle_set(text: str, words_each: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles; A-Z count as lower case, words end at ASCII white space."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = max(1, len(words) - words_each + 1)
    size = min(len(words), words_each)
    acc = np.full(n, size, U64)
    for k in range(size):
        acc = acc * U64(0xBF58476D1CE4E5B9) + h[k : k + n]
    return np.unique(mixed(acc))


def extremes(sets: list[np.ndarray], factors: np.ndarray, rows: int = 4096) -> np.ndarray:
    """For each set its minima and maxima under each factor, as (sets, factors, 2)."""
    out = np.empty((len(sets), len(factors), 2), U64)
    k = 0
    while k < len(sets):
        if len(sets[k]) > rows:
            parts = [sets[k][i : i + rows, None] * factors for i in range(0, len(sets[k]), rows)]
            out[k, :, 0], out[k, :, 1] = np.min([p.min(0) for p in parts], 0), np.max([p.max(0) for p in parts], 0)
            k += 1
            continue
        end, total = k, 0
        while end < len(sets) and total + len(sets[end]) <= rows:
            total += len(sets[end])
            end += 1
        at = np.cumsum([0, *map(len, sets[k : end - 1])])
        y = np.concatenate(sets[k:end])[:, None] * factors
        out[k:end, :, 0], out[k:end, :, 1] = np.minimum.reduceat(y, at, 0), np.maximum.reduceat(y, at, 0)
        k = end
    return out


def band_keys(values: np.ndarray, per_band: int = 2) -> np.ndarray:
    """One signed 64-bit key for each band of ``per_band`` permutations (twice as many values)."""
    n, perms, _ = values.shape
    bands = values.reshape(n, perms // per_band, per_band * 2)
    acc = np.broadcast_to(np.arange(1, perms // per_band + 1, dtype=U64), bands.shape[:2]).copy()
    for k in range(per_band * 2):
        acc = mixed(acc * U64(0x94D049BB133111EB) + bands[:, :, k])
    return acc.view(np.int64)


def signatures(docs: DataFrame, words_each: int, permutations: int = 80, seed: int = 7) -> DataFrame:
    """``doc_id, n_shingles, set_id, bands``; ``set_id`` (16 bytes) names the whole set and is null where it is empty."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, permutations, dtype=U64) * U64(2) + U64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), words_each) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(extremes(full, factors)).tolist()) if full else iter(())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), sign, SIGNATURE_SCHEMA)


def shingle_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """``id, n, hashes``: the full sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), words_each).view(np.int64) for t in part.column(1)]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], names=["id", "n", "hashes"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), make, SET_SCHEMA)


def similar(n_a: Column, n_b: Column, common: Column, percent: int) -> Column:
    return F.lit(100) * common >= F.lit(percent) * (n_a + n_b - common)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("hashes_a"))
    second = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("hashes_b"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return pairs.join(first, "a").join(second, "b").where(similar(F.col("n_a"), F.col("n_b"), common, percent)).select("a", "b")


def prefix_pairs(placed: DataFrame, sets: DataFrame, percent: int, ratio: float = 1.06) -> DataFrame:
    """All pairs of documents in different components that can be similar, by their rarest shingles; ``placed`` has x, n, comp.

    With sizes n and m, a similar pair shares at least percent * (n + m) / (100 + percent) shingles, so that, in
    any common order, it shares one among the first n - that + 1 of the one and m - that + 1 of the other. In
    the order from rare to common these are shingles that few documents have: copies changed too much to be
    alike meet in none. Sizes are dealt into classes, and a shingle is only offered to the classes for which it
    is early enough.
    """
    docs = placed.select(F.col("x").alias("id"), "n", "comp").distinct()
    own = saved(sets.select("id", F.explode("hashes").alias("h")).join(docs, "id", "left_semi"), "open-shingles")
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "h"))
    size_class = lambda m: F.floor(F.log(m.cast("double")) / F.log(F.lit(ratio))).cast("int")
    early = own.join(often, "h").withColumn("r", rank).where("often > 1").join(docs, "id")
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("r") + 1) * F.lit((100 + percent) / percent) + 1e-9) - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100)
    early = early.withColumn("most", most).where(most >= least)
    offered = saved(early.select("id", "n", "comp", "h", "most", size_class(F.col("n")).alias("own"), F.explode(F.sequence(size_class(least), size_class(F.col("most")))).alias("other")), "early-shingles")
    return apart(offered)


def apart(offered: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``offered`` (id, n, comp, h, most, own, other) that share a shingle, fit each other's size class and are in different components.

    Near copies of one base share its shingles, so most of a key's pairs would be of one component. The components of a key are counted
    first, each once; keys with one go. The others' components get small numbers, and a pair is formed where one number has a bit that the
    other lacks: no pair within a component is ever formed.
    """
    meet = ["h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")]
    keyed = offered.select("id", "n", "comp", "most", "own", "other", *meet)
    key = Window.partitionBy("h", "lo", "hi")
    comps = keyed.select("h", "lo", "hi", "comp").distinct().withColumn("number", F.row_number().over(key.orderBy("comp")) - 1).withColumn("last", F.max("number").over(key)).where("last > 0")
    bits = F.expr("sequence(0, cast(floor(log2(last)) as int))")
    dealt = saved(keyed.join(comps, ["h", "lo", "hi", "comp"]).withColumn("bit", F.explode(bits)).withColumn("there", F.expr("shiftright(number, bit) & 1")).drop("comp", "number", "last"), "crossing-shingles")
    left, right = (dealt.where(F.col("there") == x).select("h", "lo", "hi", "bit", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "most", "own", "other")]) for x in (0, 1))
    fits = (F.col("own_0") == F.col("other_1")) & (F.col("own_1") == F.col("other_0")) & (F.col("n_1") <= F.col("most_0")) & (F.col("n_0") <= F.col("most_1"))
    return left.join(right, ["h", "lo", "hi", "bit"]).where(fits).select(F.greatest("id_0", "id_1").alias("a"), F.least("id_0", "id_1").alias("b")).distinct()


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, comp`` after the components that ``links`` (a, b) join have become one."""
    comp_a, comp_b = comps.select(F.col("rep").alias("a"), F.col("comp").alias("comp_a")), comps.select(F.col("rep").alias("b"), F.col("comp").alias("comp_b"))
    joined = components(saved(links, "links").join(comp_a, "a").join(comp_b, "b"), "comp_a", "comp_b").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return saved(comps.join(joined, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "components")


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, permutations: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is
    the smallest ``doc_id`` that links reach, ``kept`` is true for the document that has it.
    """
    signed = saved(signatures(docs, words_each, permutations), "signatures")
    classes = saved(signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = saved(buckets.join(shared, "bucket"), "bucket-members")
    # The original of a group of near copies is in the largest bucket of most bands; copies differ more from each other than from it.
    weights = crowded.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = saved(crowded.drop("size").join(weights, "rep"), "weighted-members")
    sets = saved(shingle_sets(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), words_each), "shingle-sets")

    order = F.struct(-F.col("weight"), "rep", "n")
    hubs = members.groupBy("bucket").agg(F.min(order).alias("hub")).select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    near = (F.col("rep") != F.col("hub")) & similar(F.col("n"), F.col("hub_n"), F.least("n", "hub_n"), percent)
    starred = members.join(hubs, "bucket").where(near).select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    comps = merged(members.select("rep").distinct().withColumn("comp", F.col("rep")), linked(saved(starred, "pairs"), sets, percent))

    placed = members.join(comps, "rep").select("bucket", F.col("rep").alias("x"), "n", "comp")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    rest = prefix_pairs(saved(placed.join(several, "bucket", "left_semi"), "open-buckets"), sets, percent)
    comps = merged(comps, linked(saved(rest, "pairs"), sets, percent))
    rows = signed.select("doc_id", "n_shingles", "set_id").join(classes.select("set_id", "rep"), "set_id", "left").join(comps, "rep", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=2, percent=80)
