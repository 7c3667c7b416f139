"""Removing repeated byte strings by a difference-cover sample of all suffixes, bounded at the match length.

A difference cover D of period v has, for any two positions i and j, a shift d < v that takes both into the
sample {k : k mod v in D}. Sorting sampled suffixes (the classical algorithm has v = 3 and triples) and deriving the others from them
orders all suffixes; for matches of ``length`` bytes only prefixes of that length matter, so

1. sampled suffixes are named by their first ``length - v + 1`` bytes and the names sorted, across the corpus;
   equal neighbours are repeated names;
2. a suffix whose first ``length`` bytes recur anywhere has, by the property above, a repeated name among the samples
   within v bytes: only those suffixes remain. They are named by their first ``length`` bytes, sorted, and equal
   neighbours are the repeated strings;
3. the strings found so are named once more, by other numbers, and compared again: only what recurs both times is cut.

With v = 133 (the Singer difference set of 12 residues) step 1 sorts 9 % of the positions instead of the two
thirds that triples sample; a whole suffix array of a corpus, with triples and full ranks, writes some twenty times the input to
disk. Names are polynomials of the bytes modulo two primes of 31 bits (of the samples' names the upper 52 bits or more are compared). Each run draws its bases
at random, after the texts are given, and step 3 draws its own. Two different strings of 200 bytes are mistaken for each other in one step
for at most 199 of the 2^31 bases of each prime, whatever their bytes are: with a probability below 1e-14, and about 2^-62 for texts that nobody has
made up for that; powers of two as a modulus would know texts that agree for all bases. A string that is found nowhere else is cut only if steps 2 and 3 both
mistake it: among n strings with a probability below (n 1e-14)^2, and of about (n / 2^62)^2 for usual texts: 4e-17 at 30 GB. Bytes themselves are not sent.

Distinct texts are dealt into chunks of bounded size, in a bucketed table, and each step reads its own chunk again
instead of shuffling text. Texts with many copies are brought together in two steps, so that no task gets one from every task that has it.
Chunks send each name once, as packed sorted integers, to the task that sorts its range,
and get one bit back for each: a string that a third of all documents hold is one name a chunk. Chunks and ranges grow with the square root of
the input: their product, the number of packets, then grows as the input does, and a packet keeps some hundred names.

Edge cases: a null or empty text has no bytes and loses none; a text shorter than ``length`` loses none; a text that
other rows repeat loses all if it is long enough; rows that repeat count as further occurrences; matches never cross documents; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import math
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, shared_path, table, whole_text
from ledgerloom.llm.minhash import mixed

TEXT_SCHEMA = "chunk int, key binary, text binary, copies long"
NAME_SCHEMA = "chunk int, bucket int, names binary"
BIT_SCHEMA = "chunk int, bucket int, bits binary"
TEXT_RESULT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Bytes of text in a chunk and of names in a range at least, and what the product of both is of the input: a packet then has 64 names or more.
CHUNK_BYTES, BUCKET_BYTES, PACKET = 8 << 20, 8 << 20, 320
#: Bytes of a sample's name that are sent.
SAMPLE_BYTES = 6
#: Digests that a task remembers in order to send a repeated text once.
REMEMBERED = 200_000
#: A text whose copies have more bytes (at least; and more than a quarter chunk) is brought together in two steps; so many texts at most, those with the most bytes.
HEAVY_BYTES, MOST_HEAVY = 1 << 20, 250_000
#: Positions that are hashed at once.
SLICE = 1 << 18
U64 = np.uint64
#: The two largest primes of 31 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
Bases = tuple[int, int]


def difference_cover(q: int) -> tuple[int, ...]:
    """The Singer difference set of the prime q: q + 1 residues modulo q*q + q + 1 whose differences are all residues.

    Powers of a generator of GF(q^3) that lie in a plane through 0 over GF(q) have such exponents.
    """
    period, order = q * q + q + 1, q**3 - 1
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        x, cover = (1, 0, 0), []
        for k in range(order):
            if k and x == (1, 0, 0):
                break
            if x[2] == 0 and k < period:
                cover.append(k)
            x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
        else:
            if x == (1, 0, 0) and len({(i - j) % period for i in cover for j in cover}) == period:
                return tuple(cover)
    raise ValueError("q must be a prime")


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """1, base, base^2, ... modulo ``prime``."""
    out = np.ones(n, U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, prime)) % U64(prime)
        done += more
    return out


class Hasher:
    """Fingerprints of all strings of one length: polynomials modulo two primes, side by side, with their bits mixed."""

    def __init__(self, length: int, bases: Bases):
        self.length = length
        self.up = [powers(b, SLICE + length, p) for b, p in zip(bases, PRIMES, strict=True)]
        self.down = [powers(pow(b, -1, p), SLICE, p) for b, p in zip(bases, PRIMES, strict=True)]

    def at(self, data: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Of the strings that begin at ``positions``, which ascend."""
        out = np.empty(len(positions), U64)
        k = 0
        while k < len(positions):
            begin = int(positions[k])
            end = int(np.searchsorted(positions, begin + SLICE))
            part = data[begin : int(positions[end - 1]) + self.length].astype(U64) + U64(1)
            own = positions[k:end] - begin
            both = []
            for up, down, prime in zip(self.up, self.down, PRIMES, strict=True):
                sums = np.zeros(len(part) + 1, U64)
                np.cumsum(part * up[: len(part)], out=sums[1:])  # below 2^58: nothing overflows
                both.append((sums[own + self.length] - sums[own]) % U64(prime) * down[own] % U64(prime))
            out[k:end] = mixed(both[0] << U64(31) | both[1])
            k = end
        return out


class Chunk:
    """The distinct texts of one chunk and the positions that each step names."""

    def __init__(self, rows: pa.Table, length: int, cover: tuple[int, ...], period: int, bases: Bases):
        texts: dict[bytes, bytes] = {}
        copies: dict[bytes, int] = {}
        for key, text, n in zip(*(rows.column(c).to_pylist() for c in ("key", "text", "copies")), strict=True):
            copies[key] = copies.get(key, 0) + n
            if text is not None:
                texts[key] = text
        self.keys = sorted(texts)
        self.texts, self.copies = [texts[k] for k in self.keys], [copies[k] for k in self.keys]
        self.length, self.cover, self.period, self.short, self.bases = length, np.array(cover), period, length - period + 1, bases
        self.starts = np.cumsum([0, *map(len, self.texts)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their names."""
        found = []
        for begin, text in zip(self.starts[:-1].tolist(), self.texts, strict=True):
            if len(text) >= self.length:
                at = (np.arange(0, len(text), self.period)[:, None] + self.cover).ravel()
                found.append(at[at <= len(text) - self.short] + begin)
        positions = np.concatenate(found) if found else np.empty(0, np.int64)
        return positions, hasher(self.short, self.bases).at(self.data, positions)

    def near(self, repeated: np.ndarray) -> np.ndarray:
        """Positions within a period before a repeated sample, where a string of full length fits."""
        change = np.zeros(len(self.data) + 1, np.int32)
        text = np.searchsorted(self.starts, repeated, side="right") - 1
        first = np.maximum(repeated - self.period + 1, self.starts[text])
        last = np.minimum(repeated, self.starts[text + 1] - self.length)
        fits = first <= last
        np.add.at(change, first[fits], 1)
        np.add.at(change, last[fits] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def results(self, repeated: np.ndarray) -> pa.Table:
        """A row for each text, given the positions whose strings of full length recur."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + self.length, -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for key, text, n, begin, end in zip(self.keys, self.texts, self.copies, self.starts[:-1], self.starts[1:], strict=True):
            own = covered[begin:end] if n == 1 or len(text) < self.length else np.ones(len(text), bool)
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            rows.append((key, len(text), int(own.sum()), spans, hashlib.sha256(self.data[begin:end][~own].tobytes()).hexdigest()))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_hashers: dict[tuple[int, Bases], Hasher] = {}


def hasher(length: int, bases: Bases) -> Hasher:
    if (length, bases) not in _hashers:
        if len(_hashers) >= 3:  # those of another run
            _hashers.clear()
        _hashers[length, bases] = Hasher(length, bases)
    return _hashers[length, bases]


def drawn() -> Bases:
    return tuple(2 + secrets.randbelow(p - 3) for p in PRIMES)


class Names:
    """A chunk's names, each once and in order, cut into ranges by their first bits."""

    def __init__(self, names: np.ndarray, range_bits: int, width: int):
        self.distinct, self.inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        self.here = counts > 1
        self.width = width
        self.shift = U64(max(0, 64 - range_bits - 8 * width))  # the range tells the first bits
        tops = (self.distinct >> U64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(self.distinct), np.int64)
        self.cuts = np.searchsorted(tops, np.arange((1 << range_bits) + 1))

    def rows(self, chunk: int) -> pa.Table:
        packed = (self.distinct >> self.shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        full = [b for b in range(len(self.cuts) - 1) if self.cuts[b] < self.cuts[b + 1]]
        blobs = [packed[self.cuts[b] : self.cuts[b + 1]].tobytes() for b in full]
        return pa.table([pa.array([chunk] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "names"])

    def repeated(self, bits: pa.Table) -> np.ndarray:
        """For each name as given, whether it occurs again in this chunk or, by the answers, in another."""
        again = self.here.copy()
        for bucket, blob in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            begin, end = self.cuts[bucket], self.cuts[bucket + 1]
            again[begin:end] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=int(end - begin)).astype(bool)
        return again[self.inverse]


def shared_names(names: DataFrame, width: int) -> DataFrame:
    """For each chunk and range of names one bit a name: whether another chunk sent it too. Sorts the range, compares neighbours."""

    def compare(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in rows.column("names").to_pylist()]
        cuts = np.cumsum([0, *map(len, blobs)])
        values = np.zeros((int(cuts[-1]), 8), np.uint8)
        values[:, :width] = np.concatenate(blobs)
        values = values.view("<u8").ravel()
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        equal = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        bits = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.chunked_array([pa.array(bits, pa.binary())])], names=["chunk", "bucket", "bits"])

    return names.groupBy("bucket").applyInArrow(compare, BIT_SCHEMA)


def once(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text, copies) without what the same task has sent before: a text goes once, and of a key two rows tell that it has copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple[bool, int]] = {}
        for batch in batches:
            at, texts, copies = [], [], []
            for k, (key, text, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)):
                had_text, n_rows = sent.get(key, (False, 0))
                new = text.is_valid and not had_text
                if new or n_rows < 2:
                    at.append(k)
                    texts.append(text.as_buffer().to_pybytes() if new else None)
                    copies.append(n)
                    if key in sent or len(sent) < REMEMBERED:
                        sent[key] = had_text or new, n_rows + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(texts, pa.binary()), pa.array(copies, pa.int64())], names=["key", "text", "copies"])

    return map_batches(rows.select("key", "text", "copies"), run, "key binary, text binary, copies long")


def heavy_keys(docs: DataFrame, least: int) -> DataFrame:
    """The keys of the texts whose copies have the most bytes, and more than ``least``."""
    sized = docs.groupBy(text_key().alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    weight = F.col("n") * F.col("bytes")
    return sized.where((F.col("n") > 1) & (weight > least)).orderBy(weight.desc()).limit(MOST_HEAVY).select("key")


def distinct_texts(docs: DataFrame, chunks: int, total: int) -> DataFrame:
    """``TEXT_SCHEMA``: tasks send a text once; one with many copies goes to as many tasks as the root of theirs, and from there on once more."""
    keyed = docs.select(text_key().alias("key"), whole_text().cast("binary").alias("text"), F.lit(1).cast("long").alias("copies"))
    heavy = F.broadcast(saved(heavy_keys(docs, max(HEAVY_BYTES, sizes(total)[0] // 4)), "heavy-texts"))  # MOST_HEAVY keys of 16 bytes at most
    salts = max(4, math.isqrt(total >> 27))
    gathered = once(keyed.join(heavy, "key", "left_semi")).withColumn("salt", F.spark_partition_id() % salts).repartition("key", "salt")
    rows = once(keyed.join(heavy, "key", "left_anti")).unionByName(once(gathered))
    return rows.select(chunk_of(F.col("key"), chunks).alias("chunk"), "key", "text", "copies")


def chunk_of(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def text_key():
    return F.unhex(F.md5(whole_text()))


@contextlib.contextmanager
def bucketed(rows: DataFrame, chunks: int) -> Iterator[DataFrame]:
    """``rows`` in a table bucketed by ``chunk``, for as long as the context lasts; its files stay in the shared folder."""
    spark, setting = rows.sparkSession, "spark.sql.sources.bucketing.maxBuckets"
    name, before = f"loom_texts_{uuid.uuid4().hex}", spark.conf.get(setting)
    spark.conf.set(setting, max(int(before), chunks))
    try:
        rows.repartition(chunks, "chunk").write.bucketBy(chunks, "chunk").option("path", shared_path(spark, "distinct-texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.set(setting, before)


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a chunk and of a range of names, for an input of ``total`` bytes."""
    root = math.isqrt(PACKET * total)
    return max(CHUNK_BYTES, root), max(BUCKET_BYTES, root)


def repeated_strings(docs: DataFrame, length: int = 200, q: int = 11) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``: what stays of its bytes without repeated strings of ``length``."""
    cover, period = difference_cover(q), q * q + q + 1
    if period > length:
        raise ValueError("the period must not exceed the match length")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes, bucket_bytes = sizes(total)
    chunks = max(1, -(-total // chunk_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20))  # small inputs keep all cores busy
    range_bits = max(4, int(total * len(cover) // period * 8 // bucket_bytes).bit_length())
    bases, others = drawn(), drawn()

    def load(rows: pa.Table) -> Chunk:
        return Chunk(rows, length, cover, period, bases)

    def number(rows: pa.Table) -> int:
        return rows.column("chunk")[0].as_py()

    def of_step(bits: pa.Table, step: int) -> pa.Table:
        return bits.filter(pa.array(bits.column("step").to_numpy() == step))

    def sample_names(rows: pa.Table) -> pa.Table:
        return Names(load(rows).sample()[1], range_bits, SAMPLE_BYTES).rows(number(rows))

    def candidates(chunk: Chunk, bits: pa.Table) -> tuple[np.ndarray, Names]:
        positions, names = chunk.sample()
        near = chunk.near(positions[Names(names, range_bits, SAMPLE_BYTES).repeated(of_step(bits, 1))])
        return near, Names(hasher(length, bases).at(chunk.data, near), range_bits, 8)

    def found_twice(chunk: Chunk, bits: pa.Table) -> tuple[np.ndarray, Names]:
        near, names = candidates(chunk, bits)
        again = near[names.repeated(of_step(bits, 2))]
        return again, Names(hasher(length, others).at(chunk.data, again), range_bits, 8)

    def full_names(rows: pa.Table, bits: pa.Table) -> pa.Table:
        return candidates(load(rows), bits)[1].rows(number(rows))

    def check_names(rows: pa.Table, bits: pa.Table) -> pa.Table:
        return found_twice(load(rows), bits)[1].rows(number(rows))

    def cut(rows: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = load(rows)
        again, names = found_twice(chunk, bits)
        return chunk.results(again[names.repeated(of_step(bits, 3))])

    with bucketed(distinct_texts(docs, chunks, total), chunks) as texts:  # no step below shuffles text
        first = saved(shared_names(texts.groupBy("chunk").applyInArrow(sample_names, NAME_SCHEMA), SAMPLE_BYTES), "sample-bits").withColumn("step", F.lit(1))
        with_bits = lambda bits, step, schema: texts.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(step, schema)
        second = first.unionByName(saved(shared_names(with_bits(first, full_names, NAME_SCHEMA), 8), "string-bits").withColumn("step", F.lit(2)))
        third = second.unionByName(saved(shared_names(with_bits(second, check_names, NAME_SCHEMA), 8), "check-bits").withColumn("step", F.lit(3)))
        results = saved(with_bits(third, cut, TEXT_RESULT), "cut-texts")
    return docs.select("doc_id", text_key().alias("key")).join(results, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents"))
