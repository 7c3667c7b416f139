"""Token store, packing and prefix counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, token_counts, token_store
from ledgerloom.llm.bpe_units import Encoder, load_tokenizer
from ledgerloom.llm.common import shared_path

ALPHABET = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "Z", "é", "9", "²", "!", "_", "\x1c", "—", "<|endoftext|>", "<|end", "\xa0", "the", "'d", " 's", "İ", "ß", "中", "---", ".", ",", "Σ"]


def fuzz(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def library(name, text):
    return load_tokenizer(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(sample, name):
    e = Encoder(name)
    for text in fuzz(3000) + [r.text for r in sample[1]][:60]:
        assert e.encode(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_give_the_librarys_ids(sample, name):
    e, r = Encoder(name), random.Random(8)
    few = [a for a in ALPHABET if not a.startswith("<|endof")] + ["\x01", "\n\n", "\r\n", " \n", "\u3000", "я"] + [" "] * 20
    texts = fuzz(3000) + ["".join(r.choice(few) for _ in range(r.randint(0, 16))) for _ in range(6000)] + [t.text for t in sample[1]][:60]
    got = e.encode_all(pa.array(["before", *texts]).slice(1), 7)
    for text, ids in zip(texts, got.to_pylist(), strict=True):
        assert ids == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 7], text
    assert len(e.encode_all(pa.array([], pa.string()), 7)) == 0


def test_words_of_a_batch_are_looked_up_once(spark, monkeypatch):
    from ledgerloom.llm import bpe_units

    asked = []

    class Counting(bpe_units.PieceCache):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

        def get(self, piece, *default):
            asked.append(piece)
            return super().get(piece, *default)

    monkeypatch.setattr(bpe_units, "PieceCache", Counting)
    monkeypatch.setattr(token_store, "encoder", Encoder)
    monkeypatch.setattr(token_store, "map_batches", lambda df, run, *_: run)
    texts = [f"Nine words, all of them alike,\nbut number {k}." for k in range(400)]
    run = token_store.encode_documents(spark.createDataFrame([(1, "")], "doc_id long, text string"))
    (out,) = run([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])])
    assert out.column(1).to_pylist() == [[*library("byte_bpe_50k.json", t), 0] for t in texts]
    assert len(asked) < 8 * len(texts)  # 13 pieces a text


def test_cache_stays_bounded():
    from ledgerloom.llm.bpe_units import PieceCache

    cache = PieceCache(str.encode, stay=3, recent=2)
    assert cache.join([str(k) for k in range(50)] * 2) == "".join(str(k) for k in range(50)).encode() * 2
    assert len(cache) == 3 and len(cache.recent) <= 2


def test_prefix_counts_are_exact_at_every_prefix():
    counter = token_counts.PrefixCounter("byte_bpe_50k.json")
    for text in fuzz(800):
        got = np.cumsum(np.frombuffer(counter.deltas(text), np.int8), dtype=np.int64).tolist()
        assert got == [counter.library_count(text[: k + 1]) for k in range(len(text))], text


def test_counts_answer_budgets(spark):
    text = "The quick brown fox, it's <|endoftext|> here.\n\n  'll"
    df = token_counts.prefix_token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    tok = load_tokenizer("byte_bpe_50k.json")
    counts = [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    row = df.select(token_counts.tokens_at("prefix_deltas", F.lit(9)).alias("at"), token_counts.longest_prefix_within("prefix_deltas", F.lit(5)).alias("fits"), "n_tokens").first()
    assert row.at == counts[9] and row.fits == max(k for k, c in enumerate(counts) if c <= 5) and row.n_tokens == counts[-1]


def test_token_counts_of_odd_texts(odd, nothing):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.prefix_token_counts(odd).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), len(library("byte_bpe_50k.json", r.text))) for r in odd.collect()), key=str)
    assert token_counts.prefix_token_counts(nothing).count() == 0


def check_offsets(offsets, df):
    """Rows in the order of their starts: gapless, ids ascend (nulls first), and each row's ids are the library's."""
    got = sorted((r.start, r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in offsets.collect())
    ends = np.cumsum([0, *(n for *_, n, _ in got)]).tolist()
    assert [g[0] for g in got] == ends[:-1]
    assert [g[1:3] for g in got] == sorted(g[1:3] for g in got)
    blobs = [(r.doc_id, np.array([*library("byte_bpe_50k.json", r.text), 0], "<u4").tobytes()) for r in df.collect()]
    assert sorted(g[1:] for g in got) == sorted((d is not None, d or 0, len(b) // 4, zlib.crc32(b)) for d, b in blobs)


def check_store(spark, df):
    path = shared_path(spark, "store-test")
    token_store.write_token_store(df, path)
    check_offsets(token_store.token_offsets(token_store.read_token_store(spark, path)), df)
    return path


def test_store_round_trip(spark, sample, odd, nothing):
    path = check_store(spark, sample[0])
    check_store(spark, odd)
    check_store(spark, nothing)
    some = token_store.read_token_store(spark, path, [3, 7])
    assert sorted(r.doc_id for r in some.collect()) == [3, 7]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_a_common_id_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(token_store, "file_count", lambda n: 6)
    rows = [(7, f"text {k} of many") for k in range(300)] + [(None, f"none {k}") for k in range(100)] + [(k, "few") for k in range(20)] + [(7, "text 1 of many")] * 3
    path = check_store(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.file for r in token_store.read_token_store(spark, path).where("doc_id = 7").collect()}) > 1


def test_files_are_ordered_by_their_documents(spark):
    from pyspark.sql import Row

    names = {99998: [1, 2], 99999: [3, 4], 100000: [5, 6], 100001: [7]}
    store = spark.createDataFrame([Row(doc_id=d, tokens=[d] * (d + 1), file=f"part-{k}.orc") for k, ids in names.items() for d in ids], "doc_id long, tokens array<int>, file string")
    got = [(r.doc_id, r.start) for r in token_store.token_offsets(store).orderBy("doc_id").collect()]
    assert got == [(d, sum(e + 1 for e in range(1, d))) for d in range(1, 8)]
    assert [token_store.file_count(n) for n in (0, 1, 1 << 30, 30 << 30)] == [1, 1, 64, 702] and 300_000 < token_store.file_count(100 << 40) <= 409_600


def test_store_has_indexes_and_bloom_filters(spark):
    rows = spark.range(0, 60_000, 2, 1).select((F.col("id") * 7919 % 1_000_003).alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    path = shared_path(spark, "store-test")
    token_store.write_token_store(rows, path, stripe_mb=1)
    java = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    file = next(r.file for r in spark.read.orc(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect())
    reader = java.org.apache.orc.OrcFile.createReader(java.org.apache.hadoop.fs.Path(file), java.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() > 1 and str(reader.getCompressionKind()) == "ZSTD"
    scan = reader.rows()
    for stripe in reader.getStripes():
        kinds = {(str(x.getKind()), x.getColumn()) for x in scan.readStripeFooter(stripe).getStreamsList()}
        assert ("BLOOM_FILTER_UTF8", 1) in kinds and {("ROW_INDEX", 1), ("ROW_INDEX", 2)} <= kinds
    assert str(scan.readStripeFooter(reader.getStripes()[0]).getColumns(3).getKind()) == "DIRECT_V2"  # run-length encoded ids
    scan.close()

    def rows_read(ids):
        found = token_store.read_token_store(spark, path, ids)
        n = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        return n, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    there = sorted(r.doc_id for r in rows.collect())
    known = there[len(there) // 2]
    missing = next(x for x in range(known + 1, known + 50) if x not in set(there[len(there) // 2 - 60 : len(there) // 2 + 60]))
    assert rows_read([known]) [0] == 1 and rows_read([known])[1] <= 2000 < len(there)
    assert rows_read([missing]) == (0, 0)  # within the bounds of its rows: only the Bloom filter can tell


def placed(df):
    rows = packing.pack_documents(df).collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*library("word_bpe_49k.json", r.text), 1], "<u4"))
    for r in rows:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    return len(by), sum(r.length for r in rows)


def test_packing_is_whole_gapless_and_tight(sample, odd, nothing):
    used, total = placed(sample[0])
    assert used <= -(-total // 4096) + 1
    placed(odd)
    assert packing.pack_documents(nothing).count() == 0


def test_plan_places_every_piece():
    r = np.random.default_rng(4)
    for _ in range(20):
        h = np.zeros(257, np.int64)
        for length in r.integers(1, 257, 12):
            h[length] += r.integers(1, 400)
        groups = packing.plan_patterns(h, 256)
        got = np.zeros_like(h)
        for pattern, n in groups:
            assert n > 0 and sum(a * k for a, k in pattern) <= 256
            for a, k in pattern:
                got[a] += k * n
        assert (got == h).all()
        best = -(-int((h * np.arange(257)).sum()) // 256)
        halves = int(h[129:].sum())
        assert sum(n for _, n in groups) <= max(best, halves) * 1.35 + 2


def test_sequences_hold_the_ids(spark, sample):
    docs = sample[0].limit(20)
    placed_rows = packing.pack_documents(docs)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(docs, placed_rows).collect()}
    for r in placed_rows.collect():
        assert zlib.crc32(bytes(seqs[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)])) == r.ids_crc32
