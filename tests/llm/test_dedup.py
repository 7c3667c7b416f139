"""Near duplicates and repeated strings against brute force."""

import collections
import hashlib
import random

import pytest

from ledgerloom.llm import graph, minhash, suffix_dedup


def word_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def expected_components(rows, k):
    ids = [r.doc_id for r in rows]
    sets = word_sets([r.text for r in rows], k)
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and ids[i] is not None and ids[j] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                comp[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in zip(ids, sets, strict=True) if d is not None)


def got_components(df, k):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k, 80).collect() if r.doc_id is not None)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(sample, k):
    assert got_components(sample[0], k) == expected_components(sample[1], k)


def test_near_copies_linked_through_one_original(spark):
    r = random.Random(2)
    base = [f"w{r.randint(0, 900)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):
        copy = base[:]
        for k in r.sample(range(120), r.randint(2, 9)):
            copy[k] = f"n{r.randint(0, 40)}"
        texts.append(" ".join(copy))
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(df, 2) == expected_components(df.collect(), 2)


def test_only_pairs_of_different_components_are_formed(spark):
    r = random.Random(4)
    rows = [(k, r.randint(5, 9), r.choice([0, 0, 0, 0, 1, 2, 3, 4]), r.randint(0, 5), r.randint(4, 9), r.randint(0, 2), r.randint(0, 2)) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, n long, comp long, h long, most long, own int, other int")
    plain = set()
    for a in rows:
        for b in rows:
            if a[0] > b[0] and a[2] != b[2] and a[3] == b[3] and a[5] == b[6] and a[6] == b[5] and b[1] <= a[4] and a[1] <= b[4]:
                plain.add((a[0], b[0]))
    got = [tuple(x) for x in minhash.apart(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain


def test_recall_of_buckets():
    """Pairs at the threshold share a bucket; the chance to miss one is below 2e-8."""
    import numpy as np

    factors = np.random.default_rng(7).integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    r = np.random.default_rng(3)
    found = 0
    for k in range(300):
        size = (9, 45, 180)[k % 3]
        x = minhash.mixed(r.integers(0, 1 << 62, size * 10 // 9, dtype=np.uint64))
        sets = [np.unique(x[:size]), np.unique(x[len(x) - size :])]
        keys = minhash.band_keys(minhash.extremes(sets, factors))
        found += bool((keys[0] == keys[1]).any())
    assert found == 300


def test_odd_documents(odd, nothing):
    assert got_components(odd, 2) == expected_components(odd.collect(), 2)
    none = [r for r in minhash.near_duplicates(odd, 2, 80).collect() if r.doc_id is None]
    assert len(none) == 1 and none[0].kept
    assert minhash.near_duplicates(nothing, 2, 80).count() == 0


def test_min_max_values_estimate_similarity():
    import numpy as np

    factors = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = minhash.mixed(np.arange(1, 1201, dtype=np.uint64))
    e = minhash.extremes([np.sort(x[:1000]), np.sort(x[200:])], factors)
    assert abs((e[0] == e[1]).mean() - 800 / 1200) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 100), (5, 5)], "a long, b long")
    got = {r.id: r.comp for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(71), 0), 200: 100, 100: 100}


def test_difference_covers():
    for q in (2, 3, 5, 7, 11):
        cover, v = suffix_dedup.difference_cover(q), q * q + q + 1
        assert len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


def expected_cuts(rows, length=200):
    texts = [(r.text or "").encode() for r in rows]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i, v in enumerate(cover) if v and (i == 0 or not cover[i - 1]))
        kept = bytes(b for b, v in zip(t, cover, strict=True) if not v)
        out.append((r.doc_id, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_cuts(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(df, **kw).collect()), key=str)


def test_cuts_equal_brute_force(sample):
    assert got_cuts(sample[0]) == expected_cuts(sample[1])


def test_cuts_of_mixed_up_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4000)
    r = random.Random(8)
    blocks = ["".join(r.choice("ab ") for _ in range(r.randint(20, 400))) for _ in range(25)]
    rows = [(k, "".join(r.choice(blocks)[r.randint(0, 10) :] + str(r.random())[:4] * r.randint(0, 1) for _ in range(r.randint(0, 6)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_cuts(df) == expected_cuts(df.collect())
    assert got_cuts(df, length=40, q=5) == expected_cuts(df.collect(), 40)


def test_cuts_of_odd_documents(odd, nothing):
    short = odd.where("doc_id is null or doc_id not in (6, 7)")
    assert got_cuts(short) == expected_cuts(short.collect())
    long = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_strings(odd).collect()}
    assert long[7] >= long[6] - 200 > 0
    assert suffix_dedup.repeated_strings(nothing).count() == 0


def test_texts_with_many_copies_are_gathered_in_steps(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4000)
    r = random.Random(3)
    common = "".join(r.choice("abcdefgh ") for _ in range(500))
    rows = [(k, common) for k in range(40)] + [(100 + k, common[k:] + str(k) * 30) for k in range(10)] + [(200 + k, "".join(r.choice("xyz") for _ in range(300))) for k in range(20)] + [(300, None), (301, ""), (302, "short"), (303, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert got_cuts(df) == expected_cuts(df.collect())
    sent = suffix_dedup.distinct_texts(df, 3, 1 << 20).where("text is not null").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sent <= 4
    assert spark.conf.get("spark.sql.sources.bucketing.maxBuckets") == "100000" and not [t for t in spark.catalog.listTables() if t.name.startswith("loom_texts")]


def test_equal_names_of_different_strings_are_kept_apart(monkeypatch):
    """All names of whole strings agree by force: text without a repeated sample loses nothing."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(600)) for _ in range(6)]
    texts.append(texts[0][:300] + texts[1][100:])
    table = pa.table({"key": [bytes([k]) for k in range(7)], "text": [t.encode() for t in texts], "copies": [1] * 7})
    none = pa.table({"bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    at = suffix_dedup.Hasher.at

    def removed():
        chunk = suffix_dedup.Chunk(table, 200, suffix_dedup.difference_cover(11), 133, (12345, 678))
        positions, names = chunk.sample()
        near = chunk.near(positions[suffix_dedup.Names(names, 4, 5).repeated(none)])
        again = suffix_dedup.Names(suffix_dedup.hasher(200, (12345, 678)).at(chunk.data, near), 4, 8).repeated(none)
        return chunk.results(near[again]).column("n_removed").to_pylist()

    assert removed() == [300, 500, 0, 0, 0, 0, 800]
    monkeypatch.setattr(suffix_dedup.Hasher, "at", lambda self, data, positions: np.full(len(positions), 7, np.uint64) if self.length == 200 else at(self, data, positions))
    assert removed()[2:6] == [0] * 4


def test_packets_grow_as_the_input(monkeypatch):
    for total in (1 << 30, 30 << 30, 1 << 40, 100 << 40):
        chunk, bucket = suffix_dedup.sizes(total)
        packets = (total / chunk) * (total * 12 / 133 * 8 / bucket)
        assert chunk <= 190 << 20 and packets * 64 <= 2.5 * total * 12 / 133


def test_texts_made_to_collide_lose_nothing(spark):
    """Heads whose difference is a polynomial that powers of two divide at every odd base."""
    factors = [(1, 1), (2, 1), (4, 5), (8, 3), (16, 3), (32, 1)]
    difference = [1]
    for k, times in factors:
        for _ in range(times):
            longer = [0] * (len(difference) + k)
            for i, c in enumerate(difference):
                longer[i + k] += c
                longer[i] -= c
            difference = longer
    assert len(difference) == 128 and all(sum(c * pow(b, i, 1 << 64) for i, c in enumerate(difference)) % (1 << 64) == 0 for b in (3, 12345, (1 << 64) - 1))
    heads = ["".join(chr(33 + max(0, sign * c)) for c in difference) for sign in (1, -1)]
    tail = "".join(chr(97 + k * k % 23) for k in range(151))
    texts = [h + tail for h in heads] + [x + h + tail[:80] for h in heads for x in ("q", "zz")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeated_strings(df).collect()}
    places = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 199):
            places.setdefault(t[i : i + 200], []).append((k, i))
    covered = {k: {j for x in places.values() if len(x) > 1 for d, i in x if d == k for j in range(i, i + 200)} for k in range(len(texts))}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in covered.items()}
    two = suffix_dedup.repeated_strings(df.where("doc_id < 2")).collect()
    assert [(r.n_removed, r.n_spans) for r in two] == [(0, 0), (0, 0)]


def test_fingerprints_are_the_polynomials_they_claim_to_be():
    import numpy as np

    r = np.random.default_rng(2)
    data = r.integers(0, 256, 3000).astype(np.uint8)
    monkey = suffix_dedup.Hasher(200, (1234567, 7654321))
    positions = np.unique(r.integers(0, 2800, 50))
    expected = [[sum((int(data[p + k]) + 1) * pow(b, k, q) for k in range(200)) % q for b, q in zip((1234567, 7654321), suffix_dedup.PRIMES, strict=True)] for p in positions.tolist()]
    want = minhash.mixed(np.array([a << 31 | b for a, b in expected], np.uint64))
    assert (monkey.at(data, positions) == want).all()
    assert (suffix_dedup.powers(5, 1000, suffix_dedup.PRIMES[0]) == np.array([pow(5, k, suffix_dedup.PRIMES[0]) for k in range(1000)], np.uint64)).all()
