"""Language identification by compression: the language whose raw-content dictionary encodes a text smallest wins.

Each language's dictionary is text of that language, taken from a bounded sample of labelled rows. Texts are cut
down to lower-case letters and single blanks and compressed by zstandard once for each dictionary; long matches
with a dictionary are what makes one language's size smaller. Where the two smallest sizes are close, which happens with very short
texts and with texts that mostly repeat themselves, the text's distinct words are encoded again at the strongest setting
with the shortest matches, behind a run of one symbol: zstandard stores a block as it is if coding gains too little, and the run makes it
code the words, however few. A margin that stays narrow is a rejection.

Edge cases: a null text or one without a letter is ``und`` with score 0, and rejected; whole texts are encoded,
however long; rows that repeat get the same answer; without any learned language every answer is ``und``; an
empty table gives an empty result; ``fit`` ignores rows with a null language or text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, table, worker_object

UNDETERMINED = "und"
PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Below this relative margin the distinct words are encoded by themselves.
CLOSE = 0.03
#: What stands before them.
RUN = b"\0" * 512
#: Bytes by which a size must differ for the odds to double.
BYTES_FOR_DOUBLE = 2.0

Model = dict[str, bytes]


def letters(text: str) -> str:
    return " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def fit(labelled: DataFrame, *, dictionary_bytes: int = 400 << 10, piece_chars: int = 3000, pieces: int = 400) -> Model:
    """A raw-content dictionary for each ``lang`` of ``labelled`` (``text``, ``lang``).

    About ``pieces`` texts of each language are sampled by a hash of the text, so that copies count once, and
    ``piece_chars`` characters of each are collected: the driver holds at most about ``pieces * piece_chars``
    characters for each distinct label.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, 1 + 1_000_000 * pieces // max(1, n)))]), F.col("lang"))
    sample = known.where(F.pmod("h", F.lit(1_000_000)) < share).groupBy("lang", "h").agg(F.min(F.substring("text", 1, piece_chars)).alias("text"))
    model: dict[str, bytes] = dict.fromkeys(sizes, b"")
    for row in sorted(sample.select("lang", "h", "text").collect(), key=lambda r: (r.lang, r.h)):
        if len(model[row.lang]) < dictionary_bytes:
            model[row.lang] = (model[row.lang] + letters(row.text).encode())[:dictionary_bytes]
    return {lang: content for lang, content in sorted(model.items()) if len(content) >= 8}


class Classifier:
    """Sizes of texts under each dictionary."""

    def __init__(self, model: Model):
        import zstandard as z

        self.langs = list(model)
        self.fast, self.strong = [], []
        for content in model.values():
            for level, matches, to in ((3, {}, self.fast), (19, {"min_match": 3}, self.strong)):
                dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                params = z.ZstdCompressionParameters.from_level(level, window_log=20, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS, **matches)
                dictionary.precompute_compress(compression_params=params)
                to.append(z.ZstdCompressor(dict_data=dictionary, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        sizes = [len(c.compress(data)) for c in self.fast]
        if len(sizes) > 1 and margin(sizes) < CLOSE:
            words = " ".join(dict.fromkeys(text.split()))
            sizes = [len(c.compress(RUN + f" {words} ".encode())) for c in self.strong]
        return sizes

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, float, bool]:
        """Language, score, relative margin, rejected."""
        cut = letters(text) if text else ""
        if not self.langs or not any(map(str.isalpha, cut)):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(cut)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(2 ** ((sizes[best] - s) / BYTES_FOR_DOUBLE) for s in sizes)
        wide = margin(sizes)
        return self.langs[best], score, wide, wide < narrow


def margin(sizes: list[int]) -> float:
    """By how much of the second smallest size the smallest is smaller; 1 with one language."""
    if len(sizes) < 2:
        return 1.0
    first, second = sorted(sizes)[:2]
    return (second - first) / second


def classifier(model: Model) -> Classifier:
    return worker_object(("classifier", hash(tuple(model.items()))), lambda: Classifier(model))


def identify(docs: DataFrame, model: Model, narrow: float = 0.004) -> DataFrame:
    """``PREDICTION_SCHEMA`` for each row of ``docs``; only ``text`` is an input. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: dictionary_bytes for each label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier(shared.value)
        for batch in batches:
            rows = [own.predict(t.as_py(), narrow) for t in batch.column(1)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return map_batches(docs.select("doc_id", "text"), run, PREDICTION_SCHEMA, "classifier")


def keep_identified(docs: DataFrame, model: Model, narrow: float = 0.004) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier(shared.value)
        for batch in batches:
            keep = [not own.predict(t.as_py(), narrow)[3] for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema, "classifier")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The fold that nothing is learned from; rows without an id are in it."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = identify(docs, learned(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
