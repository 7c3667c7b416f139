"""Exact token counts at every prefix of a text, by dynamic programming over the byte-level BPE vocabulary.

In a byte-level BPE each prefix of a piece has one encoding; it ends in some token t, and without t it is the
encoding of the shorter prefix. So ``count[i] = count[i - len(t)] + 1``, where t is the one token that ends at i
and may follow the last token of the shorter prefix: the pair, encoded together, stays that pair. Pieces repeat,
so each worker keeps the counts of those it has seen.

The counts of a text are stored as one signed byte for each code point: by how much the exact count of the
prefix that ends there differs from that of the prefix before. Sums of it answer truncation and budget
questions without encoding anything again.

Edge cases: a null or empty text has no bytes, no tokens and no deltas; special strings inside a text count as
the tokenizer's default has it, one token, and the prefixes that end inside such a string as ordinary text; rows that repeat are
counted each; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.llm import bpe_units as U
from ledgerloom.llm.common import map_batches, table, whole_text, worker_object

PREFIX_SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary"

#: As ``bpe_units.UNIT``, for any character.
ANY_UNIT = rf"[{U.SPACE}]*\p{{L}}+|{U.ENDING}|[{U.SPACE}]*[{U.SPACE_NOT_BLANK}]{U.ENDING}|[{U.SPACE}]*[^{U.SPACE}\p{{L}}\p{{N}}]+|[{U.SPACE}]*\p{{N}}+|[{U.SPACE}]+"


class PrefixCounter:
    """Deltas of the exact token counts at all prefixes of texts, by one tokenizer."""

    def __init__(self, name: str):
        import regex

        if not name.endswith(".json"):
            raise ValueError("prefix counts need a byte-level BPE tokenizer (.json)")
        self.tokenizer = U.load_tokenizer(name)
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocabulary))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.any_unit = regex.compile(ANY_UNIT)
        self.blank = re.compile(f"[{U.SPACE}]*")
        self.ending = re.compile(U.ENDING)
        self.plain = re.compile(f"[{U.LETTER}]*")
        self.pairs: dict[int, bool] = {}
        self.heads: dict[str, tuple[list[int], list[int]]] = {}
        self.shared = (8, 5)
        self.cache = U.PieceCache(self.unit, 300_000, 150_000)

    def library_count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the model encodes the two tokens' bytes as these two tokens."""
        known = self.pairs.get(key := first << 20 | second)
        if known is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            both = self.tokenizer.id_to_token(first) + self.tokenizer.id_to_token(second)
            known = self.pairs[key] = [t.id for t in self.tokenizer.model.tokenize(both)] == [first, second]
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one piece that the pre-tokenizer doesn't cut, one for each code point."""
        data = piece.encode()
        letters = U.as_letters(piece)
        number, pairs = self.vocabulary.get, self.pairs.get
        last, count = [0], [0]
        for shared in self.shared:  # many pieces begin alike
            if (head := self.heads.get(letters[:shared])) and len(letters) >= shared:
                last, count = head[0][:], head[1][:]
                break
        for end in range(len(count), len(letters) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = number(letters[begin:end])
                if token is not None and (not begin or pairs(last[begin] << 20 | token) or self.may_follow(last[begin], token)):
                    last.append(token)
                    count.append(count[begin] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if end in self.shared and len(self.heads) < 100_000:
                self.heads[letters[:end]] = last[:], count[:]
        if len(data) == len(piece):
            return count[1:]
        return [c for c, following in zip(count[1:], [*data[1:], 0], strict=True) if following & 0xC0 != 0x80]

    def unit_counts(self, unit: str) -> list[int]:
        """Counts of the prefixes of a run of white space with what follows it, as the library has them for each prefix alone."""
        if unit[0] == " " and self.plain.fullmatch(unit, 1) and len(unit) > 1 or self.plain.fullmatch(unit):
            return self.piece_counts(unit)
        spaces = self.blank.match(unit).end()
        core = unit[spaces:]
        if spaces > 1 or spaces and (unit[0] != " " or not core):
            run = self.piece_counts(unit[:spaces])
            if not core:
                return run
            if self.ending.fullmatch(core):
                return run + [self.library_count(unit[: spaces + k + 1]) for k in range(len(core))]
            # All but the last white space is a piece of its own; a last blank joins the core, another is its own piece.
            base = run[spaces - 2] if spaces > 1 else 0
            if unit[spaces - 1] == " ":
                return run + [base + c for c in self.piece_counts(" " + core)[1:]]
            return run + [base + self.piece_counts(unit[spaces - 1])[0] + c for c in self.piece_counts(core)]
        if self.ending.fullmatch(unit):
            return [self.library_count(unit[: k + 1]) for k in range(len(unit))]
        return self.piece_counts(unit)

    def unit(self, unit: str) -> bytes:
        counts = self.unit_counts(unit)
        steps = [b - a for a, b in zip([0, *counts], counts, strict=False)]
        if steps and not (-128 <= min(steps) and max(steps) <= 127):
            raise ValueError("a prefix's count differs from the one before by more than a signed byte holds")
        return bytes([x & 0xFF for x in steps])

    def ordinary(self, text: str) -> bytes:
        return self.cache.join(self.any_unit.findall(text) if U.UNLISTED.search(text) else U.UNIT.findall(text))

    def deltas(self, text: str) -> bytes:
        """One signed byte for each code point of ``text``."""
        if not any(s in text for s in self.special):
            return self.ordinary(text)
        out, total = b"", 0
        parts = self.at_special.split(text)
        for ordinary, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            out += self.ordinary(ordinary)
            base, before = total, total + self.total(self.ordinary(ordinary))
            for k in range(1, len(special) + 1):
                count = base + self.total(self.ordinary(ordinary + special[:k])) if k < len(special) else total + self.total(self.ordinary(ordinary)) + 1
                out += (count - before).to_bytes(1, "little", signed=True)
                before = count
            total = before
        return out

    @staticmethod
    def total(deltas: bytes) -> int:
        return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


def prefix_counter(name: str) -> PrefixCounter:
    return worker_object(("prefix counter", name), lambda: PrefixCounter(name))


def prefix_token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefix_deltas`` of each row of ``docs``; one narrow pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            deltas = [counter.deltas(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.as_buffer().size for t in texts], pa.int64()), pa.array([counter.total(d) for d in deltas], pa.int64()), pa.array(deltas, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), count, PREFIX_SCHEMA, "prefix counter")


@F.pandas_udf(LongType())
def _tokens_at(deltas: pd.Series, n_chars: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or n is None or n != n else int(np.frombuffer(d, np.int8)[: max(0, int(n))].sum(dtype=np.int64)) for d, n in zip(deltas, n_chars, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def _longest_within(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    def one(d: bytes | None, b: float | None) -> int | None:
        if d is None or b is None or b != b:
            return None
        fits = np.flatnonzero(np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64) <= b)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([one(d, b) for d, b in zip(deltas, budget, strict=True)], dtype="Int64")


def tokens_at(deltas: Column | str, n_chars: Column | str) -> Column:
    """The exact token count of the first ``n_chars`` code points."""
    return _tokens_at(deltas, n_chars)


def longest_prefix_within(deltas: Column | str, budget: Column | str) -> Column:
    """The most code points whose prefix has at most ``budget`` tokens."""
    return _longest_within(deltas, budget)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
