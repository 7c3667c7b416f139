"""Tokenizing by cached pieces.

A byte-level BPE never merges across the pieces into which its pre-tokenizer cuts a text, so a text's
ids are the ids of its pieces in order. Natural text repeats its pieces, and asking the tokenizers
library once for each distinct piece is several times faster than handing it whole texts. Texts with
characters outside the alphabets listed here go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.common import tokenizer_path, worker_object

# Unicode White_Space; letters and numbers below U+02B0; endings that the GPT-2 pattern cuts off.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_NOT_BLANK = SPACE.replace(" ", "")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
ENDING = "'(?:s|t|re|ve|m|ll|d)"

#: A character whose class the patterns above don't settle.
UNLISTED = re.compile("[^\x00-\u02af\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff\u2500-\u259f]")
#: A run of white space goes with what follows it: only there does the cut depend on the next character.
UNIT = re.compile(f"[{SPACE}]*[{LETTER}]+|{ENDING}|[{SPACE}]*[{SPACE_NOT_BLANK}]{ENDING}|[{SPACE}]*[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]*[{NUMBER}]+|[{SPACE}]+")
#: Where a piece may go on across a blank: it stands between two white spaces, or behind one at the end.
INNER_BLANK = f"[{SPACE}] (?:[{SPACE}]|$)"
#: Marks words that have no blank before them.
JOINED = "\x01"
#: Where else pieces begin, and what is put there: at marks behind letters, around a line break before a letter, at other line breaks; the last two behind anything that isn't white space.
CUTS = (
    (f"([{LETTER}])([.,;:!?])", rf"\1 {JOINED}\2"),
    (f"([^{SPACE}])\n([{LETTER}])", f"\\1 {JOINED}\n {JOINED}\\2"),
    (f"([^{SPACE}{JOINED}])\n", f"\\1 {JOINED}\n"),
)
#: White space and a word: a last blank goes with the word, any other last character stands alone.
SPACED = re.compile(f"([{SPACE}]*)([{SPACE}])([{LETTER}]+|[{NUMBER}]+)")
#: For tokenizers that drop white space, words are the pieces; str.split() also cuts at these control characters.
UNLISTED_WORD = re.compile(UNLISTED.pattern + "|[\x1c-\x1f]")


def load_tokenizer(name: str):
    """The tokenizer of a ``.json`` file, without truncation or padding and on one thread: tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCache(dict):
    """piece -> value, with bounded memory: the first pieces stay, the others live in a part that is emptied when full."""

    def __init__(self, make: Callable[[str], bytes], stay: int = 300_000, recent: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.stay, self.most_recent, self.longest, self.recent = make, stay, recent, longest, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.recent.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > self.longest:
                return value
            if len(self) < self.stay:
                self[piece] = value
            else:
                if len(self.recent) >= self.most_recent:
                    self.recent.clear()
                self.recent[piece] = value
        return value

    def join(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def as_letters(piece: str) -> str:
    """A piece in the vocabulary's letters."""
    if piece.isascii() and piece[1:].isalpha():
        return piece.replace(" ", BYTE_LETTERS[32])
    return piece.encode().decode("latin-1").translate(BYTE_LETTERS)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, by the tokenizers library without added special tokens.

    Texts are cut into pieces here and the library's model encodes each distinct piece. For a tokenizer that
    drops white space (and lower-cases), words are looked up first and what a new word consists of after that.
    """

    #: Pieces that the pre-tokenizer leaves whole.
    whole = re.compile(f" ?(?:[{LETTER}]+|[{NUMBER}]+|[^{SPACE}{LETTER}{NUMBER}]+)")
    parts = re.compile(f"[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+").findall

    def __init__(self, name: str):
        self.tokenizer = load_tokenizer(name)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = self.tokenizer.normalizer is not None
        self.odd = UNLISTED_WORD if self.by_word else UNLISTED
        self.cache = PieceCache(self.word) if self.by_word else PieceCache(self.unit, 500_000, 300_000)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(as_letters(piece))]).tobytes()

    def unit(self, unit: str) -> bytes:
        if (unit.isascii() and unit.isalpha()) or self.whole.fullmatch(unit):
            return self.piece(unit)
        if spaced := SPACED.fullmatch(unit):
            before, last, word = spaced.groups()
            return (self.ids(before) if before else b"") + self.cache.join([" " + word] if last == " " else [last, word])
        return self.ids(unit)

    def word(self, word: str) -> bytes:
        parts = self.parts(word)
        if len(parts) == 1:
            return self.piece(word)
        return self.ids(word) if "'" in word else self.cache.join(parts)

    def run(self, text: str) -> bytes:
        """As ``encode``, of a text without special tokens."""
        if self.odd.search(text):
            return self.ids(text)
        return self.cache.join(text.lower().split() if self.by_word else UNIT.findall(text))

    def encode(self, text: str) -> bytes:
        return self.ids(text) if any(s in text for s in self.special) else self.run(text)

    def by_blanks(self, texts: pa.Array) -> pa.Array:
        """Whether each blank of a text begins a piece and no special token reaches across one."""
        cut = pc.invert(pc.match_substring_regex(texts, INNER_BLANK)) if not self.by_word else pa.repeat(False, len(texts))
        for kept in (JOINED, *self.special):
            cut = pc.and_not(cut, pc.match_substring(texts, kept))
        return cut

    def distinct(self, words: list[str]) -> list[bytes]:
        """The ids of words as ``encode_all`` cuts them."""
        words = [w[1:] if w[:1] == JOINED else " " + w for w in words]
        # Letters are one piece; other words may have several.
        return [known or (self.cache[w] if w[1:].isalpha() else self.run(w)) for w, known in zip(words, map(self.cache.get, words), strict=True)]

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Each text's ids, followed by ``end_id``. Arrow cuts the texts at blanks, marks and line breaks, and numbers the words; each distinct word of a batch is looked up once."""
        whole = [(None, t) if cut else (t, "") for t, cut in zip(texts.to_pylist(), self.by_blanks(texts).to_pylist(), strict=True)]
        text = pa.array([t for _, t in whole], pa.string())
        for pattern, cuts in CUTS:
            text = pc.replace_substring_regex(text, pattern, cuts)
        words = pc.split_pattern(text, " ")
        at = words.offsets.to_numpy()
        numbered = words.flatten().dictionary_encode()
        codes, names = numbered.indices.to_numpy().copy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        blobs = self.distinct(names)
        # A text's first word has no blank before it; a text that isn't cut stands in its place.
        codes[at[:-1]], first = len(blobs) + np.arange(len(texts)), codes[at[:-1]]
        blobs += [self.run(names[k]) if t is None else self.encode(t) for k, (t, _) in zip(first.tolist(), whole, strict=True)]
        blobs.append(np.array([end_id], dtype="<u4").tobytes())
        codes = np.insert(codes, at[1:], len(blobs) - 1)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        of_words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))
        ids = of_words.take(pa.array(codes))
        offsets = ids.offsets.to_numpy()[np.concatenate(([0], at[1:] + np.arange(1, len(texts) + 1)))]
        return pa.ListArray.from_arrays(pa.array(offsets), ids.values)


def encoder(name: str) -> Encoder:
    """One for each Python worker."""
    return worker_object(("encoder", name), lambda: Encoder(name))
