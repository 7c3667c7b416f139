"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is drawn by HMAC from the entity's canonical form, so every mention of an entity, in any document, gets the
same one (coreference), and only the holder of the key could link it to the original. That no two
entities share a surrogate, and that none is itself an entity of the corpus, is checked over all distinct entities of the corpus: they are
aggregated before they are shuffled, surrogates are grouped, and what collides is drawn again until nothing does.
Names are compared as they are written, without the gender. A name with a title that tells no gender (Dr, Prof) is the entity of
that name whose gender other documents tell; if they tell none or both, it is one of its own. Within a document, the first title
that tells a gender holds for the name. First and last name together are found without a title too, if any document of the corpus gives them one;
a last name alone, in a document that has the whole name, is the last word of that name's surrogate.
The documents are then rewritten in place; only entities with a second draw, a gender from elsewhere or mentions without a title are looked up.
Where drawing again doesn't help, because a format has few forms, later draws are longer; after ``MOST_DRAWS`` the job fails with a message.

Numbers count as card numbers or IBANs only if their check digits hold, and their surrogates' check digits hold too.

Edge cases: a null text stays null, an empty one empty; texts of any length are rewritten whole; rows that repeat are rewritten
alike; an empty table gives an empty result; other columns are ignored by ``surrogate_texts``.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, table

TYPES = ("email", "phone", "card", "ip", "ssn", "iban", "name")
ENTITY_SCHEMA = "kind string, canonical string"
#: The kind of what may be a name without a title: two capitalised words.
MAYBE = "maybe"
TEXT_SCHEMA = "doc_id long, text string, " + ", ".join(f"n_{t} long" for t in TYPES)
#: Entities to look up that are sent to all tasks at once; with more, each text's are joined to it. Both give the same result.
BROADCAST_REDRAWN = 100_000
#: Draws for an entity at most, and after how many of them surrogates become longer by one.
MOST_DRAWS, LONGER_AFTER = 64, 4
SHORTEST_KEY = 16

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
# With a country's code, as in North America, and national ones: pairs of digits, or an area code and a number, behind a zero.
PHONE = re.compile(
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(.])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\w)"
    r"|(?<![\w+.,/-])0[1-9](?:([ .-])\d{2})(?:\1\d{2}){3}(?![\w.-]?\d|\w)|(?<![\w+.,/-])0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,4}(?![\w.-]?\d|\w)"
)
NATIONAL = re.compile(r"(?<!\w)0[1-9]")
CARD = re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{5})(?!\w)")
IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4})?(?![\w:]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?!\w)")
# Forms of address, by the gender they tell.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа", "Κυρία")
EITHER = ("Dr", "Prof")
UPPER, LOWER = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я", "a-zß-öø-ÿά-ώа-яё"
PARTICLES = ("van", "von", "der", "den", "de", "la", "le", "du", "del", "della", "di", "da", "dos", "ten", "ter", "zu", "zum", "al", "el", "bin", "ben")
TITLES = "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))
#: A word of a name: O'Brien, McDonald, Jean-Luc; in capitals only where a title stands before it. A title is none.
PART = rf"(?:[{UPPER}]['’])?[{UPPER}][{LOWER}]+(?:[{UPPER}][{LOWER}]+)?"
NAME_WORD = rf"(?!(?:{TITLES})(?!\w)){PART}(?:-{PART})*"
CAPITALS = rf"(?:[{UPPER}]['’])?[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})*"
SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
TWO_WORDS = re.compile(rf"(?<!\w)(?=({NAME_WORD} {SMALL}{NAME_WORD})(?![\w'’]))")
NAME = re.compile(rf"(?<!\w)((?:(?:{TITLES})\.? )+)({SMALL}(?:{NAME_WORD}(?: {SMALL}{NAME_WORD})?|{CAPITALS}(?: {SMALL}{CAPITALS})?))(?![\w])")
# Syllables of invented names: script -> (openings, vowels, male ends, female ends).
NAME_PARTS = {
    "LATIN": ("b d f g k l m n p r s t v z br dr gr kl st tr".split(), "a e i o u".split(), "n r s t k m l x".split(), "a ia ela ina".split()),
    "CYRILLIC": ("б в г д к л м н п р с т ф бр др гр".split(), "а е и о у".split(), "н р в м л к с т".split(), "а ия ела ина".split()),
    "GREEK": ("β γ δ κ λ μ ν π ρ τ φ χ βρ κλ".split(), "α ε ι ο".split(), "ος ης ας ων".split(), "α η ια ινα".split()),
}

Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def iban_holds(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def detect(text: str, known: Collection[str] = ()) -> list[Span]:
    """(start, end, type, canonical form) of entities that don't overlap: by type (e-mail addresses, IBANs, which may hold a card number's digits, and then as in ``TYPES``), then by place.

    ``known``: names of first and last name that count without a title. A last name alone has the canonical form of the whole name and a mark before it.
    """
    found: list[Span] = []
    taken = bytearray()

    def add(kind: str, start: int, end: int, canonical: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span(), m[0].lower())
    if re.search(r"\d{2}|\d\.\d", text):
        for m in IBAN.finditer(text):
            if 15 <= len(iban := m[0].replace(" ", "").upper()) <= 34 and iban_holds(iban):
                add("iban", *m.span(), iban)
        if "+" in text or "-" in text or "(" in text or NATIONAL.search(text):
            for m in PHONE.finditer(text):
                if len(digits := re.sub(r"\D", "", m[0])) >= 8:
                    add("phone", *m.span(), digits)
        for m in CARD.finditer(text):
            if luhn(digits := re.sub(r"\D", "", m[0])) and len(set(digits)) > 1:
                add("card", *m.span(), digits)
        if ":" in text:
            for m in IPV6.finditer(text):
                if (address := ipv6(m[0])) is not None:
                    add("ip", *m.span(), address)
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add("ip", *m.span(), ".".join(str(int(x)) for x in m[0].split(".")))
        if "-" in text:
            for m in SSN.finditer(text):
                add("ssn", *m.span(), m[0])
    genders: dict[str, str] = {}
    forms: dict[str, set[str]] = {}  # how each name is written
    if any(t + " " in text or t + ". " in text for t in (*MALE, *FEMALE, *EITHER)):
        for m in NAME.finditer(text):
            name = in_mixed_case(m[2])
            forms.setdefault(name, set()).update((m[2], name))
            if genders.get(name, "x") == "x":
                genders[name] = gender_of(m[1])
    if known:
        for m in TWO_WORDS.finditer(text):
            if m[1] in known:
                genders.setdefault(m[1], "x")
                forms.setdefault(m[1], set()).add(m[1])
    whole: dict[str, list[tuple[int, str]]] = {}
    for name, gender in sorted(genders.items(), key=lambda x: (" " not in x[0], -len(x[0]))):
        if " " not in name and name in whole:
            continue
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(f) for f in sorted(forms[name]))})(?!\w)", text):
            add("name", *m.span(), f"{gender}:{name}")
            if " " in name:
                whole.setdefault(name.split()[-1], []).append((m.start(), f"{gender}:{name}"))
    for last, mentions in whole.items():
        mentions.sort()
        for m in re.finditer(rf"(?<!\w){re.escape(last)}(?!\w)", text):
            before = [x for at, x in mentions if at <= m.start()]
            add("name", *m.span(), LAST + (before[-1] if before else mentions[0][1]))
    return sorted(found)


def ipv6(text: str) -> str | None:
    """An IPv6 address in its short form; None for what is none, such as a time of day, and for addresses of fewer than three digits."""
    try:
        return ipaddress.IPv6Address(text).compressed if sum(c != ":" for c in text) >= 3 else None
    except ValueError:
        return None


def in_mixed_case(name: str) -> str:
    """A name in capitals as it is written otherwise."""
    return re.sub(rf"[{UPPER}]{{2,}}", lambda m: m[0].capitalize(), name) if name.isupper() else name


def gender_of(titles: str) -> str:
    """What the first title that tells a gender tells; x if none does."""
    return next((g for t in re.findall(r"[^\s.]+", titles) for g, known in (("m", MALE), ("f", FEMALE)) if t in known), "x")


def maybe_names(text: str) -> set[str]:
    """Pairs of capitalised words."""
    return {m[1] for m in TWO_WORDS.finditer(text)}


#: Before the canonical form of a name of which only the last word is written.
LAST = "~"


class Draw:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.key, self.block, self.left = f"{kind}|{attempt}|{canonical}".encode(), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.block.to_bytes(4, "big") + self.seed, hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def digit(self, least: int = 0) -> str:
        return str(least + self.below(10 - least))

    def like(self, c: str) -> str:
        """A character of the same class: digit, or letter of the same case and script block."""
        if c.isdigit():
            return self.digit()
        if c.isascii() and c.isalpha():
            return chr((97 if c.islower() else 65) + self.below(26))
        if c.isalpha():
            base = ord(c) & ~0x1F
            same = [x for x in map(chr, range(base, base + 32)) if unicodedata.category(x) == unicodedata.category(c)]
            return same[self.below(len(same))]
        return c


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate; ``written`` puts it into a mention's format."""
    d, longer = Draw(key, kind, canonical, attempt), attempt // LONGER_AFTER
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        return "".join(map(d.like, local + "a" * longer)) + "@" + ".".join(["".join(map(d.like, x)) for x in labels[:-1]] + labels[-1:])
    if kind == "phone":
        country = 1 if canonical[0] == "0" else len(canonical) - 10 if len(canonical) > 10 else 0
        return canonical[:country] + d.digit(2) + "".join(d.digit() for _ in range(len(canonical) - country - 1 + longer))
    if kind == "card":
        body = canonical[0] + "".join(d.digit() for _ in canonical[2:])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ip" and ":" in canonical:
        return ipaddress.IPv6Address(bytes([0xFD, *(d.below(256) for _ in range(15))])).compressed
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "ssn":  # areas that are never issued
        return f"9{d.below(100):02}-{1 + d.below(99):02}-{1 + d.below(9999):04}" + "".join(d.digit() for _ in range(longer))
    if kind == "iban":
        body = "".join(map(d.like, canonical[4:]))
        return next(x for n in range(2, 99) if iban_holds(x := f"{canonical[:2]}{n:02}{body}"))
    gender, _, name = canonical.partition(":")
    script = unicodedata.name(name[0]).split()[0]
    openings, vowels, male, female = NAME_PARTS.get(script, NAME_PARTS["LATIN"])
    words_in = name.split()
    longs = [k for k, w in enumerate(words_in) if w not in PARTICLES]
    words = list(words_in)
    for k in longs:
        parts = []
        for part in words_in[k].split("-"):
            stem = "".join(openings[d.below(len(openings))] + vowels[d.below(len(vowels))] for _ in range(2 + longer)) + openings[d.below(14)]
            first, last = k == longs[0], k == longs[-1]
            ends = female if gender == "f" and first else male if gender == "m" or last else male + female
            end = ends[d.below(len(ends))]
            parts.append((part[:2] if part[1:2] in ("'", "’") else "") + (stem + (vowels[d.below(len(vowels))] if end[0] not in vowels else "") + end).capitalize())
        words[k] = "-".join(parts)
    return f"{gender}:{' '.join(words)}"


def written(kind: str, canonical: str, mention: str) -> str:
    """``canonical`` in the format of ``mention``: its separators, its case."""
    if kind in ("phone", "card", "iban"):
        rest = iter(canonical.lower() if mention.islower() else canonical)
        return "".join(next(rest) if c.isalnum() else c for c in mention) + "".join(rest)
    if kind == "email" and mention.isupper():
        return canonical.upper()
    if kind == "name":
        name = canonical.partition(":")[2]
        return name.upper() if mention.isupper() else name
    return canonical


def replaced(text: str, spans: list[Span], key: bytes, special: dict[tuple[str, str], tuple[str, int]]) -> str:
    """``text`` with surrogates; ``special`` has the entity and attempt of canonical forms that aren't their own entity at the first."""
    out, at = [], 0
    for start, end, kind, marked in spans:
        canonical = marked.removeprefix(LAST) if kind == "name" else marked
        entity, attempt = special.get((kind, canonical), (canonical, 0))
        new = written(kind, surrogate(key, kind, entity, attempt), text[start:end])
        out += [text[at:start], new.split()[-1] if marked is not canonical else new]
        at = end
    return "".join(out) + text[at:]


def text_key() -> Column:
    return F.unhex(F.md5("text"))


def entities(docs: DataFrame) -> DataFrame:
    """``kind, canonical, key`` of the mentions, each once a batch and text, and of pairs of words that may be names. ``key`` tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str, bytes]] = set()
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows |= {(k, c.removeprefix(LAST) if k == "name" else c, own) for _, _, k, c in detect(text)} | {(MAYBE, c, own) for c in maybe_names(text)}
            columns = list(zip(*sorted(rows), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["kind", "canonical", "key"])

    return map_batches(docs.select(text_key().alias("key"), "text"), run, ENTITY_SCHEMA + ", key binary")


def with_untitled(found: DataFrame) -> DataFrame:
    """``found`` with the names that have a title somewhere and none here; what only may be a name goes."""
    name = F.col("canonical")
    titled = found.where("kind = 'name'").select(F.regexp_replace(name, "^[mfx]:", "").alias("canonical")).where("canonical like '% %'").distinct()
    untitled = found.where(F.col("kind") == MAYBE).join(titled, "canonical", "left_semi").select(F.lit("name").alias("kind"), F.concat(F.lit("x:"), name).alias("canonical"), "key")
    return found.where(F.col("kind") != MAYBE).unionByName(untitled).distinct()


def drawn(found: DataFrame, key: bytes) -> DataFrame:
    """``found`` (kind, canonical, attempt) with the surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, k, c, a) for k, c, a in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return map_batches(found.select("kind", "canonical", "attempt"), run, ENTITY_SCHEMA + ", attempt int, surrogate string")


def shown(column: str) -> Column:
    """A canonical form as ``written`` shows it: a name without its gender."""
    return F.when(F.col("kind") == "name", F.regexp_replace(column, "^[mfx]:", "")).otherwise(F.col(column))


def resolved(found: DataFrame) -> DataFrame:
    """``kind, canonical, entity`` of the distinct canonical forms: a name of unknown gender is the one of known gender, if there is one such."""
    seen = [F.max((F.col("kind") == "name") & F.col("canonical").startswith(f"{g}:")).alias(g) for g in "mfx"]
    own = found.groupBy("kind", shown("canonical").alias("shown")).agg(*seen)
    genders = F.filter(F.array(*[F.when(F.col(g), f"{g}:") for g in "mfx"]), lambda g: g.isNotNull())
    own = own.withColumn("gender", F.explode(F.when(F.col("kind") == "name", genders).otherwise(F.array(F.lit("")))))
    known = F.when((F.col("gender") == "x:") & F.col("m") & ~F.col("f"), "m:").when((F.col("gender") == "x:") & F.col("f") & ~F.col("m"), "f:").otherwise(F.col("gender"))
    return own.select("kind", F.concat("gender", "shown").alias("canonical"), F.concat(known, "shown").alias("entity"))


def assignment(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, entity, attempt, surrogate`` of all distinct canonical forms; no two entities are written alike."""
    own = saved(resolved(found), "entities")
    current = saved(drawn(own.where("canonical = entity").withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(MOST_DRAWS):
        made = current.withColumn("shown", shown("surrogate"))
        first = made.groupBy("kind", "shown").agg(F.min("canonical").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = made.join(first, ["kind", "shown"]).where("canonical <> first").select("kind", "canonical")
        real = made.join(own.select("kind", shown("canonical").alias("shown")), ["kind", "shown"], "left_semi").select("kind", "canonical")
        clash = saved(twice.union(real).distinct().withColumn("again", F.lit(1)), "collisions")
        if not clash.limit(1).count():
            return own.join(current.withColumnRenamed("canonical", "entity"), ["kind", "entity"])
        moved = current.join(clash, ["kind", "canonical"], "left")
        redrawn = drawn(moved.where("again = 1").withColumn("attempt", F.col("attempt") + 1), key)
        current = saved(moved.where("again is null").select("kind", "canonical", "attempt", "surrogate").unionByName(redrawn), "surrogates")
    raise ValueError(f"after {MOST_DRAWS} draws there are entities without a free surrogate: " + ", ".join(sorted({r.kind for r in clash.select("kind").distinct().collect()})))


def surrogate_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """``TEXT_SCHEMA``: each row's text with surrogates, and how many mentions of each type it had. ``key``: the caller's secret, 16 bytes or more."""
    if len(key) < SHORTEST_KEY:
        raise ValueError(f"the key needs {SHORTEST_KEY} bytes")
    mentions = saved(with_untitled(saved(entities(docs), "entity-mentions")), "titled-mentions")
    untitled = (F.col("kind") == "name") & F.col("canonical").startswith("x:")
    listed = saved(assignment(mentions, key).where((F.col("attempt") > 0) | (F.col("entity") != F.col("canonical")) | untitled).select("kind", "canonical", "entity", "attempt"), "listed-entities")
    rows, few = docs.select("doc_id", "text"), listed.limit(BROADCAST_REDRAWN + 1).collect()
    joined = len(few) > BROADCAST_REDRAWN
    everywhere = Lookup([] if joined else few)
    if joined:
        own = mentions.join(listed, ["kind", "canonical"]).groupBy("key").agg(F.collect_list(F.struct("kind", "canonical", "entity", "attempt")).alias("listed"))  # a text's own
        rows = rows.withColumn("key", text_key()).join(own, "key", "left").select("doc_id", "text", "listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist() if joined else [None] * batch.num_rows, strict=True):
                lookup = Lookup(again or []) if joined else everywhere
                spans = detect(text, lookup.known) if text else []
                texts.append(replaced(text, spans, key, lookup.special) if spans else text)
                counts.append([sum(s[2] == t for s in spans) for t in TYPES])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(TYPES)))], names=["doc_id", "text", *(f"n_{t}" for t in TYPES)])

    return map_batches(rows, run, TEXT_SCHEMA)


class Lookup:
    """Of listed entities: entity and attempt of canonical forms, and the names that count without a title."""

    def __init__(self, listed: Iterable):
        self.special = {(x["kind"], x["canonical"]): (x["entity"], x["attempt"]) for x in listed}
        self.known = {c[2:] for k, c in self.special if k == "name" and c.startswith("x:") and " " in c}


#: The session's setting with the key; the query on the synthetic tables has one of its own.
KEY_SETTING = "spark.ledgerloom.surrogateKey"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None) or "for the synthetic tables only"
    return surrogate_texts(table(spark, sf_dir, "documents"), key.encode())
