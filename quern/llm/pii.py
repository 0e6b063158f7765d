"""Surrogates for personal data: keyed, of the same type, gender, script and format.

Entities are found by format, and brought to a normal form first: a phone number's
country code and its significant digits, an address's octets, a mail address in
lower case, a name's parts.  The normal form's free characters pass a keyed
permutation that moves every value, so different entities always get different
surrogates, no entity keeps its own, and all spellings of one entity get one
surrogate, each in its own layout.  Check digits are made valid again, or kept
invalid.  Names are found by a form of address or by a known given name, with all
capitalised parts and small words that follow; whoever is named so once in a text is
replaced throughout it, also where a part of the name stands alone.  A check over all distinct entities of the table counts merged
and split ones; if there were any, all surrogates would be drawn anew.

The key is the caller's.  Defined results: a null text stays null and an empty one
empty, without entities; repeated rows are changed alike; other columns are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import documents_schema, only, slices, stored, text_buffers

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
FEMALE = ("Alice", "Anna", "Carmen", "Clara", "Elena", "Emma", "Eva", "Helena", "Ines", "Irene", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera", "Mary", "Linda", "Susan", "Karen", "Marie", "Sophie", "Claire")
MALE = ("Adam", "Alex", "Anton", "Bruno", "Carlos", "Daniel", "David", "Emil", "Felix", "Hugo", "Ivan", "Jakob", "James", "Jan", "John", "Jorge", "Karl", "Leo", "Luis", "Marco", "Martin", "Max", "Oscar", "Otto", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor")
HONORIFICS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme")
#: Telephone country codes of one and of two digits; all others have three.
SHORT_CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _letters(test) -> str:
    """Letters of the Latin, Greek and Cyrillic scripts that pass the test."""
    return "".join(c for a, b in ((0x41, 0x250), (0x370, 0x530)) for c in map(chr, range(a, b)) if c.isalpha() and test(c))


_UPPER, _LOWER = _letters(str.isupper), _letters(str.islower)


def _kinds() -> dict[str, str]:
    """Of each small letter: letters it may become: of its script, vowels or consonants, plain or marked."""
    groups: dict[tuple, list[str]] = {}
    for c in (x for x in _LOWER if ord(x) < 0x180 or 0x3B0 < ord(x) < 0x3CA or 0x42F < ord(x) < 0x460):
        base = unicodedata.normalize("NFD", c)[0]
        plain = base == c and (c in LETTERS or ord(c) > 0x180)
        if len(c.upper()) == 1 and c.upper().lower() == c and (plain or base != c):
            script = unicodedata.name(c).split()[0]
            groups.setdefault((script, base in "aeiouаеиоуыэюяαεηιουω", plain), []).append(c)
    return {c: "".join(g) for g in groups.values() if len(g) > 1 for c in g}


KINDS = _kinds()
#: Small words inside names.
PARTICLES = ("al", "ben", "bin", "d", "da", "de", "del", "den", "der", "di", "dos", "du", "el", "la", "le", "ten", "ter", "van", "von", "y", "zu", "zum", "zur")
_PIECE = f"(?:[{_UPPER}]['’])?[{_UPPER}][{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)*"
_NAME = f"{_PIECE}(?:-{_PIECE})*"
_MORE = f"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME})"
_GIVEN = "|".join(sorted({*FEMALE, *MALE}, key=len, reverse=True))
_CAPITALS = f"[{_UPPER}]['’]?[{_UPPER}]+(?:-[{_UPPER}]+)*"
_EDGE = f"(?![{_UPPER}{_LOWER}0-9_])"
#: In order: where two overlap, the earlier kind stays.
FORMATS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\(0\)[ .-]?)?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)")),
    ("name", re.compile(rf"(?:\b(?:{'|'.join(HONORIFICS)})\.?{_MORE}+|\b(?:{_GIVEN}){_MORE}+|\b(?:{_GIVEN.upper()})(?: {_CAPITALS})+){_EDGE}")),
)
_WORD = re.compile(rf"(?<![{_UPPER}{_LOWER}0-9_]){_NAME}{_EDGE}")
_MARKS = re.compile(b"(?:" + b"|".join(h.encode() for h in (*HONORIFICS, *FEMALE, *MALE, *map(str.upper, (*FEMALE, *MALE)))) + b")[ .]")
#: Values of at most so many kinds are moved along a keyed circle, others by a Feistel network.
SMALL = 4096


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def phone_parts(text: str) -> tuple[str, str, int]:
    """Country code ("" if not given), significant digits, and how many digits of the text stand before these."""
    digits = re.sub(r"[^0-9]", "", text)
    code = ""
    if text.startswith("+"):
        code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
    rest = digits[len(code) :]
    own = rest.lstrip("0")
    return code, own, len(digits) - len(own)


def _valid(kind: str, text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "phone":  # a country code, brackets, or the three-three-four form
        return 8 <= len(digits) <= 15 and len(phone_parts(text)[1]) > 2 and (text[0] in "+(" or bool(re.fullmatch(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", text)))
    if kind == "iban":
        plain = text.replace(" ", "")
        return plain[2:4] == iban_check(plain[:2], plain[4:])
    return True


def _given_part(text: str) -> list[str]:
    """The parts of a name without its form of address."""
    parts = text.split(" ")
    return parts[1:] if parts[0].rstrip(".") in HONORIFICS else parts


def _subparts(text: str) -> list[str]:
    return [p for part in _given_part(text) for p in part.split("-")]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps; names include their later bare mentions."""
    found: list[tuple[int, int, str]] = []
    taken = np.zeros(len(text) + 1, bool)

    def add(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            s, e = m.span()
            if _valid(kind, m[0]) and not taken[s:e].any():
                taken[s:e] = True
                found.append((s, e, kind))

    for kind, pattern in FORMATS:
        add(pattern, kind)
    if known := {p for s, e, kind in found if kind == "name" for p in _subparts(text[s:e])}.difference(PARTICLES):
        for m in _WORD.finditer(text):
            if not taken[m.start()] and not known.isdisjoint(m[0].split("-")):
                found.append((*m.span(), "name"))
    return sorted(found)


def normal(kind: str, text: str) -> str:
    """What all spellings of an entity share."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "phone":
        code, own, _ = phone_parts(text)
        return f"{code}|{own}"
    if kind == "name":
        return " ".join(_subparts(text))
    return re.sub(r"[^0-9A-Za-z]", "", text)


def ip_class(octets: list[int]) -> int:
    """0 for public addresses, else the private or reserved block."""
    a, b = octets[:2]
    blocks = (a == 10, a == 127, (a, b) == (192, 168), a == 172 and 16 <= b < 32, a == 0 or a > 223)
    return blocks.index(True) + 1 if any(blocks) else 0


class Surrogates:
    """Keyed permutations of entities without fixed points."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=50_000)(self._of)
        self._circle = lru_cache(maxsize=256)(self._circle_of)

    def _number(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest() * 2, "big")

    def _circle_of(self, kind: str, n: int) -> list[int]:
        """The next of each of n numbers in an order drawn by the key."""
        order = sorted(range(n), key=lambda i: self._number(kind, n, i))
        out = [0] * n
        for a, b in zip(order, order[1:] + order[:1]):
            out[a] = b
        return out

    def _rounds(self, kind: str, sides: list[int], sizes: list[int], sign: int) -> None:
        for k in range(8) if sign > 0 else range(7, -1, -1):
            to = k % 2
            sides[to] = (sides[to] + sign * self._number(kind, k, sides[1 - to], *sizes)) % sizes[to]

    def moved(self, kind: str, values: list[int], radices: list[int]) -> list[int]:
        """A permutation of all value lists with these radices that keeps none in place.

        Small ones go one step along a circle; for others a Feistel network P
        makes one: back through P, after one step, of where P leads.  Either is
        a single cycle, so steps can be repeated until a wanted value is met.
        """
        half = (len(values) + 1) // 2
        sides, sizes = [0, 0], [1, 1]
        for i, (v, r) in enumerate(zip(values, radices)):
            side = int(i >= half)
            sides[side], sizes[side] = sides[side] * r + v, sizes[side] * r
        total = sizes[0] * sizes[1]
        if total <= SMALL or min(sizes) == 1:
            at = sides[0] * sizes[1] + sides[1]
            at = self._circle(kind, total)[at] if total <= SMALL else (at + 1 + self._number(kind, total) % (total - 1)) % total
            sides = list(divmod(at, sizes[1]))
        else:
            self._rounds(kind, sides, sizes, 1)
            sides = list(divmod((sides[0] * sizes[1] + sides[1] + 1) % total, sizes[1]))
            self._rounds(kind, sides, sizes, -1)
        out = []
        for i in range(len(values) - 1, -1, -1):
            side = int(i >= half)
            sides[side], v = divmod(sides[side], radices[i])
            out.append(v)
        return out[::-1]

    def _lettered(self, kind: str, text: str, classes: dict[str, str], free: list[bool]) -> str:
        """Each free character becomes one of its class; case stays."""
        low = [c.lower() for c in text]
        at = [i for i in range(len(text)) if free[i] and low[i] in classes]
        own = [classes[low[i]] for i in at]
        shape = "|".join([kind, *sorted({c for c in own})])
        new = self.moved(shape, [k.index(low[i]) for i, k in zip(at, own)], [len(k) for k in own]) if at else []
        out = list(text)
        for i, k, v in zip(at, own, new):
            out[i] = k[v].upper() if text[i].isupper() else k[v]
        return "".join(out)

    def _fill(self, text: str, digits: list[str]) -> str:
        digits = iter(digits)
        return "".join(next(digits) if c in DIGITS else c for c in text)

    def _of(self, kind: str, text: str) -> str:
        return getattr(self, f"_{kind}")(text)

    def _email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        free = [True] * len(local) + [False]
        for i, label in enumerate(labels):
            keep = i == len(labels) - 1 or label.lower() == "example"
            free += [not keep] * len(label) + [False]
        return self._lettered("email", text, _PLAIN, free[: len(text)])

    def _card(self, text: str) -> str:
        digits = [c for c in text if c in DIGITS]
        first, body = digits[0], [int(c) for c in digits[1:]]
        if luhn("".join(digits[:-1])) == int(digits[-1]):
            new = first + "".join(map(str, self.moved("card", body[:-1], [10] * (len(body) - 1))))
            return self._fill(text, list(new + str(luhn(new))))
        while True:  # along the cycle until the number is as invalid as it was
            body = self.moved("card0", body, [10] * len(body))
            new = first + "".join(map(str, body))
            if luhn(new[:-1]) != int(new[-1]):
                return self._fill(text, list(new))

    def _iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        rest = self._lettered("iban", plain[4:], _PLAIN, [True] * (len(plain) - 4))
        new = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
        return "".join(c if c == " " else next(new) for c in text)

    def _ip(self, text: str) -> str:
        parts = text.split(".")
        octets = [int(x) for x in parts]
        block = ip_class(octets)
        if block in (1, 2, 3):
            keep = 2 if block == 3 else 1
            new = octets[:keep] + self.moved(f"ip{block}", octets[keep:], [256] * (4 - keep))
        elif block == 4:
            new = self.moved("ip4", [octets[1] - 16, *octets[2:]], [16, 256, 256])
            new = [172, new[0] + 16, *new[1:]]
        else:
            new = self.moved("ip", octets, [256] * 4)
            while ip_class(new) != block:
                new = self.moved("ip", new, [256] * 4)
        return ".".join(str(n).zfill(len(p) if p[0] == "0" and len(p) > 1 else 0) for n, p in zip(new, parts))

    def _phone(self, text: str) -> str:
        """Country code and leading zeros stay; the significant digits move, whatever the code."""
        _, own, before = phone_parts(text)
        digits = [int(c) for c in own]
        high = digits[0] >= 2
        new = self.moved(f"phone{high}", [digits[0] - 2 if high else 0, *digits[1:]], [8 if high else 1] + [10] * (len(digits) - 1))
        new[0] += 2 if high else 1
        all_digits = [c for c in text if c in DIGITS]
        return self._fill(text, all_digits[:before] + [str(d) for d in new])

    def _ssn(self, text: str) -> str:
        return self._fill(text, [str(d) for d in self.moved("ssn", [int(c) for c in text if c in DIGITS], [10] * 9)])

    def _name(self, text: str) -> str:
        own = _given_part(text)
        head = text.split(" ")[: len(text.split(" ")) - len(own)]
        return " ".join([*head, *("-".join(map(self.part, p.split("-"))) for p in own)])

    def part(self, name: str) -> str:
        """A known given name becomes another of its gender; other names change letter by letter but the last.

        Small words stay, and capitals change as the same name in small letters.
        """
        if name in PARTICLES:
            return name
        if name.isupper() and len(name) > 1 and (plain := name.capitalize()).upper() == name:
            return self.part(plain).upper()
        for gender in (FEMALE, MALE):
            if name in gender:
                return gender[self._circle(gender[0], len(gender))[gender.index(name)]]
        free = [True] * (len(name) - 1) + [False]
        if not any(c in KINDS for c in name[:-1].lower()):
            free[-1] = True
        new = self._lettered("name", name, KINDS, free)
        while new in FEMALE or new in MALE or new in HONORIFICS:  # a made-up name must not be one of the known
            new = self._lettered("name", new, KINDS, free)
        return new


_PLAIN = {c: k for k in (DIGITS, LETTERS) for c in k}


def _worth_reading(column: pa.Array) -> np.ndarray:
    """Rows that can hold an entity: an at sign, four digits, a form of address or a known given name."""
    data, at = text_buffers(column)
    n = len(at) - 1
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    signs = np.concatenate([[0], np.cumsum(data == 64)])
    worth = (digits[at[1:]] - digits[at[:-1]] >= 4) | (signs[at[1:]] > signs[at[:-1]])
    raw = data.tobytes()
    if len(hits := [m.start() for m in _MARKS.finditer(raw)]):
        worth[np.minimum(n - 1, np.searchsorted(at, hits, "right") - 1)] = True
    return worth


def distinct_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, entity, surrogate) of all distinct entities, as keyed digests of their normal forms; names by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in slices(batches, "text"):
            seen = set()
            for i in np.flatnonzero(_worth_reading(batch.column(0))).tolist():
                text = batch.column(0)[i].as_py()
                for s, e, kind in entities(text or ""):
                    old, new = normal(kind, text[s:e]), normal(kind, surrogates.of(kind, text[s:e]))
                    pairs = [p for p in zip(old.split(" "), new.split(" ")) if p[0] not in PARTICLES] if kind == "name" else [(old, new)]
                    seen.update((kind, *(hmac.new(key, x.encode(), hashlib.sha256).hexdigest() for x in pair)) for pair in pairs)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen)], ["kind", "entity", "surrogate"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, entity string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for several entities or for their own, and entities with several surrogates."""
    merged = found.groupBy("kind", F.col("surrogate").alias("value")).count().where("count > 1").withColumn("what", F.lit("merged"))
    split = found.groupBy("kind", F.col("entity").alias("value")).count().where("count > 1").withColumn("what", F.lit("split"))
    same = found.where("entity = surrogate").groupBy("kind", F.col("entity").alias("value")).count().withColumn("what", F.lit("kept"))
    return merged.unionByName(split).unionByName(same)


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None, into: str | None = "entities") -> DataFrame:
    """docs with surrogates in the text; `into` gets (kind, start, end) in the new text, length_col its length."""
    fields = [f for f in docs.schema.fields if f.name != into]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in slices(batches, text_col):
            where = batch.schema.get_field_index(text_col)
            column = batch.column(where)
            texts, found = None, [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(_worth_reading(column)).tolist():
                text = column[i].as_py() or ""
                if own := entities(text):
                    texts = texts or column.to_pylist()
                    out, last, size = [], 0, 0
                    for s, e, what in own:
                        new = surrogates.of(what, text[s:e])
                        out += [text[last:s], new]
                        size += s - last
                        found[i].append({"kind": what, "start": size, "end": size + len(new)})
                        size, last = size + len(new), e
                    texts[i] = "".join([*out, text[last:]])
            columns = list(batch.columns)
            if texts is not None:
                columns[where] = pa.array(texts, column.type)
                if length_col:
                    lengths = batch.schema.get_field_index(length_col)
                    old = columns[lengths].to_pylist()
                    columns[lengths] = pa.array([len(texts[i]) if found[i] else old[i] for i in range(len(old))], columns[lengths].type)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, kind)] if into else [])], [*batch.schema.names, *([into] if into else [])])

    schema = documents_schema(docs, {})
    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(into, spans)]) if into else schema)


def anonymise(docs: DataFrame, key: bytes, text_col: str = "text", attempts: int = 4, **how) -> DataFrame:
    """Check all distinct entities of the table for collisions, then replace them.

    Permutations of normal forms rule collisions out; should the check find any
    all the same, another key is derived and checked.
    """
    for n in range(attempts):
        own = key if n == 0 else hmac.new(key, b"%d" % n, hashlib.sha256).digest()
        if not (wrong := collisions(stored(distinct_entities(docs, own, text_col), "entities")).limit(5).collect()):
            break
        warnings.warn(f"surrogates collide, drawn anew: {[(r['kind'], r['what'], r['count']) for r in wrong]}", stacklevel=2)
    return replaced(docs, own, text_col, **how)


def surrogate_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, entities)."""
    done = anonymise(only(docs, id_col, text_col), key, text_col)
    return done.select(id_col, text_col, F.size("entities").cast("long").alias("n_entities"), "entities")
