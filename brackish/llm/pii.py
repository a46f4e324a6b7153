"""Personal data with exact places, also behind disguises.

Plain identifiers (email, ip, card, phone) are found in the text itself. A second look reads a
normalised text: transducers turn look-alike letters into Latin ones and other scripts' digits
into 0-9, drop invisible characters, write spelled digits as digits, and undo `[at]`, `(dot)` and
their kin. Every step records where its output came from, so what is found there maps back to
code points of the source. Such a find is added if a transducer touched it and no plain find of
its kind holds it.

Defined results: null and empty texts have no spans. Places are code points, the end exclusive.
Texts are scanned whole, in time linear in their length. Repeated rows each get their spans;
columns named like a result are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import small

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like Latin ones, and the words for digits.
_LOOK_ALIKES = dict(
    zip(
        "аеорсухіѕјԁһɡοανρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЅЈ",
        "aeopcyxisjdhgoavpiktuABEZHIKMNOPTYXABEKMHOPCTYXISJ",
        strict=True,
    )
)
_DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_INVISIBLE = "­​‌‍⁠﻿"

_SPELLED = "|".join(_DIGIT_WORDS)
_STEPS = re.compile(
    rf"""(?P<run>(?:\bplus[\x20-]+)?\b(?:(?:{_SPELLED})\b[\x20,.-]{{0,3}}){{7,}})
    |(?P<at>\x20?[\[({{<]\x20?at\x20?[\])}}>]\x20?|(?<=[a-z0-9])\x20at\x20(?=[a-z0-9-]+(?:\x20dot\x20|\x20?[\[({{<]\x20?dot)))
    |(?P<dot>\x20?[\[({{<]\x20?dot\x20?[\])}}>]\x20?|(?<=[a-z0-9])\x20dot\x20(?=[a-z0-9]))
    |(?P<drop>[{_INVISIBLE}]+)
    |(?P<like>[{"".join(_LOOK_ALIKES)}！-～]|(?![0-9])\d)""",
    re.VERBOSE | re.IGNORECASE,
)
_IN_RUN = re.compile(rf"plus[\x20-]+|(?:{_SPELLED})|[\x20,.-]+", re.IGNORECASE)
_MAY_HIDE = re.compile(rf"[^\x00-ɏ‐-‧‰-⁞]|[­]|[\[({{<\x20]dot[\])}}>\x20]|[\[({{<]\x20?at\x20?[\])}}>]|\b(?:{_SPELLED})\b[\x20,.-]{{0,3}}\b(?:{_SPELLED})\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of identifiers as written."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


class Normalised:
    """A text after the transducers, with the source place of each stretch of output."""

    def __init__(self, text: str):
        self.parts, self.at, self.source, self.changed = [], [], [], []
        self.size = done = 0
        for m in _STEPS.finditer(text):
            self._put(text[done : m.start()], done, m.start(), False)
            if m.lastgroup == "run":
                for x in _IN_RUN.finditer(m[0]):
                    word = x[0].lower()
                    new = "+" if word.startswith("plus") else _DIGIT_WORDS.get(word, " ")
                    self._put(new if x.end() < len(m[0]) or new != " " else x[0], m.start() + x.start(), m.start() + x.end(), True)
            elif m.lastgroup == "like":
                self._put(self._latin(m[0]), m.start(), m.end(), True)
            else:
                self._put({"at": "@", "dot": ".", "drop": ""}[m.lastgroup], m.start(), m.end(), True)
            done = m.end()
        self._put(text[done:], done, len(text), False)
        self.text = "".join(self.parts)

    @staticmethod
    def _latin(c: str) -> str:
        if "！" <= c <= "～":
            return chr(ord(c) - 0xFEE0)
        return _LOOK_ALIKES.get(c) or (str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else c)

    def _put(self, new: str, start: int, end: int, changed: bool) -> None:
        if new:
            self.parts.append(new)
            self.at.append(self.size)
            self.source.append((start, end))
            self.changed.append(changed)
            self.size += len(new)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source place of the output from start to end, and whether a transducer touched it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[i][0] + (0 if self.changed[i] else start - self.at[i])
        last = self.source[j][1] if self.changed[j] else self.source[j][0] + end - self.at[j]
        touched = any(self.changed[i : j + 1]) or any(self.source[k][1] != self.source[k + 1][0] for k in range(i, j))
        return first, last, touched


def spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, plain) by start, then kind."""
    if not text:
        return []
    found = plain(text)
    out = [(*x, True) for x in found]
    if _MAY_HIDE.search(text):
        seen = Normalised(text)
        for start, kind, end in plain(seen.text):
            first, last, touched = seen.back(start, end)
            if touched and not any(k == kind and s <= first and last <= e for s, k, e in found):
                out.append((first, kind, last, False))
    return sorted(out)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `pii`: spans of kind, start, end and whether they stand there plainly."""
    kept = [f for f in docs.schema.fields if f.name != "pii"]
    schema = T.StructType([*kept, T.StructField("pii", SPANS)])
    at = [f.name for f in kept].index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in spans(t.as_py())] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scan, schema)


def written(found: Column, only_plain: bool = False) -> Column:
    """Spans as kind:start:end, joined by commas."""
    if only_plain:
        found = F.filter(found, lambda x: x["plain"])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """`found` (of `find`) with every span replaced by its kind in angle brackets; overlapping spans become one.

    Null texts stay null.
    """
    last = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))

    clean = F.when(F.size("pii") > 0, F.aggregate("pii", last, step, finish)).otherwise(F.col(text))
    return found.withColumn(text, clean)
