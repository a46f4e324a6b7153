"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter gram binds (multiplies) its
letters, each permuted (rotated) by its place; a text or a language bundles (adds) its grams.
A text goes to the language whose prototype has the greatest cosine with the text's bundle.

Bundling is linear, so the product of a text's bundle with a prototype is the sum of the
products of its grams with that prototype; each distinct gram is bound once per slice of rows.
Bound grams are nearly orthogonal, which gives the length of a bundle from its gram counts.

Learning: each task adds up the bundles of its rows per language, Spark adds the tasks. A text's
grams weigh one over their number (and 50), so one long or repetitive text cannot stand for a language. Only
the prototypes (at most `MAX_LANGUAGES` of `DIMENSIONS` numbers) reach the driver.

Defined results: a null, empty or letterless text gets `und` and score 0, as does every text
when nothing could be learned; the first language by name wins a tie. Repeated rows each get
their row; all other columns are kept, and those named like a result are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import small

DIMENSIONS = 2048
MAX_LANGUAGES = 2000
SLICE = 1 << 19
_KEPT_GRAMS = 60_000


@cache
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


class _Letters:
    """Rotated letter vectors, made once per worker from the letter's number."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def of(self, letters: np.ndarray, turn: int) -> np.ndarray:
        found, back = np.unique(letters, return_inverse=True)
        rows = []
        for x in found.tolist():
            if (x, turn) not in self.known:
                if len(self.known) > 20_000:
                    self.known.clear()
                signs = np.random.default_rng([7, x]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
                self.known[x, turn] = np.roll(signs.astype(np.int8), turn)
            rows.append(self.known[x, turn])
        return np.stack(rows)[back]

    def grams(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = ((keys >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0))
        return self.of(a, 2) * self.of(b, 1) * self.of(c, 0)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, grams, row of each gram within the slice)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").lower())
        size += len(held[-1]) + 1
        if size >= SLICE or i == len(texts) - 1:
            yield first, len(held), *_grams(held)
            first, held, size = i + 1, [], 0


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    chars = np.where(_letter_table()[chars], chars, 0).astype(np.uint64)
    keep = np.flatnonzero((chars[1:] != 0) | (chars[:-1] != 0)) + 1
    kept = np.concatenate([np.zeros(1, np.uint64), chars[keep]])
    if len(kept) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    middle = np.flatnonzero(kept[1:-1] != 0) + 1
    grams = (kept[middle - 1] << np.uint64(42)) | (kept[middle] << np.uint64(21)) | kept[middle + 1]
    return grams, np.searchsorted(ends, keep[middle - 1], side="right")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of every language in `labelled`; rows with a null text or language teach nothing."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = _Letters(dimensions), {}
        for batch in small(batches):
            names = np.array(batch.column(1).to_pylist(), object)
            for first, n, grams, rows in _slices(batch.column(0).to_pylist()):
                here = names[first : first + n]
                keys, back = np.unique(grams, return_inverse=True)
                share = 1 / (np.bincount(rows, minlength=n) + 50.0)[rows]
                for name in set(here):
                    own = here[rows] == name
                    weights = np.bincount(back[own], share[own], len(keys))
                    vector = total.setdefault(name, np.zeros(dimensions))
                    some = np.flatnonzero(weights)
                    for i in range(0, len(some), 2000):
                        part = some[i : i + 2000]
                        vector += weights[part].astype(np.float32) @ letters.grams(keys[part]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"lang": list(total), "bundle": [v.tolist() for v in total.values()]}, pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.float64()))]))

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(bundle, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.limit(MAX_LANGUAGES * dimensions + 1).collect()
    if len(found) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for name, at, x in found:
        out.setdefault(name, np.zeros(dimensions))[at] = x
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, the cosine with that language's prototype (0 to 1)."""
    names = list(prototypes)
    dimensions = len(prototypes[names[0]]) if names else 1
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).astype(np.float32).T if names else np.zeros((1, 0), np.float32)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = [f.name for f in kept].index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = _Letters(dimensions), {}
        for batch in small(batches):
            best, cosine = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first, n, grams, rows in _slices(batch.column(at).to_pylist()) if names else ():
                keys, back = np.unique(grams, return_inverse=True)
                if len(known) > _KEPT_GRAMS:
                    known.clear()
                new = np.array([k for k in keys.tolist() if k not in known], np.uint64)
                for i in range(0, len(new), 2000):
                    part = new[i : i + 2000]
                    known.update(zip(part.tolist(), letters.grams(part).astype(np.float32) @ unit))
                if not len(keys):
                    continue
                products = np.stack([known[k] for k in keys.tolist()])
                pairs, counts = np.unique(rows * len(keys) + back, return_counts=True)
                row, gram = pairs // len(keys), pairs % len(keys)
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                sums = np.add.reduceat(products[gram] * counts[:, None], starts, axis=0)
                length = np.sqrt(dimensions * np.add.reduceat(counts.astype(np.float64) ** 2, starts))
                for r, i, x in zip(row[starts].tolist(), sums.argmax(1).tolist(), sums.max(1) / length):
                    best[first + r], cosine[first + r] = names[i], min(1.0, max(0.0, float(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(cosine)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that teaches nothing; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 4 == 2


def accepted(identified: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", chance: float = 0.001, short: int = 10) -> DataFrame:
    """Rows of `identify` whose language is one of `prototypes`.

    A text that shares no gram with a prototype has a cosine with it that is normal about 0 with variance one over the
    dimensions. A text counts as known when its best cosine is greater than that of any of the prototypes would be with probability
    `chance`. Fewer than `short` letters cannot tell; such texts stay when they have a letter and any likeness at all.
    """
    if not prototypes:
        return identified.where("false")
    dimensions = len(next(iter(prototypes.values())))
    least = NormalDist().inv_cdf(1 - chance / len(prototypes)) / dimensions**0.5
    letters = F.length(F.regexp_replace(F.col(text), r"\P{L}", ""))
    return identified.where((F.col("lang_pred") != "und") & (F.col("score") > F.when(letters < short, 0.0).otherwise(least)))
