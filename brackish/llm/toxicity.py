"""Toxicity behind disguises: decode a noisy channel, then score the restored words.

Language model: counts of neighbouring letters over all texts. Each slice of rows is counted in its
task, Spark adds the tasks; at most one sum a pair of Latin letters, accented ones included, reaches
the driver.

Channel: digits and signs stand for letters (`1d10t`, `ki11`), letters repeat (`looooser`), or stand
apart (`m o r o n`). Every string with a letter and a sign becomes a lattice of letters, and Viterbi
picks the path that the model and the costs of the channel make likeliest; signs may stand for
nothing, a final exclamation mark at no cost. Letters that stand apart, three or more, are joined
first; as they may be several words, every stretch of them counts as a word whose breaks cost at
most `BREAKS` against the likeliest breaks.

Score: words and word beginnings are counted in toxic and other labelled rows; those tied to toxicity
beyond chance carry the share of toxic rows among the rows that have them, put back to the true
share of the labels. A text scores as its strongest word does; without such a word, as the labelled
texts without one do. At most `LABELLED` rows of each label, taken in the order of a hash of the
id, teach the words, and at most `LEXICON` of them are kept.

Defined results: null and empty texts have no words and get the score of texts without evidence;
without labels of both kinds every text scores the share of toxic labels, or 0. Repeated rows score
alike; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import small

LABELLED, LEXICON, STRENGTH = 10_000, 50_000, 40.0
_KEPT_WORDS = 200_000

# What letters a sign may stand for.
_SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

_LETTERS = "".join(chr(c) for c in [*range(97, 123), *range(0xDF, 0x180)] if chr(c).islower())
_INDEX = {x: i for i, x in enumerate(["", *_LETTERS])}
BREAKS, _LONGEST = 3.0, 24

_MARKS = re.escape("".join(_SIGNS))
_CLASS = _LETTERS + _MARKS
_DISGUISED = re.compile(rf"(?<![{_CLASS}])(?=[{_MARKS}]*[{_LETTERS}])(?=[{_LETTERS}]*[{_MARKS}])[{_CLASS}]+")
_STRETCHED = re.compile(rf"(?<![{_LETTERS}])[{_LETTERS}]*?([{_LETTERS}])\1\1[{_LETTERS}]*")
_APART = re.compile(rf"(?<![\w@$])(?:[{_CLASS}][ ._*-]){{2,}}[{_CLASS}](?![\w@$])")
_WORD = re.compile(r"[^\W\d_]+")


def letter_pairs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log chance of each letter (1 and up, as in `_INDEX`; 0: anything else) after each, from all texts."""
    size = len(_INDEX)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = np.array([_INDEX.get(chr(c).lower(), 0) for c in range(0x181)], np.int32)
        total = np.zeros(size * size, np.int64)
        for batch in small(batches):
            for t in batch.column(0):
                codes = fold[np.minimum(np.frombuffer(f" {t.as_py() or ''} ".encode("utf-32-le", "replace"), np.uint32), 0x180)]
                total += np.bincount(codes[:-1] * size + codes[1:], minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": seen, "n": total[seen]})

    rows = docs.select(F.col(text)).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect()
    counts = np.full((size, size), 27 / size)
    for pair, n in rows:
        counts[pair // size, pair % size] += n
    return np.log(counts / counts.sum(1, keepdims=True))


def restore(disguised: str, model: np.ndarray) -> str:
    """The likeliest letters behind a lower-case string of letters and signs."""
    lattice: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(disguised):
        c, end = disguised[at], at + 1
        while end < len(disguised) and disguised[end] == c:
            end += 1
        run = end - at
        if c in _INDEX:
            options = [(c, 0.0), (c + c, 1.0)] if run > 2 else [(c * run, 0.0), (c, 2.5)] if run == 2 else [(c, 0.0)]
        else:
            options = [("", 0.0 if c == "!" and end == len(disguised) else 6.0 * min(run, 2))]
            if run == 2:
                options += [(x + y, 1.0 if x == y else 4.0) for x in _SIGNS[c] for y in _SIGNS[c]] + [(x, 6.0) for x in _SIGNS[c]]
            else:
                options += [(x * min(run, 2), 0.5 * run) for x in _SIGNS[c]]
            if run > 2:
                options += [(x, 1.0) for x in _SIGNS[c]]
        lattice.append(options)
        at = end
    best: dict[str, tuple[float, str]] = {"": (0.0, "")}  # by last letter
    for options in lattice:
        after: dict[str, tuple[float, str]] = {}
        for last, (score, path) in best.items():
            for letters, cost in options:
                s, prev = score - cost, last
                for x in letters:
                    s += model[_INDEX[prev], _INDEX[x]]
                    prev = x
                if prev not in after or s > after[prev][0]:
                    after[prev] = (s, path + letters)
        best = after
    return max((s + model[_INDEX[x], 0], p) for x, (s, p) in best.items())[1]


def apart(letters: str, model: np.ndarray) -> set[str]:
    """The words that letters without breaks may hold: the whole, and stretches whose breaks are likely enough."""
    at = [_INDEX[x] for x in letters]
    # what a break gains before each letter but the first
    gain = [0.0, *[model[a, 0] + model[0, b] - model[a, b] for a, b in zip(at, at[1:])], 0.0]
    out = {letters}
    for i in range(len(letters)):
        lost = max(0.0, -gain[i])
        for j in range(i + 1, min(len(letters), i + _LONGEST) + 1):
            if lost > BREAKS:
                break
            if lost + max(0.0, -gain[j]) <= BREAKS:
                out.add(letters[i:j])
            lost += max(0.0, gain[j])
    return out


def words_of(text: str | None, model: np.ndarray, known: dict[str, str]) -> set[str]:
    """Distinct words of a text, with those restored from disguise; `known` keeps what was restored."""
    if not text:
        return set()
    low = text.lower()
    words = set(_WORD.findall(low))
    spaced = {re.sub(r"[ ._*-]", "", m) for m in _APART.findall(low)}
    spaced = {x for x in spaced if any(c in _INDEX for c in x)}
    odd = spaced | set(_DISGUISED.findall(low))
    odd.update(m[0] for m in _STRETCHED.finditer(low))
    for x in odd:
        if x not in known:
            if len(known) > _KEPT_WORDS:
                known.clear()
            known[x] = restore(x, model)
        words.add(known[x])
        if x in spaced:
            words |= apart(known[x], model)
    words.discard("")
    return words


def traits(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters."""
    return [word] + [f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k]


@dataclass
class Scorer:
    model: np.ndarray
    weights: dict[str, float]
    without: float


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Scorer:
    """A scorer from all `docs` (the letters) and from the rows of `labels` (the words).

    `labels` holds only rows that may teach. Null labels and ids teach nothing.
    """
    model = letter_pairs(docs, text)
    labels = labels.where(f"`{toxic}` in (0, 1) and `{key}` is not null").select(F.col(key).alias("_id"), F.col(toxic).cast("int").alias("_toxic"))
    totals = {r[0]: r[1] for r in labels.groupBy("_toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    share = bad / (bad + good) if bad + good else 0.0
    if not bad or not good:
        return Scorer(model, {}, share)
    order = [F.xxhash64("_id"), "_id"]
    chosen = labels.where("_toxic = 1").orderBy(*order).limit(LABELLED).unionByName(labels.where("_toxic = 0").orderBy(*order).limit(LABELLED))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        held = (Counter(), Counter())
        for batch in small(batches):
            for t, label in zip(batch.column(0), batch.column(1).to_pylist()):
                held[label].update({x for w in words_of(t.as_py(), model, known) for x in traits(w)})
                held[label][""] += 1
                if len(held[0]) + len(held[1]) > 300_000:
                    yield _counts(held)
                    held[0].clear()
                    held[1].clear()
        yield _counts(held)

    counted = rows.mapInArrow(count, "trait string, bad long, good long").groupBy("trait").agg(F.sum("bad").alias("t"), F.sum("good").alias("n"))
    counted = counted.where("t >= 4 or trait = ''")
    sums = counted.where("trait = ''").first()
    if not sums or not sums["t"] or not sums["n"]:
        return Scorer(model, {}, share)
    bad_rows, good_rows = float(sums["t"]), float(sums["n"])
    with_it, all_rows = F.col("t") + F.col("n"), bad_rows + good_rows

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    strength = 2 * (
        part(F.col("t"), with_it * bad_rows / all_rows)
        + part(F.col("n"), with_it * good_rows / all_rows)
        + part(bad_rows - F.col("t"), (all_rows - with_it) * bad_rows / all_rows)
        + part(good_rows - F.col("n"), (all_rows - with_it) * good_rows / all_rows)
    )
    chance = share * F.col("t") / bad_rows / (share * F.col("t") / bad_rows + (1 - share) * (F.col("n") + 0.5) / good_rows)
    lexicon = counted.where("trait <> ''").select("trait", "t", chance.alias("p"), strength.alias("g")).where((F.col("g") >= STRENGTH) & (F.col("p") > share))
    found = lexicon.orderBy(F.desc("g"), "trait").limit(LEXICON).collect()
    seen = {r["trait"]: r["t"] for r in found}
    # a beginning that owes nearly all its toxic rows to one word says no more than the word
    idle = {x for w, t in seen.items() if not w.endswith("*") for x in traits(w)[1:] if t >= 0.8 * seen.get(x, t + t)}
    scorer = Scorer(model, {r["trait"]: r["p"] for r in found if r["trait"] not in idle}, share)
    rest = score(rows, scorer, text="_text").where("not evident").groupBy("_toxic").count().collect()
    left = {r[0]: r[1] for r in rest}
    odds = share * left.get(1, 0) / bad_rows, (1 - share) * left.get(0, 0) / good_rows
    scorer.without = odds[0] / sum(odds) if sum(odds) else share
    return scorer


def _counts(held: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(held[0].keys() | held[1].keys())
    return pa.RecordBatch.from_pydict({"trait": pa.array(names, pa.string()), "bad": pa.array([held[1][x] for x in names], pa.int64()), "good": pa.array([held[0][x] for x in names], pa.int64())})


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) and `evident` (some word speaks for toxicity)."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "evident")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("evident", T.BooleanType())])
    at = [f.name for f in kept].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        weights: dict[str, float] = {}
        for batch in small(batches):
            best = []
            for t in batch.column(at):
                top = 0.0
                for w in words_of(t.as_py(), scorer.model, known):
                    p = weights.get(w)
                    if p is None:
                        if len(weights) > _KEPT_WORDS:
                            weights.clear()
                        p = weights[w] = max((scorer.weights.get(x, 0.0) for x in traits(w)), default=0.0)
                    if p > top:
                        top = p
                best.append(top)
            found = np.array(best)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(found > 0, np.maximum(found, scorer.without), scorer.without), pa.float64()), pa.array(found > 0)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows that teaches no label; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 5 == 0
