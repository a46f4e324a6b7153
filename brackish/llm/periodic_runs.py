"""Runs of repeated words: stretches that repeat with one period, found in a suffix automaton with link-cut access.

The words of a stretch are appended one by one to a suffix automaton. Its suffix links form a tree that is
kept as a link-cut tree: every preferred path has one colour, the place where its strings were last seen to
end. Appending word i accesses the path from the new state to the root; each segment of one colour on the
way says that the last L words before and with i, L the length of the segment's deepest state, ended before at
its colour e and no longer stretch did. With d = i - e <= L that is a square of period d, whose first
word is i - L - d + 1 and cannot be earlier; as e is the last such place, d is the smallest period. A square is extended
to a run by letting it grow until the word d before the next one differs; there it is reported, once.

Only stretches that can hold a run go through an automaton. Every word of a run with exponent `EXPONENT` lies in
`GRAM` words that occur again one period away, so words outside repeated grams, and grams whose nearest
repeat is further away than a quarter of their stretch, are left out first. That loses no run and needs hashes
only: equal hashes of different grams keep more than is needed. Inside the automaton words are compared as they are.

Defined results: a null or empty text, or one without words, has no words, no runs and an empty kept text.
Texts of any length are taken whole; a task needs about 1 kB of memory a word of the longest stretch of repeated grams. Every row
of the input is one row of the result, rows with equal or null keys too. Only the key and text columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.tables import small
from brackish.llm.words import Stretches, Words, mix, read_words

LEAST, EXPONENT, GRAM = 6, 4, 5
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `words`, by start and then by period.

    A run has at least `least` words and `exponent` times its smallest period, `exponent` being 2 or more.
    """
    n = len(words)
    # the automaton: state 1 is the root, 0 stands for none
    step: list[dict] = [{}, {}]
    link, size = [0, 0], [0, 0]
    # the link-cut tree over the suffix links; colours sit at the roots of the splay trees of preferred paths
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]
    out = []

    def splay(x: int) -> None:
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                turn(p if (left[g] == p) == (left[p] == x) else x)
            turn(x)

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x
        colour[x] = colour[p]

    def state(length: int, steps: dict, parent: int) -> int:
        step.append(steps)
        size.append(length)
        link.append(parent)
        left.append(0)
        right.append(0)
        up.append(parent)
        colour.append(-1)
        return len(step) - 1

    last = 1
    for i, word in enumerate(words):
        new = state(i + 1, {}, 0)
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            link[new] = up[new] = 1
        else:
            q = step[p][word]
            if size[q] == size[p] + 1:
                link[new] = up[new] = q
            else:  # a state of its own for the shorter strings of q, right above q on its preferred path
                copy = state(size[p] + 1, dict(step[q]), link[q])
                splay(q)
                above = left[q]
                left[copy], up[copy], left[q] = above, q, copy
                if above:
                    up[above] = copy
                link[q] = copy
                while p and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                link[new] = up[new] = copy
        last = new

        at, below = new, 0
        while at:
            splay(at)
            d, long = i - colour[at], size[at]
            if colour[at] >= 0 and long >= (exponent - 1) * d and long + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                out.append((i - long - d + 1, long + d, d))
            if r := right[at]:
                colour[r] = colour[at]
            right[at] = below
            at, below = up[at], at
        colour[below] = i
    out.sort(key=lambda run: (run[0], run[2]))
    return out


def _stretches(w: Words, exponent: int) -> list[tuple[int, int, int]]:
    """(row, first word, end) of the stretches of a slice that can hold runs; words are counted from the slice's start."""
    rows = w.rows()
    starts = np.arange(len(rows))
    inside = starts + GRAM <= w.bounds[rows + 1]
    starts, rows = starts[inside], rows[inside]
    if not len(starts):
        return []
    gram = Stretches(w.hashes()).of(starts, starts + GRAM)
    gram = mix(gram ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    apart = np.where(again, starts[order[1:]] - starts[order[:-1]], np.iinfo(np.int64).max)
    near = np.full(len(starts), np.iinfo(np.int64).max)
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    keep = near < np.iinfo(np.int64).max
    starts, rows, near = starts[keep], rows[keep], near[keep]
    while len(starts):
        # grams that overlap or touch within a row make a stretch
        first = np.flatnonzero(np.append(True, (starts[1:] > starts[:-1] + GRAM) | (rows[1:] != rows[:-1])))
        begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + GRAM
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
        keep = exponent * near <= (end - begin)[of]
        if keep.all():
            return list(zip(rows[first].tolist(), begin.tolist(), end.tolist()))
        starts, rows, near = starts[keep], rows[keep], near[keep]
    return []


def _row_runs(w: Words) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of the rows of a slice that have some, with word numbers of the row."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for row, begin, end in _stretches(w, EXPONENT):
        numbers: dict[bytes, int] = {}
        words = []
        for a, b in zip(w.starts[begin:end].tolist(), w.ends[begin:end].tolist()):
            words.append(numbers.setdefault(w.raw[a:b].tobytes(), len(numbers)))
        shift = begin - int(w.bounds[row])
        if here := runs_of(words):
            found.setdefault(row, []).extend((start + shift, length, period) for start, length, period in here)
    return found


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """`words` without those that any run contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, kept_text) of every row: its runs by start and period, and its words without their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for w in read_words(batch.column(1)):
                runs = _row_runs(w)
                kept = []
                for i, words in enumerate(_words(batch.column(1).slice(w.first, w.n))):
                    kept.append(b" ".join(collapse(words, runs[i]) if i in runs else words))
                spans = [[{"start": s, "length": n, "period": p} for s, n, p in runs.get(i, ())] for i in range(w.n)]
                arrays = [pa.array(np.diff(w.bounds), pa.int64()), pa.array(spans, RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), *arrays], names=["doc", "n_words", "runs", "kept_text"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    shape = f"doc {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string"
    return rows.mapInArrow(run, shape).withColumnRenamed("doc", key)


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    for t in column.to_pylist():
        yield (t or "").encode("utf-8", "surrogatepass").split()  # white space of bytes is \\x20 and \\x09-\\x0D


def with_loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): every tenth document, by a checksum of its key, goes round in its own words from some word on.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on repeat words a to a + p - 1, where
    p = 1 + (n - a) div (3 + g mod 8). Other texts, those without words and those of null keys stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select(F.col(key), F.col(text).cast("string").alias(text), F.floor(h / 10).cast("long").alias("_g"), (h % 10).alias("_turn"))
    rows = rows.withColumn("_words", F.when(F.col("_turn") == 0, words))
    n = F.size("_words").cast("long")
    a = F.col("_g") % n
    p = F.lit(1) + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("long")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    looped = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", place(i))), " ")
    return rows.select(key, F.when((F.col("_turn") == 0) & (n > 0), looped).otherwise(F.col(text)).alias(text))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest run of each row of `find`, and digests of its runs and its kept text."""
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN IF(x.length > y.length, -1, 1) WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) WHEN x.period <> y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END)")
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    rows = found.withColumn("_best", F.get(best, F.lit(0)))
    return rows.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
