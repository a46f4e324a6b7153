"""Removal of passages that a document with a smaller id has too, by seed and extend.

Seeds: every window of `length` words holds an anchor, the least hash among its stretches of
`length // 2 + 1` words (winnowing), so equal windows have equal anchors. Anchors that occur in one
document only are dropped. Around each seed left, the match extends both ways over its block: the
run of windows that share the anchor. Blocks that are equal as a whole are settled by the smallest
document among them. Only one block of each kind goes on and is compared window by window with the other
blocks. Windows of one document that were also found in a smaller one join into maximal repeats, at
least `length` words long.

No pairs are formed. Seeds, blocks and windows are grouped by their hashes (128 bits for blocks and
windows), each group yields its smallest document, and a join takes that back; a passage that a third
of all documents share is combined before the shuffle and its join is split by adaptive execution.

Defined results: a null or empty text has no words. Texts under `length` words lose nothing. Rows
with one id never cost each other words; each row is judged by its own text. A row with a null id keeps its
words and costs no other row any. Of several copies the smallest id stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import settle, small
from brackish.llm.words import Stretches, Words, read_words

LENGTH = 50


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Stretches, Stretches]:
    """(first word, windows, anchor) of each block, and the stretches of both hash lanes."""
    lanes = tuple(Stretches(words.hashes(i), i) for i in (0, 1))
    total, k = len(words.starts), length // 2 + 1
    if total < length:
        none = np.zeros(0, np.int64)
        return none, none, none, *lanes
    grams = lanes[0].of(np.arange(total - k + 1), np.arange(k, total + 1))
    least, have, want = grams, 1, length - k + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    rows = words.rows()
    at = np.flatnonzero(rows[: total - length + 1] == rows[length - 1 :])
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchor[first], *lanes


def _blocks(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, b1, b2, doc, t, at, n): each block's hash, document, first word in it and number of windows."""
    kinds = {"anchor": pa.int64(), "b1": pa.int64(), "b2": pa.int64(), "doc": pa.int64(), "t": pa.int64(), "at": pa.int32(), "n": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in read_words(batch.column(2)):
                at, n, anchor, one, two = _anchors(w, length)
                row = np.searchsorted(w.bounds, at, side="right") - 1
                end = at + n - 1 + length
                values = (anchor.view(np.int64), one.of(at, end).view(np.int64), two.of(at, end).view(np.int64), ids[row + w.first], hashes[row + w.first], at - w.bounds[row], n)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values())], names=list(kinds))

    return docs.where("doc is not null").mapInArrow(run, "anchor long, b1 long, b2 long, doc long, t long, at int, n int")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc, t, at) of every window of the blocks in `runs` (at, n)."""
    kinds = {"w1": pa.int64(), "w2": pa.int64(), "doc": pa.int64(), "t": pa.int64(), "at": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, hashes, runs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for w in read_words(batch.column(2)):
                one, two = (Stretches(w.hashes(i), i) for i in (0, 1))
                starts, rows = [], []
                for i in range(w.n):
                    for r in runs[w.first + i]:
                        starts.append(np.arange(r["at"], r["at"] + r["n"]) + w.bounds[i])
                        rows.append(np.full(r["n"], i))
                if starts:
                    at, row = np.concatenate(starts), np.concatenate(rows)
                    values = (one.of(at, at + length).view(np.int64), two.of(at, at + length).view(np.int64), ids[row + w.first], hashes[row + w.first], at - w.bounds[row])
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values())], names=list(kinds))

    return docs.select("doc", "t", "text", "runs").mapInArrow(run, "w1 long, w2 long, doc long, t long, at int")


def repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t, spans): words to remove as [start, end) stretches, unmerged; t is the hash of the text.

    A row for every text that loses something.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    blocks = _blocks(rows, length)
    shared = blocks.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    seeds = settle(blocks.join(shared, "anchor").drop("anchor"))
    first = seeds.groupBy("b1", "b2").agg(F.min("doc").alias("low"))
    judged = settle(seeds.join(first, ["b1", "b2"]).select("doc", "t", "at", "n", (F.col("doc") > F.col("low")).alias("gone")))
    # what is left: one document for each kind of block, compared window by window
    left = judged.where("not gone").groupBy("doc", "t").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    windows = settle(_windows(rows.join(left, ["doc", "t"]), length))
    lowest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w1", "w2", "low")
    hits = windows.join(lowest, ["w1", "w2"]).where("doc > low").select("doc", "t", F.struct(F.col("at").alias("start"), (F.col("at") + length).alias("end")).alias("span"))
    whole = judged.where("gone").select("doc", "t", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end")).alias("span"))
    return settle(whole.unionByName(hits).groupBy("doc", "t").agg(F.collect_set("span").alias("spans")))


def remove(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `n_words`, `n_removed`, `kept_words` (joined by one space) and `kept_text`.

    `kept_text` keeps the source's white space between kept words; it is the source itself where
    nothing is removed, and null for a null text.
    """
    more = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_words": T.StringType(), "kept_text": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name not in more]
    found = repeats(docs, length, key, text).select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), F.col("spans").alias("_spans"))
    # the columns travel under numbers, so that none clashes with those of the spans
    plain = docs.select(*[F.col(f"`{f.name}`").alias(f"column_{i}") for i, f in enumerate(kept)])
    names = [f.name for f in kept]
    at, own = names.index(text), F.col(f"column_{names.index(key)}").cast("long")
    rows = plain.join(found, (own == F.col("_doc")) & (F.xxhash64(f"column_{at}") == F.col("_t")), "left").select(*plain.columns, "_spans")
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in more.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            spans, texts = batch.column(len(kept)).to_pylist(), batch.column(at).to_pylist()
            out = ([], [], [], [])
            for w in read_words(batch.column(at)):
                raw = w.raw.tobytes()
                for i in range(w.n):
                    lo, hi = w.bounds[i], w.bounds[i + 1]
                    starts, ends = w.starts[lo:hi], w.ends[lo:hi]
                    gone = np.zeros(hi - lo + 1, np.int64)
                    for s in spans[w.first + i] or ():
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    words = [raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())]
                    source = texts[w.first + i]
                    if source is not None and not stay.all():
                        cut = np.flatnonzero(stay)
                        breaks = np.flatnonzero(np.diff(cut) > 1) + 1
                        source = "\n".join(raw[starts[p[0]] : ends[p[-1]]].decode("utf-8", "surrogatepass") for p in np.split(cut, breaks) if len(p))
                    for column, x in zip(out, (int(hi - lo), int((~stay).sum()), b" ".join(words).decode("utf-8", "surrogatepass"), source)):
                        column.append(x)
            arrays = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)
