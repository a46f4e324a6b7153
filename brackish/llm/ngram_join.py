"""Documents linked by the Jaccard similarity of their word shingles, by parity sketches.

A document is the set of its distinct shingles of five words (a-z folded); one with fewer words
is one shingle. Equal sets are one class, named by its smallest id; only class representatives are joined.

Parity sketch: the shingles of a set are dealt into parts by one hash, and each part is the exclusive
or of another hash of its shingles. A shingle that two sets do not share changes one part at
most, so the number of parts that differ is at most the size of the symmetric difference; sets of
sizes a and b with similarity 3/4 or more differ in at most (a + b) / 7 shingles. Sets are compared
within size bands [3^i, 4 * 3^i), which overlap so that every pair that can link shares a band; a
band has so many parts that a set has more filled parts than may differ (where it has not, its empty
parts count too).

Pigeonhole: two linked sets then share a part among the rarest n/3 + 1 of each, in the common order
of frequency. Parts of one set only come first in that order, so most documents drop out at once,
and passages that a third of all documents share are used only where a document has nothing rarer.

Candidates are taken in three turns, each leaving out pairs that are already in one component: with the
smallest document of the part that a document shares most parts with; with the smallest of any of its
parts; with any other document of its parts, in pairs of blocks. A dense sketch of 1,024 bits drops
candidates whose Hamming distance, a lower bound of the symmetric difference, is too large; only the
others are written and verified on the sets. No link is lost, and a group of near copies costs a few comparisons for each of its members.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing;
its component is its own id. Rows with one id count as one document in links, each with its own
`n_shingles`. A null id has a null component. Ties (similarity of exactly 3/4) link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackish.llm.tables import components, settle, small
from brackish.llm.words import Stretches, Words, mix, read_words

SHINGLE, BITS, BLOCK, HELD, OFTEN = 5, 1024, 1024, 1 << 20, 64
_BANDS = 30
_KEY = np.uint64(0xFFFFFFFFFFFFFFE0)


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, by row and then by value, and the bounds of each row's."""
    stretches = Stretches(words.hashes())
    counts = np.diff(words.bounds)
    starts = np.arange(len(words.starts))
    rows = words.rows()
    whole = counts[rows] >= size
    keep = np.where(whole, starts + size <= words.bounds[rows + 1], starts == words.bounds[rows])
    starts, rows, whole = starts[keep], rows[keep], whole[keep]
    ends = np.where(whole, starts + size, words.bounds[rows + 1])
    hashes = stretches.of(starts, ends)
    bounds = np.searchsorted(rows, np.arange(words.n + 1)).tolist()
    for lo, hi in zip(bounds, bounds[1:]):
        hashes[lo:hi].sort()
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(words.n + 1))


def _bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest band of each size, and whether the band below holds it too."""
    edges = 3 ** np.arange(_BANDS, dtype=np.int64)
    band = np.searchsorted(edges, n, side="right") - 1
    return band, (band > 0) & (n < 4 * edges[band - 1])


def _parts(band: np.ndarray) -> np.ndarray:
    """Parts of the sketches of a band; n / 3 of them may differ, and more than that must be filled."""
    return (0.38 * 4 * 3.0**band).astype(np.int64) + 16


def _sketch(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row) of the parts of each set's sketch, and the number of keys of each row; band -1: none."""
    use = band[rows] >= 0
    hashes, rows = hashes[use], rows[use]
    parts = _parts(band)
    # hashes ascend within a row, and so do their parts
    part = (((hashes >> np.uint64(32)) * parts[rows].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    value = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1]))) if len(rows) else np.zeros(0, np.int64)
    value = np.bitwise_xor.reduceat(value, first) if len(first) else value
    rows, part = rows[first], part[first]
    filled = np.bincount(rows, minlength=len(n))
    for i in np.flatnonzero((filled <= n // 3) & (band >= 0)):  # too few parts are filled: the empty ones count
        empty = np.setdiff1d(np.arange(parts[i]), part[rows == i])
        rows, part, value = np.append(rows, np.full(len(empty), i)), np.append(part, empty), np.append(value, np.zeros(len(empty), np.uint64))
    keys = mix(value ^ mix(part.astype(np.uint64) + np.uint64(1))) & _KEY | band[rows].astype(np.uint64)
    return keys, rows, np.bincount(rows, minlength=len(n))


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, x1, x2, keys_high, keys_low, bits) of every row: size, identity and sketches of its set."""
    kinds = {"doc": pa.int64(), "n": pa.int64(), "x1": pa.int64(), "x2": pa.int64(), "keys_high": pa.int32(), "keys_low": pa.int32(), "bits": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for w in read_words(batch.column(1), lower=True):
                hashes, bounds = _sets(w, size)
                n = np.diff(bounds)
                rows = np.repeat(np.arange(w.n), n)
                band, below = _bands(np.maximum(n, 1))
                high = _sketch(hashes, rows, n, np.where(n > 0, band, -1))[2]
                low = _sketch(hashes, rows, n, np.where(below & (n > 0), band - 1, -1))[2]
                sums = np.zeros((2, w.n), np.uint64)
                some, starts = n > 0, bounds[:-1][n > 0]
                if len(starts):
                    sums[0, some] = np.bitwise_xor.reduceat(hashes, starts)
                    sums[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                bit = (mix(hashes + np.uint64(77)) % np.uint64(BITS)).astype(np.int64)
                odd = (np.bincount(rows * BITS + bit, minlength=w.n * BITS) & 1).astype(np.uint8)
                bits = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view(np.int64)), BITS // 64).cast(kinds["bits"])
                values = (n, *sums.view(np.int64), high, low)
                arrays = [pa.array(v, k) for v, k in zip(values, list(kinds.values())[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), *arrays, bits], names=list(kinds))

    return docs.mapInArrow(run, "doc long, n long, x1 long, x2 long, keys_high int, keys_low int, bits array<long>")


def _keys(docs: DataFrame, size: int, total: int, held: int = HELD, often: int = OFTEN) -> DataFrame:
    """(key, doc, n_docs) of the parts of every row's sketches that another row has too; the band is in the key's last five bits.

    Keys travel as arrays, dealt by their value into buckets of about `held`, and each bucket is sorted once. A key that `often` or more of
    about `held` keys of a task are is counted there; its bucket gets the count alone, and its documents go to buckets of their own.
    """
    buckets = max(1, -(-total // held))

    def rows_of(keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        some, counts = np.unique(keys, return_counts=True)
        hot, marks = some[counts >= often], counts[counts >= often]
        place = np.minimum(keys.astype(np.float64) / 2.0**64 * buckets, buckets - 1).astype(np.int64)
        if len(hot):
            own = np.isin(keys, hot)
            place[own] = buckets + int(mix(owners.view(np.uint64)[:1])[0] % np.uint64(buckets))
        hot_place = np.minimum(hot.astype(np.float64) / 2.0**64 * buckets, buckets - 1).astype(np.int64)
        order = np.argsort(place.astype(np.uint32), kind="stable")
        names = ["bucket", "keys", "docs", "hot", "marks"]
        for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            here = hot_place == place[at[0]]
            values = [x.tobytes() for x in (keys[at], owners[at], hot[here], marks[here])]
            yield pa.RecordBatch.from_arrays([pa.array([place[at[0]]], pa.int64()), *[pa.array([x], pa.binary()) for x in values]], names=names)
        for bucket in np.setdiff1d(hot_place, place).tolist():
            here = hot_place == bucket
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([x], pa.binary()) for x in (b"", b"", hot[here].tobytes(), marks[here].tobytes())]], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, n_keys = [], [], 0
        for batch in small(batches):
            ids = batch.column(0).to_numpy()
            for w in read_words(batch.column(1), lower=True):
                hashes, bounds = _sets(w, size)
                n = np.diff(bounds)
                rows = np.repeat(np.arange(w.n), n)
                band, below = _bands(np.maximum(n, 1))
                for b in (np.where(n > 0, band, -1), np.where(below & (n > 0), band - 1, -1)):
                    k, owner, _ = _sketch(hashes, rows, n, b)
                    keys.append(k)
                    owners.append(ids[owner + w.first])
                    n_keys += len(k)
                if n_keys >= held:
                    yield from rows_of(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, n_keys = [], [], 0
        if n_keys:
            yield from rows_of(np.concatenate(keys), np.concatenate(owners))

    def meet(t: pa.Table) -> pa.Table:
        keys, docs, hot, marks = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("docs", np.int64), ("hot", np.uint64), ("marks", np.int64)))
        if t.column("bucket")[0].as_py() >= buckets:  # frequent keys; their counts are elsewhere
            return pa.table({"key": keys.view(np.int64), "doc": docs, "n_docs": pa.nulls(len(keys), pa.int64())})
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        some, first, counts = np.unique(keys, return_index=True, return_counts=True)
        kinds, at = np.unique(hot, return_inverse=True)
        sums = np.bincount(at, marks, len(kinds)).astype(np.int64)
        both = np.isin(some, kinds, assume_unique=True)
        totals = counts + np.where(both, sums[np.minimum(np.searchsorted(kinds, some), max(len(kinds) - 1, 0))] if len(kinds) else 0, 0)
        alone = np.isin(kinds, some, assume_unique=True, invert=True)
        shared = np.repeat(totals > 1, counts)
        out = {"key": keys[shared], "doc": docs[shared], "n_docs": np.repeat(totals, counts)[shared]}
        # one row without a document tells the count of a frequent key
        tell = np.append(some[both], kinds[alone]), np.append(totals[both], sums[alone])
        key, n = np.append(out["key"], tell[0]), np.append(out["n_docs"], tell[1])
        doc = pa.concat_arrays([pa.array(out["doc"], pa.int64()), pa.nulls(len(tell[0]), pa.int64())])
        return pa.table({"key": key.view(np.int64), "doc": doc, "n_docs": n})

    dealt = docs.where("doc is not null").mapInArrow(deal, "bucket long, keys binary, docs binary, hot binary, marks binary")
    met = settle(dealt.groupBy("bucket").applyInArrow(meet, "key long, doc long, n_docs long"))
    counts = met.where("doc is null").select("key", "n_docs")
    often = met.where("n_docs is null").select("key", "doc").join(counts, "key")
    return met.where("doc is not null and n_docs is not null").unionByName(often)


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """(doc, hashes): the set of each row, sorted, as unsigned 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for w in read_words(batch.column(1), lower=True):
                hashes, bounds = _sets(w, size)
                sets = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in range(w.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), pa.array(sets, pa.binary())], names=["doc", "hashes"])

    return docs.mapInArrow(run, "doc long, hashes binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose sets are similar enough; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    return settle(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of `pairs` whose sizes and dense sketches do not rule them out."""
    one = reps.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = reps.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    differ = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    least = (100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(fits).where(distance <= least).select("a", "b")


def _within(own: DataFrame, grouped: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of documents with a common part, in different components, that sizes and dense sketches do not rule out.

    The documents of a part are cut into blocks, and each pair of blocks is compared by itself: neither memory nor
    what is written follows the square of a part's size.
    """
    named = _named(own, grouped)
    sizes = named.groupBy("key").agg(
        F.count("*").alias("m"), F.min("group").alias("g"), F.max("group").alias("h"), F.min("doc").alias("a"), F.max("doc").alias("b")
    )
    sizes = settle(sizes.where("g < h"))
    two = _possible(sizes.where("m = 2"), reps, percent)  # a part of two documents is one pair
    sizes = sizes.where("m > 2").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = named.join(sizes, "key").join(reps.groupBy("doc").agg(F.min(F.struct("n", "bits")).alias("r")).select("doc", "r.*"), "doc")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "doc", "group", "n", "bits", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def compare(t: pa.Table) -> pa.Table:
        ids, group, n, block = (t.column(c).to_numpy() for c in ("doc", "group", "n", "block"))
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        p, q = np.flatnonzero(block == t.column("one")[0].as_py()), np.flatnonzero(block == t.column("two")[0].as_py())
        distance = np.zeros((len(p), len(q)), np.int32)
        for word in range(bits.shape[1]):
            distance += np.bitwise_count(bits[p, word][:, None] ^ bits[q, word][None, :])
        a, b = n[p][:, None], n[q][None, :]
        fits = (group[p][:, None] != group[q][None, :]) & (ids[p][:, None] != ids[q][None, :])
        fits &= (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * distance <= (100 - percent) * (a + b))
        i, j = np.nonzero(fits)
        return pa.table({"a": np.minimum(ids[p[i]], ids[q[j]]), "b": np.maximum(ids[p[i]], ids[q[j]])})

    return rows.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long").unionByName(two).distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id), a row for every row of `docs`; similarity 3/4 or more links."""
    percent = 75
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    members = settle(_describe(rows, size))
    real = members.where("n > 0 and doc is not null")
    reps = real.groupBy("n", "x1", "x2").agg(F.min(F.struct("doc", "keys_high", "keys_low", "bits")).alias("r"), F.count_distinct("doc").alias("copies"))
    reps = settle(reps.select("n", "x1", "x2", "r.*", "copies"))

    # the rarest n / 3 + 1 parts of each sketch, of which those that no other set has need no row
    total = members.agg(F.sum(F.col("keys_high").cast("long") + F.col("keys_low"))).first()[0] or 0
    band = F.col("key").bitwiseAND(F.lit(31))
    sizes = reps.select("doc", "n", "keys_high", "keys_low").withColumn("high", F.floor(F.log(F.col("n") + 0.5) / F.log(F.lit(3.0))))
    own = _keys(rows, size, total).join(reps.select("doc"), "doc", "left_semi").repartition("doc")
    own = own.groupBy("doc", "key").agg(F.max("n_docs").alias("n_docs")).withColumn("band", band)
    sketch = Window.partitionBy("doc", "band")
    own = own.withColumns({"met": F.count("*").over(sketch), "rank": F.row_number().over(sketch.orderBy("n_docs", "key"))}).join(sizes, "doc")
    keys = F.when(F.col("band") == F.col("high"), F.col("keys_high")).otherwise(F.col("keys_low"))
    own = settle(own.where(F.col("rank") <= F.floor(F.col("n") / 3) + 1 - (keys - F.col("met"))).select("doc", "key"))
    lead = own.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    stars = settle(own.join(lead, "key").where("doc > low").groupBy("doc", "low").agg(F.count("*").alias("n")))
    own = settle(own.join(lead.select("key"), "key"))

    candidates = own.select("doc").distinct()
    sets = settle(_shingles(rows.join(candidates, "doc", "left_semi"), size).distinct())
    first = stars.groupBy(F.col("doc").alias("b")).agg(F.max(F.struct("n", (-F.col("low")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    links = _verify(_possible(first, reps, percent), sets, percent)
    grouped = components(links)
    one = _named(stars.select(F.col("low").alias("doc"), F.col("doc").alias("b")), grouped).withColumnsRenamed({"doc": "a", "group": "group_a"})
    both = _named(one.withColumnRenamed("b", "doc"), grouped).withColumnsRenamed({"doc": "b", "group": "group_b"})
    for turn in (lambda: _possible(both.where("group_a <> group_b"), reps, percent), lambda: _within(own, grouped, reps, percent)):
        links = links.unionByName(_verify(turn(), sets, percent))
        grouped = components(links.unionByName(grouped.select(F.col("component").alias("a"), F.col("id").alias("b"))))

    # back from classes to rows
    named = _named(reps.select("doc", "n", "x1", "x2"), grouped)
    same = real.select("doc", "n", "x1", "x2").join(named.drop("doc"), ["n", "x1", "x2"]).groupBy("doc").agg(F.min("group").alias("group"))
    out = members.select("doc", "n").join(same, "doc", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("group", "doc").alias("component_id"))


def _named(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """`rows` with `group`, the component of `doc`, itself where it has no link."""
    return rows.join(grouped.select(F.col("id").alias("doc"), F.col("component").alias("group")), "doc", "left").withColumn("group", F.coalesce("group", "doc"))
