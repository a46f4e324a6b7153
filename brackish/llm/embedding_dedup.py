"""Near copies among vectors by iterative quantisation and multi-index Hamming tables.

Codes: the rotation that makes the signs of centred unit vectors lose least is learned by iterative quantisation on at
most `SAMPLE` different vectors, the first in the order of a hash; only vectors below the hash that yields about as many reach the driver. A vector of more than `BITS` dimensions is first
projected on the sample's `BITS` strongest directions, so a code has at most `BITS` bits and the chance that a bit of two vectors
differs follows from their angle alone. Every vector, sampled or not, gets a code.

Tables: the code is cut into `CHUNKS` chunks, and each pair of chunks is a table. Two codes meet in a table when both
its chunks are equal; at cosine 0.98 a bit differs with probability 0.064 and two of seven chunks of nine bits agree with probability
0.96, whatever the dimension. The tables hold codes and ids only. A bucket of a single vector is dropped, and of
buckets with the same members one is kept, that of the first table. A pair counts in the first table where it meets.

Rerank: the vectors of the buckets left, and of these only, are compared by cosine in double precision. Equal vectors are
one before they enter the tables. A bucket is cut into blocks of about `BLOCK` vectors by a hash, and
each pair of blocks is compared on its own, so no group grows with a bucket; buckets of one block go about `DEALT` vectors to a group. A group
returns how many links each vector has in a bucket and the smallest vector of its component there; pairs are never written out.
Joins by id carry merge hints: ids take far less of a file than of memory, and a broadcast would pass through the driver.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label or id, link with nothing; such a row has no links and is its own component. Vectors
of different lengths never link. Rows with one id count as one in components. Only the key, vector and label columns are read and
only the result's columns returned, so others may have any names. Recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.tables import components, settle, small

SAMPLE, ROUNDS, BITS, CHUNKS, BLOCK, DEALT, LEAST = 20_000, 30, 64, 7, 1024, 4096, 0.98
SMALL, PAIRS = 64, 1 << 16  # vectors of a bucket whose pairs are listed, pairs listed at once


def learn_rotation(vectors: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(center, rotation) for unit `vectors`: bits are the signs of (v - center) @ rotation."""
    center = vectors.mean(0)
    x = vectors - center
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, -BITS:]
    x = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
        turn = right.T @ left.T
    return center, axes @ turn


def _usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the vectors that can link."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where("id is not null and label is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def _sampled(reps: DataFrame, sample: int) -> pa.Table:
    """At most `sample` rows (h, v), the first by the hash `h`; what reaches the driver does not grow with rows or tasks."""
    n = reps.count()
    # the hash below which `sample` rows lie but for chance, of all values from -2^63
    share = (sample + 6 * sqrt(sample)) / max(n, 1)
    rows = reps.select(F.xxhash64("id", "v", "label").alias("h"), "v")
    if share < 1:
        rows = rows.where(F.col("h") < F.lit(int(share * 2.0**64) - (1 << 63)).cast("long"))
    return rows.toArrow().sort_by("h").slice(0, sample)


def _rotations(reps: DataFrame, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Center and rotation of each length of vector in the sample."""
    by_length: dict[int, list[np.ndarray]] = {}
    for u in _units(_sampled(reps, sample).column("v").combine_chunks()):
        by_length.setdefault(len(u), []).append(u)
    return {n: learn_rotation(np.stack(x)) for n, x in by_length.items()}


def _units(column: pa.Array) -> list[np.ndarray]:
    out = []
    for v in column:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
        out.append(x / np.sqrt(x @ x))
    return out


def _codes(rows: DataFrame, rotations: dict[int, tuple[np.ndarray, np.ndarray]], chunks: int) -> DataFrame:
    """(id, label, dims, chunks): the chunks of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts, dims = [], []
            for u in _units(batch.column(2)):
                # a length that the sample does not hold gets fixed random directions
                center, turn = rotations.get(len(u)) or (0.0, np.random.default_rng(len(u)).standard_normal((len(u), min(len(u), BITS))))
                bits = ((u - center) @ turn >= 0).astype(np.uint8)
                parts.append([hash_bits(x) for x in np.array_split(bits, chunks)])
                dims.append(len(u))
            arrays = [pa.array(dims, pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "label", "dims", "chunks"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label string, dims int, chunks array<long>")


def hash_bits(bits: np.ndarray) -> int:
    """A chunk as a number; chunks of more than 62 bits are folded."""
    return int.from_bytes(np.packbits(bits).tobytes(), "big") % ((1 << 61) - 1)


def _pairs(size: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same bucket, some buckets at a time; a bucket has `size` rows from `start`."""
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        own = start[size == n]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(own), step):
            first = own[k : k + step, None]
            yield (first + i).ravel(), (first + j).ravel()


def _compare(group: pa.Table, least: float) -> pa.Table:
    """Links of some pairs of blocks: (id, links, low)."""
    group = group.sort_by([("bucket", "ascending"), ("one", "ascending"), ("two", "ascending"), ("block", "ascending")])
    bucket, one, two, block, first, second, ids, copies = (np.asarray(group.column(c)) for c in ("bucket", "one", "two", "block", "first", "second", "id", "copies"))
    vectors = _units(group.column("v").combine_chunks())
    chunk = np.stack([np.asarray(x.values) for x in group.column("chunks").combine_chunks()])
    start = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)))
    size = np.diff(np.append(start, len(ids)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def close(i: np.ndarray, j: np.ndarray) -> None:
        # the pair meets in an earlier table if another chunk before the second is equal
        places = np.arange(chunk.shape[1])
        before = (places < second[i, None]) & (places != first[i, None])
        new = ~((chunk[i] == chunk[j]) & before).any(1)
        found.append((i[new], j[new]))

    few = (size <= SMALL) & (one[start] == two[start])
    dims = np.array([len(v) for v in vectors])
    for n in np.unique(dims).tolist():  # a bucket holds vectors of one length
        mine = few & (dims[start] == n)
        at = np.cumsum(dims == n) - 1
        unit = np.stack([v for v in vectors if len(v) == n])
        for i, j in _pairs(size[mine & (size > 1)], start[mine & (size > 1)]):
            some = np.einsum("ij,ij->i", unit[at[i]], unit[at[j]]) >= least
            close(i[some], j[some])
    for s in np.flatnonzero(~few):
        rows = np.arange(start[s], start[s] + size[s])
        a, b = rows[block[rows] == one[start[s]]], rows[block[rows] == two[start[s]]]
        if len(a) and len(b):
            i, j = np.nonzero(np.stack([vectors[k] for k in a]) @ np.stack([vectors[k] for k in b]).T >= least)
            i, j = a[i], b[j]
            close(*((i[i < j], j[i < j]) if one[start[s]] == two[start[s]] else (i, j)))
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    low = ids.copy()
    while len(i):
        least_id = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least_id)
        np.minimum.at(low, j, least_id)
        if (before == low).all():
            break
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "low": low[some]})


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, chunks: int = CHUNKS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component_id, kept), a row for every row of `vectors`."""
    rows = settle(_usable(vectors, key, vector, label))
    # equal vectors are one; a hash of the vector salts nothing here because the count is combined before the shuffle
    reps = settle(rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    coded = settle(_codes(reps, _rotations(reps, sample), chunks))
    tables = F.array(*[F.struct(F.lit(i).alias("first"), F.lit(j).alias("second")) for i, j in combinations(range(chunks), 2)])
    met = coded.select("id", "label", "dims", "chunks", F.explode(tables).alias("t")).select("*", "t.*")
    number = (F.col("first") * chunks + F.col("second")).cast("long")  # of the table, in the bucket's low bits, so that tables come in order
    hashed = F.xxhash64("label", "dims", "first", F.get("chunks", F.col("first")), "second", F.get("chunks", F.col("second")))
    met = met.select("id", "first", "second", F.shiftleft(F.shiftrightunsigned(hashed, 13), 12).bitwiseOR(number).alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    # buckets with the same members would compare the same pairs: the one of the first table stays
    first_table = F.struct(F.col("bucket").bitwiseAND(4095).alias("table"), "bucket")
    sizes = sizes.groupBy("n", "members").agg(F.min(first_table)["bucket"].alias("bucket"))
    sizes = settle(sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    met = settle(met.join(sizes.hint("merge"), "bucket"))
    groups = max(1, met.count() // DEALT)
    vectors_of = reps.select("id", "copies", "v").join(coded.select("id", "chunks").hint("merge"), "id")
    met = met.join(vectors_of.hint("merge"), "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    # each block meets every block of its bucket, itself included
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    dealt = F.when(F.col("blocks") > 1, F.xxhash64("bucket", "one", "two")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    met = met.select(dealt.alias("deal"), "bucket", "first", "second", "one", "two", "block", "id", "copies", "v", "chunks")
    found = met.groupBy("deal").applyInArrow(lambda g: _compare(g, least), "id long, links long, low long")
    found = settle(found.groupBy("id", "low").agg(F.sum("links").alias("links")))

    grouped = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = reps.join(links.hint("merge"), "id", "left").join(grouped.hint("merge"), "id", "left")
    reps = reps.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    linked = rows.join(reps.hint("merge"), ["label", "v"]).groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col(key)).join(linked.withColumnRenamed("id", "_id").hint("merge"), F.col(key) == F.col("_id"), "left")
    component = F.coalesce(F.col("component"), F.col(key).cast("long"))
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
