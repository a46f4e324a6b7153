"""Nearest neighbours by inner product: a forest of random-projection trees behind one shared priority queue.

Forest: each of `TREES` trees has `DEPTH` levels of random directions, orthogonal within a tree; the median of the
projections at a node, taken on at most `SAMPLE` vectors (the first in the order of a hash of their id), splits it. The
forest is a model of fixed size. Every vector, sampled or not, is filed in one leaf of every tree.

Queue: a query holds one queue for all trees. A node waits in it with the largest sum that the signed margins on
the way to one of its leaves may have: those so far, and the largest ones of the levels below. So leaves leave the
queue best first across trees, and trees that tell more about a query give more of its leaves. `VISITS` is the share of
the forest's leaves that a query takes; a share, because without clusters the share of the vectors that must be
read for a given recall does not depend on their number.

Rerank: vectors are laid out once, by the first `SPREAD` levels of the first tree, in blocks of at most about `BLOCK`
rows. A query goes to the blocks that hold members of its leaves (known from counts per leaf and cell, at most
`TREES * 2^(DEPTH + SPREAD)` rows). There its inner products with the members of these leaves, and with no other vector, are
taken in double precision on the vectors as they are. The best of all blocks are ranked once more.

Defined results: vectors that are null, empty or zero, hold null or non-finite components or have a null id take no
part. Only vectors of one length are compared. Of rows with one id the nearest counts, once; as a query, the smallest
array counts. A query never finds its own id. Equal scores are ranked by id; scores of equal vectors are equal bit by bit.
Only the key and vector columns are read, so others may have any names. Recall is measured in the tests.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackish.llm.tables import settle, small

K, TREES, DEPTH, SAMPLE, VISITS, SPREAD, BLOCK, CHUNK = 20, 4, 8, 16_384, 0.6, 4, 8192, 256


class Forest:
    """Directions and thresholds of all trees for vectors of one length; node j of a level has children 2j and 2j + 1."""

    def __init__(self, sample: np.ndarray, dims: int, trees: int, depth: int, seed: int = 12):
        rng = np.random.default_rng([seed, dims])
        self.depth = depth
        self.turns, self.cuts = [], []
        for _ in range(trees):
            turn = rng.standard_normal((depth, dims))
            if depth <= dims:
                turn = np.linalg.qr(turn.T)[0].T
            projected = sample @ turn.T
            cuts, node = [], np.zeros(len(sample), np.int64)
            for level in range(depth):
                p = projected[:, level]
                middle = [np.median(p[node == j]) if (node == j).any() else 0.0 for j in range(2**level)]
                cuts.append(np.array(middle))
                node = 2 * node + (p >= cuts[level][node])
            self.turns.append(turn)
            self.cuts.append(cuts)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.zeros((len(vectors), len(self.turns)), np.int64)
        for t, (turn, cuts) in enumerate(zip(self.turns, self.cuts)):
            p = vectors @ turn.T
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (p[:, level] >= cuts[level][out[:, t]])
        return out

    def visit(self, query: np.ndarray, count: int) -> np.ndarray:
        """The first `count` leaves that the shared queue yields, as tree * 2^depth + leaf."""
        margins, rest = [], []
        for turn, cuts in zip(self.turns, self.cuts):
            p = turn @ query
            m = [p[level] - cuts[level] for level in range(self.depth)]
            margins.append([x.tolist() for x in m])
            rest.append(np.append(np.cumsum([np.abs(x).max() for x in m][::-1])[::-1], 0.0).tolist())
        queue = [(-r[0], t, 0, 0, 0.0) for t, r in enumerate(rest)]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < count:
            _, t, level, node, so_far = heapq.heappop(queue)
            if level == self.depth:
                found.append((t << self.depth) + node)
                continue
            m, below = margins[t][level][node], rest[t][level + 1]
            heapq.heappush(queue, (-(so_far + m + below), t, level + 1, 2 * node + 1, so_far + m))
            heapq.heappush(queue, (-(so_far - m + below), t, level + 1, 2 * node, so_far - m))
        return np.array(found, np.int64)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite).where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(length, vectors, rows) of the vectors of each length in a batch."""
    lengths = np.asarray(batch.column(at).value_lengths())
    for dims in np.unique(lengths).tolist():
        rows = batch.filter(pa.array(lengths == dims))
        yield dims, _matrix(rows.column(at), dims), rows


class Index:
    """Vectors filed in the leaves of the forest: `rows` (id, v, dims, cell, leaves) and the model."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE, spread: int = SPREAD):
        self.trees, self.depth, self.spread = trees, depth, min(spread, depth)
        usable = _usable(vectors, key, vector)
        chosen: dict[int, list] = {}
        for v in usable.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(sample).toPandas()["v"]:
            chosen.setdefault(len(v), []).append(v)
        self.known = {n: Forest(np.array(x, np.float64), n, trees, depth) for n, x in chosen.items()}
        forest, cell, n_trees = self.forest, self._cell, trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                for dims, x, rows in _by_length(batch, 1):
                    leaves = forest(dims).leaves(x)
                    own = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel(), pa.int32()), n_trees).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([dims] * len(x), pa.int32()), pa.array(cell(leaves), pa.int32()), own], names=["id", "v", "dims", "cell", "leaves"])

        kind = usable.schema["v"].dataType.simpleString()
        self.rows = settle(usable.mapInArrow(run, f"id long, v {kind}, dims int, cell int, leaves array<int>"))

    def _cell(self, leaves: np.ndarray) -> np.ndarray:
        return leaves[:, 0] >> (self.depth - self.spread)

    def forest(self, dims: int) -> Forest:
        """The forest of a length; one that the sample does not hold splits at zero."""
        if dims not in self.known:
            self.known[dims] = Forest(np.zeros((0, dims)), dims, self.trees, self.depth)
        return self.known[dims]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def _held(self) -> dict[int, np.ndarray]:
        """By length: which leaves (tree * 2^depth + leaf) have members in which cell."""
        leaf = F.posexplode("leaves").alias("tree", "leaf")
        out: dict[int, np.ndarray] = {}
        for r in self.rows.select("dims", "cell", leaf).distinct().collect():
            held = out.setdefault(r.dims, np.zeros((self.trees << self.depth, 1 << self.spread), bool))
            held[(r.tree << self.depth) + r.leaf, r.cell] = True
        return out


def _meet(vectors: pa.Table, queries: pa.Table, k: int, n_leaves: int, depth: int) -> pa.Table:
    """The best `k` of one block for each query that comes to it."""
    out = {"query": [], "id": [], "score": []}
    if vectors.num_rows and queries.num_rows:
        dims = vectors.column("dims")[0].as_py()
        x, q = _matrix(vectors.column("v"), dims), _matrix(queries.column("v"), dims)
        ids, asks = vectors.column("id").to_numpy(), queries.column("id").to_numpy()
        leaves = np.asarray(vectors.column("leaves").combine_chunks().flatten()).reshape(len(ids), -1)
        members = {}
        for t in range(leaves.shape[1]):
            order = np.argsort(leaves[:, t], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(leaves[order, t])) + 1):
                members[(t << depth) + int(leaves[rows[0], t])] = rows
        visits = [np.frombuffer(b, np.uint8) for b in queries.column("visits").to_pylist()]
        for first in range(0, len(q), CHUNK):
            some = slice(first, first + CHUNK)
            taken = np.unpackbits(np.stack(visits[some]), axis=1, count=n_leaves).astype(bool)
            score = np.full((len(taken), len(x)), -np.inf)
            for leaf, rows in members.items():
                come = np.flatnonzero(taken[:, leaf])
                if len(come):
                    score[np.ix_(come, rows)] = q[some][come] @ x[rows].T
            score[asks[some][:, None] == ids[None, :]] = -np.inf
            for one, ask, row in zip(q[some], asks[some].tolist(), score):
                found, exact = _best(one, x, ids, row, k)
                out["query"] += [ask] * len(found)
                out["id"] += found.tolist()
                out["score"] += exact.tolist()
    return pa.table(out, pa.schema({"query": pa.int64(), "id": pa.int64(), "score": pa.float64()}))


def _best(query: np.ndarray, x: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` best ids and scores of the rows that were scored at all.

    The final sums go in one order for every vector, so that equal vectors score alike; the first cut leaves room for that.
    """
    scored = np.flatnonzero(row > -np.inf)
    wanted = k
    while True:
        near = scored
        if len(near) > wanted:
            least = np.partition(row[near], -wanted)[-wanted]
            near = near[row[near] >= least - 1e-9 * (abs(least) + np.abs(row[near]).max())]
        exact = (x[near] * query).sum(1)
        order = np.lexsort((ids[near], -exact))
        near, exact = near[order], exact[order]
        new = np.sort(np.unique(ids[near], return_index=True)[1])[:k]
        if len(new) == k or len(near) == len(scored):
            return ids[near[new]], exact[new]
        wanted *= 4  # rows of one id filled the places


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, visits: float = VISITS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for every row of `queries`."""
    n_leaves, depth, spread = index.trees << index.depth, index.depth, index.spread
    count = max(1, round(visits * n_leaves))
    held = index._held()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for dims, q, rows in _by_length(batch, 1):
                if dims not in held:
                    continue
                forest, at, cells, bits = index.forest(dims), [], [], []
                for i, one in enumerate(q):
                    leaves = forest.visit(one, count)
                    taken = np.zeros(n_leaves, np.uint8)
                    taken[leaves] = 1
                    for cell in np.flatnonzero(held[dims][leaves].any(0)).tolist():
                        at.append(i)
                        cells.append(cell)
                        bits.append(np.packbits(taken).tobytes())
                rows = rows.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([dims] * len(at), pa.int32()), pa.array(cells, pa.int32()), pa.array(bits, pa.binary())], names=["id", "v", "dims", "cell", "visits"])

    # a query costs more than its bytes tell: as many tasks as the session has partitions
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _usable(queries, key, vector).repartition(tasks, "id").groupBy("id").agg(F.min("v").alias("v"))
    kind = asked.schema["v"].dataType.simpleString()
    asked = settle(asked.mapInArrow(route, f"id long, v {kind}, dims int, cell int, visits binary"))

    # cells of more than `block` rows, or that more than `block` queries come to, are cut into pieces by a hash
    def pieces(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = settle(pieces(index.rows, "parts").join(pieces(asked, "asks"), ["dims", "cell"]))
    left = index.rows.join(sizes, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    left = left.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("dims", "cell", "part", "ask", "id", "v", "leaves")
    right = asked.join(sizes, ["dims", "cell"]).withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dims", "cell", "part", "ask", "id", "v", "visits")
    groups = [x.groupBy("dims", "cell", "part", "ask") for x in (left, right)]
    found = groups[0].cogroup(groups[1]).applyInArrow(lambda x, q: _meet(x, q, k, n_leaves, depth), "query long, id long, score double")
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
