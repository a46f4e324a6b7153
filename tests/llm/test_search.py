"""Lexical search and nearest neighbours against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from brackish.llm import lexical_search, vector_search
from brackish.llm.queries import ORACLES, QUERIES
from tests.llm.cases import clashing, docs, empty, odd_rows, prose, sf

FOLDER = sf().rsplit("/", 1)[0]


def terms(text):
    fold = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold)


def brute(rows, items, k=10):
    """(item, rank, doc, score) by the formula, every document scored for every item."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, bag, n in bags:
            m = 10 + (90 * n * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words if t in bag)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


ITEMS = [(1, "five words are right HERE"), (2, None), (3, ""), (4, "straße ИВАН 中文 été"), (None, "two words"), (5, "a b c"), (5, "one two"), (6, "nowhere-at-all-zzz"), (7, "4111 1111 555")]


@pytest.mark.parametrize("block_bytes,groups,per_block", [(1 << 22, 2, 1024), (300, 1, 2), (3000, 2, 1)])
def test_search_on_odd_rows(spark, block_bytes, groups, per_block):
    base = [(100 + i, prose(random.Random(i % 7), 40, 60), None, None, None) for i in range(60)]
    rows = odd_rows() + base
    items = ITEMS + [(8, rows[6][1]), (9, base[3][1] + " " + base[9][1])]
    queries = spark.createDataFrame(items, "item_id long, text string")
    blocks = lexical_search.index(docs(spark, rows), block_bytes=block_bytes)
    got = lexical_search.search(blocks, queries, group_blocks=groups, per_block=per_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert plain(got) == brute([r[:2] for r in rows], items)


def test_tasks_hold_few_blocks_of_the_index(spark):
    """A row group, which a task holds whole, ends after a few blocks and not after a hundred."""
    import pyarrow.parquet as pq

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(1 << 40):x}" for _ in range(3000)), None, None, None) for i in range(400)]
    blocks = lexical_search.index(docs(spark, rows).repartition(1), block_bytes=1 << 18)
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert blocks.count() > 40 and max(g.total_byte_size for g in groups) < 24 << 20 and len(groups) > 1


def test_accumulators_stop(spark):
    """Once the rest cannot reach the best, common terms make no accumulator, and scores stay exact."""
    rng = random.Random(5)
    texts = [" ".join(f"common{rng.randrange(9)}" for _ in range(30)) for _ in range(600)]
    for i in range(20):
        texts[i * 30] += " " + " ".join(f"rare{j}" for j in range(12))
    blocks = [r.asDict() for r in lexical_search.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()]
    words = [f"rare{j}" for j in range(12)] + [f"common{j}" for j in range(9)]
    n, df = 600, Counter(w for t in texts for w in set(t.split()))
    weights = sorted(((w, math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))) for w in words), key=lambda x: -x[1])
    postings = lexical_search.Postings(blocks, set(words), n, sum(len(t.split()) for t in texts))
    found, scores, made = postings.search(weights, 10)
    assert made == 20
    got = list(zip(postings.ids[found].tolist(), scores.tolist()))
    assert got == [(d, s) for _, _, d, s in sorted(brute(list(enumerate(texts)), [(1, " ".join(words))]), key=lambda x: x[1])]


def test_search_of_nothing_and_clashing_names(spark):
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(lexical_search.index(empty(spark)), queries).count() == 0
    assert lexical_search.search(lexical_search.index(docs(spark)), queries.limit(0)).count() == 0
    odd = clashing(spark).selectExpr("*", "1 AS terms", "2 AS df", "3 AS doc", "4 AS rank", "5 AS query")
    asked = queries.selectExpr("*", "1 AS term", "2 AS w", "3 AS query")
    assert plain(lexical_search.search(lexical_search.index(odd), asked)) == brute([r[:2] for r in odd_rows()], ITEMS)


def test_search_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = sorted(con.execute(ORACLES["op11_lexical_search"]).fetchall(), key=str)
    assert plain(QUERIES["op11_lexical_search"](spark, FOLDER)) == want and len(want) > 100


def vectors(n=3000, dims=64, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scale is not None:
        x *= rng.uniform(*scale, n).astype(np.float32)[:, None]
    return x


def nearest(rows, queries, k=20):
    """(query, rank, id, score) in double precision over all rows."""
    usable = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    usable = [(i, v) for i, v in usable if len(v) and np.isfinite(v).all() and (v != 0).any()]
    asked = {}
    for i, v in queries:
        if any(i == j and np.array_equal(v, w) for j, w in usable):
            asked[i] = min(asked.get(i, tuple(v)), tuple(v))
    out = []
    for i, q in asked.items():
        best = {}
        for j, v in usable:
            if j != i and len(v) == len(q):
                best[j] = max(best.get(j, -np.inf), float((v * np.asarray(q, np.float64)).sum()))
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("dims,scale", [(64, None), (16, (0.2, 3.0)), (256, None), (6, (0.5, 1.5))])
def test_recall_of_neighbours(spark, dims, scale):
    x = vectors(3000, dims, scale=scale)
    table = frame(spark, enumerate(x))
    got = vector_search.search(vector_search.Index(table, sample=1000), table.where("vec_id % 60 = 0")).collect()
    want = {}
    for i in range(0, 3000, 60):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        want[i] = set(np.argsort(-s)[:20].tolist())
    found = {i: {r.vec_id for r in got if r.query_id == i} for i in want}
    assert all(len(v) == 20 for v in found.values())
    assert np.mean([len(found[i] & want[i]) / 20 for i in want]) >= 0.9
    for r in got[:200]:
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), abs=1e-12)


def test_all_leaves_give_the_exact_answer(spark):
    x = vectors(120, 5)
    odd = [(500, None), (501, []), (502, [0.0] * 5), (503, [1.0, None, 0.0, 0.0, 0.0]), (504, [float("nan")] * 5), (505, [float("inf")] * 5), (None, x[0]), (506, [1.0, 2.0]), (507, [2.0, 1.0])]
    copies = [(600 + i, x[3]) for i in range(50)] + [(20, x[7]), (20, x[8])]
    rows = [*enumerate(x), *copies, *odd]
    table = frame(spark, rows)
    for block, spread in ((8192, 4), (16, 1)):
        index = vector_search.Index(table, trees=3, depth=4, spread=spread)
        got = vector_search.search(index, table.where("vec_id % 20 = 0 or vec_id in (506, 603)"), visits=1.0, block=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        got = sorted(tuple(r) for r in got.collect())
        want = nearest(rows, [(i, v) for i, v in rows if i is not None and (i % 20 == 0 or i in (506, 603))])
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_queue_yields_leaves_best_first():
    x = vectors(2000, 8).astype(float)
    forest = vector_search.Forest(x, 8, 3, 5)
    q = x[11]
    sums = {}
    for t, (turn, cuts) in enumerate(zip(forest.turns, forest.cuts)):
        for leaf in range(32):
            node, total = 0, 0.0
            for level in range(5):
                bit = leaf >> (4 - level) & 1
                total += (1 if bit else -1) * (turn[level] @ q - cuts[level][node])
                node = 2 * node + bit
            sums[t * 32 + leaf] = total
    order = forest.visit(q, 96).tolist()
    assert sorted(order) == list(range(96))
    assert np.allclose([sums[i] for i in order], sorted(sums.values(), reverse=True))
    own = forest.leaves(q[None])[0]
    assert all(t * 32 + leaf in order[:48] for t, leaf in enumerate(own))


def test_nothing_to_search_and_clashing_names(spark):
    none = frame(spark, [(1, None)]).where("vec_id > 1")
    assert vector_search.search(vector_search.Index(none), none).count() == 0
    x = vectors(60, 4)
    table = frame(spark, enumerate(x)).selectExpr("*", "1 AS id", "2 AS v", "3 AS dims", "4 AS cell", "5 AS leaves", "6 AS score")
    assert vector_search.search(vector_search.Index(table), table.where("vec_id = 5"), visits=1.0).count() == 20


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(sf("embeddings")).collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_vector_search"](spark, FOLDER).collect())
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0])
    assert len(got) == len(want)
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)
