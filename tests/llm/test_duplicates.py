import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackish.llm import embedding_dedup, ngram_join, substring_dedup
from brackish.llm.tables import components
from tests.llm import cases


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return (text or "").encode().split()


def brute_removal(rows, length):
    first = {}
    for i, t in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = []
    for i, t in (r[:2] for r in rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("length", [50, 5, 1])
def test_substrings_against_brute_force(spark, length):
    rows = [r for r in cases.odd_rows() if length == 50 or r[0] != 14]
    found = substring_dedup.remove(cases.clashing(spark, rows), length)
    assert set(cases.CLASH) <= set(found.columns)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in found.collect()) == brute_removal(rows, length)


def test_substring_text_keeps_its_white_space(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a  b\n{p}", None, None, None), (2, f"c\t d {p}  e\nf", None, None, None), (3, None, None, None, None)]
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove(cases.docs(spark, rows)).collect()}
    assert got == {1: f"a  b\n{p}", 2: "c\t d\ne\nf", 3: None}
    assert substring_dedup.remove(cases.empty(spark)).count() == 0


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, by, groups = {}, defaultdict(list), Sets()
    for i, t in {r[:2] for r in rows if r[0] is not None}:
        sets[i] = shingles(t)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in by[s])
        for s in sets[i]:
            by[s].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                groups.join(i, j)
    return Counter((r[0], len(shingles(r[1])), None if r[0] is None else groups.find(r[0])) for r in rows)


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = cases.odd_rows()
    for k in range(12):  # families of edited copies around the threshold, with one passage in all of them
        n = int(rng.integers(4, 90))
        base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        for _ in range(6):
            w = list(base)
            for i in rng.choice(n, int(rng.integers(0, max(1, n // 14) + 1)), replace=False):
                w[i] = f"v{rng.integers(0, 10_000)}"
            rows.append((1000 + len(rows), " ".join(w) + (" released under the common license of this place" if k % 2 else ""), None, None, None))
    # exactly 3/4: 7 and 7 shingles, 6 shared
    rows += [(5000, " ".join("abcdefghijk"), None, None, None), (5001, " ".join("zbcdefghijk"), None, None, None)]
    got = ngram_join.link(cases.clashing(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]


def test_jaccard_of_a_table_and_of_none(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(cases.sf()).collect()]
    got = Counter(tuple(r) for r in ngram_join.link(spark.read.parquet(cases.sf())).collect())
    assert got == brute_components(rows)
    assert ngram_join.link(cases.empty(spark)).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(30):
            center = rng.standard_normal(64)
            for _ in range(int(rng.integers(1, 30))):
                rows.append((i, (center + rng.standard_normal(64) * rng.choice([0.01, 0.1, 0.14])).astype(np.float32).tolist(), label))
                i += 1
    same = rows[0][1]
    rows += [(i + k, same, 0) for k in range(40)]
    rows.append(rows[0])
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] * 64, 0), (9004, [None] * 64, 0), (9005, same, None), (9006, same[:10], 0), (None, same, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {(r[0], r[1], r[2], r[3]) for r in embedding_dedup.link(table, block=16).collect()}
    links, groups = Counter(), Sets()
    unit = [np.asarray(r[1], float) / np.linalg.norm(np.asarray(r[1], float)) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                groups.join(rows[a][0], rows[b][0])
    want = {(r[0], links[k], groups.find(r[0]), groups.find(r[0]) == r[0]) for k, r in enumerate(rows)}
    want |= {(x[0], 0, x[0], True) for x in odd}
    found = sum(r[1] for r in got)
    assert found >= 0.9 * sum(r[1] for r in want) and {r[0] for r in got} == {r[0] for r in want}
    assert {r for r in got if r[0] is None or r[0] >= 9000} == {r for r in want if r[0] is None or r[0] >= 9000}
    assert len(got & want) >= 0.9 * len(want)
    assert embedding_dedup.link(table.limit(0)).count() == 0


def test_digest_of_the_query(spark):
    from brackish.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(cases.sf()).collect()]
    want = {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_removal(rows, 50)}
    assert {tuple(r) for r in QUERIES["op2_substring_dedup"](spark, "/root/testdata/sf0.001").collect()} == want


def test_shared_keys_do_not_depend_on_how_they_are_dealt(spark):
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{common} {' '.join(f'w{i % 40}x{j}' for j in range(i % 25))}", None, None, None) for i in range(300)]
    rows += cases.odd_rows()
    texts = cases.docs(spark, rows).select("doc_id", "text").toDF("doc", "text").repartition(3, "text")
    found = [Counter(tuple(r) for r in ngram_join._keys(texts, 5, total, held, often).collect()) for total, held, often in ((1, 1 << 20, 1 << 30), (50_000, 2000, 4), (50_000, 500, 2), (1, 1 << 20, 2))]
    counts = Counter(k for k, _, _ in found[0].elements())
    assert all(counts[k] == n > 1 for k, _, n in found[0])
    assert max(counts.values()) >= 200
    for other in found[1:]:
        assert other == found[0]


@pytest.mark.parametrize("dims", [64, 128, 256, 768])
def test_recall_of_links_at_any_dimension(spark, dims):
    """Pairs at cosines from 0.98 to 0.995, the hard ones: at least 0.9 of the links are found, none is made up."""
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(250):
        a = rng.standard_normal(dims)
        b = rng.standard_normal(dims)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9801, 0.995)
        rows += [(2 * k, a.tolist(), k % 3), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), k % 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns({"id": F.lit(1), "v": F.lit(2), "bucket": F.lit(3)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(table).collect()}
    assert len(got) == 500 and all(got[i] in ((0, i), (1, i - i % 2)) for i in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * 500


def test_sample_of_vectors_does_not_grow_with_tasks(spark):
    """What reaches the driver are the vectors below a hash, and not the first of every task; small buckets share a group."""
    rows = spark.range(0, 20_000, 1, 40).selectExpr("id", "cast(id % 3 as string) label", "array(cast(id as double), 1.0) v")
    sent = []
    plain = type(rows).toArrow
    type(rows).toArrow = lambda self: (lambda out: (sent.append(out.num_rows), out)[1])(plain(self))
    try:
        got = embedding_dedup._sampled(rows, 300)
    finally:
        type(rows).toArrow = plain
    assert got.num_rows == 300 and sent[0] < 600
    hashes = sorted(r.h for r in rows.selectExpr("xxhash64(id, v, label) h").collect())
    assert got.column("h").to_pylist() == hashes[:300]
    assert embedding_dedup._sampled(rows.limit(5), 300).num_rows == 5


def test_buckets_in_one_group_are_compared_apart():
    import pyarrow as pa

    e = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02]]
    rows = {"bucket": [7, 7, 9, 9, 9], "first": [0, 0, 0, 0, 0], "second": [1, 1, 2, 2, 2], "one": [0] * 5, "two": [0] * 5, "block": [0] * 5, "id": [5, 3, 3, 5, 8], "copies": [1, 2, 2, 1, 4], "v": [e[0], e[1], e[1], e[0], e[2]], "chunks": [[1, 1, 4], [1, 1, 4], [1, 1, 4], [1, 1, 4], [1, 2, 4]]}
    got = embedding_dedup._compare(pa.table({**rows, "id": pa.array(rows["id"], pa.int64()), "copies": pa.array(rows["copies"], pa.int64())}), 0.98).to_pylist()
    # 3 and 5 meet in the table of chunks 0 and 1 already, 8 only in that of 0 and 2
    assert sorted((r["id"], r["links"], r["low"]) for r in got) == [(3, 1, 3), (3, 4, 3), (5, 2, 3), (5, 4, 3), (8, 3, 3)]
