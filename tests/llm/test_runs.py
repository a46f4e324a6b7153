"""Runs of repeated words against brute force, down to the registered query's digests."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from brackish.llm import periodic_runs
from brackish.llm.queries import QUERIES
from tests.llm.cases import clashing, docs, empty, odd_rows, sf


def brute(words, least=6, exponent=4):
    """Every run, by the definition: maximal stretches of equal words q apart, smallest q of each stretch."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - start >= 2 * q and (start, i) not in seen:
                seen.add((start, i))
                out.append((start, i - start, q))
    return sorted((r for r in out if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def loop(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = loop(doc_id, split(text))
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[6:]))


def test_automaton_finds_every_run():
    rng = random.Random(1)
    for _ in range(800):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        words = loop(rng.randrange(1000), [rng.randrange(k) for _ in range(n)])
        assert periodic_runs.runs_of(words, 2, 2) == brute(words, 2, 2)
        assert periodic_runs.runs_of(words) == brute(words)


def test_runs_of_known_words():
    assert periodic_runs.runs_of(list("aaaaaa")) == [(0, 6, 1)]
    assert periodic_runs.runs_of(list("aaaaa")) == []
    assert periodic_runs.runs_of(list("xabababaab")) == []
    assert periodic_runs.runs_of(list("xababababc")) == [(1, 8, 2)]
    nested = list("aaaaaab") * 4
    assert periodic_runs.runs_of(nested) == sorted(brute(nested), key=lambda r: (r[0], r[2]))
    assert {q for _, _, q in periodic_runs.runs_of(nested)} == {1, 7}


def test_left_out_stretches_hold_no_run(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(rng.choice([2, 5, 400]))}" for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):  # loops of several lengths inside
            at, q, n = rng.randrange(len(words) + 1), rng.randint(1, 12), rng.randint(0, 60)
            piece = [f"p{rng.randrange(6)}" for _ in range(q)]
            words[at:at] = [piece[i % q] for i in range(n)]
        texts.append(" ".join(words))
    found = periodic_runs.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in found.collect()}
    assert got == {i: brute(split(t)) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def test_digests_on_odd_rows(spark):
    loops = [(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 90)), None, None, None) for i in range(100, 260)]
    looped = odd_rows() + loops + [(0, "b " * 12, None, None, None)]
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.with_loops(docs(spark, looped))))
    want = [expected(r[0], r[1]) for r in looped if r[1] is None or len(r[1].split()) < 2000]
    long_ids = {r[0] for r in looped if r[1] and len(r[1].split()) >= 2000}
    assert [r for r in rows(got) if r[0] not in long_ids] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[6:]))


def test_query(spark):
    table = spark.read.parquet(sf())
    got = rows(QUERIES["op13_periodic_runs"](spark, sf().rsplit("/", 1)[0]))
    texts = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted((expected(i, t) for i, t in texts if len(split(t)) < 1500), key=lambda r: (r[0] is None, r[0] or 0, r[6:]))
    held = {w[0] for w in want}
    assert len(got) == len(texts)
    assert [r for r in got if r[0] in held] == want
    assert sum(r[1] > 0 for r in want) >= 10


def test_empty_clashing_and_very_long(spark):
    found = periodic_runs.find(empty(spark))
    assert found.columns == ["doc_id", "n_words", "runs", "kept_text"] and found.count() == 0
    odd = clashing(spark).withColumns({"runs": F.lit(1), "kept_text": F.lit("x"), "doc": F.lit(2)})
    assert periodic_runs.find(odd).count() == len(odd_rows())
    long_text = " ".join(f"w{i % 1000}" for i in range(100_000))
    row = periodic_runs.find(spark.createDataFrame([("k", long_text)], "doc_id string, text string")).first()
    assert row.doc_id == "k" and [tuple(r) for r in row.runs] == [(0, 100_000, 1000)] and len(row.kept_text.split()) == 1000
