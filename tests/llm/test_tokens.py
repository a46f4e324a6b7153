import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brackish.llm import bpe_table, packing
from tests.llm import cases

WORDS, BYTES, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
STRANGE = ["a  b 　c", "don't we'll \x1c x\x85y", "  two  spaces\n\n\nlines \t", "<|endoftext|>x<|startoftext|>", "İstanbul ΣΑΣ ﬁ", "é ñ", "!\x0b!", "​­"]


def rows():
    return cases.odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(STRANGE)]


def test_words_round_trip(spark):
    t = Tokenizer.from_file(WORDS)
    found = bpe_table.decode(bpe_table.encode(cases.clashing(spark, rows()), WORDS), WORDS).collect()
    want = Counter()
    for r in rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in found) == want
    assert bpe_table.encode(cases.empty(spark), WORDS).count() == 0


def test_small_word_tables_change_nothing(spark, monkeypatch):
    texts = [r[1] for r in rows()]
    whole = list(bpe_table.WordTable(WORDS, str.split, fold=True).encode(texts))
    monkeypatch.setattr(bpe_table, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe_table, "SLICE_CHARS", 50)
    assert list(bpe_table.WordTable(WORDS, str.split, fold=True).encode(texts)) == whole


def test_pieces_and_packing(spark):
    t = Tokenizer.from_file(BYTES)
    pieces = packing.token_pieces(cases.clashing(spark, rows()), BYTES, RANKS)
    packed = packing.pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids")).collect()
    want = Counter()
    for r in rows():
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        at, n = 0, len(ids)
        while at < n:
            stop = (n - 1) % 1024 + 1 if at == 0 else at + 1024
            want[r[0], at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())] += 1
            at = stop
    assert Counter((r.doc_id, r.start, r.length, r.crc) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x[:-1]]]).tolist() and sum(n for _, n in x) <= 1024
    assert packing.pack(packing.token_pieces(cases.empty(spark), BYTES, RANKS)).count() == 0


def test_groups_exchange_until_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 600, 1000).tolist()
    packed = packing.pack(spark.createDataFrame([(i, 0, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long"))
    assert sorted(r.length for r in packed.collect()) == sorted(lengths)
    row = packing.certificate(packed).first()
    assert row.bins <= row.bound + 1
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 1024 or n <> end")
    assert full.count() == 0


def test_no_group_grows_beyond_its_size(spark, monkeypatch):
    """Bins that cannot be filled, and a third of all rows alike."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    sizes, pack = [], packing._pack

    def watched(*args):
        out = pack(*args)
        sizes.extend(r["count"] for r in out.groupBy("_group").count().collect())
        return out

    monkeypatch.setattr(packing, "_pack", watched)
    rng = np.random.default_rng(3)
    rows = [(0, 0, 0, 700)] * 200 + [(i, 0, 0, int(n)) for i, n in enumerate(rng.integers(200, 1000, 400), 1)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long"))
    assert sorted(r.length for r in packed.collect()) == sorted(r[3] for r in rows)
    assert max(sizes) <= 2 * 50


def test_proven_groups_are_left_alone(spark, monkeypatch):
    """Pieces of more than half a sequence: the sum of lengths proves half of the bins, dual feasible functions prove all."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    turns, pack = [], packing._pack
    monkeypatch.setattr(packing, "_pack", lambda rows, groups, turn, capacity: turns.append(turn) or pack(rows, groups, turn, capacity))
    packed = packing.pack(spark.createDataFrame([(i, 0, 0, 520 + i % 300) for i in range(120)], "doc_id long, piece int, start long, length long"))
    assert tuple(packing.certificate(packed).first()) == (120, 120) and turns == [0]


def test_exact_fills_keep_the_capacity():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 60, 500):
        lengths = rng.integers(1, 1025, size)
        bins, places = packing.exact_fit(lengths, 1024)
        for b in range(bins.max() + 1):
            of = np.flatnonzero(bins == b)
            of = of[np.argsort(places[of])]
            assert places[of].tolist() == np.cumsum([0, *lengths[of][:-1]]).tolist() and lengths[of].sum() <= 1024


def test_bounds_hold_and_bite():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 1025, 60)
        bins, places = packing.best_fit(lengths, 1024)
        assert packing.lower_bound(lengths, 1024) <= bins.max() + 1
    assert packing.lower_bound(np.full(10, 513), 1024) == 10 and packing.lower_bound(np.full(10, 400), 1024) == 5
