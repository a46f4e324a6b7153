import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from brackish.llm.tables import settle
from tests.llm import cases
from tests.llm.test_duplicates import brute_components, brute_removal


def test_stages_on_odd_rows(spark):
    # every text teaches, so that none is of an unknown language (test_text has those)
    docs = settle(cases.clashing(spark).withColumn("lang", F.coalesce("lang", F.lit("en"))))
    columns = docs.columns
    seen = [docs]
    for _, stage in P.STAGES[:-1]:
        seen.append(settle(stage(spark, seen[-1], "")))
        assert seen[-1].columns == columns
    rows = [[(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in x.collect()] for x in seen]
    # languages: rows without letters go, clean rows stay
    assert Counter(rows[1]) == Counter(r for r in rows[0] if re.search(r"[^\W\d_]", r[1] or ""))
    # near copies: the smallest id of each group, once, and rows without an id
    groups = {k[0] for k in brute_components(rows[1]) if k[0] == k[2] and k[0] is not None}
    assert Counter(rows[2]) == Counter({r for r in rows[1] if r[0] in groups}) + Counter(r for r in rows[1] if r[0] is None)
    # passages
    want = brute_removal(rows[2], 50)
    assert Counter((r[0], " ".join(x.decode() for x in (r[1] or "").encode().split())) for r in rows[3]) == Counter({(i, k): n for (i, w, m, k), n in want.items() if m < w or not m})
    # personal data
    assert [r[1] for r in rows[4] if r[0] == 20] == ["mail <email> or call <phone>, <ip>, <card>"]
    assert all(r[4] == len(r[1]) for r in rows[4])
    packed = P.STAGES[-1][1](spark, seen[-1], "").collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows[4]}


def test_empty_corpus(spark):
    docs = cases.empty(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_on_a_table(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in rows}) > 100 and all(r.offset + r.length <= 1024 for r in rows)
