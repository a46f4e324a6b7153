import math
import re
from collections import Counter

from pyspark.sql import functions as F

from brackish.llm import quality_rules as Q
from tests.llm import cases


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_texts(spark):
    rows = Q.measure(cases.clashing(spark).withColumn("t", F.col("text")).select("doc_id", "text")).collect()
    want = Counter((r[0], *brute(r[1])) for r in cases.odd_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want


def test_binomial_tail_is_exact(spark):
    tried = [(0, 10), (3, 50), (0, 1000), (7, 1000), (9, 1000), (12, 1000), (50, 20_000), (150, 20_000)]
    got = spark.createDataFrame(tried, "k long, n long").select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for k, n, p in got:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1))
        assert p == (1.0 if k >= n * 0.01 else p) and (k >= n * 0.01 or abs(p - exact) < 1e-9 * exact + 1e-12)


def labelled(spark, n=4000):
    """Texts of 60 words; every tenth is bad and full of signs."""
    good = "word other more text here now then each some such " * 6
    rows = [(i, " ".join(f"{w}{j}{'***' if i % 10 == 0 else ''}" for j, w in enumerate(good.split())), None, None, None) for i in range(n)]
    docs = cases.docs(spark, rows)
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, quality int")
    return docs, labels


def test_cutoffs_reject_bad_texts_and_keep_good_ones(spark):
    docs, labels = labelled(spark)
    measured = Q.measure(docs)
    cutoffs = Q.certify(measured, labels)
    assert [tuple(r) for r in cutoffs.select("stratum", "rule").collect()] == [(0, "signs")]
    kept = {r.doc_id: r.kept for r in Q.judge(measured, cutoffs).collect()}
    assert len(kept) == 4000 and all(k == (i % 10 != 0) for i, k in kept.items())


def test_few_labels_prove_nothing(spark):
    docs, labels = labelled(spark, 200)
    measured = Q.measure(docs)
    assert Q.certify(measured, labels).count() == 0
    assert Q.judge(measured, Q.certify(measured, labels)).where("kept").count() == 200


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    measured = Q.measure(cases.empty(spark))
    assert Q.judge(measured, Q.certify(measured, labels)).count() == 0


def test_query_equals_its_sql(spark):
    from brackish.llm.queries import ORACLES, QUERIES
    from tests.oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op1_quality_rules", QUERIES["op1_quality_rules"], ORACLES["op1_quality_rules"]) == ""


def test_sql_finds_the_same_cutoffs(spark, tmp_path):
    """On a table with enough labels for cutoffs, which the small test tables lack."""
    import duckdb

    docs, labels = labelled(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.where("doc_id is not null and quality is not null").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    from brackish.llm.queries import ORACLES, QUERIES

    got = QUERIES["op1_quality_rules"](spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(ORACLES["op1_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all() and 0 < got["kept"].sum() < len(got)
