"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.llm import bpe_table, embedding_dedup, language_id, lexical_search, ngram_join, packing, periodic_runs, pii, quality_rules, secrets, substring_dedup, toxicity, vector_search
from brackish.llm.tables import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op9_bpe_tables")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = _vocabulary("word_bpe_49k.json")
    encoded = bpe_table.encode(table(spark, folder, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe_table.decode(encoded, path).select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    prototypes = language_id.learn(docs.where(~out))
    found = language_id.identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op1_quality_rules", quality_rules.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    measured = settle(quality_rules.measure(table(spark, folder, "documents")))
    cutoffs = quality_rules.certify(measured, table(spark, folder, "labels"))
    return quality_rules.judge(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"))
    scorer = toxicity.learn(docs, table(spark, folder, "labels").where(~out))
    return toxicity.score(docs, scorer).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["plain"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")


def _spans(spans: str):
    written = pii.written(F.col(spans), only_plain=True)
    return F.sha2(written.cast("binary"), 256).alias("base_sha256"), pii.written(F.col(spans)).alias("spans")


@query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii")
    return found.select("doc_id", *[_count("pii", k) for k in pii.KINDS], *_spans("pii"))


@query("op7_secrets")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.thresholds(docs)).select("doc_id", "secrets")
    return found.select("doc_id", *[_count("secrets", k) for k in secrets.KINDS[:3]], *_spans("secrets"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


@query("op6_ngram_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.link(table(spark, folder, "embeddings"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_loops(docs)))


@query("op11_lexical_search", lexical_search.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(lexical_search.index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


@query("op12_vector_search")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vector_search.Index(vectors), vectors.where("vec_id % 20 = 0"))
