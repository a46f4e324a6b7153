"""A training corpus from raw documents: language, near copies, repeated passages, personal data, sequences.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
`docs`, whatever further columns those have and however they are called. `run` writes each stage's
result as Parquet and reads it again for the next.

Defined results: an empty table gives an empty table. A null text is a document without letters and goes at
the first stage. Rows with one id count as one document; of such rows, one stays. Rows with a null id stay
and belong to no group. `n_chars`, where there is such a column, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.llm import language_id, ngram_join, packing, pii, substring_dedup
from brackish.llm.tables import settle, table

#: A model and the lengths of sets are no matter for SQL; the stages are tested against brute force.
ORACLE_SQL = None


class _Columns:
    """The columns of a table under names that clash with no result, and the way back."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.names = {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)}

    def plain(self) -> DataFrame:
        return self.docs.select(*[F.col(f"`{c}`").alias(n) for c, n in self.names.items()])

    def back(self, rows: DataFrame, text: str = "text") -> DataFrame:
        def column(c: str, n: str):
            if c == "text":
                return F.col(text).alias(c)
            if c == "n_chars":
                return F.length(text).cast(self.docs.schema[c].dataType).alias(c)
            return F.col(n).alias(c)

        return rows.select(*[column(c, n) for c, n in self.names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches: more like it than texts that share nothing with it ever are."""
    columns = _Columns(docs)
    prototypes = language_id.learn(docs, dimensions=4096)
    found = language_id.identify(columns.plain(), prototypes)
    return language_id.accepted(found, prototypes).select(*columns.names.values()).toDF(*columns.names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    first = ngram_join.link(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    columns = _Columns(docs)
    rows = columns.plain()
    others = [n for n in columns.names.values() if n != "doc_id"]
    stay = rows.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")
    return stay.unionByName(rows.where("doc_id is null")).select(*columns.names.values()).toDF(*columns.names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller id has; those that lose all words go."""
    columns = _Columns(docs)
    found = substring_dedup.remove(columns.plain())
    return columns.back(found.where("n_removed = 0 or n_removed < n_words"), "kept_text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal identifier replaced by its kind."""
    columns = _Columns(docs)
    return columns.back(pii.redact(pii.find(columns.plain())))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 1,024 tokens."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
