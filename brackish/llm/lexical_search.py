"""Ranked lexical search: term-at-a-time with a limit on accumulators, over blocks of documents.

Terms are runs of digits, letters and characters beyond ASCII; only A-Z is lower-cased. A document is scored by the
sum, over the distinct terms of a query, of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), where w =
floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 10 + (90 * n * N) div L; N counts the documents with a term, L all
their terms, n the document's terms.

Index: about `BLOCK_BYTES` of text make one block, a row with its terms, their postings and the lengths of its
documents. N, L and df come from the blocks by aggregation. Row groups of the settled index hold a few blocks, so that no task holds more.

Search: queries are cut into blocks of about `QUERIES`, and every block of queries meets every `GROUP_BLOCKS` blocks of
documents as one group. A group takes each query's terms rarest first and keeps an accumulator a document. Once the
best that the remaining terms can add, the sum of their largest contributions in the group, is
less than the k-th partial score, no document without an accumulator can be among the k best, and none is
created any more; those that exist are updated by all remaining terms, so their scores are exact. The best k of the
groups are ranked once more. No postings of frequent terms are joined with queries, and neither memory nor rows grow
with the documents that hold a term.

Defined results: a null or empty text has no terms; such a document is not counted in N and never found. Rows of
documents with one id count as documents each. Rows with a null id count in N, L and df and are never found. Query rows
with one id are one query with the terms of all; a null query id is a query like others. A query without terms, or whose
terms no document holds, has no rows. Texts of any length are read whole; a longer text than a block
makes a block of its own. Only key and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackish.llm.tables import LARGE_ROWS, settle, small

K, BLOCK_BYTES, GROUP_BLOCKS, QUERIES = 10, 1 << 20, 6, 1024
#: Between terms: ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 or chr(b) in string.ascii_letters + string.digits else 0x20 for b in range(256)).lower()


def _block(ids: list[int | None], texts: list[bytes]) -> dict:
    """One row of the index; postings are in the order of terms, and within a term in that of documents."""
    known: dict[bytes, int] = {}
    codes, lengths = [], []
    for text in texts:
        words = text.translate(_FOLD).split()
        lengths.append(len(words))
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    doc = np.repeat(np.arange(len(texts)), lengths)
    keys, tf = np.unique(np.concatenate(codes or [doc]) * len(texts) + doc, return_counts=True)
    return {
        "ids": np.array([x or 0 for x in ids], np.int64).tobytes(),
        "named": np.array([x is not None for x in ids], bool).tobytes(),
        "lengths": np.array(lengths, np.int64).tobytes(),
        "n_docs": sum(n > 0 for n in lengths),
        "n_terms": sum(lengths),
        "terms": [w.decode("utf-8", "replace") for w in known],
        "df": np.bincount(keys // max(len(texts), 1), minlength=len(known)).tolist(),
        "post_doc": (keys % max(len(texts), 1)).astype(np.int32).tobytes(),
        "post_tf": tf.astype(np.int32).tobytes(),
    }


_INDEX = pa.schema(
    {
        **dict.fromkeys(("ids", "named", "lengths"), pa.binary()),
        "n_docs": pa.int64(),
        "n_terms": pa.int64(),
        "terms": pa.list_(pa.string()),
        "df": pa.list_(pa.int64()),
        **dict.fromkeys(("post_doc", "post_tf"), pa.binary()),
    }
)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of `docs`; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in small(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 16
                if held >= block_bytes:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts)], _INDEX)
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, texts)], _INDEX)

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    shape = "ids binary, named binary, lengths binary, n_docs long, n_terms long, terms array<string>, df array<long>, post_doc binary, post_tf binary"
    return settle(rows.mapInArrow(run, shape), **LARGE_ROWS)


def weigh(blocks: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(query, terms): every query that can find something, with its terms and weights, rarest first; settled."""
    folded = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    asked = queries.select(F.col(key).alias("query"), F.explode(F.split(folded, BETWEEN)).alias("term")).where("term <> ''").distinct()
    held = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    n = blocks.agg(F.sum("n_docs")).first()[0] or 0
    w = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    weighed = asked.join(held, "term").select("query", "term", w).where("w > 0")
    rarest = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "term")))
    terms = F.transform(rarest, lambda x: F.struct(x["term"].alias("term"), (-x["order"]).alias("w")))
    return settle(weighed.groupBy("query").agg(terms.alias("terms")))


class Postings:
    """The postings of one group of blocks, by term, for the terms that its queries ask for."""

    def __init__(self, blocks: list[dict], asked: set[str], n: int, total: int):
        ids, lists, first = [], {}, 0
        for b in blocks:
            own = np.frombuffer(b["ids"], np.int64)
            named = np.frombuffer(b["named"], bool)
            m = 100 - 90 + (90 * np.frombuffer(b["lengths"], np.int64) * n) // max(total, 1)
            doc = np.frombuffer(b["post_doc"], np.int32).astype(np.int64)
            tf = np.frombuffer(b["post_tf"], np.int32).astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            bounds = np.append(0, np.cumsum(np.asarray(b["df"], np.int64)))
            for t, term in enumerate(b["terms"]):
                if term in asked:
                    d, x = doc[bounds[t] : bounds[t + 1]], impact[bounds[t] : bounds[t + 1]]
                    some = named[d]
                    lists.setdefault(term, []).append((d[some] + first, x[some]))
            ids.append(own)
            first += len(own)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.lists = {t: tuple(map(np.concatenate, zip(*x))) for t, x in lists.items()}
        self.most = {t: int(x.max()) for t, (_, x) in self.lists.items() if len(x)}

    def search(self, terms: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(document numbers, scores) of the best `k`, best first, and how many accumulators were made."""
        terms = [(t, w) for t, w in terms if t in self.most]
        rest = np.append(np.cumsum([w * self.most[t] for t, w in terms][::-1], dtype=np.int64)[::-1], 0)
        score, made, creating = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for i, (term, w) in enumerate(terms):
            doc, impact = self.lists[term]
            if not creating:
                alive = made[doc]
                doc, impact = doc[alive], impact[alive]
            score[doc] += w * impact
            if creating:
                made[doc] = True
                if rest[i + 1] < score.max() and len(score) >= k:
                    creating = rest[i + 1] >= np.partition(score, -k)[-k]
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        found = found[np.lexsort((self.ids[found], -score[found]))][:k]
        return found, score[found], int(made.sum())


def search(blocks: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", doc_key: str = "doc_id", k: int = K, group_blocks: int = GROUP_BLOCKS, per_block: int = QUERIES) -> DataFrame:
    """(key, rank, doc_key, score): the `k` best documents of every query among the `blocks` of `index`."""
    asked = weigh(blocks, queries, key, text)
    n_blocks, n, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    groups = max(1, -(-n_blocks // group_blocks))
    parts = max(1, -(-asked.count() // per_block))
    kind = asked.schema["query"].dataType.simpleString()

    def meet(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "doc": [], "score": []}
        queries = asked.select(["query", "terms"]).to_pylist()
        postings = Postings(docs.drop(["group", "part"]).to_pylist(), {t["term"] for q in queries for t in q["terms"]}, n, total)
        for q in queries:
            found, score, _ = postings.search([(t["term"], t["w"]) for t in q["terms"]], k)
            out["query"] += [q["query"]] * len(found)
            out["doc"] += postings.ids[found].tolist()
            out["score"] += score.tolist()
        return pa.table(out, pa.schema({"query": asked.schema.field("query").type, "doc": pa.int64(), "score": pa.int64()}))

    # the place of a block in its group follows from its content, so that a lost task deals alike
    left = blocks.withColumn("group", F.pmod(F.xxhash64("ids", "lengths", F.crc32("post_tf")), F.lit(groups)))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("group", "part")
    right = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    right = right.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).groupBy("group", "part")
    best = left.cogroup(right).applyInArrow(meet, f"query {kind}, doc long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(key), "rank", F.col("doc").alias(doc_key), "score")


SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^{BETWEEN[1:-2]}]+') AS words
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS total FROM docs WHERE len(words) > 0),
counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^{BETWEEN[1:-2]}]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
