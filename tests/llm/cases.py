"""Small tables with every odd case: nulls, empty and very long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators return, as columns of the input.
CLASH = ["n_words", "score", "pii", "ids", "start", "length", "component_id", "lang_pred", "_spans", "key", "text_2"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    long_text = prose(rng, 30_000, 3000)
    base = prose(rng, 300)
    passage = prose(rng, 70)
    words = base.split()
    near = " ".join("changed" if i in (20, 200) else w for i, w in enumerate(words))
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "Two words",
        "five words are right here",
        base,
        base,
        base.upper(),
        near,
        near + " end",
        f"{prose(rng, 90)}\n{passage}  {prose(rng, 60)}",
        f"{passage} {prose(rng, 55)}",
        f"{prose(rng, 20)} {passage}",
        long_text,
        "x" * 100_000,
        "same line\nsame line\n\nother\nsame line",
        "été ça ñandú straße ИВАН 中文     \x1c \x0b end",
        "a b c a b c a b c " * 30,
        "<|endoftext|> and <|startoftext|> are text",
        "mail bob@example.org or call +1 555 123 4567, 10.0.0.1, 4111 1111 1111 1111",
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None))
    rows.append((None, passage, "en", None, None))
    rows.append(rows[6])
    rows.append(rows[5])
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def clashing(spark, rows=None):
    from pyspark.sql import functions as F

    return docs(spark, rows).withColumns({c: F.lit(7) for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sf(name: str = "documents") -> str:
    return f"/root/testdata/sf0.001/{name}.parquet"
