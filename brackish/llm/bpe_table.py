"""Byte-pair encoding by tables of distinct words, and decoding by the table of pieces.

A text is split at spaces and line ends, where the pre-tokenizer always cuts. Each slice of
rows has a table of its distinct words; every word in it is encoded once by the tokenizers
library, and the ids join back by the word's place in the text. Decoding joins each id with its
piece. The pieces are the tokenizer's own vocabulary, bounded by its file.

A text that holds a rarer kind of white space, or spells a special token, is encoded whole:
there the pre-tokenizer may not cut where the split does. Tables of distinct words live in the
task and are emptied beyond `KEPT_WORDS`, so memory does not grow with the corpus.

Defined results: null and empty texts have no ids and decode to the empty text. `ids` holds
unsigned 32-bit little-endian numbers. Columns named like a result are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import small

SLICE_CHARS = 1 << 18
KEPT_WORDS = 100_000
#: White space at which a text is not split.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class WordTable:
    """Ids (as bytes) of words met so far; `spread` splits one text into words."""

    def __init__(self, path: str, split: Callable[[str], list[str]], fold: bool = False):
        self.tokenizer, self.split, self.fold, self.ids = load(path), split, fold, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bool:
        return RARE_SPACE.search(text) is not None or any(s in text for s in self.special)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held, size = [], 0
        for i, t in enumerate(texts):
            held.append(t or "")
            size += len(held[-1])
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield from self._slice(held)
                held, size = [], 0

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        words = [None if self._whole(t) else self.split(t.lower() if self.fold and t.isascii() else t) for t in texts]
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        new = [w for w in dict.fromkeys(chain.from_iterable(x for x in words if x)) if w not in self.ids]
        for i in range(0, len(new), 20_000):
            self.ids.update(zip(new[i : i + 20_000], self._encode(new[i : i + 20_000])))
        for t, x in zip(texts, words):
            yield self._encode([t])[0] if x is None else b"".join(map(self.ids.__getitem__, x))


def _with(docs: DataFrame, name: str, kind: T.DataType, source: str, make: Callable[[Iterator[list]], Iterator[list]]) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, kind)])
    at = [f.name for f in kept].index(source)
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apply(batch.column(at).to_pylist()), arrow)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`, as the tokenizer in the file `path` encodes `text` without special tokens added.

    For a tokenizer that drops white space and cuts there (word ends are part of the pieces).
    """

    def make():
        table = WordTable(path, str.split, fold=True)
        return lambda texts: list(table.encode(texts))

    return _with(docs, "ids", T.BinaryType(), text, make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`: the pieces of `ids`, joined by spaces, special tokens included."""

    def make():
        tokenizer = load(path)
        pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        return lambda rows: [" ".join(map(pieces.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in rows]

    return _with(encoded, "decoded", T.StringType(), "ids", make)
