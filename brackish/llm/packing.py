"""Packing token pieces into sequences: best fit decreasing, certified by lower bounds.

Pieces are dealt by a hash of their row number into groups of about `GROUP_ROWS` rows. Each group
packs best fit decreasing or bin by bin with exact fills, whichever is better, and computes lower
bounds of its bin count from dual feasible functions. A group that meets its bound stays as it is;
what the others left in bins that are not full is exchanged: dealt anew and packed again. A turn that saves no bin is dropped, and
the next takes a quarter of the rows, those of the emptiest bins; the last takes one group. Groups
that are each proven may still leave one bin too many each: when no gap is left to close and the
bound of all lengths is not met, the emptiest bins of all groups are exchanged in the same way.

The number of groups follows from the number of pieces dealt, in every turn by the same rule; no
group is larger than about `GROUP_ROWS`, whatever the lengths or keys are.

Defined results: a null or empty text is one piece that holds the end id only. Repeated rows
give repeated pieces, each packed for itself. Packing an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.bpe_table import load
from brackish.llm.tables import settle, small

GROUP_ROWS = 40_000
#: Characters beyond plain Latin text, and runs so long that they are left to the reference encoder.
_UNUSUAL = re.compile("[^\t\\n\\r\\x20-\\x7e\\xa1-\u024f]|[^\\s]{2000}")


@cache
def _by_ranks(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Ids of texts by a byte-level vocabulary, as the tokenizers library gives them.

    Plain Latin text goes through the same vocabulary as ranks, which is several times as fast; text
    with other characters, very long runs or the spelling of a special token goes through the library.
    """

    def __init__(self, path: str, ranks: str | None):
        self.tokenizer, self.fast = load(path), _by_ranks(ranks) if ranks else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def token_pieces(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids) of every text; ids end with `end_id`.

    Texts longer than `capacity` are cut; the first piece takes the remainder, all others are full.
    `path` is the vocabulary file of the tokenizers library, `ranks` the same vocabulary as ranks.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path, ranks)
        for batch in small(batches):
            rows = [[], [], [], [], []]
            held = 0
            for name, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text_.as_py() or "").tobytes() + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    stop = (n - 1) % capacity + 1 if at == 0 else at + capacity
                    for out, x in zip(rows, (name, piece, at, stop - at, ids[4 * at : 4 * stop])):
                        out.append(x)
                    at, piece, held = stop, piece + 1, held + 1
                    if held == 5000:
                        yield _pieces(rows, batch.schema.field(0).type)
                        rows, held = [[], [], [], [], []], 0
            yield _pieces(rows, batch.schema.field(0).type)

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def _pieces(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["key", "piece", "start", "length", "ids"])


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The greatest bound of the bin count that these dual feasible functions prove; `times` counts each of distinct lengths."""
    sizes, counts = np.unique(lengths, return_counts=True) if times is None else (lengths, times)
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    bounds = [-(-int(sizes @ counts) // capacity)]
    for low in range(1, capacity // 2 + 1):  # small pieces vanish, very large ones fill a bin
        f = np.where(sizes > capacity - low, capacity, np.where(sizes >= low, sizes, 0))
        bounds.append(-(-int(f @ counts) // capacity))
    for k in range(1, 33):  # lengths rounded down to multiples of 1/(k+1), counted as 1/k
        whole = (k + 1) * sizes % capacity == 0
        f = np.where(whole, k * sizes, (k + 1) * sizes // capacity * capacity)
        bounds.append(-(-int(f @ counts) // (k * capacity)))
    return max(bounds)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece, longest first into the fullest bin with room."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b, used = capacity, used, used + 1
        bins[i], places[i] = b, capacity - left
        room[left - n].append(b)
        mask |= 1 << (left - n)
    return bins, places


def exact_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As `best_fit`, bin by bin: the longest piece left, then what fills the room with one or two pieces, else the longest that fits.

    Bins are full while short pieces last, so that the room left over gathers in the last bins.
    """
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        held[int(lengths[i])].append(i)
    mask = sum(1 << n for n, x in enumerate(held) if x)
    back = sum(1 << (capacity - n) for n, x in enumerate(held) if x)
    used = 0
    while mask:
        room = capacity
        while fits := mask & ((2 << room) - 1):
            if room == capacity or fits >> room:
                n = fits.bit_length() - 1
            else:
                pair = fits & (back >> (capacity - room))
                if room % 2 == 0 and len(held[room // 2]) == 1:
                    pair &= ~(1 << (room // 2))
                n = (pair or fits).bit_length() - 1
            i = held[n].pop()
            bins[i], places[i] = used, capacity - room
            room -= n
            if not held[n]:
                mask &= ~(1 << n)
                back &= ~(1 << (capacity - n))
        used += 1
    return bins, places


def _better(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The packing with fewer bins, and among equals the one whose room is gathered in fewer bins."""
    tried = [f(lengths, capacity) for f in (best_fit, exact_fit)]
    return min(tried, key=lambda x: (x[0].max(), -float((np.bincount(x[0], lengths) ** 2).sum())))


def _pack(rows: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Deal `rows` into groups and pack each; settled, with the group's bins and bound on every row."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "_fill", "_group", "_bins", "_bound")]
    dealt = rows.select(*[F.col(f"`{c}`") for c in names], F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)).alias("_group"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        lengths = t.column("length").to_numpy()
        bins, places = _better(lengths, capacity)
        fill = np.bincount(bins, lengths, minlength=1).astype(np.int64)
        base = (turn << 48) + (t.column("_group")[0].as_py() << 24)
        n = len(lengths)
        more = {"sequence_id": bins + base, "offset": places, "_fill": fill[bins], "_bins": np.full(n, bins.max() + 1), "_bound": np.full(n, lower_bound(lengths, capacity))}
        for name, x in more.items():
            t = t.append_column(name, pa.array(x, pa.int64()))
        yield from t.to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return settle(dealt.groupBy("_group").applyInArrow(pack, f"{kinds}, sequence_id long, offset long, _fill long, _bins long, _bound long"))


def _whole_bound(pieces: DataFrame, capacity: int) -> int:
    """The bound of all lengths; one count a length reaches the driver."""
    counted = np.array(pieces.groupBy("length").count().collect(), np.int64).reshape(-1, 2)
    return lower_bound(counted[:, 0], capacity, counted[:, 1])


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: bins used, and the bound that dual feasible functions prove for any packing of these lengths."""
    bins = packed.select("sequence_id").distinct().count()
    return packed.sparkSession.createDataFrame([(bins, _whole_bound(packed, capacity))], "bins long, bound long")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; `length` is between 1 and `capacity`.

    `pieces` is computed once and settled. Sequences have no gaps and hold at most `capacity`.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = settle(pieces.select(*names, F.monotonically_increasing_id().alias("_row")))  # equal rows spread over the groups
    n = rows.count()
    if not n:
        return rows.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    groups, turn, most, gaps = -(-n // GROUP_ROWS), 0, n, True
    parts = [_pack(rows, groups, turn, capacity)]
    bins, bound = parts[0].where("offset = 0").count(), _whole_bound(rows, capacity)
    while bins > bound and groups > 1:
        chosen = (F.col("_fill") < capacity) & (F.col("_bins") > F.col("_bound") if gaps else F.lit(True))
        fills = _union(parts).where(chosen).groupBy("_fill").agg(F.count("*").alias("rows"), F.count_if(F.col("offset") == 0).alias("bins")).orderBy("_fill").collect()
        taken, limit = [0, 0, 0], 0  # rows, bins and tokens of the emptiest bins, `most` rows or one fill at least
        for fill, k, b in fills:
            if taken[0] and taken[0] + k > most:
                break
            taken, limit = [taken[0] + k, taken[1] + b, taken[2] + fill * b], fill + 1
        hopeless = taken[1] <= -(-taken[2] // capacity)
        saved = 0
        if not hopeless:
            chosen, turn = chosen & (F.col("_fill") < limit), turn + 1
            again = _pack(_union(parts).where(chosen), -(-taken[0] // GROUP_ROWS), turn, capacity)
            saved = taken[1] - again.where("offset = 0").count()
        if saved > 0:
            parts, bins = [*[p.where(~chosen) for p in parts], again], bins - saved
        elif not hopeless and most > GROUP_ROWS:
            most = max(min(most, taken[0]) // 4, GROUP_ROWS)
        elif gaps:
            gaps, most = False, n
        else:
            break
    return _union(parts).select(*[F.col(f"`{c}`") for c in names], "sequence_id", "offset")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
