"""Secrets in text: known shapes, and strings that pass a battery of randomness tests.

Known shapes (assign, access, hex) are found as written. Every other string of `LEAST` or more key characters that is no
ordinary word (letters of one case, or one capital and small letters) is a candidate. Its encoding is the
smallest alphabet that holds it; three tests then ask whether it could be drawn at random from it: a
chi-squared test of uniform use of the alphabet (over digits, common and rare letters of both cases, and signs), a runs test about its middle, and the
correlation of neighbours. Fisher's method combines them into one p-value.

Ordinary strings get the same battery: long words, and neighbouring words of all texts glued with capitals to the
least length of each band, as names in programs are. For every band of lengths, those up to its length give
the chance that text which is no secret scores as well; longer ones only score worse, so this is
on the safe side. A step-up rule then picks the band's threshold so that the expected share of false
finds stays below `SHARE`. Any few hundred words of prose are enough for that; a band with fewer than `ENOUGH` ordinary strings takes the
battery's own p-value at level `LEVEL`. So a find in a text does not depend on the size of the corpus around it. Counts run over
the whole corpus, without strings that touch a known shape; only a table of bands and bins (at most a few hundred rows) reaches the driver.

Defined results: null and empty texts have no spans. Texts of any length are read whole. Places are code points. Repeated rows count as
often as they occur; a column named `secrets` is replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.llm.tables import small

KINDS = ("assign", "access", "hex", "random")
LEAST, SHARE, BINS, ENOUGH, LEVEL = 16, 0.01, 48, 99, 0.05
BANDS = np.array([16, 20, 28, 40, 64])

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z][a-z]+(?![A-Za-z])")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}")

# The alphabets of the encodings, smallest first, each in the order of its values.
_ALPHABETS = (
    "0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
_VALUES = np.full((len(_ALPHABETS), 128), -1, np.int16)
for _i, _a in enumerate(_ALPHABETS):
    _VALUES[_i, [ord(c) for c in _a]] = range(len(_a))
# The twelve most frequent letters of prose in western European languages, most frequent first.
_COMMON = "etaoinsrhldu"
_KINDS = 7
_KIND = np.full(128, 6)
for _i, _a in enumerate(("01234", "56789", _COMMON, "bcfgjkmpqvwxyz", _COMMON.upper(), "BCFGJKMPQVWXYZ")):
    _KIND[[ord(c) for c in _a]] = _i
_SHARES = np.array([[np.mean([_KIND[ord(c)] == k for c in a]) for k in range(_KINDS)] for a in _ALPHABETS])
_SIZES = np.array([len(a) for a in _ALPHABETS])
_MIXED = _ALPHABETS.index("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the known shapes."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _tail(z: np.ndarray) -> np.ndarray:
    """Chance of a standard normal above z, to about 1e-7 (a rational approximation)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    half = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.clip(np.where(z >= 0, half, 1 - half), 1e-7, 1)


def battery(strings: list[str], ordinary: np.ndarray) -> np.ndarray:
    """Combined p-value of each string (of key characters); ordinary words are read in the mixed alphabet."""
    if not strings:
        return np.zeros(0)
    chars = np.frombuffer("".join(strings).encode("ascii"), np.uint8)
    n = np.array([len(s) for s in strings])
    starts = np.cumsum(n) - n
    fits = np.minimum.reduceat(_VALUES[:, chars], starts, axis=1) >= 0
    code = np.where(ordinary, _MIXED, fits.argmax(0))
    size, owner = _SIZES[code], np.repeat(np.arange(len(n)), n)
    value = _VALUES[code[owner], chars].astype(np.float64)
    # chi-squared over kinds of characters: prose, however it is cased, is full of common letters
    counts = np.bincount(owner * _KINDS + _KIND[chars], minlength=_KINDS * len(n)).reshape(-1, _KINDS)
    share = _SHARES[code]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(share > 0, (counts - n[:, None] * share) ** 2 / (n[:, None] * share), 0).sum(1)
        free = (share > 0).sum(1) - 1.0
        uniform = _tail((np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))
        # runs above and below the middle of the alphabet
        high = value >= size[owner] / 2
        ups = np.add.reduceat(high.astype(np.int64), starts)
        change = np.append(False, (high[1:] != high[:-1]) & (owner[1:] == owner[:-1]))
        runs = 1 + np.add.reduceat(change.astype(np.int64), starts)
        mean = 2 * ups * (n - ups) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        run = np.where(var > 0, 2 * _tail(np.abs(runs - mean) / np.sqrt(var)), 1e-7)
        # correlation of neighbours
        center = value - (np.add.reduceat(value, starts) / n)[owner]
        spread = np.add.reduceat(center * center, starts)
        product = np.append(center[:-1] * center[1:] * (owner[1:] == owner[:-1]), 0.0)
        serial = np.where(spread > 0, 2 * _tail(np.abs(np.add.reduceat(product, starts) / spread + 1 / n) * np.sqrt(n)), 1e-7)
    half = -np.log(np.clip(uniform, 1e-7, 1) * np.clip(run, 1e-7, 1) * np.clip(serial, 1e-7, 1))
    return np.exp(-half) * (1 + half + half * half / 2)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for the least random to BINS - 1 for p near 1, four bins a power of ten."""
    return np.clip(BINS - 1 + np.floor(4 * np.log10(np.clip(p, 1e-300, 1))), 0, BINS - 1).astype(np.int64)


def _look(text: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """Candidates with their places, and ordinary long words."""
    found, words = [], []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() and (s[1:].islower() or s.isupper()):
            words.append(s)
        else:
            found.append((m.start(), m.end(), s))
    return found, words


def _apart(found: list[tuple[int, int, str]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Candidates that touch no known shape."""
    return [x for x in found if not any(s < x[1] and x[0] < e for s, _, e in base)] if base else found


def _glued(text: str) -> Iterator[str]:
    """Neighbouring words of a text glued to the least lengths of the bands, in turn."""
    held, turn = "", 0
    for m in _WORD.finditer(text):
        held += m[0].capitalize()
        if len(held) >= BANDS[turn]:
            yield held
            held, turn = "", (turn + 1) % len(BANDS)


def _band(strings: list[str]) -> np.ndarray:
    return np.searchsorted(BANDS, [len(s) for s in strings], side="right") - 1


def thresholds(docs: DataFrame, text: str = "text", share: float = SHARE) -> dict[int, int]:
    """The least bin of each band of lengths at which candidates count as secrets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(BANDS), BINS), np.int64)

        def add(which: int, strings: list[str]) -> None:
            np.add.at(total[which], (_band(strings), _bin(battery(strings, np.full(len(strings), which == 1)))), 1)

        for batch in small(batches):
            held: tuple[list[str], list[str]] = ([], [])
            for t in batch.column(0):
                text_ = t.as_py() or ""
                found, words = _look(text_)
                held[0].extend(s for _, _, s in (_apart(found, plain(text_)) if found else ()))
                held[1].extend(words)
                held[1].extend(_glued(text_))
                for which in (0, 1):
                    if len(held[which]) > 20_000:
                        add(which, held[which])
                        held[which].clear()
            for which in (0, 1):
                add(which, held[which])
        which, band, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"which": which, "band": band, "bin": at, "n": total[which, band, at]})

    rows = docs.select(F.col(text)).mapInArrow(count, "which long, band long, bin long, n long")
    total = np.zeros((2, len(BANDS), BINS))
    for which, band, at, n in rows.groupBy("which", "band", "bin").agg(F.sum("n")).collect():
        total[which, band, at] = n
    above = total[..., ::-1].cumsum(-1)[..., ::-1]
    out = {}
    for b in range(len(BANDS)):
        words = above[1, : b + 1].sum(0)
        if words[0] < ENOUGH:
            out[b] = int(_bin(np.array([LEVEL]))[0])
            continue
        chance = (words + 1) / (words[0] + 1)
        good = np.flatnonzero((above[0, b] > 0) & (chance * above[0, b, 0] <= share * above[0, b]))
        if len(good):
            out[b] = int(good[0])
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find(docs: DataFrame, least_bins: dict[int, int], text: str = "text") -> DataFrame:
    """`docs` with `secrets`: spans of kind, start, end and whether the shape alone tells."""
    kept = [f for f in docs.schema.fields if f.name != "secrets"]
    schema = T.StructType([*kept, T.StructField("secrets", SPANS)])
    at = [f.name for f in kept].index(text)
    least = np.array([least_bins.get(b, BINS) for b in range(len(BANDS))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for t in batch.column(at):
                text_ = t.as_py() or ""
                base = plain(text_)
                out = [(*x, True) for x in base]
                found, _ = _look(text_)
                found = _apart(found, base)
                if found:
                    strings = [s for _, _, s in found]
                    good = _bin(battery(strings, np.zeros(len(strings), bool))) >= least[_band(strings)]
                    out += [(s, 3, e, False) for (s, e, _), ok in zip(found, good) if ok]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in sorted(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scan, schema)
