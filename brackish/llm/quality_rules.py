"""Quality rules whose cutoffs are proven on labelled rows not to reject too many good texts.

Everything here is DataFrame functions. `measure` counts words, signs and repeats of each whole
text; `certify` turns labelled rows into cutoffs; `judge` applies them.

Rules are shares on a grid of 1/50: signs, repeated lines, repeated words, capitals, exclamation
marks. Strata are bands of text length, eight at most. In each stratum and for each rule, the good
rows that a cutoff would reject are counted. The chance of so few, if the true share were ALPHA / rules,
is an exact binomial sum. A cutoff is certified when that chance is at most DELTA / (strata x rules):
with probability 1 - DELTA all certified cutoffs hold, and all rules together reject at most ALPHA
of the good texts of every stratum. (Stricter cutoffs reject more, so certified ones form a run from the
most lenient on; testing in that order needs no further correction.) Among certified cutoffs the one is
taken that rejects most bad rows, each good row weighing as `PRICE` bad ones, and of equals the most lenient.
Too few labels, or none that gain anything, leave the rule without a cutoff, and it rejects nothing.

Defined results: a null or empty text has no words and fails the base rules. Repeated ids are measured
row by row. Ids that are null are measured but teach nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = " \t\n\x0b\f\r"
SIGNS = "#*$%&|<>"
GRID, BANDS, ALPHA, DELTA, PRICE = 50, 8, 0.05, 0.1, 5
#: Rule: numerator and denominator among the measured counts.
RULES = {
    "signs": ("n_symbols", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "shouts": ("n_shouts", "word_chars"),
}
_TERMS = 2000


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts) of every row; `text` is read whole and not carried on."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), whole.alias("_text"))
    rows = rows.select(
        key,
        "_text",
        F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("_lines"),
    )
    rows = rows.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SIGNS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        (F.length("_text") - F.length(F.translate("_text", "!", ""))).cast("long").alias("n_shouts"),
        F.sort_array(
            F.transform(
                F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
                lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.alias("i")),
            )
        ).alias("_windows"),
    )
    same = F.transform(
        F.filter(
            "_windows",
            lambda x, i: F.coalesce(x["w"] == F.get("_windows", i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("_windows", i + 1)["w"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    rows = rows.withColumn("_at", same).drop("_windows")
    covered = F.flatten(F.transform("_at", lambda p: F.array(p, p + 1, p + 2)))
    return rows.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_at")


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    """Band of text length: 0 below 100 words, then a band for each doubling."""
    return F.least(F.greatest(F.floor(F.log2(F.col("n_words") / 50)), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def _bin(rule: str) -> Column:
    """Grid step at or above the rule's share, in whole numbers."""
    top, bottom = (F.col(c) for c in RULES[rule])
    bottom = F.greatest(bottom, F.lit(1))
    return F.least(F.floor((GRID * top + bottom - 1) / bottom), F.lit(GRID + 1)).cast("int")


def _log_factorial(n: Column) -> Column:
    """Stirling's series for log(n!), shifted by ten so that it is exact to about 1e-12."""
    x = n + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    for i in range(1, 11):
        series = series - F.log(n + float(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at chance p, summed downwards from k.

    Beyond `_TERMS` terms the rest is bounded by a geometric series, so the value is never too small.
    From k >= n p on it is 1: nothing could be certified there.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("ratio"))

    def step(acc: Column, i: Column) -> Column:
        j = k - i
        ratio = j * (1 - p) / ((n - j + 1) * p)
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), ratio.alias("ratio"))

    def finish(acc: Column) -> Column:
        rest = F.when(k > _TERMS, acc["term"] * acc["ratio"] / F.greatest(1 - acc["ratio"], F.lit(1e-9))).otherwise(0.0)
        return acc["sum"] + rest

    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(_TERMS))).cast("int"))
    total = F.aggregate(steps, start, step, finish)  # the step at i = k adds nothing
    return F.when(k >= n * p, 1.0).otherwise(F.least(first * total, F.lit(1.0)))


def certify(measured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff): rows whose grid step is at least `cutoff` are rejected by that rule.

    At most `BANDS` x rules rows. `labels` has 1 for good and 0 for bad rows; other values teach nothing.
    """
    known = labels.where(F.col(quality).isin(0, 1)).select(F.col(key).alias("_id"), F.col(quality).alias("_good"))
    taught = measured.where(~base_failed()).join(known, F.col(key) == F.col("_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _bin(r).alias("step")) for r in RULES]))
    counts = taught.select(stratum().alias("stratum"), "_good", steps.alias("s")).groupBy("stratum", "s.rule", "s.step")
    counts = counts.agg(F.sum(F.col("_good").cast("long")).alias("good"), F.sum(1 - F.col("_good").cast("long")).alias("bad"))
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.desc("step"))
    tried = counts.select(
        "stratum", "rule", "step", F.sum("good").over(group).alias("n"), F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("caught")
    )
    tests = BANDS * len(RULES)
    tried = tried.withColumn("chance", binomial_tail(F.col("k"), F.col("n"), ALPHA / len(RULES))).where(F.col("chance") <= DELTA / tests)
    gain = F.col("caught") - PRICE * F.col("k")
    best = tried.where(gain > 0).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), F.col("step").alias("cutoff"))).alias("best"))
    return best.select("stratum", "rule", "best.cutoff")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`measured` with `base_failed`, `kept` and the cutoffs' own verdict `broken` (rules, comma-joined)."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    rows = measured.withColumns({"_s": stratum(), "base_failed": base_failed()}).join(F.broadcast(wide), F.col("_s") == F.col("_stratum"), "left")
    broken = F.concat_ws(",", *[F.when(_bin(r) >= F.col(f"_{r}"), r) for r in RULES])
    return rows.withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == "")).drop("_s", "_stratum", *[f"_{r}" for r in RULES])


SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_id, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY row_id
), m AS (
  SELECT w.row_id, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (row_id)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words < 100 THEN 0 ELSE least(floor(log2(n_words / 50.0)), {BANDS - 1}) END::INT AS stratum
  FROM m
), steps AS (
  SELECT row_id, doc_id, stratum, base_failed, rule, least((({GRID} * top + bottom - 1) // bottom), {GRID + 1}) AS step
  FROM (SELECT *, unnest(['signs', 'lines', 'repeats', 'capitals', 'shouts']) AS rule,
               unnest([n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_shouts]) AS top,
               unnest([greatest(word_chars, 1), greatest(n_lines, 1), greatest(n_words, 1), greatest(word_chars, 1), greatest(word_chars, 1)]) AS bottom
        FROM s)
), counts AS (
  SELECT stratum, rule, step, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad
  FROM steps JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1) GROUP BY ALL
), tried AS (
  SELECT stratum, rule, step, sum(good) OVER (PARTITION BY stratum, rule) AS n,
         sum(good) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS k,
         sum(bad) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS caught
  FROM counts
), proven AS (
  SELECT stratum, rule, max((caught - {PRICE} * k) * 1000 + step) AS best
  FROM tried
  WHERE caught - {PRICE} * k > 0 AND k < n * {ALPHA / len(RULES)}
    AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
        + j * ln({ALPHA / len(RULES)}) + (n - j) * ln(1 - {ALPHA / len(RULES)})))) <= {DELTA / (BANDS * len(RULES))}
  GROUP BY stratum, rule
), broken AS (
  SELECT DISTINCT row_id FROM steps JOIN proven USING (stratum, rule) WHERE step >= best % 1000
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken.row_id IS NULL AS kept
FROM s LEFT JOIN broken USING (row_id)
"""
