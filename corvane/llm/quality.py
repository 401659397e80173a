"""Quality rules: fixed limits, then robust outliers per language and source.

Each text gives a vector of transformed statistics. For every language and
source, concentration steps find the estimate of least covariance determinant
over a share ``KEEP`` of its rows: all rows' distances under the last estimate
are counted into fine bins with their exact integer moments, and the nearest
bins that hold the share give the next estimate. Rows further from the final
estimate than ``LIMIT`` (squared, in robust units) are rejected. Every row
counts in every step; per group only a bounded number of bins is gathered.
The same estimates are made for each language and for all rows: groups of fewer
than ``LEAST_ROWS`` rows that pass the base are judged by their language's
estimate, and where the language has as few, by that of all rows.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are groups of their own; in a table of fewer than
``LEAST_ROWS`` such rows the spread is widened by ``WIDE``; repeated rows count
and are judged each on their own; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, in_arrow, mix64, slices, stretch_hashes, utf8, windows, word_spans

SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Statistics are held in units of 1/512, so that sums are exact and come out alike in any order.
UNIT = 512
KEEP, STEPS, LEAST_ROWS = 0.75, 6, 30
#: Least standard deviation of each statistic, about its noise in one text of 300 words: many texts have none of a thing at all.
#: A count's is 1 / sqrt(n), a share's 1 / (2 * sqrt(n)): 300 words; their mean length; 2,000 characters with symbols in
#: clumps of four; 40 lines; 300 words with repeats in clumps of six.
FLOOR = (0.06, 0.03, 0.022, 0.08, 0.07)
#: Spread that a table of few rows is given besides its own.
WIDE = (1.0, 0.2, 0.1, 0.25, 0.2)
#: Stands for any source, or any language and source; names of real ones are empty or begin with "=".
POOLED = "*"
DIMS = len(FLOOR)
#: Bytes of parameters that are sent to all tasks at most; beyond it rows are dealt by group and salt.
SENT_BYTES = 4 << 20
#: Share of a normal sample that is rejected.
TAIL = 1e-6


def _chi_squared_limit(tail: float) -> float:
    """The value that a chi-squared sum with five degrees of freedom exceeds with probability ``tail``."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        above = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        lo, hi = (x, hi) if above > tail else (lo, x)
    return lo


#: Squared distance beyond which a row is rejected.
LIMIT = _chi_squared_limit(TAIL)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
PARAMS = ", ".join(["g_lang string, g_source string, trial int, det double, n long", *(f"m{i} double" for i in range(DIMS)), *(f"p{i}{j} double" for i, j in PAIRS)])


_SYMBOL, _WORD_LEAD = np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(SYMBOLS)] = True
# The first byte of each character that isn't a blank.
_WORD_LEAD[[*range(9, 14), 32, *range(0x80, 0xC0)]] = False


def _first_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurred before, and how often it occurs in all."""
    order = np.argsort(keys, kind="stable")
    by = keys[order]
    new = np.concatenate([[True], by[1:] != by[:-1]]) if len(by) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    count = np.bincount(group) if len(by) else np.zeros(0, np.int64)
    before, total = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    before[order], total[order] = ~new, count[group]
    return before, total


def text_statistics(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines with a word, by text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, of = word_spans(data, offsets)
    total = lambda rows, **more: np.bincount(rows, minlength=n, **more).astype(np.int64)
    def marked(table) -> np.ndarray:
        """How many bytes of each text the table marks."""
        upto = np.flatnonzero(table[data])
        return np.diff(np.searchsorted(upto, offsets))

    word_chars, symbols = marked(_WORD_LEAD), marked(_SYMBOL)
    # Lines: cut at each \n and at each text's end; those with a word count.
    cuts = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    line_end = np.sort(np.concatenate([offsets[1:], cuts]))
    line_row = np.searchsorted(offsets[1:], line_end, side="left")
    line_row = np.minimum(line_row, n - 1)
    has = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end, line_row = line_start[has], line_end[has], line_row[has]
    salt = mix64(np.arange(1, n + 1, dtype=U64))
    dup, _ = _first_rows(stretch_hashes(data, line_start, line_end) ^ salt[line_row])
    # Words in windows of three that occur twice or more in their text.
    hashes = stretch_hashes(data, starts, ends)
    three = windows(hashes, 3)
    good = of[: len(three)] == of[2:] if len(three) else np.zeros(0, bool)
    at = np.flatnonzero(good)
    _, often = _first_rows(three[at] ^ salt[of[at]])
    covered = np.zeros(len(starts) + 3, bool)
    hit = at[often >= 2]
    for j in range(3):
        covered[hit + j] = True
    repeat = total(of[covered[: len(starts)]])
    return [total(of), word_chars, symbols, total(line_row[dup]), repeat, total(line_row)]


def statistics(docs: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in STATS.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = text_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *(pa.array(x, pa.int64()) for x in found)], names=names)

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text"))]
    return docs.select(*cols).transform(in_arrow, run, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))
    raw = [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        share("n_symbols", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        share("n_repeat_words", words),
    ]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _inverse(mean: np.ndarray, cov: np.ndarray) -> tuple[float, list[float]]:
    """The log determinant of the floored covariance, and the entries of its inverse."""
    cov = cov + np.diag((np.asarray(FLOOR) * UNIT) ** 2)
    inverse = np.linalg.inv(cov)
    return float(np.linalg.slogdet(cov)[1]), [float(inverse[i, j]) for i, j in PAIRS]


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group and trial's bins to its next estimate."""
    pdf = pdf.sort_values("bin")
    counts = pdf["n"].to_numpy(np.int64)
    n = int(counts.sum())
    last = int(np.searchsorted(np.cumsum(counts), math.ceil(KEEP * n)))
    near = pdf.iloc[: last + 1]
    k = float(near["n"].sum())
    mean = np.array([int(near[f"s{i}"].sum()) / k for i in range(DIMS)])
    cov = np.zeros((DIMS, DIMS))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = int(near[f"q{i}{j}"].sum()) / k - mean[i] * mean[j]
    # A normal sample's nearest share KEEP has its covariance shrunk by this factor (five dimensions).
    few = max(0.0, 1 - n / LEAST_ROWS)
    det, inverse = _inverse(mean, cov / 0.55 + few * np.diag((np.asarray(WIDE) * UNIT) ** 2))
    head = [pdf["g_lang"].iloc[0], pdf["g_source"].iloc[0], int(pdf["trial"].iloc[0]), det, n]
    return pd.DataFrame([[*head, *mean, *inverse]], columns=[f.split()[0] for f in PARAMS.split(", ")])


def _distance() -> Column:
    parts = [(1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) for i, j in PAIRS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _levels(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row for its own group (o_lang, o_source), for its language and for all rows."""
    of = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    lang, source, pooled = F.col("g_lang"), F.col("g_source"), F.lit(POOLED)
    each = rows.select(lang.alias("o_lang"), source.alias("o_source"), *columns, F.explode(F.array(of(0, lang, source), of(1, lang, pooled), of(2, pooled, pooled))).alias("of"))
    return each.select("o_lang", "o_source", *columns, "of.*")


def _meet(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with their group's parameters, without a task that has to take a whole group.

    Parameters of a checked size are sent to all tasks, and rows stay where they are; greater ones have a copy for each
    shuffle partition, and a group's rows are dealt to these copies in turn.
    """
    key = ["g_lang", "g_source"]
    width = 8 * (len(params.columns) + 4)
    size = params.agg(F.sum(width + F.octet_length("g_lang") + F.octet_length("g_source"))).first()[0]
    if (size or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(params), key, how)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod("turn", F.lit(salts)).cast("int")).join(copies.hint("merge"), [*key, "_salt"], how).drop("_salt")


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates a group: medians with the quartiles' spread, and medians with the floors."""
    quartiles = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"), *(F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"r{i}") for i in range(DIMS)))
    wide = quartiles.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("trial"))
    zero = F.lit(0.0)
    inverse = []
    for i, j in PAIRS:
        spread = F.when(F.col("trial") == 0, F.pow((F.col(f"r{i}")[2] - F.col(f"r{i}")[0]) / 1.349, F.lit(2.0))).otherwise(zero)
        inverse.append((1 / (spread + (FLOOR[i] * UNIT) ** 2) if i == j else zero).alias(f"p{i}{j}"))
    return wide.select("g_lang", "g_source", F.col("trial").cast("int").alias("trial"), zero.alias("det"), "n", *(F.col(f"r{i}")[1].alias(f"m{i}") for i in range(DIMS)), *inverse)


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "quality")
    group = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"g_{c}") for c in ("lang", "source")]
    stats = scratch.cut(statistics(docs).select("*", base_failed().alias("base_failed"), *_vector(), *group, F.monotonically_increasing_id().alias("turn")), "statistics")
    key = ["g_lang", "g_source"]
    rows = _levels(stats.where(~F.col("base_failed")), "turn", *(f"x{i}" for i in range(DIMS))).drop("level", "o_lang", "o_source")
    params = scratch.cut(_starts(rows), "start")
    for step in range(STEPS):
        # 32 bins to each doubling of the distance; beyond 2**40 all are alike.
        binned = _meet(rows, params).withColumn("bin", F.floor(32 * F.log2(1 + F.least(F.greatest(_distance(), F.lit(0.0)), F.lit(2.0**40)))).cast("int"))
        sums = [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS)]
        bins = binned.groupBy(*key, "trial", "bin").agg(*sums)
        params = scratch.cut(bins.groupBy(*key, "trial").applyInPandas(_concentrate, PARAMS), f"step{step}")
    best = params.groupBy(*key).agg(F.min_by(F.struct("n", *(f"m{i}" for i in range(DIMS)), *(f"p{i}{j}" for i, j in PAIRS)), F.struct("det", "trial")).alias("best")).select(*key, "best.*")
    best = scratch.cut(best, "best")
    enough = best.where((F.col("n") >= LEAST_ROWS) | (F.col("g_lang") == POOLED))
    values = [c for c in best.columns if c not in key]
    chosen = _levels(stats.select(*key).distinct()).join(enough, key).groupBy("o_lang", "o_source").agg(F.min_by(F.struct(*values), "level").alias("best"))
    chosen = scratch.cut(chosen.select(F.col("o_lang").alias("g_lang"), F.col("o_source").alias("g_source"), "best.*"), "chosen")
    far = F.coalesce(_distance() > LIMIT, F.lit(False))
    return _meet(stats, chosen, "left").select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _distance().alias("distance"), (~F.col("base_failed") & ~far).alias("kept"))
