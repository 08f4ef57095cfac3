"""Operator 8: quality rules with risk-controlled thresholds.

Fixed base rules fail very short or repetitive texts. Beyond them, each signal (share of symbols, of
repeated lines, ...) has a cutoff in each stratum, chosen on labelled documents so that it rejects at
most a stated share of the good ones: a cutoff is allowed when the exact binomial tail says so.
Cutoffs of one signal are tried from lenient to strict and stop at the first that fails (each at the
same level, as fixed-sequence testing allows); the level is divided by the number of signals and
strata, and the allowed share by the number of signals, so that the promise holds for all together.
Among allowed cutoffs the most lenient is taken that still rejects nearly all bad documents which the
strictest allowed one rejects. A stratum with too few labels gets no cutoff, only the base rules.

The measurements of every whole text are one map; labels are joined to them, and only a histogram
(strata x signals x bins) reaches the driver. Null texts have no words (and so fail the base rules). A
document with several labels counts as good only if all say so, a repeated id as one document (the least of
its rows' signals); labels of unknown documents and null ids or labels are left out; a null stratum is a
stratum of its own. With no labels all cutoffs are open. Copies among the labelled documents are counted as
independent trials, which the binomial bound takes them for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import let_go, materialize, slices, struct, table

SPACES, SYMBOLS = "\t\n\v\f\r ", "#*$%&|<>"
LETTER = regex.compile(r"\p{L}")
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")
#: Signals: each is bad when high. Values are cut into bins of equal width from 0 up; the last is open.
BINS = 100
SIGNALS = {
    "symbols": lambda c: _share(c("n_symbols"), c("word_chars"), 2.0),
    "dup_lines": lambda c: _share(c("n_dup_lines"), c("n_lines"), 1.0),
    "repeats": lambda c: _share(c("n_repeat_words"), c("n_words"), 1.0),
    "long_words": lambda c: _share(c("word_chars"), c("n_words"), 1 / 40),
    "letterless": lambda c: _share(c("n_words") - c("n_letter_words"), c("n_words"), 1.0),
}


def _share(a, b, scale: float):
    """The bin of scale * a / b."""
    return F.when(b > 0, F.least(F.floor(a * (scale * BINS) / b), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def repeated_words(words: list) -> int:
    """How many words lie in windows of eight words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    spread = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for k in range(WINDOW):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + spread[k : k + n]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0  # equal windows have equal hashes
    # Exact numbers of windows: of one word, then two, four, eight.
    at, width = ids.astype(np.int64), 1
    while width < WINDOW:
        _, at = np.unique(at[:-width] * len(words) + at[width:], return_inverse=True)
        width *= 2
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(np.bincount(at)[at] > 1)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    if text.isascii():
        letters = sum(1 for w in words if w.isalpha() or LETTER.search(w.decode()))
    else:
        letters = sum(1 for w in words if w.isalpha() or LETTER.search(w.decode("utf-8", "surrogatepass")))
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), letters)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """id_col, the columns `keep`, with keep_text the text as a string, and the MEASURES of every whole text."""
    text = [text_col] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            rows = [measure_text(t or "") for t in b.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i + 2) for i in range(len(keep))), *(b.column(1) for _ in text), *columns], [id_col, *keep, *text, *MEASURES])

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *keep)
    fields = [source.schema[0], *(source.schema[k] for k in keep), *struct(*((c, T.StringType()) for c in text), *((m, T.LongType()) for m in MEASURES)).fields]
    return source.mapInArrow(run, T.StructType(fields))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: how likely so few false rejections were, if their true share were p. It is the
    regularised incomplete beta function of 1 - p with parameters n - k and k + 1, at any n."""
    if p <= 0 or n <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    return incomplete_beta(n - k, k + 1, 1 - p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges."""
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Terms of the fraction in pairs; numerators and denominators are renewed from below and above.
    above, below = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value, m = below, 0
    while True:
        m += 1
        before = value
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            below, above = 1 / ((1 + term * below) or 1e-300), (1 + term / above) or 1e-300
            value *= below * above
        if abs(value - before) <= 1e-15 * abs(value):
            return min(1.0, front * value)


def choose(good: np.ndarray, bad: np.ndarray, share: float, level: float, enough: float = 0.98) -> int | None:
    """The cutoff (reject bins at or above it) for counts of good and bad documents by bin, or None."""
    n, strictest = int(good.sum()), None
    for cut in range(BINS - 1, 0, -1):
        if tail(int(good[cut:].sum()), n, share) > level:
            break
        strictest = cut
    if strictest is None or not bad[strictest:].sum():
        return None
    return next(c for c in range(BINS - 1, 0, -1) if bad[c:].sum() >= enough * bad[strictest:].sum())


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stratum_col: str | None = "lang", share: float = 0.02, level: float = 0.05) -> dict[str, dict[str, int]]:
    """Cutoffs by stratum and signal. `share`: of the good documents of a stratum, at most so many are
    rejected by all signals together; `level`: the chance that this fails in any stratum."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(label_col).alias("__good"))
    binned = measured.where(~base_failed()).select(F.col(id_col), stratum.alias("stratum"), F.array(*[f(F.col) for f in SIGNALS.values()]).alias("bins"))
    # An id counts once, however many rows it has.
    once = binned.join(known, id_col).groupBy(id_col).agg(F.min(F.struct("stratum", "bins", "__good")).alias("r")).select("r.*")
    counts = once.select("stratum", "__good", F.posexplode("bins").alias("signal", "bin")).groupBy("stratum", "signal", "bin").agg(F.count(F.when(F.col("__good") > 0, 1)).alias("good"), F.count(F.when(F.col("__good") <= 0, 1)).alias("bad"))
    table_: dict[str, np.ndarray] = {}
    for r in counts.collect():
        table_.setdefault(r["stratum"], np.zeros((len(SIGNALS), BINS, 2), dtype=np.int64))[r["signal"], r["bin"]] = r["good"], r["bad"]
    tests = len(SIGNALS) * max(1, len(table_))
    return {s: {name: cut for i, name in enumerate(SIGNALS) if (cut := choose(t[i, :, 0], t[i, :, 1], share / len(SIGNALS), level / tests)) is not None} for s, t in table_.items()}


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: dict[str, dict[str, int]], stratum_col: str | None = "lang") -> DataFrame:
    """The measured rows with base_failed and kept."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rejected = F.lit(False)
    for s, cuts in cutoffs.items():
        for name, cut in cuts.items():
            rejected = rejected | ((stratum == s) & (SIGNALS[name](F.col) >= cut))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def rate(docs: DataFrame, labels: DataFrame, stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document, with cutoffs learned from `labels`."""
    keep = (stratum_col,) if stratum_col and stratum_col in docs.columns else ()
    measured = materialize(measure(docs, keep=keep), "quality")
    return judge(measured, thresholds(measured, labels, stratum_col=keep[0] if keep else None), keep[0] if keep else None)


def query(spark, sf_dir: str) -> DataFrame:
    found = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
