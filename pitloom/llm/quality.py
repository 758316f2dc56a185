"""Quality rules whose cutoffs hold the share of good texts they reject below a limit.

Every rule scores a text; a high score is bad.  For each stratum the rules are
tightened in turn, one notch of a fixed fine grid at a time, from the mildest
cutoffs on.  After each notch all rules so far are judged together against the
labelled texts that are good: it passes if an exact binomial test refutes, at
the corrected level, that together they reject more than the limit; the first
that fails ends the walk (fixed-sequence testing).  So the whole limit is
shared by the rules that fire, and only the number of strata enters the
Bonferroni correction: the verdict keeps the limit with the stated confidence
in every stratum at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .session import checkpointed

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
_NAMES = [x.split()[0] for x in STATS.split(", ")]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

#: Notches of each rule's grid.
NOTCHES = 20


def _grid(mild: float, strict: float) -> list[float]:
    """Cutoffs in equal ratios; the strict end is so strict that no corpus passes it, so the test ends the walk, not the grid."""
    return [round(mild * (strict / mild) ** (i / (NOTCHES - 1)), 6) for i in range(NOTCHES)]


#: Score and grid of cutoffs, mildest first, of each rule.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", _grid(0.5, 0.002)),
    "long_words": ("word_chars / greatest(n_words, 1)", _grid(40.0, 4.0)),
    "marks": ("n_marks / greatest(n_words, 1)", _grid(4.0, 0.02)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", _grid(0.9, 0.02)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", _grid(0.8, 0.01)),
    "capitals": ("n_upper / greatest(word_chars, 1)", _grid(0.9, 0.01)),
}

#: The walk: (rule, cutoff) in the order in which the rules are tightened.
STEPS = [(rule, grid[i]) for i in range(NOTCHES) for rule, (_, grid) in RULES.items()]


def _group(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = words.spans(buf, offsets)
    in_word = ~words.SPACE[buf]
    # lines: from a text's start or a line feed to the next line feed or the text's end
    feeds = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_text = np.searchsorted(offsets[1:], begin, "right")
    line_text = np.minimum(line_text, len(offsets) - 2)
    stop = np.append(begin[1:], len(buf))
    feed_before_stop = (stop > begin) & (stop > 0) & (buf[np.minimum(np.maximum(stop, 1), max(len(buf), 1)) - 1] == 10) if len(buf) else np.zeros(len(begin), bool)
    stop = stop - feed_before_stop
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(in_word, out=seen[1:])
    real = seen[stop] > seen[begin]
    begin, stop, line_text = begin[real], stop[real], line_text[real]
    lines = np.bincount(line_text, minlength=len(offsets) - 1)
    line_key = np.stack([line_text.astype(np.uint64), words.span_hashes(buf, begin, stop)]) if len(begin) else np.zeros((2, 0), np.uint64)
    distinct = np.unique(line_key, axis=1)[0].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    dup = lines - np.bincount(distinct, minlength=len(lines))

    hashes = words.span_hashes(buf, starts, ends)
    at, five = words.windows(hashes, first, 5)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    key = five ^ words.mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1] if len(key) else np.zeros(0, bool)
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    repeat = words.by_text(words.covered(at[again], 5, len(starts)), first)
    points = (buf & 0xC0) != 0x80
    return [np.diff(first), words.by_text(points & in_word, offsets), words.by_text(_SYMBOL[buf], offsets), dup, repeat, lines, words.by_text(_UPPER[buf], offsets), words.by_text(_MARK[buf], offsets)]


def text_stats(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep and STATS of every whole text; no shuffle."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in _NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_group(buf, offsets) for _, _, buf, offsets in words.texts(batch.column(batch.num_columns - 1))]
            stats = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(s.astype(np.int64)) for s in stats)], names=[*keep, *_NAMES])

    return rows.mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _binomial_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p  # P = I_{1-p}(n-k, k+1)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-13:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def fit_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.03, confidence: float = 0.95) -> DataFrame:
    """One row for each stratum and certified rule: (stratum, rule, cutoff).

    stats has doc_id, the stratum and STATS; labels has doc_id and quality.  A
    document with several labels counts as good if one of them says so, which
    can only make the cutoffs milder.  Texts that fail the base rule are not
    counted.  All labelled rows are used; counts of each
    stratum and notch are all that is left to walk over.  A stratum with too few labels to refute anything
    (with four strata, under 144 good texts) gets no cutoff.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    held = stats.where(~base_failed()).join(good, "doc_id", "left_semi")
    first = F.least(*(F.coalesce(*(F.when(F.expr(f"{RULES[r][0]} > {cut}D"), F.lit(i)) for i, (r, cut) in enumerate(STEPS) if r == rule), F.lit(len(STEPS))) for rule in RULES))
    table = checkpointed(held.groupBy(F.col(stratum).alias("stratum"), first.alias("first")).agg(F.count(F.lit(1)).alias("n")))
    level = (1 - confidence) / max(1, table.select("stratum").distinct().count())

    def walk(pdf):
        import pandas as pd

        total, fired, passed = int(pdf["n"].sum()), dict(zip(pdf["first"], pdf["n"])), {}
        over = 0
        for i, (rule, cut) in enumerate(STEPS):
            over += int(fired.get(i, 0))  # rejected by the steps so far, together
            if _binomial_at_most(over, total, limit) > level:
                break
            passed[rule] = cut
        return pd.DataFrame([(pdf["stratum"].iloc[0], *x) for x in passed.items()], columns=["stratum", "rule", "cutoff"])

    return table.groupBy("stratum").applyInPandas(walk, "stratum string, rule string, cutoff double")  # a row for each notch at most


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with base_failed and kept: no base failure and no score above its stratum's cutoff."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES))
    joined = stats.withColumn("base_failed", base_failed()).join(wide, stats[stratum].eqNullSafe(wide["stratum"]), "left")
    over = [F.coalesce(F.expr(f"({score}) > _cut_{rule}"), F.lit(False)) for rule, (score, _) in RULES.items()]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", *(f"_cut_{r}" for r in RULES))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, STATS, base_failed and kept of every row of docs.

    A null or empty text has no words and fails the base rule.  Repeated rows
    are judged alike, each for itself.  With no labels only the base rule holds.
    """
    stats = checkpointed(text_stats(docs.select("doc_id", "lang", "text"), "text", ["doc_id", "lang"]))
    return judge(stats, fit_cutoffs(stats, labels, **fit)).drop("lang")


def keep_good(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    stats = text_stats(docs.select("doc_id", "lang", "text"), "text", ["doc_id", "lang"])
    cutoffs = checkpointed(fit_cutoffs(stats, labels, **fit))
    rows = docs.select(F.struct("*").alias("_row"), F.col("lang").alias("_lang"), F.col("text").alias("_whole"))
    full = text_stats(rows, "_whole", ["_row", "_lang"])
    return judge(full, cutoffs, "_lang").where("kept").select("_row.*")
