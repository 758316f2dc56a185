"""Removal of repeated line runs through a suffix array of line ids.

Every line that has a word is a symbol; equal lines have equal ids.  Suffixes
are ranked by their first line, then, by prefix doubling, by twice as many
lines: the rank of a prefix of h+s lines is that of the pair (rank of the
first h lines, rank of the h lines s further on).  Each ranking is a
distributed sort of the distinct pairs.  Suffixes whose prefix occurs once
have their place in the array and leave; doubling ends when every prefix is
unique.  At each length suffixes of equal rank are the intervals of the array
whose longest common prefix is at least that long.  The first suffix of an
interval, in document order, is the original; the runs at all others are later
copies.  A copy of L lines is covered by those of the largest length h <= L,
at its start and at h lines before its end, so copies that overlap join to the
maximal repeated runs, and single lines side by side do not.  Equal texts take
part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import WORD
from .ranks import numbered
from .session import checkpointed, forget

_KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), F.col("text"))})


def _ranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """rows whose pair occurs more than once, with the pair's rank as `rank`."""
    several = rows.groupBy(*pair).count().where("count > 1").select(*pair)
    ranks = numbered(several, [F.col(c) for c in pair])
    return rows.join(ranks, pair).drop(*pair)


def _later_copies(docs: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """Texts (k1, k2, doc, n_lines), doc the first document; and (k1, k2, copies): starts and lengths of later copies.

    Lines are numbered among those with a word.
    """
    marked = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.when(x.rlike(WORD), F.xxhash64(x)).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")))
    worded = F.filter(marked, lambda x: x["h1"].isNotNull())
    rows = _keyed(docs.where("text is not null").select("doc_id", "text")).select("doc_id", *_KEY, worded.alias("lines"))
    lines = rows.select("doc_id", *_KEY, F.posexplode("lines").alias("seq", "line")).select("doc_id", *_KEY, "seq", "line.*")
    lines = checkpointed(lines.groupBy(*_KEY, "seq").agg(F.min("doc_id").alias("doc"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    texts = lines.groupBy(*_KEY).agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_lines"))
    place = F.struct(F.col("doc").isNull().alias("n"), "doc", *_KEY, "seq")
    state, have, copies = checkpointed(_ranked(lines, ["h1", "h2"])), 1, []
    while True:
        if have >= min_lines:
            first = checkpointed(state.groupBy("rank").agg(F.min(place).alias("first")))  # a table of its own, so that a hot rank's join can be split
            copies.append(checkpointed(state.join(first, "rank").where(place != F.col("first")).select(*_KEY, "seq", F.lit(have).alias("run"))))
            forget(first)
        step = have if have >= min_lines else min(have, min_lines - have)
        ahead = state.select(*_KEY, (F.col("seq") - step).alias("seq"), F.col("rank").alias("next"))
        pairs = checkpointed(state.join(ahead, [*_KEY, "seq"]).withColumnRenamed("rank", "this"))
        forget(state)
        state = checkpointed(_ranked(pairs, ["this", "next"]))
        forget(pairs)
        if state.isEmpty():
            break
        have += step
    if not copies:
        copies = [lines.limit(0).select(*_KEY, "seq", F.lit(1).alias("run"))]
    longest = reduce(DataFrame.unionByName, copies).groupBy(*_KEY, "seq").agg(F.max("run").alias("run"))
    return texts, longest.groupBy(*_KEY).agg(F.collect_list(F.struct("seq", "run")).alias("copies"))


def _merged(copies: list, n: int) -> tuple[list[bool], list[int]]:
    """Which of n lines lie in the copies, and the lengths of the runs that overlapping copies make up."""
    gone, runs, end = [False] * n, [], -1
    for seq, run in sorted((c["seq"], c["run"]) for c in copies):
        if seq >= end:
            runs.append(0)
            end = seq
        runs[-1] += max(0, seq + run - end)
        end = max(end, seq + run)
        gone[seq : seq + run] = [True] * run
    return gone, runs


def without_repeated_runs(docs: DataFrame, min_lines: int = 1) -> DataFrame:
    """docs with a `text` that lacks later copies, and with `_n_lines`, `_n_removed` and `_runs`, the removed runs' lengths.

    A run is min_lines or more lines with a word, one after another; lines
    without a word don't count and stay.  Of every run that occurs more than
    once the first occurrence (by doc_id, then line) stays and the lines of
    all others go; where a run overlaps its own copy, what lies in the copy
    goes.  Of equal texts all but that of the smallest doc_id lose every line
    with a word, if they have min_lines of them.  Repeated rows with one doc_id
    and text are one document and are treated alike; null doc_ids come last;
    a null text stays null.  No row is dropped; an empty table stays empty.
    Other columns are kept whatever their names, but for the three above.
    """
    texts, copies = _later_copies(docs, min_lines)
    known = texts.join(copies, _KEY, "left").where(F.col("n_lines") >= min_lines)
    rows = _keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text")).join(known, _KEY, "left")
    rows = rows.select("_row", F.col("text").alias("_text"), "copies", (F.col("n_lines").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("doc"))).alias("copy"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_runs", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, copy in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text is None:
                    out.append((None, 0, 0, []))
                    continue
                if not copy and not copies:
                    out.append((text, sum(bool(x.strip()) for x in text.split(b"\n")), 0, []))
                    continue
                lines = text.split(b"\n")
                real = [i for i, x in enumerate(lines) if x.strip()]  # strips what separates words
                gone, runs = ([True] * len(real), [len(real)]) if copy else _merged(copies, len(real))
                drop = {i for i, g in zip(real, gone) if g}
                out.append((b"\n".join(x for i, x in enumerate(lines) if i not in drop), len(real), len(drop), runs))
            text, n, gone, runs = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=schema.names)

    done = rows.mapInArrow(cut, schema)
    return done.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns), "_n_lines", "_n_removed", "_runs")
