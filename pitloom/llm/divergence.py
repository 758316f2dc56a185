"""How the sources of a language differ in their words.

Terms are runs of letters and of all that is not ASCII.  A first pass counts
the documents of each term; the kept ones, in the order of their bytes, make
minimal acyclic transducers that give each term its ordinal.  A second pass
streams the whole texts through them and recounts each source's terms as
ordinals.  Smoothed shares are integers.  For pairs of sources the counts of a
block of terms meet as a matrix of a bounded number of sources; partial sums of
all blocks add up.  Ranks break ties by ordinals.

Transducers are sent to all tasks in passes of at most TERMS terms; a larger
vocabulary takes several passes over the texts of the languages concerned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered
from .session import checkpointed, forget
from .transducer import Transducer
from .words import CHUNK_BYTES, texts

#: Terms of the transducers that tasks hold at a time: some ten MB.
TERMS = 262_144
#: Counts or terms that a task gathers before it hands them on.
HELD = 400_000
#: Terms and sources of one matrix: at most 2 MB, of 262,144 counts.
BLOCK_TERMS = 2048
BLOCK_SOURCES = 128

_BILLION = 1_000_000_000
_LETTER = np.zeros(256, np.uint8)  # a letter's lower case; 0 for what separates terms
_LETTER[128:] = range(128, 256)
for _upper, _lower in zip(range(65, 91), range(97, 123)):
    _LETTER[_upper] = _LETTER[_lower] = _lower
_TRANSLATED = bytes(x or 32 for x in _LETTER.tolist())


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, term, n): documents with the term, added up over many."""
    held: dict[str, Counter] = {}

    def given() -> pa.RecordBatch:
        langs = np.repeat(np.array(list(held), object), [len(c) for c in held.values()])
        terms = [t for c in held.values() for t in c]
        counts = [n for c in held.values() for n in c.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "term", "n"])

    for batch in batches:
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            letters, at, seen = text.as_py().translate(_TRANSLATED), 0, set()
            while at < len(letters):  # a very long text is cut where no term is
                end = letters.find(b" ", at + CHUNK_BYTES)
                end = len(letters) if end < 0 else end
                seen.update(letters[at:end].split())
                at = end
            held.setdefault(lang, Counter()).update(seen)
            size += len(letters)
            if size > CHUNK_BYTES:
                size = 0
                if sum(map(len, held.values())) > HELD:
                    yield given()
    if held:
        yield given()


def _shipped(terms: DataFrame, lang: str) -> DataFrame:
    """(lang, blob): the transducer of each language's terms (lang, term, ordinal)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("ordinal")
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "first": [int(g["ordinal"].iloc[0])], "blob": [Transducer.build(t.encode() for t in g["term"]).to_bytes()]})

    return terms.groupBy(lang).applyInPandas(build, "lang string, first long, blob binary")


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of groups of non-null texts; what separates terms is 0, and a very long text is cut there."""
    for row, _, raw, offsets in texts(column):
        text, at = _LETTER[raw], 0
        while len(offsets) == 2 and len(text) - at > 2 * CHUNK_BYTES:
            end = at + CHUNK_BYTES
            while end < len(text) and text[end]:
                end += 1
            yield row, text[at:end], np.array([0, end - at])
            at = end
        yield row, text[at:], offsets - at if len(offsets) > 2 else np.array([0, len(text) - at])


def _tokens(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each term's document, start and length."""
    inside = np.zeros(len(text) + 1, bool)
    inside[1:] = text > 0
    new = inside[1:] & ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(text)]
    new[first] = inside[1:][first]  # a document starts a term
    starts = np.flatnonzero(new)
    gap = np.flatnonzero(~inside[1:])
    ends = np.append(gap, len(text))[np.searchsorted(gap, starts)]
    doc = np.searchsorted(edges, starts, "right") - 1
    return doc, starts, np.minimum(ends, edges[doc + 1]) - starts


def _counted(docs: DataFrame, shipped: list) -> DataFrame:
    """(lang, source, ordinal, n) of documents (lang, source, text) through the transducers (lang, first, blob)."""
    blobs = docs.sparkSession.sparkContext.broadcast({r["lang"]: (r["first"], r["blob"]) for r in shipped})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {k: (first, Transducer.from_bytes(blob)) for k, (first, blob) in blobs.value.items()}
        groups: dict[tuple, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def given() -> pa.RecordBatch:
            names = list(groups)
            group = keys // (2 * TERMS)
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1))
            first = np.array([machines[x[0]][0] if x[0] in machines else 0 for x in names], np.int64)
            return pa.RecordBatch.from_arrays([lang, source, pa.array(first[group] + keys % (2 * TERMS)), pa.array(counts)], names=["lang", "source", "ordinal", "n"])

        def merged(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(found), return_counts=True)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, where, np.concatenate([counts, n]))
            return both, total

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, batch.column(1).to_pylist())])
            found, size = [], 0
            for row, text, edges in _pieces(batch.column(2)):
                doc, starts, lengths = _tokens(text, edges)
                mine = langs[row : row + len(edges) - 1]
                for lang in set(mine) & set(machines):
                    those = np.flatnonzero((mine == lang)[doc])
                    ordinals = machines[lang][1].ordinals(text, starts[those], lengths[those])
                    kept = ordinals >= 0
                    found.append(group[row + doc[those[kept]]] * (2 * TERMS) + ordinals[kept])
                    size += len(found[-1])
                if size > HELD:
                    keys, counts = merged(found)
                    found, size = [], 0
            if found:
                keys, counts = merged(found)
            if len(keys) > HELD:
                yield given()
                keys, counts = keys[:0], counts[:0]
                groups.clear()
        if len(keys):
            yield given()

    rows = docs.select("lang", "source", "text").mapInArrow(stream, "lang string, source string, ordinal long, n long")
    return rows.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total) for counts <= total < 9 * 10^15, by long division three digits at a time."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _share(count, n, v):
    """The same in the JVM."""
    top = (count + 5).cast("decimal(19,0)") * F.lit(_BILLION).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (n + 5 * v).cast("decimal(19,0)")).cast("long")


def _distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed distances of the sources of each language, of counts (lang, source, ordinal, n) and groups (lang, source, total, size, place)."""
    tile = F.floor(F.col("place") / BLOCK_SOURCES).cast("int")
    blocks = F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK_TERMS).cast("int") - 1)
    heads = groups.where("size > 0").select("lang", tile.alias("tile"), F.explode(blocks).alias("block"), "place", "total", "size", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("n"))
    sparse = counts.join(groups.select("lang", "source", "place"), ["lang", "source"])
    sparse = sparse.select("lang", tile.alias("tile"), F.floor(F.col("ordinal") / BLOCK_TERMS).cast("int").alias("block"), "place", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("size"), (F.col("ordinal") % BLOCK_TERMS).cast("int").alias("at"), "n")
    rows = heads.unionByName(sparse)
    tiles = groups.groupBy("lang").agg((F.max(tile) + 1).alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.join(tiles, "lang").select("*", other).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        lang, block, a, b = g["lang"].iloc[0], int(g["block"].iloc[0]), g["a"].iloc[0], g["b"].iloc[0]
        head, cell = g[g["n"].isna()].sort_values("place"), g[g["n"].notna()]
        places, size = head["place"].to_numpy(np.int64), int(head["size"].iloc[0])
        counts = np.zeros((len(places), min(BLOCK_TERMS, size - block * BLOCK_TERMS)), np.int64)
        counts[np.searchsorted(places, cell["place"].to_numpy(np.int64)), cell["at"].to_numpy(np.int64)] = cell["n"].to_numpy(np.int64)
        p = shares(counts + 5, (head["total"].to_numpy(np.int64) + 5 * size)[:, None])
        left, right = np.flatnonzero(places // BLOCK_SOURCES == a), np.flatnonzero(places // BLOCK_SOURCES == b)
        sums = [np.abs(p[right] - p[i]).sum(1) for i in left]
        return pd.DataFrame({"lang": lang, "x": np.repeat(places[left], len(right)), "y": np.tile(places[right], len(left)), "value": np.concatenate(sums)})

    parts = rows.groupBy("lang", "block", "a", "b").applyInPandas(meet, "lang string, x long, y long, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = parts.where("x div {0} = y div {0}".format(BLOCK_SOURCES)).unionByName(parts.where("x div {0} <> y div {0}".format(BLOCK_SOURCES)).select("*", F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("y").alias("q")), F.struct(F.col("y").alias("p"), F.col("x").alias("q")))).alias("_s")).select("lang", F.col("_s.p").alias("x"), F.col("_s.q").alias("y"), "value"))
    return both.where("x <> y")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    A language keeps the terms that at least `least` of its documents hold.  A
    kept term's share of a group is 1 + floor(10^9 * (count + 5) / (all counts
    + 5 * kept terms)), for each (lang, source) that occurs and for each
    language as a whole.  Part `pair` ranks the language's other sources by
    the sum of absolute differences of shares; part `term` the `top` terms of
    the group whose share exceeds the language's, by the excess.  Ties go by
    the bytes of the item.

    Null text, lang and source are empty.  Every row counts as a document,
    repeated rows too.  A group without terms, or of a language that keeps
    none, still has its pairs (with value 0 in the latter case).  An empty
    table gives none.  Other columns are not read.  Counts are exact up to
    9 * 10^15 terms in a language.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    seen = docs.select("lang", "text").mapInArrow(_document_terms, "lang string, term string, n long")
    kept = checkpointed(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    vocabulary = checkpointed(numbered(kept, [F.col("lang"), F.col("term")]).withColumn("rank", F.col("rank") - 1))
    forget(kept)
    sizes = checkpointed(vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("start")))
    total = vocabulary.count()
    counts = []
    for i in range(math.ceil(total / TERMS)):
        mine = vocabulary.where((F.col("rank") >= i * TERMS) & (F.col("rank") < (i + 1) * TERMS)).withColumnRenamed("rank", "ordinal")
        shipped = _shipped(mine, "lang").collect()
        langs = sorted(r["lang"] for r in shipped)
        counts.append(checkpointed(_counted(docs.where(F.col("lang").between(langs[0], langs[-1])), shipped)))
    if counts:
        all_counts = counts[0]
        for c in counts[1:]:
            all_counts = all_counts.unionByName(c)
    else:
        all_counts = docs.limit(0).select("lang", "source", F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"))
    held = all_counts.join(F.broadcast(sizes.select("lang", "start")) if total <= TERMS else sizes.select("lang", "start"), "lang").withColumn("ordinal", F.col("ordinal") - F.col("start")).drop("start")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = checkpointed(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place")))

    name = groups.select("lang", "place", "source")
    near = _distances(held, groups).join(name.withColumnRenamed("place", "x"), ["lang", "x"]).join(name.withColumnsRenamed({"place": "y", "source": "item"}), ["lang", "y"])
    bare = groups.where("size = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = near.select("lang", "source", "item", "value").unionByName(bare)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))

    whole = held.groupBy("lang", "ordinal").agg(F.sum("n").alias("all"))
    of = groups.select("lang", "source", "total", "size").join(groups.groupBy("lang").agg(F.sum("total").alias("everything")), "lang")
    terms = held.join(whole, ["lang", "ordinal"]).join(of, ["lang", "source"]).where("n > 0")
    terms = terms.withColumn("value", _share(F.col("n"), F.col("total"), F.col("size")) - _share(F.col("all"), F.col("everything"), F.col("size"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    spelled = vocabulary.join(sizes, "lang").select("lang", (F.col("rank") - F.col("start")).alias("ordinal"), F.col("term").alias("item"))
    best = best.join(spelled, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
