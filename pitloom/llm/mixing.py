"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered
from .session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: A source table of more rows than this is joined, not broadcast.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame) -> DataFrame:
    """docs and `_size`: the words of the text, null as none."""
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """sources (source, weight, source_size, ...) with `target`.

    share of all sizes is dealt by weight; a source whose part is above
    max_epochs times its size is held there and the excess is dealt again over
    the others, until none is above.  Each round sums one small table; only
    the sums reach the driver.  Sums are of whole numbers, so they are exact.
    """
    cap = F.col("source_size") * max_epochs
    state = checkpointed(sources.withColumn("_held", F.lit(False)))
    total = (state.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        row = state.agg(F.sum(F.when(F.col("_held"), cap)), F.sum(F.when(~F.col("_held"), F.col("weight"))), F.count(F.when(F.col("_held"), 1))).first()
        level = (total - (row[0] or 0)) / row[1] if row[1] else 0.0
        part = F.col("weight") * F.lit(float(level))
        now = checkpointed(state.withColumn("_held", F.col("_held") | (part > cap)))
        if now.where("_held").count() == row[2]:
            return now.withColumn("target", F.when(F.col("_held"), cap.cast("double")).otherwise(part)).drop("_held")
        state = now


def numbered_sources(sized_docs: DataFrame) -> DataFrame:
    """(source, source_size, rows, weight): sources by code point, null last, weigh 1, 2, 3, repeating.

    The table has one row for each source; ranks come from ranges of sources,
    so no task sees all of them.
    """
    sums = sized_docs.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    dealt = numbered(sums, [F.col("source").asc_nulls_last()])
    rank = F.col("rank")
    return dealt.select("source", "source_size", "rows", ((rank - 1) % 3 + 1).cast("long").alias("weight"))


def mixture(sized_docs: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows with `_key` (of the row), `target` and `taken`: words the mix takes.

    Every document of a source is taken as many whole times as the target
    holds the source's size.  What is left is taken from the source's documents
    in a seeded order, one after another, the last one in part, so a source's
    words are its target to within one word.  The order is that of
    md5(seed, doc_id); a hash range of a source holds about the square root of
    its rows, so that running sums are taken in two short steps and a source
    of a third of all rows is no one's task.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    quota = F.round("target").cast("long")
    many = sources.withColumn("_quota", quota).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_quota") / F.col("source_size"))).otherwise(0).cast("long"))
    many = many.withColumn("_rest", F.col("_quota") - F.col("_whole") * F.col("source_size")).withColumn("_ranges", F.ceil(F.sqrt("rows")).cast("long"))
    many = many.withColumnRenamed("source", "_source")
    small = F.broadcast(many) if many.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else many
    rows = sized_docs.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_hash", key).withColumn("_range", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("_ranges")).cast("long"))
    sums = rows.groupBy("source", "_range").agg(F.sum("_size").alias("_sum"))
    ahead = sums.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")).select(F.col("source").alias("_source"), F.col("_range").alias("_r"), "_ahead")
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r"))).drop("_source", "_r")
    order = Window.partitionBy("source", "_range").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - start))
    return rows.withColumn("_part", part.cast("long")).withColumn("taken", (F.col("_whole") * F.col("_size") + F.col("_part")).cast("long"))


def mix_plan(docs: DataFrame, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, taken) of every row of docs.

    A null text has size 0 and a null source is a source of its own.  Repeated
    rows are documents of their own.  A source without words has target 0.
    """
    light = checkpointed(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size"))
    sources = checkpointed(water_fill(numbered_sources(light), max_epochs))
    out = mixture(light, sources, seed)
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "weight", "target", "taken")


def mixed(docs: DataFrame, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; a last part is the text's beginning, with so many words.

    Rows with no words are not taken.  Repeated rows of one doc_id, source and
    size share their parts in turn.
    """
    light = checkpointed(sized(docs).select("doc_id", "source", "_size"))
    sources = checkpointed(water_fill(numbered_sources(light), max_epochs))
    plan = mixture(light, sources, seed).groupBy("doc_id", "source", "_size").agg(F.max("_whole").alias("_whole"), F.sum("_part").alias("_parts"), F.count(F.lit(1)).alias("_same"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_size").alias("_z"), "_whole", "_parts", "_same")
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    rows = sized(packed).where("_size > 0")
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    part = F.least(F.col("_size"), F.ceil(F.col("_parts") / F.col("_same"))).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, part), "")
    whole = F.array_repeat(F.col("text"), F.col("_whole").cast("int"))
    last = F.when(part <= 0, F.array().cast("array<string>")).when(part >= F.col("_size"), F.array("text")).otherwise(F.array(cut))
    out = rows.select("_row", F.explode(F.concat(whole, last)).alias("_text"))
    return out.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
