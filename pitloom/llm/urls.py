"""URL rules as intervals of reversed-host keys, matched by a sorted sweep.

A rule's host and all its subdomains are the keys that start with its reversed
labels: one interval, and two such intervals are nested or apart.  Urls are
range-partitioned by key, path and a salt, so a host of a third of all rows is
dealt over many partitions.  Each rule goes to the partitions that its
interval meets; there rules and urls are sorted together and swept once, with
a stack of the rules whose interval is open.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed

_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _A, _A.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: str) -> F.Column:
    return F.when(F.col(host) == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(default: str):
    """Verdicts of the sorted rows; urls of one key and path share a look at the stack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, last, answer = None, [], None, (None, default)
        for batch in batches:
            where, rules_, verdicts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "rule", "verdict"))
            for at, (p, key, is_url, path, rule, verdict) in enumerate(zip(*columns)):
                if p != part:
                    part, stack, last = p, [], None
                if not is_url or last != (key, path):
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    had = stack[-1][1].get(path)
                    if had is None or verdict == "block":  # of two equal rules a block holds
                        stack[-1][1][path] = (rule, verdict)
                    last = None
                    continue
                if last != (key, path):
                    last, answer, best = (key, path), (None, default), -1
                    for _, rules in reversed(stack):  # of equally long rules the one for the longer host
                        if len(rules) <= len(path) + 1:
                            fit = [x for x in rules if path.startswith(x)]
                        else:
                            fit = [path[:n] for n in range(len(path) + 1) if path[:n] in rules]
                        for x in fit:
                            if len(rules[x][0]) > best:
                                best, answer = len(rules[x][0]), rules[x]
                where.append(at)
                rules_.append(answer[0])
                verdicts.append(answer[1])
            urls = batch.take(pa.array(where, pa.int64()))
            page = pc.if_else(urls.column("has_id"), urls.column("page_id"), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([page, urls.column("host"), urls.column("path"), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    rules has (host, path, verdict), hosts in lower case.  A rule fits its host
    and all subdomains if the url's path starts with the rule's; the longest
    rule wins, then the one for the longer host, then a block.  A url without
    `://`, or null, has an empty host, which no rule fits.  Null page_ids stay
    null, repeated rows are judged alike; without rules all urls get default.
    """
    spark = pages.sparkSession
    host, path = host_and_path("url")
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", _key("host"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salt = F.xxhash64("page_id")
    urls = checkpointed(urls.repartitionByRange(width, "key", "path", salt).withColumn("part", F.spark_partition_id()))
    ends = sorted((r[1], r[2], r[0]) for r in urls.groupBy("part").agg(F.min("key"), F.max("key")).collect())  # a row for each partition
    lows, highs, parts = [e[0].encode() for e in ends], [e[1].encode() for e in ends], [e[2] for e in ends]

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                start, stop = key.encode(), key[:-1].encode() + b"/"  # "/" follows "."
                found.append(parts[bisect.bisect_left(highs, start) : bisect.bisect_left(lows, stop)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    keyed = rules.where("host <> ''").select(_key("host").alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    placed = keyed.mapInArrow(meets, "key string, path string, rule string, verdict string, parts array<int>")
    no = F.lit(None)
    both = placed.select(F.explode("parts").alias("part"), "key", F.lit(False).alias("is_url"), "path", "rule", "verdict", F.lit(False).alias("has_id"), F.lit(0).cast("long").alias("page_id"), no.cast("string").alias("host"))
    both = both.unionByName(urls.select("part", "key", F.lit(True).alias("is_url"), "path", no.cast("string").alias("rule"), no.cast("string").alias("verdict"), F.col("page_id").isNotNull().alias("has_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long")).alias("page_id"), "host"))
    swept = both.repartitionById(width, F.col("part") % width).sortWithinPartitions("part", "key", "is_url", "path")
    return swept.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
