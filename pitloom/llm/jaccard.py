"""Jaccard join of word n-gram sets by partitioning the universe of shingles.

Two sets of sizes up to U with similarity t or more differ in at most
d = 2U(1-t)/(1+t) elements.  Shingles are dealt by hash into m segments.  With
exact segments (v = 1) at least m-d of them agree; with one-deletion
neighbourhoods (v = 2) at least m-d/2 differ in one element at most, and then
a segment or one with an element left out agrees with the other's.  Sizes fall
into bands so that similar sets lie in the same or in neighbouring bands; each
set is indexed under its own band's scheme and the next one's.  v and m are
allocated for each band by cost: rows written, plus the pairs that empty
segments would bring together, from the number of sets in the band.  Empty
segments are indexed only for sets that have so many of them that no other
segment need agree; of a lost pair both sets would be such.  A few segments
more than that are added, so that each set can do without those of its keys
that most sets share: what a passage common to many texts brings together.

Keys are counted in packed form (a few bytes for each key, sorted in numpy);
only keys with two different sets become rows.  In each key's group the sets
are first compared with a centre, the set that shares most keys with others:
of a family of near copies that is the original or one close to it.  Each set
meets first the one centre that it shares most keys with; keys whose sets then
lie in one component are settled, and only of the others every set meets the
key's centre.  A link
between sets that this leaves in different components has one of two forms.
Either both hold an element that the centre lacks; then they meet under that
element, and a prefix of such elements in hash order suffices.  Or they don't;
then all their additions to the centre count as differences between them, and
few sets have so few.  In a group of at most SMALL sets the pairs whose
differences from the centre allow a link are taken as they are.  All these are
sifted by counts of elements in hash buckets, which differ by no more than the
sets do, and what is left is verified exactly.  So a family of near copies
costs a star, not all pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import packed, words
from .components import components
from .session import checkpointed, forget

#: Partners of one set that one task compares in a row, about.
SALT_ROWS = 64
#: Columns with a set's elements counted in 32 hash buckets, 8 bits for each.
COARSE = ("c0", "c1", "c2", "c3")
#: Largest group of one key whose sets are paired without a look at their additions.
SMALL = 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text, and each text's first one (with one entry more)."""
    buf = words.LOWER[buf]
    starts, ends, first = words.spans(buf, offsets)
    hashes = words.span_hashes(buf, starts, ends)
    if seed:
        hashes = words.mix(hashes + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, h = words.windows(hashes, first, n)
    who = [owner[at]]
    out = [h]
    count = np.diff(first)
    for short in range(1, n):
        if (count == short).any():
            at, h = words.windows(hashes, first, short)
            only = count[owner[at]] == short
            who.append(owner[at][only])
            out.append(h[only])
    who, out = np.concatenate(who), np.concatenate(out)
    order = np.lexsort((out, who))
    who, out = who[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    who, out = who[new], out[new]
    return out, np.searchsorted(who, np.arange(len(first)))


def _identity(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each set; 0 for the empty set."""
    def total(x):
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=c[1:])
        return c[first[1:]] - c[first[:-1]]

    n = np.diff(first)
    one, two = words.mix(total(words.mix(sets)) + n.astype(np.uint64)), words.mix(total(words.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))) - n.astype(np.uint64))
    one[n == 0] = two[n == 0] = 0
    return one, two


@dataclass(frozen=True)
class Scheme:
    upper: int  # largest size
    v: int
    m: int
    need: int  # segments that must agree within v-1 elements, beside the hot ones
    hot: int = 0  # so many more must agree: a set's keys that most sets share are not needed


def _bounds(percent: int, largest: int) -> list[int]:
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return [*out, max(out[-1] + 1, -(-out[-1] * 100 // percent))]


def allocate(percent: int, band_sizes: dict[int, int], largest: int) -> list[Scheme]:
    """The cheapest scheme of each band; band_sizes: sets in a band."""
    out = []
    for k, upper in enumerate(_bounds(percent, largest)):
        differ = 2 * upper * (100 - percent) // (100 + percent)
        sets = band_sizes.get(k, 0) + band_sizes.get(k - 1, 0) + 1
        best = None
        for v in (1, 2):
            hot = 3 + differ // v // 16
            for spare in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32):
                m = differ // v + 1 + spare + hot
                if spare > max(2, m // 4):
                    break
                a = upper * percent / 100 / m
                weak = math.exp(-a) * (1 if v == 1 else 1 + a)  # chance that a segment can bring an empty key
                mean = m * weak
                rare = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(spare + 1))
                rare = max(rare, 0.0)
                # every pair of sets that both index an empty segment is compared, at some 200 rows' work
                cost = (m if v == 1 else m + upper) + 200 * m * sets * (rare * weak) ** 2
                if best is None or cost < best[0]:
                    best = (cost, Scheme(upper, v, m, 1 + spare, hot))
        out.append(best[1])
    return out


def _keys(sets: np.ndarray, first: np.ndarray, schemes: list[Scheme]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of the sets, and the set of each key; a key's last bit is that of its scheme's number."""
    size = np.diff(first)
    uppers = np.array([s.upper for s in schemes])
    band = np.searchsorted(uppers, size)
    mixed = words.mix(sets + np.uint64(0x2545F4914F6CDD1D))
    keys, who = [], []
    owner = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        k = np.minimum(band + step, len(schemes) - 1)
        m = np.array([s.m for s in schemes])[k]
        v = np.array([s.v for s in schemes])[k]
        need = np.array([s.need for s in schemes])[k]
        m = np.where(size > 0, m, 0)
        base = np.concatenate([[0], np.cumsum(m)])
        slot = base[:-1][owner] + (((mixed >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total, count = np.zeros(base[-1], np.uint64), np.bincount(slot, minlength=base[-1])
        np.add.at(total, slot, mixed)
        of = np.repeat(np.arange(len(size)), m)
        place = (np.arange(base[-1]) - base[:-1][of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (k[of].astype(np.uint64) << np.uint64(33))
        weak = np.bincount(of[count < v[of]], minlength=len(size)) if len(of) else np.zeros(len(size), np.int64)
        rare = weak >= need
        use = (count > 0) | rare[of]
        odd = (k & 1).astype(np.uint64)
        keys.append(words.mix(total[use] + words.mix(place[use] + count[use].astype(np.uint64))) >> np.uint64(1) << np.uint64(1) | odd[of[use]])
        who.append(of[use])
        two = v[owner] == 2
        left = count[slot] - 1
        two &= (left > 0) | rare[owner]
        s = slot[two]
        keys.append(words.mix((total[s] - mixed[two]) + words.mix(place[s] + left[two].astype(np.uint64))) >> np.uint64(1) << np.uint64(1) | odd[owner[two]])
        who.append(owner[two])
    return np.concatenate(keys), np.concatenate(who)


def _packer(n: int, seed: int, schemes: list[Scheme], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(0, np.uint64)  # sets of this task, each indexed once
        for batch in batches:
            for _, _, buf, offsets in words.texts(batch.column(0)):
                sets, first = shingle_sets(buf, offsets, n, seed)
                one, _ = _identity(sets, first)
                fresh = np.zeros(len(one), bool)
                fresh[np.unique(one, return_index=True)[1]] = True
                fresh &= ~np.isin(one, done)
                done = np.concatenate([done, one[fresh]])
                size = np.diff(first)
                sets, one, size = sets[np.repeat(fresh, size)], one[fresh], size[fresh]
                keys, who = _keys(sets, np.concatenate([[0], np.cumsum(size)]), schemes)
                yield from packed.pack(keys, one[who], buckets, short=True)

    return run


def _compare(n: int, seed: int, percent: int):
    """Rows (a, b, text), a's own text first (b null), to (a, b, shared, size_a, size_b, COARSE of b, added).

    added: the least elements that b has and a lacks, one more than b can have and a set linked with it lack.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for lo, hi, buf, offsets in words.texts(batch.column(2)):
                sets, first = shingle_sets(buf, offsets, n, seed)
                for i in range(lo, hi):
                    own = sets[first[i - lo] : first[i - lo + 1]]
                    if b[i] is None:
                        have, mine = a[i], own.copy()
                        continue
                    if a[i] != have:
                        raise RuntimeError("a pair's first text is missing")
                    at = np.searchsorted(mine, own)
                    both = mine[np.minimum(at, len(mine) - 1)] == own if len(mine) else np.zeros(len(own), bool)
                    added = own[~both][: len(own) * (100 - percent) // 100 + 1].view(np.int64)
                    coarse = np.minimum(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=32), 255).astype(np.uint8).view(np.int64)
                    rows.append((a[i], b[i], int(both.sum()), len(mine), len(own), *coarse.tolist(), added))
            if rows:
                *numbers, added = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(added, pa.list_(pa.int64()))], names=["a", "b", "shared", "size_a", "size_b", *COARSE, "added"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, seed: int, percent: int) -> DataFrame:
    """Exact overlap of the distinct pairs (a, b); a set with many partners is dealt over several tasks."""
    many = pairs.groupBy("a").count().where(F.col("count") > SALT_ROWS).select("a", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("_n"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_n", F.lit(1))).cast("int").alias("salt"))
    right = dealt.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "b", "salt", "text")
    left = dealt.select("a", "salt").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", F.lit(None).cast("long").alias("b"), "salt", "text")
    width = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = left.unionByName(right).repartition(width, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_compare(n, seed, percent), "a long, b long, shared long, size_a long, size_b long, " + "".join(f"{c} long, " for c in COARSE) + "added array<long>")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Sets hold the distinct n-word shingles after lower-casing A-Z; a text of
    fewer words is one shingle, a null or wordless text has none and links
    with nothing.  Sets link if 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach.  Equal texts, and
    repeated rows, share a component.  Null doc_ids are never the smallest.
    An empty table gives an empty one.
    """
    rows, _ = _rooted(docs, n, percent)
    return rows.select("doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _rooted(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, int]:
    """(doc_id, n_shingles, id, root, component_id), id the row's set and root its component; and the seed of the hashes."""
    seed = 0
    while True:
        light = checkpointed(_light(docs, n, seed))
        # two sets under one 64-bit id: take other hashes
        if light.where("id is not null").groupBy("id").agg((F.min("id2") != F.max("id2")).alias("x")).where("x").isEmpty():
            break
        forget(light)
        seed += 1
    classes = checkpointed(light.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("size")))
    largest = classes.agg(F.max("size")).first()[0] or 1
    bounds = _bounds(percent, largest)
    band = F.expr("0" + "".join(f" + CAST(size > {u} AS INT)" for u in bounds))
    sizes = {r[0]: r[1] for r in classes.groupBy(band.alias("band")).count().collect()}  # a few for each power of the size
    schemes = allocate(percent, sizes, largest)
    total = sum(c * sum(s.m + (bounds[k] if s.v == 2 else 0) for s in schemes[k : k + 2]) for k, c in sizes.items())
    buckets = packed.buckets_for(docs.sparkSession, total)
    member = checkpointed(packed.shared(docs.select("text").mapInArrow(_packer(n, seed, schemes, buckets), packed.SCHEMA)).distinct())
    every, member = member, checkpointed(_without_hot(member, classes.select("id", band.alias("band")), schemes))
    forget(every)
    star = checkpointed(_centres(member))
    near = checkpointed(member.join(star, "key").where("id <> a"))
    texts = checkpointed(_texts(docs, member.select("id").distinct().join(classes, "id").select("id", "doc"), n, seed))
    linked = f"100 * shared >= {percent} * (size_a + size_b - shared)"

    # each set with the centre that it shares most keys with
    shared = near.groupBy("id", "a").agg(F.count(F.lit(1)).alias("keys"))
    pairs = checkpointed(shared.groupBy("id").agg(F.max_by("a", F.struct("keys", "a")).alias("a")).select("a", F.col("id").alias("b")))
    checked = checkpointed(_verified(pairs, texts, n, seed, percent))
    found = checkpointed(components(checked.where(linked).select("a", "b")))
    # a key whose sets lie in one component is settled; of the others every set meets the key's centre
    root = found.select(F.col("node").alias("id"), "root")
    spread = member.join(root, "id", "left").groupBy("key").agg((F.min(F.coalesce("root", "id")) != F.max(F.coalesce("root", "id"))).alias("open")).where("open").select("key")
    open_ = checkpointed(near.join(spread, "key"))
    forget(member, near)
    more = checkpointed(open_.select("a", F.col("id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    checked = checked.unionByName(checkpointed(_verified(more, texts, n, seed, percent)))
    links = checked.where(linked).select("a", "b")
    found = checkpointed(components(links))
    rest = _near_enough(_unsettled(open_, checked, found, percent), texts, percent)
    if not rest.isEmpty():
        last = _verified(rest, texts, n, seed, percent).where(linked).select("a", "b")
        found = checkpointed(components(links.unionByName(last)))
    forget(texts, open_, rest, star, pairs, more)
    group = found.join(classes.select(F.col("id").alias("node"), "doc"), "node").groupBy("root").agg(F.min("doc").alias("component"))
    node = found.join(group, "root").select(F.col("node").alias("id"), "root", "component")
    answer = classes.select("id", "doc").join(node, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("component", "doc").alias("component_id"))
    return light.join(answer, "id", "left").select("doc_id", "n_shingles", "id", "root", "component_id"), seed


def _without_hot(member: DataFrame, bands: DataFrame, schemes: list[Scheme]) -> DataFrame:
    """member without the keys that each set need not have: of either scheme those that most sets share.

    Linked sets share need + hot keys of one scheme.  Keys are ordered by the
    number of their sets, then by themselves; of the keys that two sets share
    the last one in this order is among the first `hot` of neither.
    """
    sized = member.join(member.groupBy("key").agg(F.count(F.lit(1)).alias("sets")), "key").join(bands, "id")
    odd = F.col("key").bitwiseAND(1).cast("int")
    # a set is indexed under its band's scheme and the next one's
    number = F.least(F.when(F.col("band") % 2 == odd, F.col("band")).otherwise(F.col("band") + 1), F.lit(len(schemes) - 1))
    order = Window.partitionBy("id", odd).orderBy(F.desc("sets"), "key")
    kept = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") > F.element_at(F.array(*(F.lit(s.hot) for s in schemes)), number + 1)).select("key", "id")
    several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key")
    return kept.join(several, "key")


def _centres(member: DataFrame) -> DataFrame:
    """(key, a): of each key's sets the one that shares most keys with other sets."""
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    degree = member.join(size, "key").groupBy("id").agg(F.sum("size").alias("degree"))
    return member.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("a"))


def _unsettled(near: DataFrame, checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one key, of (key, id, a) with a the key's centre, in different components, that their differences from the centre let link.

    Let x be what a set adds to the centre and y what it lacks.  Sets of sizes
    s and t differ in at most (s + t)(1 - p) / (1 + p) elements if they link.
    Their additions and lacks differ by |x - x'| + |y - y'| at least if they
    share an addition, and by x + x' + |y - y'| if they share none.
    """
    part = checked.select("a", F.col("b").alias("id"), F.col("size_b").alias("size"), (F.col("size_b") - F.col("shared")).alias("x"), (F.col("size_a") - F.col("shared")).alias("y"), *COARSE)
    part = part.join(found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # keys whose other sets lie in one component are settled: those have all been compared with the centre
    keyed = near.join(part, ["a", "id"])
    mixed = keyed.groupBy("key").agg((F.min("root") != F.max("root")).alias("open"), F.count(F.lit(1)).alias("n")).where("open").select("key", "n")
    grouped = checkpointed(keyed.join(mixed, "key").select("key", "n", "a", "id", "root", "size", "x", "y", *COARSE))
    few, open_ = (grouped.where(f"n {op} {SMALL}").drop("n") for op in ("<=", ">"))
    sets = checkpointed(open_.drop("key").distinct())
    own, other = ("size", "x", "y", "root", *COARSE), ("size_", "x_", "y_", "root_", *(f"{c}_" for c in COARSE))

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"id": "b", **dict(zip(own, other))})

    room = f"(size + size_) * {100 - percent} div {100 + percent}"
    # counts differ by no more than the sets do
    coarse = " + ".join(f"abs((shiftright({c}, {8 * i}) & 255) - (shiftright({c}_, {8 * i}) & 255))" for c in COARSE for i in range(8))
    apart = f"root <> root_ AND abs(y - y_) + abs(x - x_) <= {room} AND {coarse} <= {room}"
    direct = few.join(renamed(few).drop("a"), "key").where(f"id < b AND {apart}").select(F.col("id").alias("a"), "b")
    added = checked.select("a", F.col("b").alias("id"), "added").join(sets, ["a", "id"]).withColumn("e", F.explode("added")).drop("added")
    several = added.groupBy("a", "e").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("a", "e")
    added = checkpointed(added.join(several, ["a", "e"]))
    one = added.join(renamed(added), ["a", "e"]).where(f"id < b AND {apart}")
    # where both lists are whole, the additions shared are counted, and so the least difference
    whole = " AND ".join(f"x{i} <= size{i} * {100 - percent} div 100 + 1" for i in ("", "_"))
    one = one.groupBy("a", "id", "b").agg(F.count(F.lit(1)).alias("n"), F.first(F.expr(f"CASE WHEN {whole} THEN x + x_ + abs(y - y_) - {room} ELSE 0 END")).alias("need"))
    one = one.where("2 * n >= need").select(F.col("id").alias("a"), "b")
    # without a shared addition one of the two has at most half the room, which is at most this
    light = open_.where(f"2 * x <= size * {100 - percent} div {percent}")
    heavy = open_.where(f"x <= size * {100 - percent} div {percent}")
    two = light.join(renamed(heavy).drop("a"), "key").where(f"id <> b AND root <> root_ AND x + x_ + abs(y - y_) <= {room} AND {coarse} <= {room}")
    two = two.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    return direct.unionByName(one).unionByName(two).distinct()


def _bucket_counts(own: np.ndarray) -> bytes:
    """How many elements have each value of their top bits, up to 255; a quarter to half as many buckets as elements."""
    bits = max(0, len(own).bit_length() - 2)
    at = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _near_enough(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their bucket counts: those differ by no more than the sets do."""
    def run(batches):
        for batch in batches:
            size_a, size_b, one, two = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, w = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (one[i], two[i]))
                # a sum over buckets is cut off at 255 like a bucket itself
                while len(u) > len(w):
                    u = np.minimum(u.reshape(-1, 2).sum(1), 255)
                while len(w) > len(u):
                    w = np.minimum(w.reshape(-1, 2).sum(1), 255)
                keep[i] = np.abs(u - w).sum() * (100 + percent) <= (size_a[i] + size_b[i]) * (100 - percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    counts = texts.select("id", "size", "counts")
    rows = pairs.join(counts.withColumnsRenamed({"id": "a", "size": "size_a", "counts": "one"}), "a").join(counts.withColumnsRenamed({"id": "b", "size": "size_b", "counts": "two"}), "b")
    return checkpointed(rows.select("a", "b", "size_a", "size_b", "one", "two").mapInArrow(run, "a long, b long"))


def _sets_of(column: pa.Array, n: int, seed: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size and the two hashes of each text's set; the hashes are null where it has none."""
    parts = []
    for _, _, buf, offsets in words.texts(column):
        sets, first = shingle_sets(buf, offsets, n, seed)
        parts.append((np.diff(first), *_identity(sets, first)))
    size, one, two = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return pa.array(size, pa.int64()), pa.array(one.view(np.int64), mask=size == 0), pa.array(two.view(np.int64), mask=size == 0)


def _light(docs: DataFrame, n: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_sets_of(batch.column(1), n, seed)], names=["doc_id", "n_shingles", "id", "id2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, id long, id2 long")


def _texts(docs: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """One text for each wanted (id, doc), that of the class's smallest document, with its set's size and bucket counts."""
    def run(batches):
        for batch in batches:
            ids, sizes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for _, _, buf, offsets in words.texts(batch.column(1)):
                sets, first = shingle_sets(buf, offsets, n, seed)
                ids.append(_identity(sets, first)[0])
                sizes.append(np.diff(first).astype(np.int64))
                counts += [_bucket_counts(sets[i:j]) for i, j in zip(first[:-1], first[1:])]
            columns = [batch.column(0), pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(counts, pa.binary()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "id", "size", "counts", "text"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text is not null").mapInArrow(run, "doc long, id long, size long, counts binary, text string")
    found = keyed.join(wanted.withColumnRenamed("doc", "_doc"), (keyed["id"] == wanted["id"]) & keyed["doc"].eqNullSafe(F.col("_doc"))).select(keyed["id"], keyed["size"], keyed["counts"], "text")
    # documents of one id have one set
    return found.groupBy("id").agg(F.first("size").alias("size"), F.first("counts").alias("counts"), F.min("text").alias("text"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the first by doc_id (null last), then by its set, then by its text.

    Rows with one doc_id and different texts are judged each for itself.  A
    repeated row stays once.  Texts without words are in no group: all of them
    stay, repeated ones too.  All columns of docs are kept as they are,
    whatever their names; an empty table stays empty.
    """
    rows, seed = _rooted(docs, n, percent)
    first = rows.where("id is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first"))
    first = checkpointed(first.select(F.col("first.doc_id").alias("_first_doc"), F.col("first.id").alias("_first_id")))
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text"))
    schema = T.StructType([whole.schema["_row"], whole.schema["_doc"], T.StructField("_id", T.LongType())])

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, one, _ = _sets_of(batch.column(2), n, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), one], names=["_row", "_doc", "_id"])

    known = checkpointed(whole.mapInArrow(identified, schema))
    kept = known.join(first, known["_id"].eqNullSafe(first["_first_id"]) & known["_doc"].eqNullSafe(first["_first_doc"]), "left_semi").where("_id is not null")
    kept = kept.groupBy("_doc", "_id").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    return kept.select("_row.*").unionByName(known.where("_id is null").select("_row.*"))
