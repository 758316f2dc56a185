"""The trie of conversation prefixes by truncation peeling.

A prefix is named by 128 bits: the exclusive or of hashes of its turns and
their places.  Distinct conversations are sorted by the names of their prefixes
and cut into blocks.  A block is peeled from its greatest depth on: the
conversations that end there merge with the nodes that survive from below,
equal ones become one node, each node adds what it knows to its parent (the
last turn is stripped), and so on to the top; nodes are discovered and summed
in this one pass.  A node that lies on the path of a block's first or last
conversation may have members in other blocks and stays open: its partial
sums are rows of the next round, which peels the open nodes of many blocks
together.  A round leaves two paths for each block at most.

Conversations longer than CHUNK turns are peeled in chunks, the deepest first;
the roots of one chunk's trie are the ends of the chunk above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered
from .session import checkpointed

#: Turns that one row holds.
CHUNK = 128
#: Tasks whose open nodes meet in one task of the next round.
FAN = 32
#: Ids in one piece of the list of a node's ends.
PIECE = 50_000

_NAMES = ["a", "b", "pa", "pb", "chars"]
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_COLUMNS = ["depth", *_NAMES, "conv_id", *_SUMS]
_STATE = ", ".join(f"{c} long" for c in _COLUMNS)
_NOBODY = np.iinfo(np.int64).max


def rebuilt_turns(turns: DataFrame, share: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin with turns of a shared one: (conv_id, place, ha, hb, chars) of rows (conv_id, turn, role, text).

    Conversation c takes the first crc32(c) % heads turns of conversation
    c - c % share, and then its own turns after as many.  One without a turn
    left has one row of null place.  Turns are in order of turn (null first),
    role and the text's md5; ha and hb are hashes of role and text, chars the
    text's code points; null role and text are empty; rows without conv_id
    take no part; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("tie"),
        F.xxhash64(role, text).alias("ha"), F.xxhash64(F.lit("second"), role, text).alias("hb"), F.length(text).cast("long").alias("chars"),
    )
    t = checkpointed(numbered(t, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")], "place").drop("turn", "role", "tie"))
    sizes = checkpointed(t.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    head = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    base = sizes.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv_id", "first", "n", head, (F.col("conv_id") - F.col("conv_id") % share).alias("base")).join(base, "base", "left")
    plan = checkpointed(plan.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    turn = ["ha", "hb", "chars"]
    placed = t.join(plan.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("place", F.col("place") - F.col("first") + 1)
    shared = placed.where((F.col("conv_id") % share == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("base"), "place", *turn)
    begun = plan.select("conv_id", "base", "taken").join(shared, "base").where("place <= taken").select("conv_id", "place", *turn)
    own = placed.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), *turn)
    bare = plan.where("taken = 0 and n <= h").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("place", *turn)))
    return begun.unionByName(own).unionByName(bare)


def _chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, last, ra, rb, a, b, chars): the name of the prefix before each chunk and arrays of those at its turns."""
    at = F.col("place")
    turn = F.struct(at.alias("place"), F.xxhash64("place", "ha", "hb").alias("a"), F.xxhash64(F.lit("second"), "place", "ha", "hb").alias("b"), "chars")
    hashed = turns.select("conv_id", F.coalesce(F.floor((at - 1) / CHUNK), F.lit(0)).cast("int").alias("chunk"), F.when(at.isNotNull(), turn).alias("t"))
    rows = hashed.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("t"), F.expr("bit_xor(t.a)").alias("xa"), F.expr("bit_xor(t.b)").alias("xb"))
    before, whole = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    past = lambda x: F.coalesce(F.expr(f"bit_xor({x})").over(before), F.lit(0))
    rows = rows.select("conv_id", "chunk", (F.col("chunk") == F.max("chunk").over(whole)).alias("last"), past("xa").alias("ra"), past("xb").alias("rb"), "t")
    names = ["conv_id", "chunk", "last", "ra", "rb", "a", "b", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = batch.column("t").flatten(), batch.column("t").value_lengths().to_numpy()
            edges = np.concatenate([[0], np.cumsum(sizes)])
            arrays = []
            for name, start in (("a", "ra"), ("b", "rb")):
                total = np.bitwise_xor.accumulate(np.concatenate([[0], values.field(name).to_numpy()]))
                x = total[1:] ^ np.repeat(total[edges[:-1]] ^ batch.column(start).to_numpy(), sizes)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int64())))
            arrays.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values.field("chars")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), *arrays], names=names)

    return rows.mapInArrow(run, "conv_id long, chunk int, last boolean, ra long, rb long, a array<long>, b array<long>, chars array<long>")


_Rows = dict[str, np.ndarray]


def _peel(depth: int, top: int, arrive: Callable[[int], _Rows], strip: Callable[[_Rows, int], _Rows], path: Callable[[int], np.ndarray]) -> Iterator[tuple[_Rows, np.ndarray]]:
    """The nodes of one block, from the greatest depth up to `top`, and which of each depth's are open.

    arrive(d): what ends at depth d, rows of the state but for depth.
    strip(nodes, d): the names and whatever else rows need at depth d, of
    nodes one deeper.  path(d): names of nodes that may have members
    elsewhere.  An open node passes nothing up but its parent's name.
    """
    alive: _Rows = {}
    for d in range(depth, top - 1, -1):
        rows = arrive(d)
        if alive:  # what has arrived stands first in its group, as only that knows a node's parent in later rounds
            rows = {c: np.concatenate([rows[c], alive[c]]) for c in rows}
        order = np.lexsort((rows["b"], rows["a"]))  # stable
        rows = {c: v[order] for c, v in rows.items()}
        new = np.ones(len(order), bool)
        new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        nodes = {c: v[first] for c, v in rows.items() if c not in _SUMS}
        nodes["conv_id"] = np.minimum.reduceat(rows["conv_id"], first)
        nodes |= {c: np.add.reduceat(rows[c], first) for c in _SUMS}
        opened = np.isin(nodes["a"], path(d))
        shut = ~opened
        nodes["n_leaves"] += shut & (nodes["n_children"] == 0)
        nodes["saved_tokens"] += shut * (nodes["n_convs"] - 1) * nodes["chars"]
        yield {"depth": np.full(len(first), d), **nodes}, opened
        if d > top:
            alive = {**strip(nodes, d - 1), "conv_id": np.where(shut, nodes["conv_id"], _NOBODY), "n_children": shut.astype(np.int64), **{c: shut * nodes[c] for c in ("n_convs", "n_leaves", "saved_tokens")}}


def _given(nodes: _Rows, opened: np.ndarray, block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(nodes[c], pa.int64()) for c in _COLUMNS), pa.array(~opened), pa.array(np.full(len(opened), block), pa.int64())], names=[*_COLUMNS, "done", "block"])


def _blocks(sequences: DataFrame, top: int) -> DataFrame:
    """The first round: sequences (ra, rb, a, b, chars, and sums at their ends) are sorted, and each batch of them is peeled."""

    def block(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        size = batch.column("a").value_lengths().to_numpy()
        start = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        inner = np.ones(n, bool)
        inner[start] = False
        names = {c: np.zeros(n, np.int64) for c in _NAMES}  # of all prefixes of a sequence, from the root's on
        for c in ("a", "b"):
            names[c][start], names[c][inner] = batch.column("r" + c).to_numpy(), batch.column(c).flatten().to_numpy()
            names["p" + c][1:][inner[1:]] = names[c][:-1][inner[1:]]
        names["chars"][inner] = batch.column("chars").flatten().to_numpy()
        sums = {c: batch.column(c).to_numpy() for c in ("conv_id", *_SUMS)}
        by_size = np.argsort(size, kind="stable")
        sorted_size = size[by_size]

        def arrive(d: int) -> _Rows:
            lo, hi = np.searchsorted(sorted_size, [d - top, d - top + 1])
            who = by_size[lo:hi]
            return {"who": who, **{c: v[start[who] + d - top] for c, v in names.items()}, **{c: v[who] for c, v in sums.items()}}

        def strip(nodes: _Rows, d: int) -> _Rows:
            return {"who": nodes["who"], **{c: v[start[nodes["who"]] + d - top] for c, v in names.items()}}

        ends = np.array([0, len(size) - 1])
        edge = lambda d: names["a"][start[ends[size[ends] >= d - top]] + d - top]
        for nodes, opened in _peel(top + int(sorted_size[-1]), top, arrive, strip, edge):
            yield _given(nodes, opened, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if batch.num_rows:
                yield from block(batch, (task << 32) + i)

    width = max(1, int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sequences.withColumn("way", F.concat(F.array("ra"), F.col("a"))).repartitionByRange(width, "way", "eb").sortWithinPartitions("way", "eb")
    return dealt.select("ra", "rb", "a", "b", "chars", "conv_id", *_SUMS).mapInArrow(run, f"{_STATE}, done boolean, block long")


def _regrouped(opened: DataFrame, group: Column, top: int, last: bool) -> DataFrame:
    """A later round: peels the open nodes of a group of neighbouring blocks together; in the last one all close."""

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        rows = {c: g[c].to_numpy(np.int64) for c in _COLUMNS}
        order = np.argsort(rows["depth"], kind="stable")
        rows = {c: v[order] for c, v in rows.items()}
        block = g["block"].to_numpy(np.int64)[order]
        edge = np.zeros(len(order), bool) if last else (block == block.min()) | (block == block.max())
        lie = lambda d: slice(*np.searchsorted(rows["depth"], [d, d + 1]))
        arrive = lambda d: {c: rows[c][lie(d)] for c in _COLUMNS[1:]}
        strip = lambda nodes, d: {"a": nodes["pa"], "b": nodes["pb"], **{c: np.zeros(len(nodes["a"]), np.int64) for c in ("pa", "pb", "chars")}}
        path = lambda d: rows["a"][lie(d)][edge[lie(d)]]
        out = [pd.DataFrame(nodes).assign(done=~opened) for nodes, opened in _peel(int(rows["depth"][-1]), top, arrive, strip, path)]
        return pd.concat(out)[[*_COLUMNS, "done"]].assign(block=int(block.min()))

    return opened.groupBy(group.alias("_group")).applyInPandas(meet, f"{_STATE}, done boolean, block long")


def _peeled(sequences: DataFrame, top: int) -> DataFrame:
    """All nodes from depth `top` on of sequences whose ends carry sums."""
    now = checkpointed(_blocks(sequences, top))
    done, fan = [now.where("done")], FAN
    tasks = 1 + ((now.agg(F.max("block")).first()[0] or 0) >> 32)
    while True:
        last = tasks <= fan
        group = F.lit(0) if last else F.floor(F.shiftrightunsigned("block", 32) / fan)
        now = checkpointed(_regrouped(now.where("not done"), group, top, last))
        done.append(now.where("done"))
        if last:
            return reduce(DataFrame.unionByName, done).select(*_COLUMNS)
        fan *= FAN


def _ends(ended: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of rows (a, b, conv_id): ids in order, in pieces; a digest reads a node's pieces one by one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids = None, None, []

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([node[0]], pa.int64()), "b": pa.array([node[1]], pa.int64()), "first": pa.array([first], pa.int64()), "piece": [",".join(map(str, ids))]})

        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "conv_id"))):
                if (a, b) != node or len(ids) >= PIECE:
                    if ids:
                        yield given()
                    node, first, ids = (a, b), c, []
                ids.append(c)
        if ids:
            yield given()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, piece in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "piece"))):
                if (a, b) == node:
                    sha.update(b"," + piece.encode())
                    continue
                if sha:
                    out.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=["a", "b", "ends_sha256"])

    width = max(1, int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = ended.repartitionByRange(width, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(pieces, "a long, b long, first long, piece string")
    return cut.repartition(width, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, place, ha, hb, chars), a row for each turn.

    A node is a distinct sequence of the first turns of some conversation; the
    root has none.  Turns are the same whose ha and hb are.  Returned are
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  Members are the conversations that
    begin with the sequence.  n_leaves counts the childless nodes of the subtree,
    saved_tokens adds up (n_convs - 1) times the characters of the last text
    over it, and ends_sha256 is the digest of the ids, in order and joined by
    commas, of the members that end at the node.

    Places number a conversation's turns from 1; a row of null place is a
    conversation without turns, a member of the root alone.  conv_id is not
    null.  Equal conversations share all nodes.  No rows give no nodes.
    """
    chunks = checkpointed(_chunks(turns))
    end = lambda c, r: F.when(F.size(c) > 0, F.element_at(c, -1)).otherwise(F.col(r))
    chunks = chunks.withColumns({"ea": end("a", "ra"), "eb": end("b", "rb")})
    deepest = chunks.agg(F.max("chunk")).first()[0]
    below, nodes = None, []
    for chunk in range(deepest if deepest is not None else -1, -1, -1):
        mine = chunks.where(F.col("chunk") == chunk)
        same = mine.groupBy("ea", "eb").agg(F.min("conv_id").alias("conv_id"), F.count_if("last").alias("n_convs"), *(F.first(c).alias(c) for c in ("ra", "rb", "a", "b", "chars")))
        zero = F.lit(0).cast("long")
        if below is None:
            same = same.withColumns({c: zero for c in ("n_children", "n_leaves", "saved_tokens")})
        else:
            known = below.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("n_convs").alias("more"), "n_children", "n_leaves", "saved_tokens")
            same = same.join(known, ["ea", "eb"], "left").withColumn("n_convs", F.col("n_convs") + F.coalesce("more", zero)).withColumns({c: F.coalesce(c, zero) for c in ("n_children", "n_leaves", "saved_tokens")})
        top = chunk * CHUNK
        tree = checkpointed(_peeled(same, top))
        nodes.append(tree if chunk == 0 else tree.where(F.col("depth") > top))
        below = tree.where(F.col("depth") == top)  # without a saving of their own, as their turn is known in the chunk above
    if not nodes:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    trie = checkpointed(reduce(DataFrame.unionByName, nodes))
    parents = trie.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(chunks.where("last").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "conv_id"))
    out = trie.join(parents, ["pa", "pb", "depth"], "left").join(ends, ["a", "b"], "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return out
