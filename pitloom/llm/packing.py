"""Packing tokens into sequences by Karmarkar-Karp multiway differencing.

Each task tokenizes its texts, each different word once while it remembers it,
and gathers pieces for some hundred sequences at a time.  Whole sequences of a
long text stand alone; the rest, cut to short pieces, are dealt to k windows:
every piece starts as a partition of its own with k-1 empty windows, and the
two partitions of the largest spread are merged again and again, the fullest
windows of one with the emptiest of the other.  If a window comes out above
the capacity, k rises by one.  There is no shuffle, and a task holds one batch
of pieces at a time.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Words whose ids a Python worker remembers, at most, at some 40 bytes each.
MEMORY_WORDS = 400_000
#: So many words are given to the tokenizer at a time.
ENCODE_WORDS = 4_096
#: Texts are tokenized together up to this many bytes.
GROUP_BYTES = 1 << 20

#: The rules of a tokenizer that `units` follows; another one gets words cut at white space alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
ANY, LETTER, DIGIT, MARK, SPACE = range(5)
KIND = np.full(256, ANY, np.uint8)  # of ASCII bytes; others and control characters are ANY
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[words.SPACE] = SPACE
LOWER = words.LOWER.copy()  # of the bytes of LETTERs
LOWER[0x80:0x9F] += 32  # after 0xC3: the capitals of Latin-1
#: The character that a byte-level tokenizer has for each byte, as code points.
BYTE_LEVEL = np.arange(256, dtype="<u4")
_UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LEVEL[_UNSEEN] = 256 + np.arange(len(_UNSEEN))


def units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: Iterator[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where NORMALIZER and PRE_TOKENIZER always cut: the bytes with capitals lowered, starts, ends, and which units are one pre-token.

    Runs of letters (ASCII and Latin-1), single digits and runs of other ASCII
    characters part from each other, but not after an apostrophe, which may
    begin a contraction.  Nothing is cut or lowered beside other characters,
    which may combine with their neighbours, nor in words that hold one of the
    places `whole`.
    """
    kind = KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    second = buf[lead + 1]
    lead = lead[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]  # without the signs of times and division
    kind[lead] = kind[lead + 1] = LETTER
    for at in whole:
        word = np.searchsorted(starts, at, "right") - 1
        kind[starts[word] : ends[word]] = ANY
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (left != ANY) & (right != ANY) & (left != SPACE) & (right != SPACE) & ((left != right) | (right == DIGIT)) & ~((buf[:-1] == 0x27) & (right == LETTER))
    edge = cut.copy()
    cut[starts] = edge[ends] = True
    starts, ends = np.flatnonzero(cut), np.flatnonzero(edge)
    if not len(starts):
        return buf, starts, ends, np.zeros(0, bool)
    least = np.minimum.reduceat(kind, starts)
    lowered = buf.copy()
    lower = np.zeros(len(buf), bool)
    lower[starts[0] :] = np.repeat(least != ANY, np.diff(np.append(starts, len(buf))))
    lower &= kind == LETTER
    lowered[lower] = LOWER[buf[lower]]
    return lowered, starts, ends, (least != ANY) & (kind[starts] == kind[ends - 1])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the sizes' indices, with near-equal sums."""
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]  # (-spread, tie, sums of the used windows, their members)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        join = max(0, len(a) + len(b) - k)  # so many windows must be shared: the emptiest of a with ...
        if join:
            # fullest of one with the emptiest of the other, empty windows counting as such
            order = np.argsort(np.array(a), kind="stable")
            other = np.argsort(-np.array(b), kind="stable")
            a, x = [a[i] for i in order], [x[i] for i in order]
            b, y = [b[i] for i in other], [y[i] for i in other]
            # a's k-len(a) empty windows take b's fullest; the rest meet a's emptiest
            free = k - len(a)
            sums, members = a, x
            for i, (s, m) in enumerate(zip(b[free:], y[free:])):
                sums[i] += s
                members[i] = members[i] + m
            sums, members = sums + b[:free], members + y[:free]
        else:
            sums, members = a + b, x + y
        heapq.heappush(heap, (-(max(sums) - (min(sums) if len(sums) == k else 0)), tie, sums, members))
    groups = heap[0][3] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of no more than the capacity; as few as differencing finds, from the least possible up."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [g for g in groups if g]
        k += 1


class Tokens:
    """Ids of whole texts; words, cut at ASCII white space and into `units`, are encoded once and then looked up by hash, checked by a second one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = [json.loads(part.__getstate__()) if part else None for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.in_units = rules == [NORMALIZER, PRE_TOKENIZER] and not any(t.normalized or t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added)
        self.added = [t.content.encode() for t in added]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; the word's place below
        self.check = np.zeros(0, np.uint64)  # a second hash, by place
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return self.hashes[at] == wanted, self.rank[at]

    def _encoded(self, spelled: list, encode: Callable[[list], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has; the tokenizer's objects are held for some words at a time."""
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for at in range(0, len(spelled), ENCODE_WORDS):
            ids = encode(spelled[at : at + ENCODE_WORDS])
            size.append(np.array([len(x) for x in ids], np.int32))
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def _of_text(self, spelled: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in spelled], add_special_tokens=False)]

    def _of_one(self, spelled: list[str]) -> list[list[int]]:
        """Ids of single pre-tokens in BYTE_LEVEL characters, which need the tokenizer's model alone."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(x)] for x in spelled]

    def _learn(self, hashes: np.ndarray, check: np.ndarray, spelled: list, encode: Callable[[list], list[list[int]]]) -> None:
        flat, size = self._encoded(spelled, encode)
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size, dtype=np.int64) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        self.check = np.append(self.check, check)
        hashes = np.append(self.hashes, hashes)
        rank = np.append(self.rank, np.arange(len(self.size) - len(size), len(self.size), dtype=np.int32))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rank = hashes[order], rank[order]

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As `units`, and each text's first one."""
        starts, ends, first = words.spans(buf, offsets)
        if not self.in_units:
            return buf, starts, ends, np.zeros(len(starts), bool), first
        buf, starts, ends, one = units(buf, starts, ends, _places(buf.tobytes(), self.added))
        return buf, starts, ends, one, np.searchsorted(starts, offsets)

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and each text's first one (with one entry more)."""
        buf, starts, ends, one, first = self._cut(buf, offsets)
        code, found = pd.factorize(words.span_hashes(buf, starts, ends))
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        check = words.span_hashes(buf, starts, ends, 1)
        example = np.empty(len(found), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        known, place = self._find(found)
        if len(self.hashes) + int((~known).sum()) > MEMORY_WORDS:
            self._forget()
            known[:] = False
        if not known.all():
            single = one[example]
            for new, data, encode in ((~known & single, BYTE_LEVEL[buf].tobytes().decode("utf-32-le"), self._of_one), (~known & ~single, buf.tobytes(), self._of_text)):
                pick = example[new]
                self._learn(found[new], check[pick], [data[s:e] for s, e in zip(starts[pick].tolist(), ends[pick].tolist())], encode)
            known, place = self._find(found)
        place = place[code]
        if not (self.check[place] == check).all():  # two words under one hash
            return self._one_by_one(buf, starts, ends, first)
        count, begin = self.size[place], self.begin[place]
        ahead = np.zeros(len(code) + 1, np.int64)
        np.cumsum(count, out=ahead[1:])
        pick = np.arange(ahead[-1]) + np.repeat(begin - ahead[:-1], count)
        return self.flat[pick], ahead[first]

    def _one_by_one(self, buf, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        flat, size = self._encoded([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())], self._of_text)
        return flat, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[first]


def _places(data: bytes, wanted: list[bytes]) -> Iterator[int]:
    """Where any of the wanted parts begins."""
    for part in wanted:
        at = data.find(part)
        while at >= 0:
            yield at
            at = data.find(part, at + 1)


@functools.lru_cache(2)
def tokens_of(path: str) -> Tokens:
    """One for each Python worker, which many tasks use in turn."""
    return Tokens(path)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, batch_sequences: int = 128, piece: int = 1024, slack: float = 0.002) -> DataFrame:
    """PIECES of every row of docs (doc_id, text); ids as little-endian unsigned 32-bit words.

    A document's ids are those of its text and end_id; a null or empty text
    has only end_id.  Each id lies in one piece.  Repeated rows are packed each
    for itself.  A sequence's offsets have no gaps; sequence_id is unique.
    """
    room = int(batch_sequences * capacity * (1 - slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, serial = tokens_of(tokenizer), TaskContext.get().partitionId() << 32
        waiting, held = [], 0  # (doc_id, start, ids, doc_tokens)

        def rows(groups: list[list[tuple]]):
            nonlocal serial
            out = []
            for group in groups:
                offset = 0
                for doc, start, ids, total in group:
                    out.append((doc, start, len(ids), ids.tobytes(), total, serial, offset))
                    offset += len(ids)
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=PIECES.names)

        def flush():
            nonlocal waiting, held
            groups = [[waiting[i] for i in g] for g in windows_for([len(w[2]) for w in waiting], capacity)]
            waiting, held = [], 0
            return rows(groups)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, buf, offsets in words.texts(batch.column(1), GROUP_BYTES):
                flat, first = tokens.ids(buf, offsets)
                for doc, x, y in zip(doc_ids[lo:hi], first[:-1].tolist(), first[1:].tolist()):
                    ids = np.append(flat[x:y], np.uint32(end_id)).astype("<u4")
                    total, start = len(ids), 0
                    whole = []
                    while total - start >= capacity:
                        whole.append([(doc, start, ids[start : start + capacity], total)])
                        start += capacity
                    if whole:
                        yield rows(whole)
                    while start < total:
                        size = min(piece, total - start, room - held)
                        waiting.append((doc, start, ids[start : start + size], total))
                        start, held = start + size, held + size
                        if held >= room:
                            yield flush()
        if waiting:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
