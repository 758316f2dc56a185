"""Words, shingles and windows of whole texts, as numpy arrays over Arrow batches.

A word is a run of bytes outside space and 0x09-0x0D, which in UTF-8 is the
same as a run of code points outside them.  Texts are read as bytes, so
nothing is decoded.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to this many bytes; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Longer spans are hashed one by one.
LONG_BYTES = 2048

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def texts(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of groups of whole texts; null is empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.cast(pa.binary()).fill_null(b"")
        _, offsets, data = chunk.buffers()
        wide = chunk.type in (pa.large_string(), pa.large_binary())
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(chunk):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            end = min(end, len(chunk))
            yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word (with one entry more)."""
    space = SPACE[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[:1] = after[-1:] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the bytes of each span, eight bytes mixed in at a time; lanes are independent of each other."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(lane) * _NEXT + np.uint64(1))
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    left, at = np.flatnonzero((size > 0) & (size <= LONG_BYTES)), 0
    while len(left):
        part, rest = eight[starts[left] + at], size[left] - at
        short = rest < 8
        part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[left] = mix((out[left] ^ part) * _STEP)
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([lane])).digest()
        out[i] ^= np.frombuffer(digest, np.uint64)[0]
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two parts in this order; not linear in either, so no pattern of repeated words cancels out."""
    return (a ^ (a >> np.uint64(29))) * _STEP + (b ^ (b >> np.uint64(32))) * _NEXT


def windows(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of so many words inside one text, and their hashes, joined from blocks of 1, 2, 4, ... words."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(length, n + length) <= last)
    block, size, total, done = hashes, 1, None, 0
    while True:
        if length & size:
            total = block if total is None else _joined(total[: len(block) - done], block[done:])
            done += size
        if done == length:
            return at, mix(total[at] + np.uint64(length))
        block = _joined(block[:-size], block[size:])
        size *= 2


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of this length that starts at one of these."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the flags between the offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
