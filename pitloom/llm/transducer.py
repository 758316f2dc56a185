"""A minimal acyclic transducer: sorted terms in, each term's place in that order out.

States that accept the same endings are one.  An arc's output is the number of
terms that come before it, so the outputs along a term's path add up to its
ordinal.  Arcs stand in an open hash table, and all terms of a batch of texts
take their steps together.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(-1)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Transducer:
    """keys (state * 256 + byte), targets and outputs of arcs by slot; which states accept."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, start: int):
        self.keys, self.targets, self.outputs, self.final, self.start = keys, targets, outputs, final, start
        self.bits = len(keys).bit_length() - 1

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in the order of their bytes.

        A state is frozen once no later term can pass through it; one that
        equals an earlier state is replaced by it.
        """
        known: dict[tuple, int] = {}
        accepts, below, arcs = [], [], []  # of frozen states: final, terms that start there, (byte, target) pairs

        def freeze(final: bool, out: list) -> int:
            key = (final, *out)
            if key not in known:
                known[key] = len(arcs)
                accepts.append(final)
                below.append(final + sum(below[t] for _, t in out))
                arcs.append(out)
            return known[key]

        path: list[list] = [[False, []]]  # of the last term: final, frozen arcs
        last = b""
        for term in terms:
            shared = 0
            while shared < min(len(last), len(term)) and last[shared] == term[shared]:
                shared += 1
            for i in range(len(last), shared, -1):
                path[i - 1][1].append((last[i - 1], freeze(*path.pop())))
            path += [[False, []] for _ in range(len(term) - shared)]
            path[-1][0] = True
            last = term
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], freeze(*path.pop())))
        start = freeze(*path[0])
        keys, targets, outputs = [], [], []
        for state, out in enumerate(arcs):
            before = int(accepts[state])
            for byte, target in out:
                keys.append(state * 256 + byte)
                targets.append(target)
                outputs.append(before)
                before += below[target]
        return cls._hashed(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int64), np.array(accepts, bool), start)

    @classmethod
    def _hashed(cls, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, start: int) -> Transducer:
        bits = max(4, (2 * len(keys)).bit_length())
        slots = np.full(1 << bits, _NONE)
        at, left = _slots(keys, bits), np.arange(len(keys))
        while len(left):  # of the arcs that want one free slot, one takes it; the others go on to the next slot
            free = left[slots[at[left]] == _NONE]
            slots[at[free]] = free
            left = left[slots[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        full = slots != _NONE
        pick = lambda x, none: np.where(full, x[np.maximum(slots, 0)] if len(x) else none, none)
        return cls(pick(keys, _NONE), pick(targets, -1).astype(np.int32), pick(outputs, 0), final, start)

    def to_bytes(self) -> bytes:
        head = np.array([self.start, len(self.keys), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.outputs, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        start, n, states = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at = 24
        parts = []
        for kind, size in ((np.int64, n), (np.int32, n), (np.int64, n), (bool, states)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(*parts, start)

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ordinal of each term text[start : start + length], or -1."""
        out = np.full(len(starts), _NONE)
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        which, state, total = order, np.full(len(order), self.start, np.int64), np.zeros(len(order), np.int64)
        mask, step = len(self.keys) - 1, 0
        while len(which):
            done = np.searchsorted(-size, -step)  # terms are in order of length: those from here on end now
            ended = slice(done, len(which))
            out[which[ended]] = np.where(self.final[state[ended]], total[ended], _NONE)
            at, size, which, state, total = at[:done], size[:done], which[:done], state[:done], total[:done]
            key = state * 256 + text[at + step]
            slot = _slots(key, self.bits)
            found = self.keys[slot]
            miss = np.flatnonzero((found != key) & (found != _NONE))
            while len(miss):
                slot[miss] = (slot[miss] + 1) & mask
                found[miss] = self.keys[slot[miss]]
                miss = miss[(found[miss] != key[miss]) & (found[miss] != _NONE)]
            go = np.flatnonzero(found == key)
            slot = slot[go]
            at, size, which = at[go], size[go], which[go]
            state, total = self.targets[slot].astype(np.int64), total[go] + self.outputs[slot]
            step += 1
        return out
