"""SuperMinHash signatures of sets of 64-bit hashes, many sets at a time, in numpy.

Each element walks its own random permutation of the slots: at step j it offers the value j + r,
r in [0, 1), to the j-th slot of the permutation. Values of later steps are larger, so a set whose
slots are all filled by step j is done. The ranks of one element's values are a permutation, not
independent draws: that is what lowers the variance against MinHash.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Steps for which swaps are kept as a list; permutations are written out for what is left after.
_EARLY = 7


def signatures(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """One row of `slots` values for each set; counts: how many of `elements` each has, in turn. Empty sets keep the largest value."""
    sets = len(counts)
    out = np.full(sets * slots, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(sets, dtype=np.int64), counts)
    live = elements.astype(np.uint64)
    kept_k: list[np.ndarray] = []
    kept_v: list[np.ndarray] = []
    table: np.ndarray | None = None
    for j in range(slots):
        if not len(live):
            break
        with np.errstate(over="ignore"):
            draw = mixed(live + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(40)) | (draw >> np.uint64(24))
        if j < _EARLY:
            # What slot j held before this step, and what slot k held: their last swaps, if any, else themselves.
            mine, chosen = np.full(len(live), j, np.int64), k.copy()
            for before_k, before_v in zip(kept_k, kept_v, strict=True):
                np.copyto(mine, before_v, where=before_k == j)
                np.copyto(chosen, before_v, where=before_k == k)
            slot = np.where(k == j, mine, chosen)
            kept_k.append(k)
            kept_v.append(mine)
        else:
            rows = np.arange(len(live))
            if table is None:
                table = np.tile(np.arange(slots, dtype=np.uint16), (len(live), 1))
                for i, before_k in enumerate(kept_k):
                    moved = table[rows, before_k].copy()
                    table[rows, before_k] = table[:, i]
                    table[:, i] = moved
                kept_k, kept_v = [], []
            slot = table[rows, k].astype(np.int64)
            table[rows, k] = table[:, j]
            table[:, j] = slot
        np.minimum.at(out, owner * slots + slot, value)
        going = out.reshape(sets, slots).max(axis=1) == _EMPTY
        stay = going[owner]
        if not stay.all():
            live, owner = live[stay], owner[stay]
            kept_k, kept_v = [x[stay] for x in kept_k], [x[stay] for x in kept_v]
            table = None if table is None else table[stay]
    return out.reshape(sets, slots)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of `rows` values, with the band's number in it."""
    sets, slots = signature.shape
    h = np.broadcast_to(np.arange(1, slots // rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (sets, slots // rows)).copy()
    each = signature.reshape(sets, slots // rows, rows)
    for k in range(rows):
        h = mixed(h + each[:, :, k])
    return h


def sketch(signature: np.ndarray) -> np.ndarray:
    """Each value as 8 bits: equal where values are, and by chance once in 256."""
    return (mixed(signature) & np.uint64(0xFF)).astype(np.uint8)
