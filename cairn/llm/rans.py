"""Static range asymmetric numeral system over token ids, in numpy, many lanes at a time.

A block holds up to BLOCK ids, dealt over LANES interleaved streams: lane k has ids k, k + LANES, ...
All blocks share one frequency table with a sum of 2**SCALE. States are 64 bits wide and give off
32 bits at a time; a row of ids is one numpy step over all lanes. Every CHECKPOINT rows the encoder
notes the states and the position in the words, so that a reader can begin there, in parallel.

The checkpoints of a block are lanes of their own when it is decoded: all stretches between them
advance together, one numpy step for a row of each.

Block layout, little endian: magic, n ids, lanes, rows between checkpoints, n checkpoints, n words,
crc32 of these fields and the checkpoints; the checkpoints (states as uint64, word position as
uint64, crc32 of the words and of the ids up to the next one); the words as uint32, in the order in
which the decoder reads them. Each stretch is held against checksums of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS2"
HEADER = struct.Struct("<4sIIIII")
_CRC = struct.Struct("<I")
_MARK = struct.Struct("<QII")
SCALE = 24
LOW = 1 << 31
BLOCK = 1 << 18
LANES = 1 << 10
CHECKPOINT = 64


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies with a sum of 2**SCALE and at least 1 for every id, those unseen included: any id can be encoded."""
    counts = counts.astype(np.float64)
    free = (1 << SCALE) - len(counts)
    out = 1 + np.floor(counts * (free / max(counts.sum(), 1))).astype(np.int64)
    out[int(np.argmax(counts))] += (1 << SCALE) - int(out.sum())
    return out.astype(np.uint64)


class Table:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each of the 2**SCALE slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.f), dtype=np.uint16 if len(self.f) <= 1 << 16 else np.uint32), self.f.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        rows = -(-n // lanes)
        padded = np.zeros(rows * lanes, np.int64)
        padded[:n] = ids
        f, start = self.f[padded].reshape(rows, lanes), self.start[padded].reshape(rows, lanes)
        limit = f << np.uint64(63 - SCALE)
        state = np.full(lanes, LOW, np.uint64)
        words, marks, written = [], [], 0
        for row in range(rows - 1, -1, -1):
            k = lanes if row < rows - 1 else n - row * lanes
            x, fr = state[:k], f[row, :k]
            over = x >= limit[row, :k]
            if over.any():
                out = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                words.append(out[::-1])
                written += len(out)
                x = np.where(over, x >> np.uint64(32), x)
            q = x // fr
            state[:k] = (q << np.uint64(SCALE)) + (x - q * fr) + start[row, :k]
            if row % every == 0:
                marks.append((state.copy(), written))
        stream = (np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)).astype("<u4")
        marks.reverse()
        edges = [written - w for _, w in marks] + [written]
        size = every * lanes
        table = b"".join(
            s.astype("<u8").tobytes() + _MARK.pack(a, zlib.crc32(stream[a:z].tobytes()), crc32(ids[k * size : (k + 1) * size]))
            for k, ((s, _), a, z) in enumerate(zip(marks, edges[:-1], edges[1:], strict=True))
        )
        head = HEADER.pack(MAGIC, n, lanes, every, len(marks), written)
        return head + _CRC.pack(zlib.crc32(table, zlib.crc32(head))) + table + stream.tobytes()

    def decode(self, block: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from checkpoint `begin` to before checkpoint `end`, the whole block by default; other stretches are neither read nor checked."""
        if len(block) < HEADER.size + _CRC.size:
            raise ValueError("damaged block")
        magic, n, lanes, every, marks, n_words = HEADER.unpack_from(block)
        size, first = 8 * lanes + _MARK.size, HEADER.size + _CRC.size
        view = memoryview(block)
        if magic != MAGIC or len(block) != first + marks * size + 4 * n_words or zlib.crc32(view[first : first + marks * size], zlib.crc32(view[: HEADER.size])) != _CRC.unpack_from(block, HEADER.size)[0]:
            raise ValueError("damaged block")
        end = marks if end is None else min(end, marks)
        if begin >= end:
            return np.zeros(0, np.uint32)
        states = np.stack([np.frombuffer(block, "<u8", lanes, first + k * size) for k in range(begin, end)]).astype(np.uint64)
        noted = [_MARK.unpack_from(block, first + k * size + 8 * lanes) for k in range(begin, min(end + 1, marks))]
        edges = [x[0] for x in noted] + [n_words] * (end == marks)
        words = np.frombuffer(block, "<u4", edges[-1] - edges[0], first + marks * size + 4 * edges[0])
        for (_, crc, _), a, z in zip(noted, edges[:-1], edges[1:]):
            if zlib.crc32(words[a - edges[0] : z - edges[0]]) != crc:
                raise ValueError("damaged block")
        at = np.array(edges[:-1], np.int64) - edges[0]
        words = words.astype(np.uint64)
        # Only the last stretch of a block may be short; it goes by itself then.
        whole = end - begin - (end == marks and n < marks * every * lanes)
        parts = [self._stretches(states[:whole], at[:whole], words, every, lanes)] if whole else []
        if whole < end - begin:
            rest = n - (end - 1) * every * lanes
            if rows := rest // lanes:
                parts.append(self._stretches(states[whole:], at[whole:], words, rows, lanes))
            if rest % lanes:
                parts.append(self._stretches(states[whole:], at[whole:], words, 1, rest % lanes))
        ids = np.concatenate(parts)
        for k, (_, _, crc) in enumerate(noted[: end - begin]):
            if crc32(ids[k * every * lanes : (k + 1) * every * lanes]) != crc:
                raise ValueError("the ids do not match their checksum")
        return ids

    def _stretches(self, states: np.ndarray, at: np.ndarray, words: np.ndarray, rows: int, lanes: int) -> np.ndarray:
        """The ids of so many rows of the first `lanes` lanes of each stretch; moves states and at on."""
        out = np.empty((len(at), rows, lanes), np.uint32)
        slots, mask = self.slots, np.uint64((1 << SCALE) - 1)
        for row in range(rows):
            x = states[:, :lanes]
            slot = x & mask
            ids = slots[slot]
            out[:, row] = ids
            x = self.f[ids] * (x >> np.uint64(SCALE)) + slot - self.start[ids]
            if (under := x < np.uint64(LOW)).any():
                each = under.sum(axis=1)
                place = np.arange(each.sum()) + np.repeat(at - (np.cumsum(each) - each), each)
                x[under] = (x[under] << np.uint64(32)) | words[place]
                at += each
            states[:, :lanes] = x
        return out.reshape(-1)


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def sizes(block: bytes) -> tuple[int, int]:
    """How many ids a block has, and how many there are between its checkpoints."""
    _, n, lanes, every, _, _ = HEADER.unpack_from(block)
    return n, lanes * every
