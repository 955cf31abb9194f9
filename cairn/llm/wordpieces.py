"""Pre-tokens of the word-end BPE vocabulary, and their encodings with the tokenizers library.

The vocabulary normalises (NFC, white space, lower case), splits by a pattern and merges each
pre-token by itself. So an encoding is that of its pre-tokens in turn, and equal pre-tokens share
one answer of the library. Pre-tokens are cut from whole batches of UTF-8 bytes in numpy and looked
up by a 64-bit hash, and every hit is held against the bytes of the string found. Texts with
characters outside the fixed set below, and those with a string whose hash another one holds, go to
the library whole.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast

from .common import block, eights, word_hashes

# Fixed values. The cut below equals the vocabulary's pattern on texts of these characters only:
# ASCII but for controls; the Latin letters of U+00C0 to U+00FF with their two signs; the marks
# U+00A1, U+00AB, U+00BB, U+00BF; the punctuation U+2010 to U+2027. All are stable under NFC.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
END = "</w>"
_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = range(5)
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _OTHER  # follow-on bytes; they take their first byte's class
_CLASS[0xC3] = _LETTER
_CLASS[[0xC2, 0xE2]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE, _TWO = np.zeros(256, bool), np.zeros((256, 256), bool)
_ONE[list(b"stmd")] = True
for _a, _b in (b"re", b"ve", b"ll"):
    _TWO[_a, _b] = True

#: Pre-tokens that a worker holds beside the vocabulary's; beyond it they are forgotten and asked for again.
HELD = 1 << 19
_LOADED: dict[int, Pieces] = {}


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes; start and end of each pre-token; how many each text has; which texts this cut holds for. Text k is raw[at[k]:at[k + 1]]."""
    n, texts = len(raw), len(at) - 1
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts, np.int64), np.ones(texts, bool)
    kind = np.zeros(n + 1, np.uint8)
    np.take(_CLASS, raw, out=kind[:n])
    low = np.zeros(n + 3, np.uint8)
    np.take(_LOWER, raw, out=low[:n])
    after = np.zeros(n + 2, np.uint8)
    after[:n] = raw
    bad = [np.flatnonzero(kind[:n] == _BAD)]
    if (raw >= 0x80).any():
        lead = np.flatnonzero(raw == 0xC3)
        second = after[lead + 1]
        sign = (second == 0x97) | (second == 0xB7)
        kind[lead[sign]] = _OTHER
        upper = lead[(second >= 0x80) & (second <= 0x9E) & ~sign]
        low[upper + 1] += 32
        lead = np.flatnonzero(raw == 0xC2)
        bad.append(lead[~np.isin(after[lead + 1], (0xA1, 0xAB, 0xBB, 0xBF))])
        lead = np.flatnonzero(raw == 0xE2)
        bad.append(lead[(after[lead + 1] != 0x80) | (after[lead + 2] < 0x90) | (after[lead + 2] > 0xA7)])
        more = np.flatnonzero((raw & 0xC0) == 0x80)
        for _ in range(2):
            kind[more] = kind[more - 1]
    first = np.ones(n, bool)
    np.not_equal(kind[1:n], kind[: n - 1], out=first[1:])
    first |= kind[:n] == _DIGIT
    edges = at[:-1][at[:-1] < n]
    first[edges] = True
    edge = first.copy()
    first &= kind[:n] != _SPACE
    # A contraction is an apostrophe that begins a pre-token and the letters after it.
    mark = np.flatnonzero((raw == 39) & first)
    if len(mark):
        text_end = at[np.searchsorted(at, mark, "right")]
        size = np.where(_TWO[low[mark + 1], low[mark + 2]] & (mark + 3 <= text_end), 2, 0)
        size = np.where(_ONE[low[mark + 1]] & (mark + 2 <= text_end), 1, size)
        mark, size = mark[size > 0], size[size > 0]
        first[mark + 1] = edge[mark + 1] = False
        rest = mark + 1 + size
        rest = rest[rest < n]
        edge[rest] = True
        first[rest] |= kind[rest] != _SPACE
    bounds = np.append(np.flatnonzero(edge), n)
    opens = first[bounds[:-1]]
    starts, ends = bounds[:-1][opens], bounds[1:][opens]
    holds = np.ones(texts, bool)
    for where in bad:
        holds[np.searchsorted(at, where, "right") - 1] = False
    if (where := np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))).size:
        for k in set((np.searchsorted(at, where, "right") - 1).tolist()):
            text = raw[at[k] : at[k + 1]].tobytes()
            holds[k] &= not any(x in text for x in SPECIAL)
    return low[:n], starts, ends, np.diff(np.searchsorted(starts, at)), holds


class Pieces:
    """A hash table in numpy from pre-tokens to their ids, that asks the library for those it lacks, all of a batch in one call.

    whole: the vocabulary strings proved to encode alone as one token; they are in the table from the start.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        known = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(known.values()) + 1, bool)
        self.ends[[i for x, i in known.items() if x.endswith(END)]] = True
        self.whole = self.whole_tokens()
        #: Ids are held as narrow as the vocabulary lets them be.
        self.kind = id_kind(len(self.ends))
        self.forget()

    def whole_tokens(self) -> dict[str, int]:
        """Each vocabulary string that is one pre-token and that the library encodes alone as one token, with that token: the proof is the library's own answer."""
        from tokenizers.decoders import ByteLevel

        spelt = ByteLevel()
        order = sorted({spelt.decode([x.removesuffix(END)]) for x in self.library.get_vocab(with_added_tokens=False)})
        raw = [x.encode() for x in order]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        low, starts, ends, counts, holds = cut(joined, at)
        good = holds & (counts == 1)
        at_one = np.cumsum(counts) - counts
        same = [bool(g) and starts[k] == a and ends[k] == z and (low[a:z] == joined[a:z]).all() for g, k, a, z in zip(good, np.minimum(at_one, len(starts) - 1), at[:-1], at[1:], strict=True)]
        order = [x for x, ok in zip(order, same, strict=True) if ok]
        return {x: e.ids[0] for x, e in zip(order, self.library.encode_batch(order, add_special_tokens=False), strict=True) if len(e.ids) == 1}

    def forget(self) -> None:
        size = 4 * HELD
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.n = 0
        self.starts, self.sizes = np.zeros(2 * HELD, np.int32), np.zeros(2 * HELD, np.int32)
        self.flat, self.used = np.zeros(8 * HELD, self.kind), 0
        #: The strings themselves, end to end, and where each one is.
        self.text, self.text_used = np.zeros(8 * HELD, np.uint8), 0
        self.text_at, self.text_size = np.zeros(2 * HELD, np.int64), np.zeros(2 * HELD, np.int64)
        texts = [x.encode() for x in self.whole]
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        hashes, one = np.unique(_hashes(raw, at[:-1], at[1:]), return_index=True)
        self.n_whole = len(one)
        self.insert(hashes, np.array(list(self.whole.values()))[one], np.ones(len(one), np.int64), raw, at[:-1][one], at[1:][one])

    def insert(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Distinct hashes that the table lacks, the ids of each, and its string raw[begin:end]."""
        m, k, size = len(hashes), len(ids), end - begin
        while self.n + m > len(self.starts):
            self.starts, self.sizes, self.text_at, self.text_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.text_at, self.text_size))
        while self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.text_used + size.sum() + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        places = np.arange(self.n, self.n + m, dtype=np.int32)
        edge = np.cumsum(size) - size
        self.text[self.text_used : self.text_used + size.sum()] = raw[np.repeat(begin - edge, size) + np.arange(size.sum())]
        self.text_at[places], self.text_size[places] = self.text_used + edge, size
        self.text_used += int(size.sum())
        self.flat[self.used : self.used + k] = ids
        self.sizes[places] = sizes
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + m, self.used + k
        slot, left = hashes & self.mask, np.arange(m)
        while len(left):
            free = self.keys[slot[left]] == 0
            _, winner = np.unique(slot[left[free]], return_index=True)
            won = left[free][winner]
            self.keys[slot[won]], self.values[slot[won]] = hashes[won], places[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place, or -1."""
        slot = hashes & self.mask
        held = self.keys[slot]
        out = np.where(held == hashes, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def same(self, place: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each string is, byte for byte, the one held at its place."""
        size, held = ends - starts, np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        eight, at = eights(low), self.text_at[place]
        out = (self.text_size[place] == size) & (block(eight, starts, size) == block(held, at, size))
        left, done = np.flatnonzero(out & (size > 8)), 8
        while len(left):
            rest = size[left] - done
            equal = block(eight, starts[left] + done, rest) == block(held, at[left] + done, rest)
            out[left[~equal]] = False
            left = left[equal & (rest > 8)]
            done += 8
        return out

    def learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Ask for distinct new pre-tokens, parted by spaces: each one's ids end with the one vocabulary string that ends a word."""
        raw = low.tobytes()
        texts = [raw[a:z].decode() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = np.array(self.ids(" ".join(texts)), np.int64)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(texts):
            raise AssertionError("a pre-token without exactly one word end")
        self.insert(hashes, ids, np.diff(last, prepend=-1), low, starts, ends)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def places(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each pre-token, learnt where it is new."""
        hashes = _hashes(low, starts, ends)
        out = self.find(hashes)
        lack = np.flatnonzero(out < 0)
        if len(lack):
            if self.n > HELD:
                self.forget()
                return self.places(low, starts, ends)
            new, one = np.unique(hashes[lack], return_index=True)
            self.learn(low, starts[lack[one]], ends[lack[one]], new)
            out[lack] = self.find(hashes[lack])
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids in one array, how many each text has, and how many of its pre-tokens the shortcut took."""
        low, starts, ends, counts, holds = cut(raw, at)

        def left(*each):
            keep = np.repeat(holds, counts)
            return *(x[keep] for x in each), np.where(holds, counts, 0)

        if not holds.all():
            starts, ends, counts = left(starts, ends)
        place = self.places(low, starts, ends)
        if len(other := np.flatnonzero(~self.same(place, low, starts, ends))):
            holds[np.searchsorted(np.cumsum(counts), other, "right")] = False
            place, counts = left(place)
        sizes = self.sizes[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        n = np.diff(total[edges])
        ids = self.flat[np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])]
        whole = np.diff(np.concatenate([[0], np.cumsum(place < self.n_whole)])[edges])
        if not holds.all():
            own = np.split(ids, np.cumsum(n)[:-1])
            for k in np.flatnonzero(~holds):
                own[k] = np.array(self.ids(raw[at[k] : at[k + 1]].tobytes().decode()), self.kind)
                n[k] = len(own[k])
            ids = np.concatenate(own)
        return ids, n, whole


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of strings; 0 marks a free slot and is nobody's."""
    return np.maximum(word_hashes(raw, starts, ends, lower=False), np.uint64(1))


def id_kind(size: int) -> type:
    """The narrowest type for ids below `size`."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def vocabulary_size(vocabulary: str, *more: int) -> int:
    """One more than the largest id of a vocabulary, and of those given besides."""
    from tokenizers import Tokenizer

    return 1 + max([*Tokenizer.from_str(vocabulary).get_vocab(with_added_tokens=True).values(), *more])


def pieces(vocabulary: Broadcast) -> Pieces:
    """This worker's table for a vocabulary; made once and kept while the worker lives."""
    key = hash(vocabulary.value)
    if key not in _LOADED:
        _LOADED[key] = Pieces(vocabulary.value)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
