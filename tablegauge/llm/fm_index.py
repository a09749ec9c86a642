"""A compressed full-text index over word ids: a BWT in a wavelet matrix, and bit vectors.

Built for one bounded shard of short segments, each followed by a separator that no
pattern holds. Rows are ordered by their first ``window`` symbols only, which is all that
backward search for patterns of up to that length looks at. What stays after building is
the wavelet matrix, two bit vectors that mark where the first ``window - 1`` and ``window``
symbols change, and one sampled position, the earliest, for each window that occurs.
"""

from __future__ import annotations

import numpy as np

#: Most symbols of a shard, separators included: three ranks fit one 63-bit sort key.
MOST = (1 << 20) - 1


class BitRank:
    """A bit vector with constant-time rank, 64 bits a word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, BitRank]] = []
        seq = symbols
        for b in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            self.levels.append((b, BitRank(bit)))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self._descend(np.arange(alphabet, dtype=np.int32), np.zeros(alphabet, np.int32))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, level in self.levels:
            ones = level.ones(i)
            i = np.where(c >> b & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol ``c`` before position ``i``, for each pair."""
        return self._descend(c, i) - self.base[c]


def _joined(rank: np.ndarray, a: int, b: int, bits: int) -> np.ndarray:
    """Sort keys of the ranks at each position, ``a`` and ``b`` further on; there is nothing but rank 0 after the end."""
    key = rank.astype(np.int64) << 2 * bits
    key[: len(rank) - a] |= rank[a:].astype(np.int64) << bits
    key[: len(rank) - b] |= rank[b:]
    return key


def _changes(key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=out[1:])
    return out


class FMIndex:
    """Backward search over a shard of segments.

    ``words`` are ids from 1 on, segment after segment; ``sizes`` the words of each, one
    at least. ``window`` (3 or more) is the match length at which statistics are capped.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int):
        if window < 3:
            raise ValueError("a window has three words at least")
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1])
        if n > MOST:
            raise ValueError("a shard is too large")
        self.window = window
        self.first = ends - sizes - 1  # where each segment begins in the text
        self.sizes = sizes
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        self.text = np.zeros(n, np.int32)
        self.text[inside] = words
        bits, length, rank = n.bit_length(), 1, self.text
        while 3 * length < window:  # ranks of the symbols at hand, then of three times as many
            key = _joined(rank, length, 2 * length, bits)
            order = np.argsort(key)
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(_changes(key[order])) - 1
            length *= 3
        # three runs of that length, overlapping, make up a window, and one word less
        key = _joined(rank, min(length, window - length), window - length, bits)
        order = np.argsort(key)
        new = _changes(key[order])
        shorter = _joined(rank, min(length, window - 1 - length), window - 1 - length, bits)[order]
        less = _changes(shorter)
        del key, shorter, rank
        order = order.astype(np.int32)
        self.starts = np.flatnonzero(new).astype(np.int32)
        self.occurrences = np.diff(self.starts, append=np.int32(n))
        self.earliest = np.minimum.reduceat(order, self.starts)
        self.windows, self.prefixes = BitRank(new), BitRank(less)
        self.prefix_starts = np.flatnonzero(less).astype(np.int32)
        alphabet = int(self.text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=alphabet))[:-1]]).astype(np.int32)
        self.wavelet = WaveletMatrix(self.text[order - 1], alphabet)  # before the first symbol stands the last separator

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of all windows inside segments, and the number of each one's interval.

        Intervals are ``starts[k] .. starts[k] + occurrences[k]``. Every segment is streamed
        from its end, all in step: each symbol extends the match to the left by one rank
        query, and a match of the window's length is first cut back by its last symbol, to
        the interval of the rest. A segment of the shard occurs at least as itself, so no
        interval is empty and its lower end is enough to follow.
        """
        w = self.window
        position, found = [], []
        row = np.zeros(len(self.sizes), np.int32)
        longest_first = np.argsort(-self.sizes, kind="stable")
        sizes, last = self.sizes[longest_first], (self.first + self.sizes)[longest_first] - 1
        for t in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -t, "left"))  # segments of more than t words
            p, low = last[:active] - t, row[:active]
            c = self.text[p]
            if t >= w:
                low = self.prefix_starts[self.prefixes.ones(low + 1) - 1]
            low = self.less[c] + self.wavelet.rank(c, low)
            if t + 1 >= w:
                position.append(p)
                found.append(self.windows.ones(low + 1) - 1)
            row[:active] = low
        if not position:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(position), np.concatenate(found)
