"""A wavelet matrix of token ids: bit-planes with rank directories."""

from __future__ import annotations

import numpy as np

WORDS = 8  # words of 64 bits between two entries of a rank directory


class WaveletMatrix:
    """Plane p (from the highest bit) holds that bit of every id, in the order left by the planes
    before: ids with a 0 first, then those with a 1, both in their order."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # words of 64 bits
        self.ranks = []
        for words in planes:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)])[::WORDS].copy())
        self.zeros = [n - int(np.bitwise_count(words).sum()) for words in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()).bit_length() if len(ids) else 0
        x = ids.astype(np.uint16 if top <= 16 else np.uint32)
        planes = []
        for p in range(top - 1, -1, -1):
            bit = (x & x.dtype.type(1 << p)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            room = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
            room[: len(packed)] = packed
            planes.append(room.view("<u8"))
            x = np.concatenate([np.compress(~bit, x), np.compress(bit, x)])
        return cls(len(ids), planes)

    @classmethod
    def loads(cls, n: int, planes: list[bytes]) -> WaveletMatrix:
        return cls(n, [np.frombuffer(p, "<u8") for p in planes])

    def dumps(self) -> list[bytes]:
        return [p.tobytes() for p in self.planes]

    def _ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        words, directory = self.planes[plane], self.ranks[plane]
        word = i >> 6
        out = directory[np.minimum(word // WORDS, len(directory) - 1)].copy()
        base = np.minimum(word // WORDS, len(directory) - 1) * WORDS
        for k in range(WORDS):
            full = base + k < word
            out[full] += np.bitwise_count(words[np.minimum(base + k, len(words) - 1)])[full]
        rest = i & 63
        part = words[np.minimum(word, len(words) - 1)] & (
            (np.uint64(1) << rest.astype(np.uint64)) - np.uint64(1)
        )
        return out + np.where(rest > 0, np.bitwise_count(part), 0)

    def access(self, positions) -> np.ndarray:
        i = np.asarray(positions, np.int64)
        out = np.zeros(len(i), np.uint32)
        for plane, words in enumerate(self.planes):
            bit = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0
            ones = self._ones(plane, i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit, self.zeros[plane] + ones, i - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before ``end`` stand after the last plane."""
        low, high = 0, end
        for plane in range(len(self.planes)):
            a, b = self._ones(plane, np.array([low, high]))
            if token >> (len(self.planes) - 1 - plane) & 1:
                low, high = self.zeros[plane] + int(a), self.zeros[plane] + int(b)
            else:
                low, high = low - int(a), high - int(b)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences among the first ``end`` ids."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, found by select from the last plane up."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        low, high = self._range(token, self.n)
        at = np.arange(low, high)
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th bits of one kind, by bisection over ranks."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        for _ in range(max(1, self.n.bit_length())):
            middle = (low + high) // 2
            ones = self._ones(plane, middle + 1)
            enough = (ones if bit else middle + 1 - ones) > k
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low

    def decode(self) -> np.ndarray:
        """All ids: the partitions undone from the last plane up."""
        top = len(self.planes)
        kind = np.uint16 if top <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for p, words in enumerate(reversed(self.planes)):
            bit = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little") > 0
            zeros = self.zeros[top - 1 - p]
            y = np.empty(self.n, kind)
            if zeros:
                np.place(y, ~bit, x[:zeros])
            if zeros < self.n:
                np.place(y, bit, x[zeros:] | kind(1 << p))
            x = y
        return x
