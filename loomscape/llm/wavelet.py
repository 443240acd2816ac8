"""A wavelet matrix over 16-bit ids in one compressed byte string.

The ids of a shard are renumbered densely in ascending order. Plane k holds bit k (from
the highest) of every number in the order that the planes above leave: zeros first, then
ones, each in their former order. Each plane carries the count of ones before every
512th bit, so that rank, select, access, counts and occurrences read few bytes of it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

MAGIC = b"LWM1"
_STEP = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _bits(packed: np.ndarray, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)])


def _halves(values: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, int]:
    """values with those at zeros first; the count of zeros."""
    ones = _bits(packed, len(values))
    array = pa.array(values)
    low = pc.filter(array, pc.invert(ones)).to_numpy()
    return np.concatenate([low, pc.filter(array, ones).to_numpy()]), len(low)


def encode(ids: np.ndarray, level: int = 1) -> bytes:
    """ids (uint16, any number of them) as one compressed wavelet matrix."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16)
    n = len(ids)
    alphabet = np.flatnonzero(np.bincount(ids, minlength=1 << 16)).astype(np.uint16) if n else np.zeros(0, np.uint16)
    rank = np.zeros(1 << 16, dtype=np.uint16)
    rank[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
    now = rank[ids]
    depth = max(0, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(alphabet.astype("<u2").tobytes())]
    for k in range(depth - 1, -1, -1):
        packed = np.packbits((now & np.uint16(1 << k)) != 0, bitorder="little")
        full = np.zeros(-(-len(packed) // 64) * 64, dtype=np.uint8)
        full[: len(packed)] = packed
        before = np.cumsum(_ONES[full].reshape(-1, 64).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), before])
        now, zeros = _halves(now, packed)
        parts.append(press.compress(struct.pack("<Q", zeros) + directory.astype("<u4").tobytes() + packed.tobytes()))
    head = MAGIC + struct.pack("<QII", n, len(alphabet), depth)
    return head + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


class WaveletMatrix:
    """Reads what encode() wrote. Planes are unpacked when they are first asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, m, self.depth = struct.unpack_from("<QII", data, 4)
        sizes = struct.unpack_from(f"<{self.depth + 1}I", data, 20)
        at = 20 + 4 * (self.depth + 1)
        self._parts: list[bytes] = []
        for s in sizes:
            self._parts.append(data[at : at + s])
            at += s
        self._open = zstandard.ZstdDecompressor()
        self.alphabet = np.frombuffer(self._open.decompress(self._parts[0]) if m else b"", dtype="<u2")
        self._planes: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return self.n

    def plane(self, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Of level k, 0 being the highest bit: the count of zeros, the directory, the bits."""
        if k not in self._planes:
            raw = self._open.decompress(self._parts[k + 1])
            steps = -(-(-(-self.n // 8)) // 64) + 1
            self._planes[k] = (struct.unpack_from("<Q", raw)[0], np.frombuffer(raw, "<u4", steps, 8), np.frombuffer(raw, np.uint8, -1, 8 + 4 * steps))
        return self._planes[k]

    def _ones_before(self, k: int, i: int) -> int:
        _, directory, packed = self.plane(k)
        step = i // _STEP
        whole = int(_ONES[packed[step * 64 : i // 8]].sum())
        rest = bin(int(packed[i // 8]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0
        return int(directory[step]) + whole + rest

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.depth):
            zeros, _, packed = self.plane(k)
            bit = packed[i // 8] >> (i % 8) & 1
            ones = self._ones_before(k, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | int(bit)
        return int(self.alphabet[value])

    def _node(self, token: int, i: int) -> tuple[int, int] | None:
        """Where token's entries of positions below i stand on the lowest level."""
        number = int(np.searchsorted(self.alphabet, token))
        if number >= len(self.alphabet) or self.alphabet[number] != token:
            return None
        low, high = 0, min(max(i, 0), self.n)
        for k in range(self.depth):
            zeros = self.plane(k)[0]
            a, b = self._ones_before(k, low), self._ones_before(k, high)
            if number >> (self.depth - 1 - k) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often token stands before position i."""
        node = self._node(token, i)
        return node[1] - node[0] if node else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The position of token's occurrence j, from 0; -1 if there are fewer."""
        node = self._node(token, self.n)
        if not node or not 0 <= j < node[1] - node[0]:
            return -1
        number, at = int(np.searchsorted(self.alphabet, token)), node[0] + j
        for k in range(self.depth - 1, -1, -1):
            one = number >> (self.depth - 1 - k) & 1
            at = self._find(k, at - self.plane(k)[0] if one else at, one)
        return at

    def _find(self, k: int, j: int, one: int) -> int:
        """The place of the one (or zero) number j of a plane."""
        _, directory, packed = self.plane(k)
        before = directory.astype(np.int64)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * _STEP - before
        step = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(packed[step * 64 : step * 64 + 64], bitorder="little")
        return step * _STEP + int(np.flatnonzero(bits == one)[j - int(before[step])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def to_numpy(self) -> np.ndarray:
        """All ids in order."""
        n = self.n
        if not n:
            return np.zeros(0, np.uint16)
        place = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
        for k in range(self.depth):
            place, _ = _halves(place, self.plane(k)[2])
        numbers = _grouped(self.depth)
        numbers = numbers[numbers < len(self.alphabet)]
        counts = self._counts(numbers)
        out = np.empty(n, dtype=np.uint16)
        out[place] = np.repeat(self.alphabet[numbers], counts)
        return out

    def _counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each number stands, from the bounds of its group on the lowest level."""
        low = np.zeros(len(numbers), dtype=np.int64)
        high = np.full(len(numbers), self.n, dtype=np.int64)
        for k in range(self.depth):
            zeros, directory, packed = self.plane(k)
            ones = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(_ONES[packed], out=ones[1:])
            tail = np.append(packed, np.uint8(0))

            def before(i, ones=ones, tail=tail):
                return ones[i >> 3] + _ONES[tail[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)]

            a, b = before(low), before(high)
            one = (numbers >> (self.depth - 1 - k) & 1).astype(bool)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def _grouped(depth: int) -> np.ndarray:
    """Numbers of depth bits as the lowest level orders them: by their bits from the last."""
    numbers = np.arange(1 << depth, dtype=np.int64)
    back = np.zeros_like(numbers)
    for k in range(depth):
        back |= (numbers >> k & 1) << (depth - 1 - k)
    return back
