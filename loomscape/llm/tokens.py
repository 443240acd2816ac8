"""Token ids of whole Arrow string columns by a file of the tokenizers library.

Texts are cut where the tokenizer's own splitting is certain to cut (between letters,
digits, punctuation and single spaces of the common ranges); each distinct piece is
given to the library once and its ids are kept, so that ids are those of the whole
text. Where a cut isn't certain, the piece simply stays longer. A text that spells a
special token goes to the library as a whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from loomscape.llm.words import _BYTE, _LOWER, BLOCK, U, _powers, mix, text_blocks, text_buffers

_L, _D, _P, _S, _N, _X = 1, 2, 3, 4, 5, 6
_KIND = np.full(256, _X, dtype=np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _L
_KIND[list(range(0x30, 0x3A))] = _D
_KIND[[c for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)) if c != 0x27]] = _P
_KIND[0x20], _KIND[0x0A] = _S, _N
_LATIN = np.zeros(256, dtype=bool)  # second bytes of Latin-1 letters; 0x97 and 0xB7 are signs
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Table:
    """An open-addressing map from 64-bit keys to rows, for whole arrays at once."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, U((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & self.mask).astype(np.int64)
        rows = self.rows[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (rows >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.mask)
            s = slot[wrong]
            rows[wrong] = self.rows[s]
            wrong = wrong[(self.keys[s] != keys[wrong]) & (self.rows[s] >= 0)]
        return rows

    def add(self, keys: np.ndarray, first_row: int) -> None:
        """Distinct keys that aren't there yet get the rows from first_row on. No more than
        half of the slots are ever taken."""
        if 2 * (self.count + len(keys)) > len(self.rows):
            raise ValueError("more keys than the table is meant for")
        rows = np.arange(first_row, first_row + len(keys), dtype=np.int32)
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = np.flatnonzero(self.rows[s] < 0)
            _, once = np.unique(s[free], return_index=True)
            put = left[free[once]]
            self.keys[slot[put]] = keys[put]
            self.rows[slot[put]] = rows[put]
            done = np.zeros(len(left), dtype=bool)
            done[free[once]] = True
            left = left[~done]
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.count += len(keys)


@dataclass
class TokenBlock:
    """Texts first..first+len(at)-2 of a column. Ids of text i: at[i] up to at[i+1]."""

    first: int
    at: np.ndarray
    ids: np.ndarray  # uint16


class Encoder:
    """One per worker process and file; keeps the ids of the pieces that it has met,
    at most about two million (some 80 MB), then begins anew."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str, bits: int = 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.word_ends = self.tokenizer.encode("a b", add_special_tokens=False).ids == [
            *self.tokenizer.encode("a", add_special_tokens=False).ids,
            *self.tokenizer.encode("b", add_special_tokens=False).ids,
        ]  # white space is dropped and letters are lowered
        self.value = _BYTE[_LOWER] if self.word_ends else _BYTE
        self.letters = str.maketrans(_byte_alphabet())
        self.known = _Table(bits)
        self.most = 1 << (bits - 1)
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.flat = np.zeros(1 << 16, dtype=np.uint16)
        self.at = np.zeros(1 << 16, dtype=np.int64)  # of pieces in flat
        self.used = 0

    def spelled(self, piece: bytes) -> str:
        """piece in the byte-level alphabet."""
        if piece.isascii():
            return "\u0120" + piece[1:].decode("ascii") if piece[:1] == b" " else piece.decode("ascii")
        return piece.decode("latin1").translate(self.letters)

    def _cuts(self, raw: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of pieces."""
        n = len(raw)
        kind = np.zeros(n + 4, dtype=np.uint8)  # two before and after
        own = kind[2 : n + 2]
        own[:] = _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        own[lead] = own[lead + 1] = _L
        solid = (kind >= _L) & (kind <= _P)
        here, last, following = solid[2 : n + 2], solid[1 : n + 1], solid[3 : n + 3]
        cut = here & last & (own != kind[1 : n + 1])
        blank = (own == _S) | (own == _N)
        if self.word_ends:
            cut |= here & (own == _D)  # each digit is a piece
            before = kind[1 : n + 1]
            cut |= ~blank & ((before == _S) | (before == _N))
            begin = np.zeros(n + 1, dtype=bool)
            begin[:n] = cut | blank
            begin[text_at] = True
            at = np.flatnonzero(begin)
            starts, ends = at[:-1], at[1:]
            keep = ~blank[starts]
            return starts[keep], ends[keep]
        cut |= blank & last & following
        cut |= here & (kind[1 : n + 1] == _N) & solid[:n]
        begin = np.zeros(n + 1, dtype=bool)
        begin[:n] = cut
        begin[text_at] = True
        at = np.flatnonzero(begin)
        return at[:-1], at[1:]

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Asks the library for the ids of new pieces (distinct keys)."""
        data = raw.tobytes().lower() if self.word_ends else raw.tobytes()
        tokenize, spelled = self.tokenizer.model.tokenize, self.spelled
        is_letter = (_KIND[raw] == _L) | ((raw >= 0x80) & (not self.word_ends))
        letters = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(is_letter, out=letters[1:])
        size = ends - starts
        pure = (letters[ends] - letters[starts] + (raw[starts] == 0x20) == size) & (size < 200)
        if not self.word_ends:  # other letters than Latin ones make a piece odd
            sure = np.zeros(len(raw) + 1, dtype=np.int64)
            lead = np.flatnonzero(raw[:-1] == 0xC3)
            lead = lead[_LATIN[raw[lead + 1]]] + 1
            sure[lead] += 2
            high = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum(raw >= 0x80, out=high[1:])
            sure = np.concatenate([[0], np.cumsum(sure[:-1])])
            pure &= high[ends] - high[starts] == sure[ends] - sure[starts]
        got: list[list[int]] = []
        odd: list[int] = []
        for k, (s, e, one) in enumerate(zip(starts.tolist(), ends.tolist(), pure.tolist(), strict=True)):
            if one:  # one pre-token
                piece = data[s:e]
                got.append([t.id for t in tokenize(spelled(piece))])
            else:
                got.append([])
                odd.append(k)
        if odd:
            data = raw.tobytes()
            texts = [data[starts[k] : ends[k]].decode("utf-8", "replace") for k in odd]
            for k, x in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                got[k] = x.ids
        counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        new = np.fromiter((i for x in got for i in x), dtype=np.uint16, count=int(counts.sum()))
        row = self.known.count
        end = self.used + len(new)
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < row + len(keys) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : end] = new
        self.at[row + 1 : row + len(keys) + 1] = self.used + np.cumsum(counts)
        self.used = end
        self.known.add(keys, row)

    def _rows(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows of pieces, at most self.most of them, that are learnt where they are new."""
        rows = self.known.find(keys)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        once = np.unique(keys[missing], return_index=True)[1]
        if self.known.count + len(once) > self.most:
            self._reset()
            missing = np.arange(len(keys))
            once = np.unique(keys, return_index=True)[1]
        new = missing[once]
        self._learn(raw, keys[new], starts[new], ends[new])
        return self.known.find(keys)

    def _encoded(self, raw: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of concatenated texts, and where each text's begin."""
        starts, ends = self._cuts(raw, text_at)
        power, inverse = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * power[: len(raw)], out=total[1:])
        keys = mix((total[ends] - total[starts]) * inverse[starts])
        data = raw.tobytes()
        odd = [i for i in range(len(text_at) - 1) if any(x in data[text_at[i] : text_at[i + 1]] for x in self.special)] if any(x in data for x in self.special) else []
        if odd:
            inside = np.isin(np.searchsorted(text_at, starts, side="right") - 1, odd)
            own = [hashlib.blake2b(data[text_at[i] : text_at[i + 1]], digest_size=8).digest() for i in odd]
            starts, ends = np.append(starts[~inside], text_at[odd]), np.append(ends[~inside], text_at[np.array(odd) + 1])
            keys = np.append(keys[~inside], np.frombuffer(b"".join(own), dtype=np.uint64))
            order = np.argsort(starts, kind="stable")
            starts, ends, keys = starts[order], ends[order], keys[order]
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for lo in range(0, len(keys), self.most):  # so that the table holds every slice
            part = slice(lo, lo + self.most)
            rows = self._rows(raw, keys[part], starts[part], ends[part])
            begin = self.at[rows]
            counts.append(self.at[rows + 1] - begin)
            upto = np.cumsum(counts[-1])
            ids.append(self.flat[np.repeat(begin - upto + counts[-1], counts[-1]) + np.arange(int(upto[-1]))])
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return upto[np.searchsorted(starts, text_at)], np.concatenate(ids)

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one long text, some BLOCK bytes at a time up to a certain cut."""
        out, at, step = [], 0, BLOCK
        while at < len(raw):
            part = raw[at : at + step]
            if len(part) == step:
                starts = self._cuts(part, np.array([0, step]))[0]
                starts = starts[starts < step - 8]  # what follows is known there
                if not len(starts) or not starts[-1]:
                    step *= 2
                    continue
                part = part[: starts[-1]]
            out.append(self._encoded(part, np.array([0, len(part)]))[1])
            at, step = at + len(part), BLOCK
        return np.concatenate(out)

    def blocks(self, column: pa.Array) -> Iterator[TokenBlock]:
        """The ids of every text, by blocks of texts; a null is an empty text. A text of
        any length gives all its ids; pieces are learnt and held a bounded number at once."""
        data, at = text_buffers(column)
        for i, j in text_blocks(at):
            raw = data[at[i] : at[j]]
            if len(raw) > 2 * BLOCK and j == i + 1 and not any(x in raw.tobytes() for x in self.special):
                ids = self._long(raw)
                yield TokenBlock(i, np.array([0, len(ids)]), ids)
            elif len(raw):
                yield TokenBlock(i, *self._encoded(raw, at[i : j + 1] - at[i]))
            else:
                yield TokenBlock(i, np.zeros(j - i + 1, np.int64), np.zeros(0, np.uint16))
