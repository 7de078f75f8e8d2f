"""Elias-Fano coded monotone sequences and the n-gram trie built on them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of a byte.
_SELECT = np.array([[[p for p in range(8) if b >> p & 1][k] if k < bin(b).count("1") else 0 for k in range(8)] for b in range(256)], np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits in a row; two spare words at the end."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (shift + np.uint64(width)) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


@dataclass
class EliasFano:
    """A nondecreasing sequence: low bits packed, high bits as unary gaps, and a count of ones before each word."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values, n = values.astype(np.uint64), len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1 if n else 0) // 64 * 64 + 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        before = np.zeros(len(high) + 1, np.int64)
        np.cumsum(bits.reshape(-1, 64).sum(1), out=before[1:])
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> shift
        out |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set, or unset, bit of the high part."""
        k = np.maximum(k, 0)
        counts = self.before if ones else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(counts, k, side="right") - 1
        inside = word < len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        left = k - counts[word]
        value = self.high[word] if ones else ~self.high[word]
        at = np.zeros(len(k), np.int64)
        going = inside.copy()
        for byte in range(8):
            part = ((value >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            here = _ONES[part].astype(np.int64)
            hit = going & (left < here)
            at[hit] = 8 * byte + _SELECT[part[hit], left[hit]]
            left = left - np.where(going, here, 0)
            going &= ~hit
        return np.where(inside, word * 64 + at, len(self.high) * 64)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x (``n`` if there is none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        want = x & np.uint64((1 << self.width) - 1)
        # elements of a bucket lie between its unset bits
        zeros = len(self.high) * 64 - int(self.before[-1])
        start = np.where(bucket > 0, self._select(np.minimum(bucket - 1, zeros), False) - bucket + 1, 0)
        stop = self._select(np.minimum(bucket, zeros), False) - bucket
        start = np.where(bucket > zeros, self.n, np.minimum(start, self.n))
        stop = np.where(bucket >= zeros, self.n, np.minimum(stop, self.n))
        lo, hi = start.copy(), stop.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        equal = lo < stop
        at = np.flatnonzero(equal)
        equal[at] = self._low(lo[at]) == want[at]
        return lo, equal


#: Codes on a logarithmic grid, as fixed values: STEP codes a factor of ten; 0 stands for "none".
STEP = 1024


def grid_code(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in (0, 1]: the next grid value not above each, 10^-63 at least."""
    return (np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEP - 1e-9), 0, 64_000) + 1).astype(np.uint16)


def grid_value(code: np.ndarray) -> np.ndarray:
    """The probability of each code; 0 for code 0."""
    return np.where(code > 0, 10.0 ** ((1.0 - code) / STEP), 0.0)


class Trie:
    """Levels of n-grams, each in context order.

    A level's successors are numbers relative to their context. Prefixed by the parent they are one monotone sequence.
    ``pointers`` (monotone too) say where a parent's successors begin. Probabilities and back-off weights are grid codes.
    """

    def __init__(self, arrays: dict[str, np.ndarray], meta: list[dict]):
        self.arrays, self.meta, self.levels = arrays, meta, len(meta)
        self.next = [self._sequence(f"next{k}", level["next"]) for k, level in enumerate(meta)]
        self.pointers = [self._sequence(f"pointer{k}", level["pointer"]) for k, level in enumerate(meta)]

    def _sequence(self, name: str, meta: dict) -> EliasFano:
        return EliasFano(meta["n"], meta["width"], *(self.arrays[f"{name}.{p}"] for p in ("low", "high", "before")))

    @classmethod
    def build(cls, levels: list[dict]) -> "Trie":
        """``levels``: dicts of arrays ``parent``, ``successor`` (relative), both in order, ``alpha`` of each node and
        ``bow`` of each parent, as grid codes; and ``parents``, their number, and ``universe``, which successors are below."""
        arrays, meta = {}, []
        for k, level in enumerate(levels):
            sequences = {"next": level["parent"].astype(np.uint64) * np.uint64(level["universe"]) + level["successor"].astype(np.uint64), "pointer": np.searchsorted(level["parent"], np.arange(level["parents"] + 1))}
            about = {"universe": int(level["universe"])}
            for name, values in sequences.items():
                ef = EliasFano.build(values)
                about[name] = {"n": ef.n, "width": ef.width}
                arrays |= {f"{name}{k}.low": ef.low, f"{name}{k}.high": ef.high, f"{name}{k}.before": ef.before}
            arrays |= {f"{name}{k}.code": level[name].astype(np.uint16) for name in ("alpha", "bow")}
            meta.append(about)
        return cls.view(cls(arrays, meta).tobytes())

    def alpha(self, level: int, node: np.ndarray) -> np.ndarray:
        """Codes of nodes; of -1, any."""
        codes = self.arrays[f"alpha{level}.code"]
        return codes[node] if len(codes) else np.zeros(len(node), np.uint16)

    def bow(self, level: int, parent: np.ndarray) -> np.ndarray:
        return self.arrays[f"bow{level}.code"][parent]

    def find(self, level: int, parent: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Node of a (parent, relative successor) pair, or -1."""
        universe = self.meta[level]["universe"]
        out = np.full(len(parent), -1, np.int64)
        if self.next[level].n:
            ok = np.flatnonzero((parent >= 0) & (successor >= 0) & (successor < universe))
            at, equal = self.next[level].successor(parent[ok].astype(np.uint64) * np.uint64(universe) + successor[ok].astype(np.uint64))
            out[ok] = np.where(equal, at, -1)
        return out

    def first(self, level: int, parent: np.ndarray) -> np.ndarray:
        return self.pointers[level].get(parent).astype(np.int64)

    def tobytes(self) -> bytes:
        """A header with the layout, then the arrays, aligned, as they lie in memory."""
        layout, at = {}, 0
        for name, a in self.arrays.items():
            layout[name] = [at, len(a), a.dtype.str]
            at += -(-a.nbytes // 64) * 64
        head = json.dumps({"meta": self.meta, "layout": layout}).encode()
        pad = -(-(len(head) + 8) // 64) * 64
        out = bytearray(pad + at)
        out[:8] = pad.to_bytes(8, "little")
        out[8 : 8 + len(head)] = head
        for name, a in self.arrays.items():
            start = pad + layout[name][0]
            out[start : start + a.nbytes] = a.tobytes()
        return bytes(out)

    @classmethod
    def view(cls, packed) -> "Trie":
        """The trie in a buffer, or in a mapped file, without copying: its arrays are views."""
        whole = np.frombuffer(packed, np.uint8)
        pad = int.from_bytes(whole[:8].tobytes(), "little")
        head = json.loads(whole[8:pad].tobytes().rstrip(b"\0"))
        return cls({name: whole[pad + at : pad + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, n, kind) in head["layout"].items()}, head["meta"])

    @classmethod
    def map(cls, path: str) -> "Trie":
        """The trie in a file, without reading it."""
        return cls.view(np.memmap(path, np.uint8, "r"))
