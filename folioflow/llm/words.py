"""Words, word hashes and window hashes: what several operators read from a text.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is what ``bytes.split`` yields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java form of the word separators.
SEPARATORS = r"[\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def byte_list(texts: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


class WordHash(dict):
    """Word to 64-bit hash. Starts over when ``limit`` words are held, so a worker's memory stays bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Shared by the operators that run in one worker.
HASHES = WordHash()
#: All that workers keep from task to task.
MEMOS: list[dict] = [HASHES]


def keep_only(*own: dict) -> None:
    """Drop what earlier stages left in this worker, so that a pipeline's stages don't add up."""
    others = [m for m in MEMOS if m and not any(m is o for o in own)]
    if others:
        for memo in others:
            memo.clear()
        pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.Array], rows: int = 1000) -> Iterator[pa.Array]:
    """The arrays in slices of at most so many rows, so that what is made of a batch isn't held all at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 2 * len(_tables[0]), 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table, dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` consecutive word hashes; equal windows have equal hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, dtype=np.uint64, out=total[1:])
    return mix64((total[size:] - total[:-size]) * down[:n])
