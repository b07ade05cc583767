"""Texts of an Arrow batch as one flat code point array, and exact rolling hashes over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points worked on at once; a longer text is one batch of its own.
FLAT_CHARS = 1 << 20
#: Rows made Python strings at once.
ROWS = 1024
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def unique_docs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with each id once. Texts are only shuffled if an ids-only pass finds a repeated id."""
    ids = docs.select(id_column)
    if ids.groupBy(id_column).count().where("count > 1").isEmpty():
        return docs
    others = [c for c in docs.columns if c != id_column]
    return docs.groupBy(id_column).agg(F.min(F.struct(*others)).alias("_r")).select(id_column, *[F.col(f"_r.{c}").alias(c) for c in others])


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                pair.append(np.multiply.accumulate(p))
        have = _powers[base] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose order is unrelated to the input's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Flat:
    """Concatenated texts: ``code`` (uint32), document ``d`` spans ``start[d]:start[d + 1]``."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        self.code = np.frombuffer(b"".join(raw), np.uint32)
        self.start = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
        self._prefix: dict[int, np.ndarray] = {}

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def hashes(self, at: np.ndarray | slice, length: int | np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the substrings [at, at + length)."""
        n, base = len(self.code), BASES[which]
        up, down = powers(base, n + 1)
        if which not in self._prefix:
            with np.errstate(over="ignore"):
                self._prefix[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        p = self._prefix[which]
        with np.errstate(over="ignore"):
            if isinstance(at, slice):
                return mix((p[at.start + length : at.stop + length] - p[at]) * down[at])
            return mix((p[at + length] - p[at]) * down[at])


def flats(batches: Iterator[pa.RecordBatch], chars: int = FLAT_CHARS, least: int = 0) -> Iterator[tuple[pa.RecordBatch, Flat]]:
    """Slices of the batches with their texts (column ``text``) flattened; null and texts shorter than ``least`` are left out."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):  # texts become Python strings a few rows at a time
            batch = whole.slice(at, ROWS)
            texts = batch.column("text").to_pylist()
            took: list[int] = []
            size = 0
            for i, t in enumerate(texts):
                if t is None or len(t) < least:
                    continue
                if took and size + len(t) > chars:
                    yield batch.take(pa.array(took)), Flat([texts[k] for k in took])
                    took, size = [], 0
                took.append(i)
                size += len(t)
            if took:
                yield batch.take(pa.array(took)), Flat([texts[k] for k in took])
