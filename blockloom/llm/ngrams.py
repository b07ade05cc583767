"""Character n-gram counts of a whole column, in a table whose size is bounded.

Words are counted in the JVM first, so Python sees each different word once. The different n-grams of the column are counted exactly, by 64-bit hash. The table that goes to the
tasks holds the count of each n-gram as long as there are at most ``MOST_GRAMS`` (ten bytes each); beyond that it holds those of the commonest ones, and the rest, all rarer, share ``2^REST_BITS`` hashed cells.
``support`` allows for the share of cells in use, so that it means the same however full they are. Counts are kept as logarithms in 16 bits.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import cut

MOST_GRAMS, REST_BITS = 4_000_000, 20
CHUNKS = 64
#: Steps per doubling of a count.
STEPS = 1024


def gram_hash(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"))


def word_counts(table: DataFrame, column: str, separators: str) -> DataFrame:
    """(word, n) of a column split at runs of ``separators`` (a Java regular expression)."""
    words = table.where(F.col(column).isNotNull()).select(F.explode(F.split(F.col(column), separators)).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


class Counts:
    """Counts by n-gram: ``counts[gram]``. ``grams``: sorted hashes of those held one by one, ``logs`` their counts; ``rest``: cells of all others, none if empty."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, rest: np.ndarray):
        self.grams, self.logs, self.rest = grams, logs, rest
        self.used = float(np.count_nonzero(rest)) / max(1, len(rest))
        self._memo: dict[str, float] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> Counts:
        """From plain counts."""
        grams = np.array([gram_hash(g) for g in counts], np.uint64)
        order = np.argsort(grams)
        return cls(grams[order], _logs(np.array(list(counts.values()), np.int64))[order], np.empty(0, np.uint16))

    def __getitem__(self, gram: str) -> float:
        known = self._memo.get(gram)
        if known is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            h = np.uint64(gram_hash(gram))
            at = int(np.searchsorted(self.grams, h))
            if at < len(self.grams) and self.grams[at] == h:
                v = int(self.logs[at])
            else:
                v = int(self.rest[int(h) >> (64 - REST_BITS)]) if len(self.rest) else 0
            known = self._memo[gram] = 2.0 ** ((v - 1) / STEPS) if v else 0.0
        return known

    def __getstate__(self):
        return [zlib.compress(x.tobytes(), 1) for x in (self.grams, self.logs, self.rest)]

    def __setstate__(self, state):
        self.__init__(*(np.frombuffer(zlib.decompress(x), t) for x, t in zip(state, (np.uint64, np.uint16, np.uint16))))


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.round(np.log2(np.maximum(counts, 1)) * STEPS), 0).astype(np.uint16)


def fold_counts(words: DataFrame, grams: Callable[[str], Iterable[str]], most: int | None = None) -> Counts:
    """The counts of ``grams(word)``, each weighted by the word's count."""
    most = MOST_GRAMS if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"gram": pa.array(np.fromiter(sums, np.uint64, len(sums)).view(np.int64)), "n": pa.array(list(sums.values()), pa.int64())})
            sums.clear()
            return out

        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for g in grams(w):
                    sums[gram_hash(g)] += n
            if len(sums) > 500_000:
                yield flush()
        yield flush()

    exact = cut(words.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    # the least count that is held by itself: eight classes a doubling, so a few hundred rows
    sizes = exact.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("c")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        held += r.k
        if held > most:
            break
        least = r.n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty((2, 0), np.uint64)]
        rest = np.zeros(1 << REST_BITS, np.int64)
        for batch in batches:
            g, n = batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            big = n >= least
            kept.append(np.stack([g[big], n[big].astype(np.uint64)]))
            np.add.at(rest, (g[~big] >> np.uint64(64 - REST_BITS)).astype(np.int64), n[~big])
        g, n = np.concatenate(kept, axis=1)
        cells = np.flatnonzero(rest)
        parts = [g, _logs(n.astype(np.int64)), cells.astype(np.uint32), _logs(rest[cells])]
        if len(g) or len(cells):
            yield pa.record_batch({k: pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for k, x in zip("abcd", parts)})

    placed = exact.repartition(CHUNKS, F.shiftrightunsigned("gram", 64 - REST_BITS))  # a cell lies in one part
    own, logs, rest = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], np.zeros(1 << REST_BITS, np.uint16)
    for r in placed.mapInArrow(pack, "a binary, b binary, c binary, d binary").collect():  # at most CHUNKS rows, ten bytes a gram held
        a, b, c, d = (np.frombuffer(zlib.decompress(x), t) for x, t in zip(r, (np.uint64, np.uint16, np.uint32, np.uint16)))
        own.append(a)
        logs.append(b)
        rest[c] = np.maximum(rest[c], d)
    grams_held = np.concatenate(own)
    order = np.argsort(grams_held)
    return Counts(grams_held[order], np.concatenate(logs)[order], rest if rest.any() else np.empty(0, np.uint16))


def trigrams(word: str) -> Iterator[str]:
    """Trigrams and, marked, their two-letter contexts; word ends are letters of their own."""
    s = "\x02\x02" + word + "\x03"
    for i in range(len(s) - 2):
        yield s[i : i + 3]
        yield "2" + s[i : i + 2] + "\x04"


class TrigramCost:
    """-log P(word) under smoothed trigram counts."""

    ALPHA = 2.0
    ALPHABET = 3000

    def __init__(self, counts: Counts):
        self.counts = counts
        self._memo: dict[str, float] = {}

    def _one(self, gram: str) -> float:
        known = self._memo.get(gram)
        if known is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            n3, n2 = self.counts[gram], self.counts["2" + gram[:2] + "\x04"]
            known = self._memo[gram] = -math.log((n3 + self.ALPHA / self.ALPHABET) / (n2 + self.ALPHA))
        return known

    def __call__(self, word: str) -> float:
        s = "\x02\x02" + word + "\x03"
        one = self._one
        return sum([one(s[i : i + 3]) for i in range(len(s) - 2)])

    def support(self, word: str) -> float:
        """Share of the word's trigrams that the column has at all, less what cells in use would give by chance."""
        s = "\x02\x02" + word + "\x03"
        share = sum(self.counts[s[i : i + 3]] > 0 for i in range(len(s) - 2)) / (len(s) - 2)
        return (share - self.counts.used) / (1 - self.counts.used) if self.counts.used < 1 else 0.0
