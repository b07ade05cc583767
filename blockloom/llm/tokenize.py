"""Encoding of a corpus with a public byte-level BPE tokenizer by prefix dynamic programming.

For each prefix of a byte string exactly one token can end its BPE encoding: the one token t for which the pair (last token before t, t) survives BPE on
its own. ``PrefixTable`` stores that last token for every prefix, so the encoding is read off backwards, an append only continues the table
and an edit keeps the prefixes before it. The pre-tokenizer's pieces are encoded one by one; equal pieces hit a bounded memo; a piece that is a token is its own encoding, as the table would have it.
``encode_edited`` brings an encoded corpus up to date: ids away from an edit stay, an append encodes from the last safe cut on.

Defined results: null and empty text give an empty list; blank text is encoded as it is; strings of special tokens are ordinary text; a repeated id
counts once (the smallest text wins). Texts of any length are encoded whole. The vocabulary path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.textbatch import unique_docs

#: Fixed value: the pre-tokenizer pattern of the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MEMO_PIECES = 400_000
#: Characters looked back for a safe cut before the whole beginning is searched.
REACH = 4096
_CUT = regex.compile(r"\S\s")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token ids by bytes, and for merged tokens the pair they were merged from."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for c in letters:
            t = vocab[c]
            self.ids[as_bytes(c)] = t
            self.rank[t], self.split[t] = -1, (t, t)
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            t = vocab[a + b]
            left, right = vocab[a], vocab[b]
            self.pair.setdefault((left, right), t)
            if t not in self.rank:
                self.ids[as_bytes(a + b)] = t
                self.rank[t], self.split[t] = k, (left, right)
        self.longest = max(map(len, self.ids))
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of ``a`` and ``b`` leaves just these two tokens."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 4 * MEMO_PIECES:
                self._fits.clear()
            known = self._fits[a, b] = self._survives(a, b)
        return known

    def _survives(self, a: int, b: int) -> bool:
        # The two sides are taken apart in reverse order of merging; a merge across the border that comes before the next merge inside would have happened.
        rank, split, pair = self.rank, self.split, self.pair
        until = (1 << 60, 0)
        while True:
            t = pair.get((a, b))
            if t is not None and (rank[t], 0) < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # of two equal ranks the left occurrence merges first, so the right one is undone first
            if rank[a] > rank[b]:
                until = (rank[a], 0)
                a = split[a][1]
            else:
                until = (rank[b], 1)
                b = split[b][0]


class PrefixTable:
    """The unique valid last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.size = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        v, last, size = self.v, self.last, self.size
        n = len(self.data)
        data = self.data = self.data + more
        ids, fits = v.ids, v.fits
        for end in range(n + 1, len(data) + 1):
            for begin in range(max(0, end - v.longest), end):
                t = ids.get(data[begin:end])
                if t is not None and (begin == 0 or fits(last[begin], t)):
                    last.append(t)
                    size.append(end - begin)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def edit(self, begin: int, end: int, new: bytes) -> PrefixTable:
        """Replace ``data[begin:end]``; the prefixes before ``begin`` stay as they are."""
        rest = self.data[end:]
        self.data = self.data[:begin]
        del self.last[begin + 1 :], self.size[begin + 1 :]
        return self.append(new + rest)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= self.size[at]
        return out[::-1]


class Encoder:
    """Texts to token ids; pieces are encoded by ``PrefixTable`` and remembered."""

    def __init__(self, path: str = VOCABULARY):
        self.v = v = Vocabulary(path)

        class Memo(dict):
            def __missing__(self, piece: str) -> list[int]:
                if len(self) >= MEMO_PIECES:
                    self.clear()
                raw = piece.encode("utf-8", "replace")
                whole = v.ids.get(raw)
                out = self[piece] = [whole] if whole is not None else PrefixTable(v, raw).tokens()
                return out

        self._of = Memo().__getitem__
        self._pieces = regex.compile(PIECES).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._of, self._pieces(text)))) if text else []


    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token id."""
        out = np.zeros(max(self.v.ids.values()) + 1, np.int64)
        out[list(self.v.ids.values())] = [len(b) for b in self.v.ids]
        return out

    def edit(self, text: str, ids: list[int], begin: int, end: int, new: str) -> tuple[str, list[int]]:
        """Text and ids after ``text[begin:end]`` became ``new``; only what lies between safe cuts around the edit is encoded again.

        A blank after a character that is none always begins a piece, whatever stands before or after the two.
        """
        begin, end = max(0, min(begin, len(text))), max(0, min(end, len(text)))
        end = max(begin, end)
        out = text[:begin] + new + text[end:]
        left = 0
        for m in _CUT.finditer(text[max(0, begin - 1 - REACH) : begin]):
            left = max(0, begin - 1 - REACH) + m.start() + 1
        if not left and begin - 1 > REACH:
            left = max((m.start() + 1 for m in _CUT.finditer(text[:begin])), default=0)
        m = _CUT.search(text, end)
        right = m.start() + 1 if m else len(text)
        done = np.cumsum(self.sizes[ids]) if ids else np.empty(0, np.int64)
        a = int(np.searchsorted(done, len(text[:left].encode("utf-8", "replace")), "right"))
        b = int(np.searchsorted(done, len(text[:right].encode("utf-8", "replace")), "right"))
        return out, [*ids[:a], *self.encode(out[left : len(out) - (len(text) - right)]), *ids[b:]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [e.encode(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return unique_docs(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def encode_edited(docs: DataFrame, encoded: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, ids) of the documents that ``edits`` (doc_id, begin, end, new) name, from their old text and ids; one edit a document.

    Offsets are code points of the old text and are clamped to it; ``begin`` beyond the end appends. A null ``new`` deletes; null text is empty. Of several edits of one
    document the smallest (begin, end, new) counts. Documents without an edit keep their rows of ``encoded`` and aren't touched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = (part.column(c).to_pylist() for c in ("text", "ids", "begin", "end", "new"))
                done = [e.edit(t or "", i or [], b or 0, n or 0, w or "") for t, i, b, n, w in zip(*columns)]
                texts, ids = pa.array([t for t, _ in done], pa.string()), pa.array([i for _, i in done], pa.list_(pa.int32()))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text": texts, "ids": ids})

    one = edits.groupBy("doc_id").agg(F.min(F.struct("begin", "end", "new")).alias("e")).select("doc_id", "e.begin", "e.end", "e.new")
    old = unique_docs(docs.select("doc_id", "text")).join(one, "doc_id").join(encoded.select("doc_id", "ids"), "doc_id")
    return old.select("doc_id", "text", "ids", "begin", "end", "new").mapInArrow(run, "doc_id bigint, text string, ids array<int>")
