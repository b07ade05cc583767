"""Evaluation passages in training pages: q-gram lemma filter over diagonal bands, then banded alignment.

A page is read column by column (lines ordered by the clusters of their boxes' left edges, then from top to bottom), and only letters and digits are
kept, folded to lower case without accents, so that line ends, broken words, case and punctuation are no differences.

A case is a window of ``MIN_WORDS`` consecutive item words. A window of L letters has an edit budget of one letter in ``LETTERS_PER_EDIT``, E = ceil(L / LETTERS_PER_EDIT). By the
q-gram lemma L - q + 1 - q*E of its q-grams are left on the page, at different places of the item and within E diagonals. The bound is taken for each window of each
item, with the largest q of ``QS`` that leaves at least ``LEAST_BOUND`` hits (the smallest one always does), so short words need no other route. Hits of page and item q-grams are
counted in overlapping bands of diagonals as wide as the item's largest budget; what reaches the bound of some window inside one window's letters is retained.
Q-grams that many items share are left out of the index where every window over them can spare one: its bound sinks by one, so nothing is lost.

Retained regions whose best local alignment in the band scores less than a window within its budget must are dropped. Each other one is verified by a banded alignment that carries, for every diagonal and number of edits in the current word, the longest run of item words there:
a word is there with at most ``WORD_EDITS`` of its letters edited, and at most ``STRAY`` page letters part two words. Where a run is long enough, a second pass of the
alignment takes the fewest edits of each window of ``MIN_WORDS`` words: the pair is a leak if some window is there within the budget by which the filter was set, so filter and verification agree.

The items are the stated query set: they go to the tasks in blocks of at most ``BLOCK_LETTERS`` letters, one pass over all pages a block; an index is built once a process.
With several blocks each pass is written and its block dropped before the next is read.

Defined results: null and blank pages and items have no leak, nor have items of fewer than ``MIN_WORDS`` words. A repeated item id counts once (smallest text), so does a repeated page id.
Pages without boxes, or with another number of boxes than lines, are read in stored order. Empty tables give no rows. Items and pages may be of any length.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.textbatch import flats, unique_docs
from blockloom.session import cut

#: Consecutive item words that make a leak.
MIN_WORDS = 12
#: One letter in so many may be edited in a window of ``MIN_WORDS`` words that is sure to be found.
LETTERS_PER_EDIT = 8
#: Gram lengths tried, and the hits that a window's bound should leave. For q = 2 the bound is 7 at least.
QS, LEAST_BOUND = (5, 4, 3, 2), 5
#: Q-grams with more places than this may be left out of the index, as long as each window's bound stays at SPARED.
COMMON, SPARED = 64, 10
#: A word is there if at most this share of its letters (or one letter) is edited; more letters than STRAY between two words part them.
WORD_EDITS, STRAY = 0.4, 2
#: What an edit takes off the score by which regions are looked over before they are aligned word by word.
EDIT_COST = 3
COLUMN_GAP = 100
BLOCK_LETTERS = 4_000_000
#: Hits looked at together; a stretch of pages with more is worked off in overlapping pieces.
HITS_AT_ONCE = 4_000_000
REGIONS_AT_ONCE = 256
SEEN_BITS = CELL_BITS = 22
#: Letters that have no decomposition, and the letter they are read as.
LETTER_FOLDS = {"ſ": "s", "ß": "s", "æ": "a", "ø": "o", "œ": "o", "ð": "d", "ł": "l", "đ": "d", "þ": "p", "ı": "i"}


def _fold_one(c: int) -> int:
    """1.. for a letter or digit (folded), 0 for all else; letters of other scripts keep a code of their own."""
    ch = chr(c).lower()[:1]
    ch = unicodedata.normalize("NFKD", LETTER_FOLDS.get(ch, ch))[:1]
    return (ord(ch) - 47 if ch.isascii() else ord(ch)) if ch.isalnum() else 0


_table: np.ndarray | None = None


def fold(code: np.ndarray) -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([_fold_one(c) for c in range(0x10000)], np.uint32)
    out = _table[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        kinds, which = np.unique(code[far], return_inverse=True)
        out[far] = np.array([_fold_one(int(c)) for c in kinds], np.uint32)[which]
    return out


def _grams(a: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams (exact for the usual letters)."""
    n = max(0, len(a) - q + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = h * np.uint64(0x1F35B) + a[k : k + n]
    return h


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


class Postings:
    """Item q-grams of one length with their places. A passage whose first hit is at a place has ``need`` hits from there up to place ``limit``."""

    def __init__(self, q: int, bits: np.ndarray, gram: np.ndarray, item: np.ndarray, at: np.ndarray, need: np.ndarray, limit: np.ndarray):
        self.q = q
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        self.item, self.at, self.need, self.limit = (x[order].astype(np.int32) for x in (item, at, need, limit))
        self.bits = bits[self.item].astype(np.int32)
        self.spread = (self.item.astype(np.int64) * 0x85EBCA6B & 0x3FFFFFFF).astype(np.int32)
        self.gram, first = np.unique(gram, return_index=True)
        self.first = np.concatenate([first, [len(gram)]]).astype(np.int64)
        # most page q-grams are in no item: one bit of a table tells
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[_slot(self.gram)] = True

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, number of the gram) of the page q-grams that some item has."""
        where = np.flatnonzero(self.seen[_slot(g)])
        if not len(self.gram) or not len(where):
            return where[:0], where[:0]
        k = np.minimum(np.searchsorted(self.gram, g[where]), len(self.gram) - 1)
        good = self.gram[k] == g[where]
        return where[good], k[good]


class Items:
    """Index of a block of items: their letters, the word of each letter, what each word bears, and the postings of each gram length."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.min_words = min_words
        letters, words, sizes = [], [], []
        for _, text in rows:
            code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            f = fold(code)
            kept = f > 0
            w = np.cumsum(np.isin(code, (9, 10, 13, 32, 0xA0)))[kept]
            if len(w):  # words without letters don't count
                w = np.unique(w, return_inverse=True)[1]
            letters.append(f[kept])
            words.append(w.astype(np.int64))
            sizes.append(np.bincount(w) if len(w) else np.empty(0, np.int64))
        counts = [len(a) for a in letters]
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.letters = np.concatenate(letters) if letters else np.empty(0, np.uint32)
        size = np.concatenate([s[w] for s, w in zip(sizes, words)]) if words else np.empty(0, np.int64)
        self.single = size == 1
        self.may = np.maximum(1, (WORD_EDITS * size).astype(np.int64)).astype(np.int16)
        self.last = np.zeros(len(self.letters), bool)
        for s, e, w in zip(self.start[:-1], self.start[1:], words):
            if e > s:
                self.last[s:e] = np.append(w[1:] != w[:-1], True)
        bounds = [self._bounds(s) for s in sizes]
        #: (from, to, edits) of each item's windows, letters of its longest one, and the width of its bands.
        self.window = [np.stack([np.append(0, np.cumsum(s))[: len(b[0])], np.append(0, np.cumsum(s))[: len(b[0])] + b[0], b[1]], axis=1) for s, b in zip(sizes, bounds)]
        self.reach = np.array([b[0].max(initial=0) for b in bounds], np.int64)
        budget = np.array([b[1].max(initial=0) for b in bounds], np.int64)
        #: Least score of a window within its budget, and most edits of a word.
        self.least_score = np.array([(b[0] - b[1] * (1 + EDIT_COST)).min() if len(b[0]) else 0 for b in bounds], np.int64)
        self.levels = np.array([int(self.may[a:z].max(initial=1)) for a, z in zip(self.start[:-1], self.start[1:])], np.int64)
        self.bits = np.maximum(4, np.ceil(np.log2(budget + 1)).astype(np.int64))
        self.longest = int(max(counts, default=0))
        self.overlap = int((self.reach + budget).max(initial=0)) + max(QS)
        spread: dict[int, list] = {q: [] for q in QS}
        for k, (a, w, s, b) in enumerate(zip(letters, words, sizes, bounds)):
            for q in QS:
                if (b[2] == q).any():
                    spread[q].append((k, a, w, s, b))
        self.postings = [self._postings(q, parts) for q, parts in spread.items() if parts]

    def _bounds(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(letters, edits, q, hits) of each window of words."""
        total = np.concatenate([[0], np.cumsum(size)])
        letters = total[self.min_words :] - total[: -self.min_words] if len(size) >= self.min_words else np.empty(0, np.int64)
        edits = -(-letters // LETTERS_PER_EDIT)
        q, hits = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
        for k in reversed(QS):
            bound = letters - k + 1 - k * edits
            take = (bound >= LEAST_BOUND) | (k == QS[-1])
            q, hits = np.where(take, k, q), np.where(take, bound, hits)
        return letters, edits, q, hits

    def _postings(self, q: int, parts: list) -> Postings:
        grams = [_grams(a, q) for _, a, _, _, _ in parts]
        every = np.concatenate(grams)
        _, which, often = np.unique(every, return_inverse=True, return_counts=True)
        often = often[which]
        out = []
        done = 0
        for (k, _, word, size, (_, _, of, bound)), g in zip(parts, grams):
            n, m = len(g), self.min_words
            slack = np.where(of == q, bound, np.iinfo(np.int32).max)
            w = word[:n]
            low, high = np.maximum(0, w - m + 1), np.minimum(w, len(slack) - 1)
            keep = np.ones(n, bool)
            times = often[done : done + n]
            done += n
            common = np.flatnonzero(times > COMMON)
            for p in common[np.argsort(-times[common], kind="stable")].tolist():
                near = slack[low[p] : high[p] + 1]
                if near.min() > SPARED:
                    near -= 1
                    keep[p] = False
            least = np.array([slack[a : b + 1].min() for a, b in zip(np.maximum(0, np.arange(len(size)) - m + 1), np.minimum(np.arange(len(size)), len(slack) - 1))])
            need = least[w]
            keep &= need < np.iinfo(np.int32).max
            end = np.cumsum(size)
            limit = end[np.minimum(w + m, len(size)) - 1] - q
            at = np.flatnonzero(keep)
            out.append((g[at], np.full(len(at), k), at, need[at], limit[at]))
        return Postings(q, self.bits, *(np.concatenate(x) for x in zip(*out)))


def reading_order(flat, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(code points in reading order, document of each)."""
    code, start = flat.code, flat.start
    docs = len(start) - 1
    feeds = np.flatnonzero(code == 10)
    first = np.concatenate([start[:-1], feeds + 1])
    last = np.concatenate([start[1:], feeds])
    doc = np.concatenate([np.arange(docs), flat.doc_of(feeds)])
    order = np.argsort(first, kind="stable")
    first, doc = first[order], doc[order]
    last = np.sort(np.concatenate([feeds, start[1:]]), kind="stable")
    lines = np.bincount(doc, minlength=docs)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines)
    x, y = np.zeros(len(doc), np.int64), number.copy()
    if "line_boxes" in batch.schema.names:
        boxes = batch.column("line_boxes")
        boxes = pa.concat_arrays([boxes])
        off = boxes.offsets.to_numpy().astype(np.int64)
        sizes = np.where(boxes.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
        inner = boxes.values
        bx, by, no = (inner.field(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "line_no"))
        usable = (sizes == lines) & (lines > 0)
        take = np.repeat(off[:-1] - (np.cumsum(np.where(usable, sizes, 0)) - np.where(usable, sizes, 0)), np.where(usable, sizes, 0)) + np.arange(int(sizes[usable].sum()))
        of = np.repeat(np.arange(docs), np.where(usable, sizes, 0))
        bad = ~np.isfinite(bx[take]) | ~np.isfinite(by[take]) | ~np.isfinite(no[take])
        bad |= np.where(np.isfinite(no[take]), (no[take] < 0) | (no[take] >= lines[of]), True)
        wrong = np.zeros(docs, bool)
        wrong[of[bad]] = True
        ok = ~wrong[of]
        take, of = take[ok], of[ok]
        at = (np.cumsum(lines) - lines)[of] + no[take].astype(np.int64)
        x[at], y[at] = bx[take].astype(np.int64), by[take].astype(np.int64)
    by_x = np.lexsort((x, doc))
    new = np.ones(len(by_x), bool)
    new[1:] = (doc[by_x][1:] != doc[by_x][:-1]) | (x[by_x][1:] - x[by_x][:-1] > COLUMN_GAP)
    column = np.empty(len(by_x), np.int64)
    column[by_x] = np.cumsum(new)
    read = np.lexsort((number, y, column))
    n = (last - first)[read]
    src = np.repeat(first[read] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return code[src], np.repeat(doc[read], n)


def _retained(items: Items, p: Postings, letters: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows (document, item, first diagonal, from, to) of regions in which some window's bound is reached; any such window lies whole in [from, to)."""
    g = _grams(letters, p.q)
    where, k = p.lookup(g)
    inside = doc[where] == doc[where + p.q - 1]
    where, k = where[inside], k[inside]
    many = np.cumsum(p.first[k + 1] - p.first[k])
    out = [np.empty((0, 5), np.int64)]
    lo = 0
    while lo < len(where):
        hi = max(int(np.searchsorted(many, (many[lo - 1] if lo else 0) + HITS_AT_ONCE, "right")), lo + 1)
        if hi < len(where):  # a piece spans two overlaps at least, so that each step gets on
            hi = max(hi, int(np.searchsorted(where, where[lo] + 2 * items.overlap, "right")))
        out.append(_bands(items, p, where[lo:hi], k[lo:hi], doc, begin))
        if hi >= len(where):
            break
        lo = int(np.searchsorted(where, where[hi] - items.overlap, "left"))
    return np.unique(np.concatenate(out), axis=0)


def _bands(items: Items, p: Postings, where: np.ndarray, k: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n = (p.first[k + 1] - p.first[k]).astype(np.int32)
    row = np.repeat((p.first[k] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)
    d = doc[where]
    shift = 1 << max(16, items.longest.bit_length() + 1)
    base = where - begin[d] + shift
    wide = np.int64 if int(base.max(initial=0)) >= 1 << 30 else np.int32
    of = np.repeat(np.arange(len(where), dtype=np.int32), n)
    band = (base.astype(wide)[of] - p.at[row]) >> p.bits[row]
    # a first look: hits of two neighbouring bands, counted in cells that other bands may share
    spread = (d * 0x9E3779B1 & 0x3FFFFFFF).astype(np.int32)
    cell = (spread[of] + p.spread[row] + band) & ((1 << CELL_BITS) - 1)
    count = np.bincount(cell, minlength=1 << CELL_BITS)
    count += np.maximum(np.roll(count, 1), np.roll(count, -1))
    live = np.flatnonzero(count.astype(np.int32)[cell] >= p.need[row])
    if not len(live):
        return np.empty((0, 5), np.int64)
    row, of = row[live], of[live]
    band, item = band[live].astype(np.int64), p.item[row].astype(np.int64)
    room = int(band.max(initial=1)).bit_length() + 1
    key = ((d[of] * len(items.ids) + item) << room) | band
    # each hit counts for its band and the one before
    key, row = np.concatenate([key, key - 1]), np.concatenate([row, row])
    at = p.at[row].astype(np.int64)
    order = np.lexsort((at, key))
    key, at, row = key[order], at[order], row[order]
    new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))
    key, at, row = key[new], at[new], row[new]
    last = np.arange(len(key)) + np.maximum(p.need[row], 1) - 1
    ok = last < len(key)
    last = np.minimum(last, len(key) - 1)
    ok &= (key[last] == key) & (at[last] <= p.limit[row])
    ok = np.flatnonzero(ok)
    if not len(ok):
        return np.empty((0, 5), np.int64)
    # a window holds its hits from the first to the last one, so it ends at most its length behind the first and begins at most its length before the last; windows that meet or overlap are one region
    kk, a, b = key[ok], at[ok], at[last[ok]]
    part = np.append(True, (kk[1:] != kk[:-1]) | (a[1:] > b[:-1] + 1))
    f = np.flatnonzero(part)
    reach = items.reach[(kk[f] >> room) % len(items.ids)]
    kk, a, b = kk[f], np.minimum.reduceat(b, f) + p.q - reach, np.maximum.reduceat(a, f) + reach
    pair = kk >> room
    item = pair % len(items.ids)
    low = ((kk & ((1 << room) - 1)) << items.bits[item]) - shift
    return np.stack([pair // len(items.ids), item, low, a, b], axis=1)


_NEVER = np.int16(-30_000)


def _banded(items: Items, item: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, page: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, runs: bool) -> np.ndarray:
    """Banded alignment of item letters [a, b) on diagonals [low, low + width) with page letters [begin, end), word by word.

    ``runs``: the longest run of item words that are there. Else: the fewest edits with which all words are there, as a negative number (``_NEVER`` or less if they can't be). ``v[e, r, x]`` is the
    best value before the current word if region r stands on diagonal ``low + x`` with e edits in that word. All regions advance together, an item letter a step; those with fewer letters drop out.
    """
    order = np.argsort(a - b, kind="stable")
    item, a, b, low, begin, end = (x[order] for x in (item, a, b, low, begin, end))
    size = b - a
    steps = int(size.max(initial=0))
    src = (begin + low + a)[:, None] + np.arange(steps + width)
    valid = (src >= begin[:, None]) & (src < end[:, None])
    text = np.where(valid, page[np.clip(src, 0, max(len(page) - 1, 0))], 0) if len(page) else np.zeros(src.shape, np.uint32)
    at = items.start[item] + a
    levels = int(max((items.may[s:e].max(initial=1) for s, e in zip(at.tolist(), (at + size).tolist())), default=1)) + 1
    v = np.full((levels, len(item), width), _NEVER, np.int16)
    v[0] = 0
    best = np.full(len(item), 0 if runs else _NEVER, np.int16)
    level = np.arange(levels, dtype=np.int16)[:, None, None]
    for i in range(steps):
        live = int(np.searchsorted(-size, -i, "left"))
        v = v[:, :live]
        here = at[:live] + i
        t = text[:live, i : i + width]
        new = np.where(t == items.letters[here][:, None], v, _NEVER)
        np.maximum(new[1:], np.where(t > 0, v[:-1], _NEVER), out=new[1:])
        # an item letter that the page lacks; a word of one letter must be there
        gone = v[:-1, :, 1:]
        if items.single[here].any():
            gone = np.where(items.single[here][:, None], _NEVER, gone)
        np.maximum(new[1:, :, :-1], gone, out=new[1:, :, :-1])
        for e in range(1, levels):  # page letters more
            np.maximum(new[e, :, 1:], new[e - 1, :, :-1], out=new[e, :, 1:])
        ends = np.flatnonzero(items.last[here])
        if len(ends):
            done = np.where(level <= items.may[here[ends]][:, None], new[:, ends] - (0 if runs else level), _NEVER).max(axis=0)
            if runs:
                done = np.where(done >= 0, done + np.int16(1), np.int16(0))
                best[ends] = np.maximum(best[ends], done.max(axis=1))
            else:
                best[ends] = done.max(axis=1)  # that of the last word stays
            go = done.copy()
            for k in range(1, STRAY + 1):
                np.maximum(go[:, k:], done[:, :-k] - np.int16(0 if runs else k), out=go[:, k:])
            new[:, ends] = _NEVER
            new[0, ends] = np.maximum(go, _NEVER)
        v = new
    out = np.empty(len(item), np.int64)
    out[order] = best
    return out


def _scores(items: Items, item: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, page: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Best local score of each region: a letter 1, an edit -EDIT_COST. A window within its budget scores at least its letters less (1 + EDIT_COST) for each edit."""
    order = np.argsort(a - b, kind="stable")
    item, a, b, low, begin, end = (x[order] for x in (item, a, b, low, begin, end))
    size = b - a
    steps = int(size.max(initial=0))
    src = (begin + low + a)[:, None] + np.arange(steps + width)
    valid = (src >= begin[:, None]) & (src < end[:, None])
    text = np.where(valid, page[np.clip(src, 0, max(len(page) - 1, 0))], 0) if len(page) else np.zeros(src.shape, np.uint32)
    at = items.start[item] + a
    kind = np.int16 if width * EDIT_COST + steps < 30_000 else np.int32
    cost = kind(EDIT_COST)
    across = np.arange(width, dtype=kind) * cost
    v = np.zeros((len(item), width), kind)
    best = np.zeros(len(item), kind)
    for i in range(steps):
        live = int(np.searchsorted(-size, -i, "left"))
        v = v[:live]
        new = v + np.where(text[:live, i : i + width] == items.letters[at[:live] + i][:, None], kind(1), -cost)
        np.maximum(new[:, :-1], v[:, 1:] - cost, out=new[:, :-1])
        new += across
        np.maximum.accumulate(new, axis=1, out=new)
        new -= across
        np.maximum(new, 0, out=new)
        np.maximum(best[:live], new.max(axis=1), out=best[:live])
        v = new
    out = np.empty(len(item), np.int64)
    out[order] = best
    return out


def verify(items: Items, rows: np.ndarray, page: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Longest run of words of each retained region, 0 where no window of words is there within its edit budget."""
    d, item, low, a, b = rows.T
    length = items.start[item + 1] - items.start[item]
    a, b = np.maximum(0, a), np.minimum(length, b)
    low = low - (1 << items.bits[item])
    s, e = begin[d], begin[d + 1]

    def each(what, own: np.ndarray, a: np.ndarray, b: np.ndarray, *more) -> np.ndarray:
        got = np.zeros(len(own), np.int64)
        kind = items.bits[item[own]] << 16 | (items.levels[item[own]] if more else 0)
        for k in np.unique(kind).tolist():
            some = np.flatnonzero(kind == k)
            some = some[np.argsort((b - a)[some], kind="stable")]
            for j in range(0, len(some), REGIONS_AT_ONCE):
                x = some[j : j + REGIONS_AT_ONCE]
                r = own[x]
                got[x] = what(items, item[r], a[x], b[x], low[r], page, s[r], e[r], 4 << (k >> 16), *more)
        return got

    out = np.zeros(len(rows), np.int64)
    near = np.arange(len(rows))
    near = near[each(_scores, near, a, b) >= items.least_score[item]]
    out[near] = each(_banded, near, a[near], b[near], True)
    near = np.flatnonzero(out >= items.min_words)
    if not len(near):
        return np.zeros(len(rows), np.int64)
    # each window of words that lies in the region, with its own budget
    of, first, last, budget = [], [], [], []
    for r in near.tolist():
        bound = items.window[item[r]]
        inside = np.flatnonzero((bound[:, 0] >= a[r]) & (bound[:, 1] <= b[r]))
        of.append(np.full(len(inside), r))
        first.append(bound[inside, 0])
        last.append(bound[inside, 1])
        budget.append(bound[inside, 2])
    of, first, last, budget = (np.concatenate(x) for x in (of, first, last, budget))
    kept = np.unique(of[-each(_banded, of, first, last, False) <= budget])
    final = np.zeros(len(rows), np.int64)
    final[kept] = out[kept]
    return final


def find_in(items: Items, flat, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, longest run of words) of each pair with a region that may hold a leak."""
    code, doc = reading_order(flat, batch)
    letters = fold(code)
    kept = letters > 0
    letters, doc = letters[kept], doc[kept]
    none = np.empty(0, np.int64)
    begin = np.searchsorted(doc, np.arange(len(flat.start)))
    found = [_retained(items, p, letters, doc, begin) for p in items.postings]
    rows = np.concatenate(found) if found else np.empty((0, 5), np.int64)
    if not len(rows):
        return none, none, none
    d, item = rows[:, 0], rows[:, 1]
    runs = verify(items, rows, letters, begin)
    pair, which = np.unique(d * len(items.ids) + item, return_inverse=True)
    most = np.zeros(len(pair), np.int64)
    np.maximum.at(most, which, runs)
    return pair // len(items.ids), pair % len(items.ids), most


def _blocks(eval_items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    one = eval_items.where("text is not null").groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id")
    block: list[tuple[int, str]] = []
    size = 0
    for r in one.toLocalIterator():
        if block and size + len(r.text) > BLOCK_LETTERS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


_index: dict[tuple[str, int], Items] = {}


def index_of(key: str, block, min_words: int) -> Items:
    """The index of a broadcast block, built once a process; only the newest one is kept."""
    if (key, min_words) not in _index:
        _index.clear()
        _index[key, min_words] = Items(block.value, min_words)
    return _index[key, min_words]


def find_leaks(docs: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words): pages that hold at least ``min_words`` consecutive words of an item; ``n_words`` is the longest run seen in a retained region."""
    spark = docs.sparkSession
    columns = ["doc_id", "text"] + ["line_boxes"] * ("line_boxes" in docs.columns)
    docs = unique_docs(docs.select(*columns))
    schema = "doc_id bigint, item_id bigint, n_words bigint"

    def search(number: int, rows: list[tuple[int, str]]):
        block = spark.sparkContext.broadcast(rows)
        key = f"{uuid.uuid4().hex}-{number}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index_of(key, block, min_words)
            for batch, flat in flats(batches):
                d, item, words = find_in(items, flat, batch)
                good = words >= min_words
                if good.any():
                    yield pa.record_batch(
                        {"doc_id": batch.column("doc_id").take(pa.array(d[good])), "item_id": pa.array(items.ids[item[good]]), "n_words": pa.array(words[good])}
                    )

        return block, docs.mapInArrow(run, schema)

    blocks = enumerate(_blocks(eval_items))
    out, held = spark.createDataFrame([], schema), next(blocks, None)
    while held is not None:
        later = next(blocks, None)
        block, found = search(*held)
        if later is not None or held[0]:
            found = cut(found)
            block.destroy()
        out, held = out.unionByName(found), later
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
