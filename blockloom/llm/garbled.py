"""Text decoded with the wrong character encoding: found and, where possible, restored by round trips.

A word is re-encoded under each candidate legacy encoding and strictly decoded as each candidate intended encoding, also in up to ``LAYERS`` nested layers, of which
no two in a row swap one legacy encoding for another (two such swaps look like one); of UTF-8 read as a single-byte encoding also parts of a word are tried, byte sequence by byte sequence. All
texts that such chains lead to are judged, whatever their number or rank. A repair is accepted when the garbling cost
drops by ``MARGIN`` (``UTF8_MARGIN`` if UTF-8 was read): the cost adds the word's trigram cost under counts of the whole column to fixed penalties for what garbling leaves behind
(control characters, symbols inside words, scripts in turns, capitals after small letters). Replacement and C1 control characters mark a word as garbled
even where nothing can be restored.

Defined results: null, empty and pure ASCII text is never garbled. Repeated ids count once. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.ngrams import Counts, TrigramCost, fold_counts, trigrams, word_counts

#: Encodings a text may wrongly have been read with.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-7", "iso8859-9", "iso8859-15", "mac-roman", "koi8-r", "cp437", "cp850", "cp852", "cp866", "gbk", "cp932")
#: Encodings it may have been written in.
WRITTEN_AS = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-7", "mac-roman", "koi8-r", "cp437", "cp850", "cp852", "cp866", "cp932", "euc-jp", "gb18030", "big5", "euc-kr")
MARGIN = 3.0
#: Hardly any text spells valid UTF-8 by chance, so a repair by it needs less.
UTF8_MARGIN = 1.5
#: Share of a repair's trigrams that the column must have, unless UTF-8 was read in every layer.
SUPPORT = 0.5
#: What each layer of a nested repair must gain.
LAYER_COST = 2.0
LAYERS = 3
SEPARATORS = r"[0-9 _.()\-]+"
MEMO_WORDS = 200_000
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_INVISIBLE = dict.fromkeys((0xA0, 0xAD))
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def _encoder(name: str):
    """Character to byte under a single-byte encoding; bytes the encoding leaves undefined stand for themselves, as lenient decoders have it."""
    to: dict[str, int] = {}
    for b in range(256):
        try:
            to[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            to.setdefault(chr(b), b)
    return to


_BYTES = {n: _encoder(n) for n in READ_AS if n not in ("gbk", "cp932")}


def re_encode(word: str, name: str) -> bytes | None:
    table = _BYTES.get(name)
    if table is None:
        try:
            return word.encode(name)
        except UnicodeEncodeError:
            return None
    try:
        return bytes(map(table.__getitem__, word))
    except KeyError:
        return None


def _parts(word: str, name: str) -> str | None:
    """``word`` with every run of characters that spells valid UTF-8 under ``name`` decoded."""
    table = _BYTES.get(name)
    if table is None:
        return None
    raw = bytes(table.get(c, 0) if ord(c) > 127 else 0 for c in word)
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            text = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[at : m.start()], text]
        at = m.end()
    return "".join([*out, word[at:]]) if at else None


def _pair_classes() -> tuple[re.Pattern, dict[str, re.Pattern]]:
    """Patterns of two characters that may begin a UTF-8 sequence, under any encoding and under each."""
    each, leads, follows = {}, set(), set()
    for name, table in _BYTES.items():
        lead = {c for c, b in table.items() if 0xC2 <= b <= 0xF4}
        follow = {c for c, b in table.items() if 0x80 <= b <= 0xBF}
        each[name] = re.compile(f"[{re.escape(''.join(sorted(lead)))}][{re.escape(''.join(sorted(follow)))}]")
        leads |= lead
        follows |= follow
    return re.compile(f"[{re.escape(''.join(sorted(leads)))}][{re.escape(''.join(sorted(follows)))}]"), each


_ANY_PAIR, _PAIRS = _pair_classes()


def utf8_candidates(word: str) -> Iterator[str]:
    """Repairs of one layer in which UTF-8 was read as something else: of the whole word and of parts."""
    if word.isascii():
        return
    if _ANY_PAIR.search(word):
        for r, pair in _PAIRS.items():
            if pair.search(word):
                p = _parts(word, r)
                if p is not None:
                    yield p
    for r in READ_AS:
        if r in _BYTES and not _PAIRS[r].search(word):
            continue  # strict UTF-8 with a character beyond ASCII has such a pair
        raw = re_encode(word, r)
        if raw is not None:
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError:
                pass


def legacy_candidates(word: str) -> Iterator[str]:
    """Repairs of one layer in which a legacy encoding was read as another."""
    for r in READ_AS:
        if r not in _BYTES:
            continue
        raw = re_encode(word, r)
        if raw is None:
            continue
        for w in WRITTEN_AS:
            if w != r and w != "utf-8":
                try:
                    yield raw.decode(w)
                except UnicodeDecodeError:
                    pass


def _script(c: str) -> str:
    n = unicodedata.name(c, "?").split(" ", 1)[0]
    return n if n in ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW") else ""


def traces(word: str) -> float:
    """Penalty for what garbling leaves behind."""
    total, before = 0.0, ""
    for i, c in enumerate(word):
        o = ord(c)
        if 0x80 <= o < 0xA0 or c == "�" or 0xE000 <= o < 0xF900 or not c.isprintable() and o > 127 and c != "\xa0":
            total += 6
        elif o > 127 and unicodedata.category(c)[0] in "SPN":
            total += 1.5 if (i == 0 or not word[i - 1].isalpha()) and (i + 1 == len(word) or not word[i + 1].isalpha()) else 3
        script = _script(c) if c.isalpha() else ""
        if script and before and script != before and {script, before} <= {"LATIN", "CYRILLIC", "GREEK"}:
            total += 1.0
        before = script or before
        if i and c.isupper() and word[i - 1].islower():
            total += 1.5
    return total


class Repair:
    """Judges words; remembers them up to a bound."""

    def __init__(self, counts: Counts):
        self.lm = TrigramCost(counts)
        self._memo: dict[str, tuple[bool, str]] = {}

    def cost(self, word: str) -> float:
        return self.lm(word) + traces(word)

    def word(self, word: str) -> tuple[bool, str]:
        """(garbled, restored or as it is)."""
        if word.isascii():
            return False, word
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            known = self._memo[word] = self._judge(word)
        return known

    def _judge(self, word: str) -> tuple[bool, str]:
        if word.translate(_INVISIBLE).isascii():
            return False, word
        start = self.cost(word)
        # every text that a chain of layers leads to, with whether UTF-8 was read in each; none is left out for its rank
        chains: dict[str, tuple[int, bool]] = {word: (0, True)}
        layer = [(word, True, True)]
        for depth in range(1, LAYERS + 1):
            following = []
            for w, utf8, may_legacy in layer:
                for y in utf8_candidates(w):
                    if y and (y not in chains or utf8 and chains[y] == (depth, False)):
                        chains[y] = (depth, utf8)
                        following.append((y, utf8, True))
                if may_legacy:
                    for y in legacy_candidates(w):
                        if y and y not in chains:
                            chains[y] = (depth, False)
                            following.append((y, False, False))
            layer = following
            if not layer:
                break
        text, gain = word, 0.0
        for y, (depth, utf8) in chains.items():
            if not depth:
                continue
            won = start - self.cost(y) - LAYER_COST * (depth - 1)
            if won > gain and won >= (UTF8_MARGIN if utf8 else MARGIN) and (utf8 or self.lm.support(y) >= SUPPORT):
                gain, text = won, y
        return (True, text) if text != word else (bool(_LOST.search(word)), word)

    def name(self, name: str) -> tuple[bool, str]:
        """(garbled, restored) of a text: word by word, then with separators that may be part of a character."""
        bad, out, at = False, [], 0
        for m in re.finditer(SEPARATORS, name):
            for piece, plain in ((name[at : m.start()], False), (m[0], True)):
                if piece and not plain:
                    b, piece = self.word(piece)
                    bad |= b
                out.append(piece)
            at = m.end()
        if at < len(name):
            b, piece = self.word(name[at:])
            bad |= b
            out.append(piece)
        return bad, "".join(out)


def cost_table(table: DataFrame, column: str) -> Counts:
    return fold_counts(word_counts(table, column, SEPARATORS), trigrams)


def repair_names(table: DataFrame, id_column: str = "entry_id", column: str = "name") -> DataFrame:
    """(id, name, restored) of every record whose text, or a part of it, was decoded wrongly; ``restored`` is null if nothing could be repaired."""
    counts = table.sparkSession.sparkContext.broadcast(cost_table(table, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repair(counts.value)
        for batch in batches:
            names = batch.column(1).to_pylist()
            verdict = [r.name(n) for n in names]
            keep = [i for i, (b, _) in enumerate(verdict) if b]
            if keep:
                took = pa.array(keep)
                fixed = [verdict[i][1] if verdict[i][1] != names[i] else None for i in keep]
                yield pa.record_batch([batch.column(0).take(took), batch.column(1).take(took), pa.array(fixed, pa.string())], names=[id_column, column, "restored"])

    odd = table.where(F.col(column).rlike(r"[^\x00-\x7f]")).select(F.col(id_column).cast("long").alias(id_column), column)
    return odd.mapInArrow(run, f"{id_column} bigint, {column} string, restored string").distinct()
