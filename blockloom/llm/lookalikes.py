"""Text that looks the same but differs in its characters, brought to one form.

Compatibility normalization comes first; ignorable characters are deleted, kinds of space and hyphen become one. Each word is then a lattice: a letter
with look-alikes in other scripts may stand for any of them. Viterbi search picks the path of the best score, the log counts of script-consistent
character bigrams (counted over the whole column, in words of one script) less a penalty for each change of script. The lattice is the same for all
spellings that look the same, so they get the same form. Accents are composed again at the end; letter case, accents and ASCII
characters among one another stay different.

Defined results: null text has no form, empty text has an empty one. Repeated ids count once. Records with one and the same text are no pair. Empty
tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.ngrams import Counts, fold_counts, word_counts
from blockloom.session import cut

#: Latin letters and the Cyrillic and Greek letters of the same shape.
LATIN = "ABCEHIJKMOPSTXYZaceijopsxyhvduwqlGN"
CYRILLIC = "АВСЕНІЈКМОРЅТХУ асеіјорѕхуһѵԁ ԝԛӏԌ "
GREEK = "ΑΒ ΕΗΙ ΚΜΟΡ ΤΧΥΖα  ιϳορ  γ ν υ    Ν"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
SPACES = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}
HYPHENS = {0x2010, 0x2011, 0x2012, 0x2212, 0x2043, 0x02D7, 0xFE63, 0xFF0D}
IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0000, 0xE1000)}
CHANGE = 6.0
MEMO_WORDS = 300_000
SEPARATORS = r"[^\p{L}\p{M}]+"


def _classes() -> dict[str, tuple[str, str, str]]:
    """Letter to its (Latin, Cyrillic, Greek) forms; "" where a script has none."""
    out: dict[str, tuple[str, str, str]] = {}
    for forms in zip(LATIN, CYRILLIC, GREEK):
        forms = tuple(f.strip() for f in forms)
        for f in forms:
            if f:
                out[f] = forms  # type: ignore[assignment]
    return out


CLASSES = _classes()


def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ", 1)[0]


def plain(text: str) -> str:
    """Decomposed compatibility form without ignorable characters, one kind of space and of hyphen."""
    if text.isascii():
        return text
    out = []
    # a deleted character may stand between a letter and its accent, so normalization follows the deletion too
    for c in unicodedata.normalize("NFKD", text):
        o = ord(c)
        if o < 128:
            out.append(c)
        elif o in HYPHENS:
            out.append("-")
        elif unicodedata.category(c) == "Cf" or o in IGNORED:
            continue
        elif unicodedata.category(c) == "Zs" or o in SPACES:
            out.append(" ")
        else:
            out.append(c)
    return unicodedata.normalize("NFKD", "".join(out))


def bigrams(word: str) -> Iterator[str]:
    """Bigrams of a word all of one script, with its ends; none of a mixed word."""
    base = [c for c in plain(word) if c.isalpha()]
    found = {script(c) for c in base}
    if len(found) == 1:
        s = "\x02" + "".join(base) + "\x03"
        for i in range(len(s) - 1):
            yield "b" + s[i : i + 2]


class Forms:
    """Words to their one form; remembers them up to a bound."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self._memo: dict[str, str] = {}
        self._words = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*").sub

    def _score(self, a: str, b: str) -> float:
        return math.log(1.0 + self.counts["b" + a + b])

    def _path(self, word: str) -> str:
        known = self._memo.get(word)
        if known is not None:
            return known
        states: list[tuple[float, str, str, str]] = [(0.0, "", "\x02", "")]  # score, script, last letter, text
        for c in word:
            forms = CLASSES.get(c)
            if forms is None:
                if not c.isalpha():  # an accent follows its letter whatever the path
                    states = [(v, s, p, t + c) for v, s, p, t in states]
                    continue
                options = [(script(c), c)]
            else:
                options = [(s, f) for s, f in zip(SCRIPTS, forms) if f]
            step = []
            for s, f in options:
                # ties go to the first script, so the result depends on the lattice alone
                best = max(states, key=lambda x: x[0] + self._score(x[2], f) - (CHANGE if x[1] and x[1] != s else 0.0))
                step.append((best[0] + self._score(best[2], f) - (CHANGE if best[1] and best[1] != s else 0.0), s, f, best[3] + f))
            states = step
        out = max(states, key=lambda x: x[0] + self._score(x[2], "\x03"))[3]
        if len(self._memo) >= MEMO_WORDS:
            self._memo.clear()
        self._memo[word] = out
        return out

    def form(self, text: str) -> str:
        out = self._words(lambda m: self._path(m[0]), plain(text))
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def bigram_table(table: DataFrame, column: str) -> Counts:
    return fold_counts(word_counts(table, column, SEPARATORS), bigrams)


def add_form(table: DataFrame, column: str, counts: Counts, form: str = "form") -> DataFrame:
    """``table`` with the one form of ``column`` (null for null)."""
    shared = table.sparkSession.sparkContext.broadcast(counts)
    at = table.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = pa.array([None if t is None else forms.form(t) for t in texts], pa.string())
            yield pa.record_batch([*batch.columns, made], names=[*batch.schema.names, form])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, f"{fields}, `{form}` string")


def _members(dirent: DataFrame) -> DataFrame:
    """(image_id, dir_inode, form, entry_id, name) of the (directory, form) groups with different names."""
    named = dirent.where(F.col("name").isNotNull() & ~F.col("name").isin(".", ".."))
    rows = named.select(F.col("entry_id").cast("long").alias("entry_id"), "image_id", "dir_inode", "name")
    formed = cut(add_form(rows, "name", bigram_table(named, "name")))
    key = ["image_id", "dir_inode", "form"]
    groups = formed.groupBy(*key).agg(F.min("name").alias("_a"), F.max("name").alias("_b")).where("_a <> _b").select(*key)
    return cut(formed.join(groups, key, "left_semi").select(*key, "entry_id", "name").distinct())


def look_classes(dirent: DataFrame) -> DataFrame:
    """(entry_id, class_id, form): one row per entry that looks like another of its directory; ``class_id`` is the class's smallest entry. The form that stays linear in a hot directory."""
    members = _members(dirent)
    key = ["image_id", "dir_inode", "form"]
    return members.join(members.groupBy(*key).agg(F.min("entry_id").alias("class_id")), key).select("entry_id", "class_id", "form").distinct()


def same_looking(dirent: DataFrame) -> DataFrame:
    """(entry_id_a, entry_id_b): entries of one directory whose names differ but look the same.

    Only the few (directory, form) groups with different names are joined with themselves; the join key holds the form, and what comes out is what
    is asked for: the group's pairs. ``look_classes`` says the same in one row per entry.
    """
    key = ["image_id", "dir_inode", "form"]
    members = _members(dirent)
    a, b = members.alias("a"), members.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.entry_id") < F.col("b.entry_id"), F.col("a.name") != F.col("b.name")]
    return a.join(b, on).select(F.col("a.entry_id").alias("entry_id_a"), F.col("b.entry_id").alias("entry_id_b")).distinct()
