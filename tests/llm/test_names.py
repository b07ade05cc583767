"""Garbled and look-alike names."""

import collections
import itertools
import random
import re
import unicodedata

import numpy as np

from blockloom.llm import garbled, lookalikes
from blockloom.llm.ngrams import Counts, fold_counts, trigrams

WORDS = ["canción", "année", "Größe", "Журнал", "отчет", "список", "報告書", "議事録", "Ελλάδα", "łódź", "São", "naïve", "niño", "forêt", "MÃO", "ÎLE", "СПИСОК", "report", "index", "survey"]


def _names():
    return [f"{w}_{k:04d}.txt" for w in WORDS for k in range(150)]


def _garble(text, wrote, read):
    return text.encode(wrote).decode(read)


def test_garbled(spark):
    good = _names()
    bad = {
        _garble("canción_7.txt", "utf-8", "latin-1"): "canción_7.txt",
        _garble("année_8.txt", "utf-8", "cp437"): "année_8.txt",
        _garble("Größe (3).txt", "utf-8", "mac-roman"): "Größe (3).txt",
        _garble("отчет-9.doc", "cp1251", "koi8-r"): "отчет-9.doc",
        _garble("список-9.doc", "cp866", "cp1251"): "список-9.doc",
        _garble("Журнал-9.doc", "cp1251", "latin-1"): "Журнал-9.doc",
        _garble(_garble("niño 5", "utf-8", "latin-1"), "utf-8", "latin-1"): "niño 5",
        _garble("報告書_1", "utf-8", "latin-1"): "報告書_1",
        "forêt S" + _garble("ã", "utf-8", "cp1252") + "o_77": "forêt São_77",
        "r�port_4.txt": None,
    }
    rows = [(i, n, "x") for i, n in enumerate(good)] + [(10_000 + i, n, "x") for i, n in enumerate(bad)] + [(20_000, None, "x"), (20_001, "", "x"), (20_002, "plain.txt", "x"), (10_000, next(iter(bad)), "x")]
    got = garbled.repair_names(spark.createDataFrame(rows, "entry_id bigint, name string, restored string")).collect()
    assert sorted(r["entry_id"] for r in got) == [10_000 + i for i in range(len(bad))]
    assert {r["name"]: r["restored"] for r in got} == bad
    assert garbled.repair_names(spark.createDataFrame([], "entry_id bigint, name string")).count() == 0


def test_restores_planted_originals():
    """Clean names garbled in many ways, among a column that has both: found and restored, and no clean name touched."""
    rng = random.Random(6)
    clean = _names()
    ways = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "latin-1")]
    planted = {}
    for n in rng.sample(clean, 900):
        wrote, read = rng.choice(ways)
        try:
            bad = _garble(n, wrote, read)
            if rng.random() < 0.2:
                bad = _garble(bad, "utf-8", rng.choice(["latin-1", "cp1252"]))
        except UnicodeError:
            continue
        if bad != n:
            planted[bad] = n
    grams = collections.Counter(g for n in [*clean, *planted] for w in re.split(garbled.SEPARATORS, n) if w for g in trigrams(w))
    r = garbled.Repair(Counts.of(grams))
    assert len(planted) > 300
    assert not [n for n in clean if r.name(n)[0]]
    found = [bad for bad in planted if r.name(bad)[0]]
    assert len(found) >= 0.99 * len(planted), set(planted) - set(found)
    assert sum(r.name(bad)[1] == n for bad, n in planted.items()) >= 0.98 * len(planted)


def test_nothing_is_left_out_for_its_rank():
    """A right repair behind better-looking wrong ones of the first layer is reached in the second."""
    grams = collections.Counter(g for n in _names() for w in re.split(garbled.SEPARATORS, n) if w for g in trigrams(w))
    r = garbled.Repair(Counts.of(grams))
    for word in ("Größe", "報告書", "Журнал"):
        for read in ("latin-1", "cp1252", "cp437", "cp850"):
            try:
                bad = _garble(_garble(word, "utf-8", read), "utf-8", "latin-1")
            except UnicodeError:
                continue
            assert r.word(bad) == (True, word), (bad, word)


def test_counts_beyond_the_bound(spark):
    """Where there are too many n-grams the commonest are held exactly and none is underestimated."""
    words = spark.createDataFrame([(f"w{i:05d}", 1 + i % 7 if i else 500) for i in range(3000)], "word string, n bigint")
    exact = collections.Counter()
    for r in words.collect():
        for g in trigrams(r["word"]):
            exact[g] += r["n"]
    for most in (10**6, 300, 0):
        c = fold_counts(words, trigrams, most)
        assert len(c.grams) <= max(most, 0) and (most < 10**6 or c.used == 0)
        assert all(c[g] >= 0.999 * n for g, n in exact.items())
    assert fold_counts(words.limit(0), trigrams)["abc"] == 0


def test_invisible_characters_are_not_garbled():
    r = garbled.Repair(Counts.of({}))
    for w in ("in\xaddex", "\xad", "notes\xa0", "​", "ｉｎｄｅｘ", "indеx"):
        assert not r.word(w)[0], w


def test_long_name(spark):
    text = "canción " * 20_000 + _garble("canción", "utf-8", "latin-1")
    rows = [(i, n) for i, n in enumerate(_names())] + [(99_999, text)]
    got = garbled.repair_names(spark.createDataFrame(rows, "entry_id bigint, name string")).collect()
    assert [(r["entry_id"], r["restored"]) for r in got] == [(99_999, "canción " * 20_000 + "canción")]


def _skeleton(t):
    """Plain look-alike folding, without lattices."""
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Cf")
    t = "".join("-" if ord(c) in lookalikes.HYPHENS else " " if unicodedata.category(c) == "Zs" else c for c in t)
    return unicodedata.normalize("NFC", "".join(next((f for f in lookalikes.CLASSES.get(c, (c,)) if f), c) for c in unicodedata.normalize("NFKD", t)))


ALIKE = [
    ["summary 12.txt", "ѕummаrу 12.txt", "ｓｕｍｍａｒｙ 12.txt", "sum​mary 12.txt"], ["café-1", "café-1", "cafe‍́‑1"], ["READМЕ", "README", "RΕАDΜE"], ["отчет", "oтчeт", "отчeт"],
    ["Ελλάδα", "Ελλαδα"], ["index", "Index"], ["l1", "ll"], ["O0", "OO"], ["pages 1–5", "pages 1-5"], ["cop", "сор", "ϲop"], [".", "․"], ["", "​"],
]


def test_same_looking(spark):
    rows, k = [], 0
    for img, folder in (("a", 2), ("a", 3), ("b", 2)):
        for names in ALIKE:
            for n in names[: len(names) if folder == 2 else 1]:
                k += 1
                rows.append((k, img, folder, n, "f"))
    rows += [(900, "a", 2, None, "f"), (901, "a", 2, "index", "f"), (902, "a", 2, "..", "f"), rows[1], (903, "a", 2, "summary 12.txt", "f"), (904, "a", 9, "x" * 50_000, "f"), (905, "a", 9, "х" + "x" * 49_999, "f")]
    df = spark.createDataFrame(rows, "entry_id bigint, image_id string, dir_inode bigint, name string, form string")
    got = [tuple(r) for r in lookalikes.same_looking(df).collect()]
    by = {}
    for e, img, folder, n, _ in set(rows):
        if n is not None and n not in (".", ".."):
            by.setdefault((img, folder, _skeleton(n)), set()).add((e, n))
    want = {(min(x, y)[0], max(x, y)[0]) for g in by.values() for x, y in itertools.combinations(sorted(g), 2) if x[1] != y[1]}
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalikes.same_looking(df.limit(0)).count() == 0
    classes = {r["entry_id"]: r["class_id"] for r in lookalikes.look_classes(df).collect()}
    assert set(classes) == {e for p in want for e in p}
    assert all(classes[a] == classes[b] for a, b in want) and all(c <= e for e, c in classes.items())


def test_form_depends_on_the_look_alone():
    rng = np.random.default_rng(0)
    letters = "\x02\x03copyрhоtоΑΒΕexposé" + lookalikes.LATIN + lookalikes.CYRILLIC + lookalikes.GREEK
    forms = lookalikes.Forms(Counts.of({"b" + a + b: int(rng.integers(0, 50)) for a in letters for b in letters}))
    for word in ("copy", "рhоtо", "ΑΒΕ", "exposé"):
        options = [[f for f in lookalikes.CLASSES.get(c, (c,)) if f] for c in unicodedata.normalize("NFD", word)]
        assert len({forms.form("".join(p)) for p in itertools.product(*options)}) == 1
