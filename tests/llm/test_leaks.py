import itertools
import random

import numpy as np
import pyarrow as pa

from blockloom.llm import leaks
from blockloom.llm.textbatch import Flat

WORDS = "harbour committee the of and lighthouse silver turnip vestry organ barley constable reward drainage football herring candle police annual weather theatre Kerthal Brilin Müller été mañana".split()
WORDS += ["".join(p) for p in itertools.product(("ker", "wick", "stan", "bri", "gan", "mor", "thal", "pen"), ("ford", "ley", "combe", "ton", "", "low", "dra"), ("", "hal", "gate"))]
BOX = "line_boxes array<struct<line_no int, x0 int, y0 int, x1 int, y1 int, conf float>>"


def _noise(rng, text, rate):
    out = []
    for c in text:
        r = rng.random()
        if c.isalpha() and r < rate:
            out.append(rng.choice(["", c + "i", rng.choice("abcdeilo1ſ")]))
        else:
            out.append(c)
    return "".join(out)


def _lines(rng, words, width=32):
    """Lines of a column, long words broken with several marks."""
    out, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > width:
            if len(w) > 6 and rng.random() < 0.5:
                out.append(f"{line} {w[:3]}{rng.choice('-¬­')}".strip())
                line = w[3:]
                continue
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def _page(rng, words, interleaved):
    columns = [_lines(rng, words[k::1][: len(words) // 2] if k == 0 else words[len(words) // 2 :]) for k in (0, 1)]
    rows = [(c, i, t) for c, ls in enumerate(columns) for i, t in enumerate(ls)]
    if interleaved:
        rows.sort(key=lambda r: (r[1], r[0]))
    boxes = [(n, 110 + 500 * c + rng.randint(-4, 4), 180 + 33 * i + rng.randint(-4, 4), 0, 0, None) for n, (c, i, _) in enumerate(rows)]
    return "\n".join(t for _, _, t in rows), boxes


def test_planted(spark):
    rng = random.Random(11)
    # every item draws on words of its own as well, so that short runs of common words are no passage
    items = [(k, " ".join(rng.choice(WORDS) + (rng.choice(["", ".", ","])) for _ in range(30))) for k in range(1, 21)]
    rows, want, not_want = [], set(), set()
    for d in range(120):
        filler = lambda n: [rng.choice(WORDS) for _ in range(n)]
        k, n = rng.randint(1, 20), rng.choice([0, 5, 8, 14, 20, 30])
        words = items[k - 1][1].split()
        a = rng.randint(0, 30 - n)
        page = [*filler(40), *(w.upper() if d % 5 == 0 else w for w in words[a : a + n]), *filler(40)]
        text, boxes = _page(rng, page, d % 2 == 0)
        text = "\n".join(_noise(rng, line, 0.02) for line in text.split("\n"))
        rows.append((d, text, boxes, 7))
        if n >= 14:
            want.add((d, k))
        elif n <= 8:
            not_want.add((d, k))
    rows += [(900, None, None, 0), (901, "", [], 0), (902, " \n ", None, 0), (903, "word " * 40_000 + items[0][1], None, 0), rows[3]]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {BOX}, item_id int")
    evals = spark.createDataFrame([*items, items[0], (77, None), (78, ""), (79, "ab")], "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, evals).collect()]
    assert len(got) == len(set(got))
    assert (want | {(903, 1)}) - set(got) == set()
    assert set(got) & not_want == set()


def test_other_words_end_a_run(spark):
    """Passages with words put in the place of the item's are no leak unless twelve in a row are left."""
    rng = random.Random(7)
    items = [(k, " ".join(rng.sample(WORDS, 30))) for k in range(1, 11)]
    rows, want = [], set()
    for d in range(60):
        k, every = rng.randint(1, 10), rng.choice([4, 6, 8, 14, 15])
        words = [("zuqqox" if len(w) < 6 else "ypz") if (i + 1) % every == 0 else w for i, w in enumerate(items[k - 1][1].split())]
        rows.append((d, " ".join(rng.choice(WORDS) for _ in range(30)) + "\n" + " ".join(words) + "\nend"))
        if every > 12:
            want.add((d, k))
    docs, evals = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, evals).collect()}
    assert got == want


def test_edges(spark):
    docs = spark.createDataFrame([], f"doc_id bigint, text string, {BOX}")
    evals = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.find_leaks(docs, evals).count() == 0
    one = spark.createDataFrame([(1, "some page of text")], "doc_id bigint, text string")
    assert leaks.find_leaks(one, evals).count() == 0
    assert leaks.find_leaks(one.limit(0), spark.createDataFrame([(1, "x " * 20)], "item_id bigint, text string")).count() == 0


def _misread(rng, words, n):
    """``n`` letters of a passage read as others, dropped or doubled."""
    text = list(" ".join(words))
    for k in rng.sample([i for i, c in enumerate(text) if c != " "], n):
        text[k] = rng.choice(["q" if text[k] != "q" else "z"] * 3 + [text[k] * 2])
    return "".join(text)


def test_short_words_and_misread_letters(spark):
    """Twelve words of 24 letters with up to three letters misread, thirteen of 42 with five, one-letter words, and an edit budget used up everywhere."""
    rng = random.Random(23)
    two = ["".join(p) for p in itertools.product("abcdefghiklmnoprstu", repeat=2)]
    rows, items, want = [], [], set()
    for k in range(60):
        if k % 3 == 0:
            words = rng.sample(two, 12)
            bad = 1 + k // 3 % 3
        elif k % 3 == 1:
            words = [w + rng.choice(["", "x"]) for w in rng.sample(two, 13)]
            while sum(map(len, words)) < 42:
                i = rng.randrange(13)
                words[i] += rng.choice("aeiou")
            bad = 5 if sum(map(len, words)) == 42 else 4
        else:
            words = rng.sample(WORDS, 12)
            bad = sum(map(len, words)) // leaks.LETTERS_PER_EDIT
        items.append((k, " ".join(words)))
        text = " ".join(words)
        while True:  # a word is there with two letters in five misread, or one of a short word
            spoilt = _misread(rng, words, bad)
            if all(abs(len(a) - len(b)) + sum(x != y for x, y in zip(a, b)) <= max(1, int(0.4 * len(a))) for a, b in zip(words, spoilt.split())):
                break
        filler = lambda: " ".join(rng.choice(WORDS) for _ in range(40))
        rows.append((k, f"{filler()} {spoilt}\n{filler()}"))
        rows.append((1000 + k, f"{filler()} {' '.join(text.split()[:8])}\n{filler()}"))
        want.add((k, k))
    docs, evals = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, evals).collect()}
    assert want - got == set()
    assert {p for p in got if p[0] >= 1000} == set()


def test_long_items_and_far_letters(spark):
    rng = random.Random(5)
    long = [rng.choice(WORDS) + rng.choice(["", "n", "rd", "st"]) for _ in range(14_000)]
    item = " ".join(long)
    assert len(item.replace(" ", "")) > 70_000
    gothic = "".join(chr(0x10330 + rng.randrange(20)) + (" " if i % 4 == 3 else "") for i in range(14 * 4)).strip()
    capitals = "".join(chr(0x10400 + rng.randrange(39)) + (" " if i % 5 == 4 else "") for i in range(14 * 5)).strip()
    rows = [(1, "so " * 50 + " ".join(long[:20])), (2, " ".join(long[-20:])), (3, gothic), (4, "x " * 9 + capitals.lower()), (5, " ".join(long[5000:5008])), (6, " ".join(long[7000:7015]).upper())]
    evals = spark.createDataFrame([(1, item), (2, gothic), (3, capitals)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), evals).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3), (6, 1)}


def _found(items, texts):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    d, i, w = leaks.find_in(items, Flat(texts), batch)
    return {(int(a), int(items.ids[b])): int(c) for a, b, c in zip(d, i, w) if c >= leaks.MIN_WORDS}


def test_pieces_and_blocks_change_nothing(spark, monkeypatch):
    """Few hits at a time, or one item a block, give the same leaks."""
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(WORDS[:40]) for _ in range(40))) for k in range(12)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) + " " + " ".join(rows[k % 12][1].split()[k % 20 :][:13]) + " wharf" * (k % 3) for k in range(24)] + ["the of and " * 300 + rows[3][1]]
    at_once = _found(leaks.Items(rows), texts)
    assert len(at_once) >= 25
    monkeypatch.setattr(leaks, "HITS_AT_ONCE", 50)
    assert set(_found(leaks.Items(rows), texts)) == set(at_once)
    monkeypatch.setattr(leaks, "COMMON", 0)
    monkeypatch.setattr(leaks, "SPARED", leaks.LEAST_BOUND)
    assert set(_found(leaks.Items(rows), texts)) == set(at_once)
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 300)
    got = leaks.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(rows, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == set(at_once)


def _brute_run(words, page, low, width):
    """Longest run of words there, by trying every way of every word."""
    n = len(page)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w))

    def ends(word, at, place):
        """Places where ``word``, begun at page place ``place``, may end with few enough edits, inside the band."""
        may = max(1, int(leaks.WORD_EDITS * len(word)))
        layer = {(0, place, 0)}
        seen, out = set(layer), set()
        while layer:
            nxt = set()
            for i, p, e in layer:
                if i == len(word):
                    out.add(p)
                steps = [(i, p + 1, e + 1)] if p < n else []
                if i < len(word):
                    if p < n:
                        steps.append((i + 1, p + 1, e + (page[p] != word[i])))
                    if len(word) > 1:
                        steps.append((i + 1, p, e + 1))
                for s in steps:
                    if s[2] <= may and 0 <= s[1] - (at + s[0]) - low < width and s not in seen:
                        seen.add(s)
                        nxt.add(s)
            layer = nxt
        return out

    best = 0
    reach = {}
    for k, w in enumerate(words):
        now = {}
        for p in range(max(0, starts[k] + low), min(n, starts[k] + low + width - 1) + 1):
            run = max([reach.get(p - s, 0) for s in range(leaks.STRAY + 1)])
            for q in ends(w, starts[k], p):
                now[q] = max(now.get(q, 0), run + 1)
        reach = now
        best = max([best, *now.values()])
    return best


def test_scores_bound_every_passage():
    """A window with as many edits as it may have scores what the filter asks, whatever edits they are."""
    rng = random.Random(31)
    code = lambda t: leaks.fold(np.frombuffer(t.encode("utf-32-le"), np.uint32))
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 4, 6, 9]))) for _ in range(14)]
        items = leaks.Items([(1, " ".join(words))])
        first, last, budget = items.window[0][rng.randrange(len(items.window[0]))]
        page = list("".join(words)[first:last])
        for _ in range(budget):
            k = rng.randrange(len(page))
            page[k] = rng.choice(["", "z", page[k] + "y"])
        page = code("q" * 20 + "".join(page) + "q" * 20)
        one, m = np.array([0]), len(items.letters)
        bits = int(items.bits[0])
        low = np.array([20 - first - (2 << bits)])
        assert leaks._scores(items, one, one, np.array([m]), low, page, one, np.array([len(page)]), 4 << bits)[0] >= items.least_score[0]


def test_word_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 6]))) for _ in range(rng.randint(2, 7))]
        page = list("".join(words))
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(page) + 1)
            page[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "b", "cc"])
        page = rng.choice(["", "ab", "cacab"]) + "".join(page) + rng.choice(["", "bca"])
        items = leaks.Items([(1, " ".join(words))])
        code = lambda t: leaks.fold(np.frombuffer(t.encode("utf-32-le"), np.uint32))
        m, one = len(items.letters), np.array([0])
        got = leaks._banded(items, one, one, np.array([m]), np.array([-8]), code(page), one, np.array([len(page)]), 16, True)
        assert got[0] == _brute_run(words, page, -8, 16), (words, page)
