import random

import pytest
from pyspark.sql import functions as F

from blockloom.llm import spans


def _brute(rows, length):
    docs = {}
    for i, t in rows:
        if t is not None:
            docs[i] = min(docs.get(i, t), t)
    where = {}
    for i, t in docs.items():
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], set()).add(i)
    out = set()
    for i, t in docs.items():
        run = None
        for s in range(len(t) - length + 1):
            if len(where[t[s : s + length]]) > 1:
                if run and s <= run[1]:
                    run[1] = s + length
                else:
                    if run:
                        out.add((i, *run))
                    run = [s, s + length]
        if run:
            out.add((i, *run))
    return out


def _corpus(seed, n, letters):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    pool = [make(rng.randint(100, 900)) for _ in range(8)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            part = list(p[a : rng.randint(a, len(p))])
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(letters)
            t += "".join(part) + make(rng.randint(0, 60))
        rows.append((i, rng.choice([t, t, t, t, None, ""]) if i % 9 == 0 else t))
    return rows + [rows[1], (7001, "x" * 2000), (7002, "x" * 900 + "y"), (7003, " \n" * 400), (7004, "é" * 319), (7005, pool[0] * 40)]


@pytest.mark.parametrize("seed,length,letters,hot", [(1, 320, "abcdefgh \n", 5000), (2, 100, "ab", 5000), (3, 320, "abéж議😀 ", 1), (4, 64, "abcd ", 0)])
def test_against_brute_force(spark, seed, length, letters, hot):
    rows = _corpus(seed, 60, letters)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, start int, n int")
    got = [tuple(r) for r in spans.shared_spans(df, length, hot_variants=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows, length)


def test_prefilter_never_loses(spark):
    """A sketch far too narrow passes more, and the result is the same."""
    rows = _corpus(9, 40, "abcdef ")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    narrow, wide = (set(map(tuple, spans.shared_spans(df, 320, bits=b).collect())) for b in (4, 20))
    assert narrow == wide == _brute(rows, 320)


def test_prefilter_share_does_not_grow(spark):
    """At any size about 1 segment in CELLS passes by chance, and every repeated one passes."""
    rng = random.Random(12)
    copy = "".join(rng.choice("abcdefgh ") for _ in range(700))
    for n in (20, 200, 1500):
        rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(900)) + (copy if i % 50 == 0 else "")) for i in range(n)]
        seg = spans.cut(spans.segment_table(spark.createDataFrame(rows, "doc_id bigint, text string")))
        kept = spans.estimated_repeated(seg)
        repeated = seg.groupBy("anchor").agg(F.countDistinct("doc_id").alias("k")).where("k > 1").select("anchor")
        true = seg.join(repeated, "anchor", "left_semi")
        assert true.join(kept, ["anchor", "doc_id", "start"], "left_anti").count() == 0
        by_chance = kept.count() - true.count()
        assert by_chance <= 0.02 * seg.count()
        # a sketch seven times too narrow for its corpus passes most segments in vain
        crowded = spans.estimated_repeated(seg, max(1, (seg.count() // 7).bit_length() - 1))
        assert crowded.count() > 0.9 * seg.count() and true.join(crowded, ["anchor", "doc_id", "start"], "left_anti").count() == 0


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_spans(empty).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 319), (4, "a" * 319)], "doc_id bigint, text string")
    assert spans.shared_spans(df).count() == 0
    share = spans.shared_share(df, spans.shared_spans(df)).orderBy("doc_id").collect()
    assert [tuple(r) for r in share] == [(1, 0, 0), (2, 0, 0), (3, 0, 319), (4, 0, 319)]


def test_segments_agree_with_windows():
    """Every window has the anchor of its segment: the smallest gram hash inside it."""
    import numpy as np

    from blockloom.llm.textbatch import Flat

    rng = random.Random(4)
    flat = Flat(["".join(rng.choice("ab c") for _ in range(k)) for k in (0, 500, 320, 10, 900)])
    anchor, doc, at, n = spans.segments(flat, 320)
    h = flat.hashes(slice(0, len(flat.code) - spans.GRAM + 1), spans.GRAM)
    seen = 0
    for a, d, s, k in zip(anchor, doc, at, n):
        for w in range(s, s + k):
            assert flat.start[d] <= w and w + 320 <= flat.start[d + 1]
            assert np.min(h[w : w + 320 - spans.GRAM + 1]) == a
            seen += 1
    assert seen == 181 + 1 + 581
