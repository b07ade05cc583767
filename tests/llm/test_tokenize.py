import os
import random

import pytest

from blockloom.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary files")
TEXTS = [
    "", " ", "\n\n  \t", "don't  stop", "  a  b\n\n c<|endoftext|>x", "Zürich 12345 ½ — “quoted”", "ａｂｃ 議事録 Ελλάδα Журнал", "a" * 5000, "ab" * 700, " " * 333, "👩‍👩‍👧 ​﻿­",
    "committee of the harbour " * 400, "é́́ \x00\x01", "'s 'S 'll've",
]


def _reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.VOCABULARY)
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_against_library(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeinorst éßжλ\n-1,") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    want = _reference()(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(9000, None, "x"), (3, texts[3], "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_corpus(df).collect()}
    assert len(got) == len(texts) + 1 and tokenize.encode_corpus(df).count() == len(texts) + 1
    assert got[9000] == [] and got[0] == []
    assert all(got[i] == w for i, w in enumerate(want))
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


def test_prefix_table():
    v = tokenize.encoder(tokenize.VOCABULARY).v
    whole = tokenize.PrefixTable(v, b"lighthouses")
    grown = tokenize.PrefixTable(v, b"light").append(b"hou").append(b"ses")
    assert grown.tokens() == whole.tokens() and grown.last == whole.last
    assert b"".join({t: b for b, t in v.ids.items()}[t] for t in whole.tokens()) == b"lighthouses"
    edited = tokenize.PrefixTable(v, b"lighthouses").edit(5, 10, b"weight")
    assert edited.tokens() == tokenize.PrefixTable(v, b"lightweights").tokens()
    for n in range(1, 12):
        assert tokenize.PrefixTable(v, b"lighthouses"[:n]).tokens() == grown.edit(0, len(grown.data), b"lighthouses"[:n]).tokens()


def test_edits_near_and_far(spark):
    """Ids after an edit or an append are those of the new text."""
    rng = random.Random(8)
    e = tokenize.encoder(tokenize.VOCABULARY)
    pool = [t for t in TEXTS if t] + ["word, word's  end. " * 300, "x" * 9000 + " y", "no blanks at all".replace(" ", "")]
    rows, edits, want = [], [], {}
    for k in range(300):
        t = rng.choice(pool)
        b = rng.choice([0, len(t), rng.randint(0, len(t))])
        n = rng.choice([b, min(len(t), b + rng.randint(0, 9)), len(t)])
        new = rng.choice(["", " ", "s", " more text", "\n\n", "'s", "é1", "  two"])
        rows.append((k, t))
        edits.append((k, b, n, new))
        want[k] = (t[:b] + new + t[n:], e.encode(t[:b] + new + t[n:]))
        assert e.edit(t, e.encode(t), b, n, new) == want[k], (t[:60], b, n, new)
    rows += [(1000, None), (1001, ""), (1002, "kept")]
    edits += [(1000, 0, 0, "now text"), (1001, 5, 9, "now text"), edits[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = tokenize.encode_edited(docs, tokenize.encode_corpus(docs), spark.createDataFrame(edits, "doc_id bigint, begin bigint, end bigint, new string")).collect()
    want |= {1000: ("now text", e.encode("now text")), 1001: ("now text", e.encode("now text"))}
    assert len(got) == len(want) and {r["doc_id"]: (r["text"], r["ids"]) for r in got} == want


def test_every_token_is_its_own_encoding():
    """What lets a piece that is a token skip the table: the table gives just that token."""
    v = tokenize.encoder(tokenize.VOCABULARY).v
    for raw, t in list(v.ids.items())[::97]:
        assert tokenize.PrefixTable(v, raw).tokens() == [t]
