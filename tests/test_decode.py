"""Column builders against Python's struct and plain arithmetic."""

import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.functions import layout


def _one(spark, raw, *columns):
    return spark.createDataFrame([(bytearray(raw),)], "b binary").select(*columns).first()


def test_integers(spark):
    raws = [bytes((i * 37 + k * 91) & 255 for k in range(16)) for i in range(8)]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "b binary")
    cols = [D.le("b", o, w).alias(f"c{o}_{w}") for o in (0, 3, 8) for w in (1, 2, 4, 8)]
    for raw, row in zip(raws, df.select(*cols, D.be("b", 2, 4).alias("be"), D.signed(D.le("b", 0, 2), 2).alias("s16")).collect()):
        for o in (0, 3, 8):
            for w in (1, 2, 4, 8):
                assert int(row[f"c{o}_{w}"]) == int.from_bytes(raw[o : o + w], "little")
        assert row["be"] == struct.unpack_from(">I", raw, 2)[0]
        assert row["s16"] == struct.unpack_from("<h", raw, 0)[0]


def test_modes(spark):
    modes = [0o100644, 0o040755, 0o120777, 0o060600, 0o020600, 0o140700, 0o010644, 0o104751, 0]
    rows = spark.createDataFrame([(m,) for m in modes], "m bigint").select("m", D.mode_type("m").alias("t"), D.permissions("m").alias("p")).collect()
    want = ["file", "directory", "symlink", "block_device", "character_device", "socket", "fifo", "file", "unknown"]
    assert [r["t"] for r in rows] == want
    for r in rows:
        assert r["p"]["user"]["read"] == bool(r["m"] & 0o400) and r["p"]["other"]["write"] == bool(r["m"] & 0o002) and r["p"]["setuid"] == bool(r["m"] & 0o4000)


def test_text_forms(spark):
    r = spark.range(1).select(
        D.dashed(F.lit("0123456789abcdef0123456789abcdef")).alias("u"), D.human_duration(F.lit(93_789)).alias("d"), D.hex_text(F.lit(0xEF53)).alias("h"),
        D.flag_names(F.lit(0x42), layout.INCOMPAT).alias("n"), D.flag_names(F.lit(0), layout.INCOMPAT).alias("none"), D.masked(F.lit(2), [1, 2, 4]).alias("m"),
        D.c_string(F.lit(b"abc\0def")).alias("c"), D.ceil_div(F.lit(9), 8).alias("q"),
    ).first()
    assert tuple(r) == ("01234567-89ab-cdef-0123-456789abcdef", "26h03m09s", "0xef53", "FILETYPE EXTENTS", "none", [0, 2, 0], "abc", 2)


@settings(max_examples=5, deadline=None)
@given(st.binary(min_size=4, max_size=4))
def test_bits(spark, raw):
    got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "b").select("i", D.bit("b", F.col("i")).alias("v")).collect()
    assert [r["v"] for r in got] == [bool(raw[i >> 3] >> (i & 7) & 1) for i in range(32)]
