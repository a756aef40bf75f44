"""Encodings: round trips, and windows against the byte codecs."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import encoding as c


@given(st.integers(0, 2**63 - 1))
def test_varint(n):
    assert c.varint_decode(c.varint_encode(n)) == (n, len(c.varint_encode(n)))


def test_varint_bytes():
    assert [c.varint_encode(n).hex() for n in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    assert [len(c.varint_encode(n)) for n in (0, 127, 128, 16383, 16384)] == [1, 1, 2, 2, 3]
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            c.varint_decode(bad)
    with pytest.raises(ValueError):
        c.varint_encode(-1)
    assert c.varints_decode(c.varints_encode([0, 5, 300]), 3) == [0, 5, 300]


@given(st.lists(st.integers(0, 3), max_size=60))
def test_runs_of_bytes(values):
    assert c.rle_decode(c.rle_encode(values)) == values
    assert c.pattern_rle_decode(*c.pattern_rle_encode(values)) == values


def test_pattern_runs():
    assert c.pattern_rle_encode([1, 2, 3] * 3) == ("pattern", bytes([0xFF, 3, 1, 2, 3, 3]))
    assert c.pattern_rle_encode([255] * 6)[0] == "pattern" and c.pattern_rle_decode(*c.pattern_rle_encode([255] * 3)) == [255] * 3
    assert c.rle_encode([7] * 70_000, 65_535) == c.varints_encode([7, 65_535, 7, 4_465])


@given(st.lists(st.integers(0, 2**40), max_size=40).map(sorted))
def test_timestamps(values):
    steps = [b - a for a, b in zip(values, values[1:])]
    if all(s < 2**31 for s in steps):
        assert c.timestamps_decode(c.timestamps_encode(values)) == values


def test_timestamp_edges():
    for change in (63, 64, 255, 256, 2047, 2048, -64, -256, -2048):
        values = [10**6, 10**6 + 5000, 10**6 + 10000 + change]
        assert c.timestamps_decode(c.timestamps_encode(values)) == values
    assert len(c.timestamps_encode([1717891200 + i for i in range(10_000)])) == 4 + (64 + 32 + 9998 + 7) // 8


@given(st.binary(max_size=300), st.sampled_from([7, 64, 256]))
def test_block_sorting(data, block):
    assert c.inverse_bwt(c.bwt(data, block)) == data


def test_block_sorting_groups_letters():
    assert c.bwt(b"banana")[8:] == b"nnbaaa"


def frame(spark, values):
    return spark.createDataFrame([("s", i * 3, v) for i, v in enumerate(values)], "source string, log_idx long, ts_ms long")


def test_windows(spark):
    values = [0, 5, 12, 3, 7, 125, 256, 1000, 4, 8, 15, 23]
    coded = c.delta_encode(frame(spark, values))
    assert [r.decoded for r in c.delta_decode(coded).orderBy("log_idx").collect()] == values
    z = [r.z for r in coded.select("log_idx", c.zigzag(F.col("delta")).alias("z")).orderBy("log_idx").collect()]
    assert all(x >= 0 for x in z)
    for n, zz in ((0, 0), (-1, 1), (1, 2), (-64, 127), (64, 128)):
        row = spark.range(1).select(c.zigzag(F.lit(n).cast("long")).alias("z")).select("z", c.unzigzag(F.col("z")).alias("n")).first()
        assert tuple(row) == (zz, n)
    sizes = spark.createDataFrame([(n,) for n in (0, 127, 128, 16383, 16384, -1)], "n long").select(c.varint_size(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == [1, 1, 2, 2, 3, 10]


def test_run_windows(spark):
    values = [1, 1, 2, 2, 2, 1, 3] + [4] * 5
    found = c.runs(frame(spark, values), "ts_ms", cap=3)
    assert [(r.value, r["count"]) for r in found.orderBy("run").collect()] == [(1, 2), (2, 3), (1, 1), (3, 1), (4, 3), (4, 2)]
    assert [r.value for r in c.expand_runs(found).orderBy("place").collect()] == values


def test_dictionary(spark):
    df = frame(spark, [9, 7, 9, 8])
    ids = c.dictionary(df, "ts_ms")
    assert [(r.value, r.id) for r in ids.orderBy("id").collect()] == [(9, 0), (7, 1), (8, 2)]
    coded = c.dictionary_encode(df, "ts_ms").withColumn("ts_ms_id", F.when(F.col("log_idx") == 3, 99).otherwise(F.col("ts_ms_id")))
    assert [r.v for r in c.dictionary_decode(coded, ids, "ts_ms_id", "v").orderBy("log_idx").collect()] == [9, None, 9, 8]


@pytest.mark.parametrize("name", list(c.CODECS))
def test_codec_functions(spark, name):
    encode, decode = c.codec_functions(name)
    df = spark.createDataFrame([([5, 5, 7, 300],), ([],), ([0],)], "v array<long>")
    assert all(r.v == r.back for r in df.select("v", decode(encode("v")).alias("back")).collect())


def test_one_source_is_spread(spark):
    """A long sequence goes through many ranges, and gives what one pass would."""
    from itertools import groupby

    from sparkloom.operators.ordered import SLICE, Ordered, numbered

    rng = random.Random(3)
    rows = [(s, i, rng.randrange(1, 4), rng.randrange(5) if s == "a" else 1) for s in "ab" for i in range(0, 600, 2)]
    df = spark.createDataFrame(rows, "source string, log_idx long, ts_ms long, v int").repartition(5).cache()
    ordered = Ordered(df, slices=7)
    assert ordered.df.where("source = 'a'").select(SLICE).distinct().count() > 2
    got = ordered.running(F.col("ts_ms"), "sum").previous(F.col("v"), "prev").rows().collect()
    for s in "ab":
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.log_idx)
        total, last = 0, None
        for r in mine:
            total += r.ts_ms
            assert r["sum"] == total and (r.prev is None if last is None else r.prev.v == last)
            last = r.v
        values = [r.v for r in mine]
        runs = [(r.value, r["count"]) for r in c.runs(df.where(F.col("source") == s), "v", cap=100).orderBy("run").collect()]
        want = [(v, n) for v, g in groupby(values) for size in [len(list(g))] for n in [100] * (size // 100) + [size % 100] * (size % 100 > 0)]
        assert runs == want
    places = numbered(df, "log_idx", "place").collect()
    assert all(r.place == r.log_idx // 2 for r in places)
    ids = {(r.source, r.value): r.id for r in c.dictionary(df, "v").collect()}
    assert sorted(i for (s, _), i in ids.items() if s == "a") == [0, 1, 2, 3, 4] and ids["b", 1] == 0
    assert numbered(df.limit(0), "log_idx", "place").count() == 0


def test_roundtrips_of_odd_events(spark, tmp_path):
    """Nulls are not coded, long names are, and blocks are read many at a time."""
    from sparkloom import queries

    rows = [(0, 1, "2024-01-01 00:00:00", "view"), (1, 1, None, None), (2, 1, "2024-01-01 00:00:09", "x" * 300), (4096, 1, "2024-01-02 00:00:00", "click"), (3, None, "2024-01-01 00:00:00", "view")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = queries.codec_roundtrips(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 0, 3, True), (1, 1, 1, True), (None, 0, 1, True)], key=str)
    assert "GroupsInPandas" not in found._jdf.queryExecution().toString()


def test_block_sorting_of_short_blocks():
    """Blocks of either way of sorting give the same bytes."""
    rng = random.Random(3)
    cases = [bytes(rng.choice(b"ab") for _ in range(n)) for n in range(c.SHORT_BLOCK + 1)]
    short, c.SHORT_BLOCK = c.SHORT_BLOCK, 0
    try:
        want = [c.bwt(x) for x in cases]
    finally:
        c.SHORT_BLOCK = short
    assert [c.bwt(x) for x in cases] == want
    assert [c.inverse_bwt(c.bwt(x)) for x in cases] == cases
