from pyspark.sql import functions as F

from tidemark import functions as fn

FT = 116_444_736_000_000_000


def lit(v):
    return F.lit(v).cast("bigint") if v is None or isinstance(v, int) else F.lit(v)


def test_filetime(one):
    given = [FT, FT + 1, FT + 10_000_000, 1_577_836_800 * 10_000_000 + FT, 0, FT - 1, None, -5, 2**63 - 1]
    want = [0, 100, 1_000_000_000, 1_577_836_800 * 10**9, 0, 0, 0, 0, 0]
    assert one(*[fn.filetime_to_ns(lit(g)) for g in given]) == want
    a, b = one(fn.filetime_to_ns(lit(133499040000000000)), fn.filetime_to_ns(lit(133499040000000001)))
    assert b - a == 100
    assert one(fn.filetime_to_ns(lit(FT + 72_581_184_000_000_001), fn.YEAR_2200_NS)) == 0


def test_browser_and_unix_times(one):
    e = 11_644_473_600_000_000
    assert one(*[fn.webkit_us_to_ns(lit(v)) for v in (e + 1, e, e - 1, 0, None, 2**63 - 1)]) == [1000, 0, 0, 0, 0, 0]
    assert one(*[fn.unix_us_to_ns(lit(v)) for v in (5, 0, -1, None)]) == [5000, 0, 0, 0]
    assert one(*[fn.unix_s_to_ns(lit(v)) for v in (5, 0, -1, None, 10**12)]) == [5 * 10**9, 0, 0, 0, 0]


def test_ole(one):
    assert one(*[fn.ole_to_ns(F.lit(v)) for v in (25570.0, 25569.0, 0.0, 1.0, 120001.0)]) == [86_400 * 10**9, 0, 0, 0, 0]
    import struct
    bits = struct.unpack("<q", struct.pack("<d", 45000.75))[0]
    want = int((45000.75 - 25569.0) * 86400.0 * 1e9)
    assert one(fn.srum_time_to_ns(F.lit(None).cast("double"), lit(bits))) == want
    assert one(fn.srum_time_to_ns(F.lit(45000.75), lit(FT))) == want
    assert one(fn.srum_time_to_ns(F.lit(0.0), lit(FT + 7))) == 700


def test_text_times(one):
    base = 1_673_778_600 * 10**9
    assert one(*[fn.parse_text_ts(F.lit(v)) for v in ("2023-01-15 10:30:00", " 2023-1-15 10:30:00.5 ", "2023-02-30 00:00:00", "x", "")]) == [
        base, base + 500_000_000, 0, 0, 0]
    assert one(*[fn.parse_iso_ts(F.lit(v)) for v in ("2023-01-15T10:30:00.1234567Z", "2023-01-15T10:30", "2023-01-15", "")]) == [
        base + 123_456_700, base, 0, 0]
    assert one(*[fn.parse_wmi_ts(F.lit(v)) for v in ("20230115103000.000001+060", "20230115103000.000000-120", "2023")]) == [
        base + 1000 - 3600 * 10**9, base + 7200 * 10**9, 0]


def test_iso(one):
    given = [0, 1_577_836_800 * 10**9, 1, 1_577_836_800_123_456_700, None]
    assert one(*[fn.ns_to_iso(lit(g)) for g in given]) == [
        "1970-01-01T00:00:00Z", "2020-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "2020-01-01T00:00:00.1234567Z", None]
    assert one(fn.ns_to_iso(F.lit("1" + "0" * 30).cast("decimal(38,0)"))) == "1601-01-01T00:00:00Z"
    assert one(*[fn.clamp_ns(lit(v)) for v in (None, -1, 7)]) == [0, 0, 7]


def test_srum_time_columns_beside_each_other(one):
    """A usable double wins over bits and FILETIME; one out of range leaves the row to them."""
    bits = (1023 + 15) << 52
    of = lambda days: int((days - 25569.0) * 86400.0 * 1e9)
    assert one(fn.srum_time_to_ns(F.lit(45000.75), lit(bits))) == of(45000.75)
    assert one(fn.srum_time_to_ns(F.lit(120001.0), lit(bits))) == of(32768.0)
    assert one(fn.srum_time_to_ns(F.lit(120001.0), lit(None))) == 0


def test_srum_times_beyond_the_greatest_day(spark, tmp_path):
    import duckdb
    from __spark_entry__ import oracle_sql, queries
    path = f"{tmp_path}/events.parquet"
    spark.range(79_980, 80_070, 1, 1).selectExpr("id AS event_id", "timestamp_micros(1700000000000000L + id) AS ts").write.parquet(path)
    want = duckdb.sql(oracle_sql()["srum_times"].replace("FROM events", f"FROM '{path}/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries()["srum_times"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
