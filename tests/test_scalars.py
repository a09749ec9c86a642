"""Column functions on literal fixtures."""

import math

from pyspark.sql import functions as F

from tablegauge.functions import scalars as S


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_to_int(spark):
    assert values(spark, ["12", "1.5", "1e3", "0x1F", "abc", "", None, " 7 ", "-3"], S.text_to_int) == [12, 1, 0, 31, 0, 0, 0, 7, -3]


def test_hex_to_int_leaves_other_texts(spark):
    assert values(spark, ["0x1F", "0Xff", "12", None], S.hex_to_int) == ["31", "255", "12", None]


def test_kmg(spark):
    assert values(spark, ["1.5K", "2M", "3.2G", "12%", " 4 ", "9000", "n/a", None], S.kmg_to_number) == [1500.0, 2e6, 3.2e9, 0.12, 4.0, 9000.0, None, None]


def test_expand_suffix_keeps_the_value(spark):
    assert values(spark, ["5K", "12%", "1.5K", "x"], S.expand_suffix) == ["5000", "0.12", "1500", "x"]


def test_ports(spark):
    rows = [None, -1.0, 0.0, 20.0, 22.0, 80.0, 255.0, 256.0, 443.0, 1023.0, 1024.0, 1883.0, 49151.0, 49152.0, 57343.0, 57344.0, 65535.0, 65536.0]
    got = values(spark, rows, S.port_service, "double")
    assert got[0] == got[1] == got[-1] == "Other"
    assert (got[3], got[4], got[5], got[8], got[11]) == ("FTP-Data", "SSH", "HTTP", "HTTPS", "MQTT")
    assert got[12] == "Registered_1024_49151" and got[13] == got[14] == "Dynamic_49152_57343" and got[15] == got[16] == "Dynamic_57344_65535"


def test_rounding_half_even(spark):
    assert values(spark, [0.0005, 0.0015, 2.5], lambda x: S.round_half_even(x), "double") == [0.0, 0.002, 2.5]


def test_latency_exponent(spark):
    assert values(spark, [None, 0.0, -1.0, 3e-7, 12.0], S.latency_exponent, "double") == ["NaN", "NaN", "NaN", "-7", "1"]


def test_entropy_and_row_mean(spark):
    df = spark.createDataFrame([([0.5, 0.5], 1.0, None), ([1.0, 0.0], 2.0, 4.0)], "p array<double>, a double, b double")
    rows = df.select(S.entropy(F.col("p")).alias("h"), S.row_mean("a", "b").alias("m")).collect()
    assert math.isclose(rows[0]["h"], math.log(2), abs_tol=1e-6) and abs(rows[1]["h"]) < 1e-6
    assert [r["m"] for r in rows] == [1.0, 3.0]


def test_addresses(spark):
    from tablegauge.operators.profile import is_ip, is_mac

    assert values(spark, ["10.0.0.1", " 255.255.255.255 ", "::1", "2001:db8:0:0:0:0:0:1", "256.1.1.1", "1.2.3", "x"], is_ip) == [True, True, True, True, False, False, False]
    assert values(spark, ["00:1A:2b:3c:4d:5e", "00-1a-2b-3c-4d-5e", "00_1a_2b_3c_4d_5e", "001a2b3c4d5e", "00:1a:2b", "zz"], is_mac) == [True, True, True, True, False, False]


def test_comma_decimal_and_elapsed(spark):
    assert values(spark, ["1,5", "2", "x", None], S.comma_decimal) == [1.5, 2.0, None, None]
    df = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:01:00.5' b")
    assert df.select(S.elapsed_seconds(F.col("a"), F.col("b"))).first()[0] == 60.5


def test_quantiles_of_a_table_do_not_deal_rows_by_their_column(spark):
    """However small a table may be for a broadcast, no join gives one task all values of a column."""
    from tablegauge.operators.ordering import quantiles

    rows = spark.range(1000).selectExpr("double(id) as a", "double(id % 10) as b")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles(rows, ["a", "b"], [0.25, 0.5])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {r["feature"]: r["q"] for r in out.collect()} == {"a": [249.75, 499.5], "b": [2.0, 4.5]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
