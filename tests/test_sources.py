"""Scans, adapters and sinks on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from tablegauge.sources import readers as I
from tablegauge.sources import sinks
from tablegauge.sources.adapters import ADAPTERS, adapted
from tablegauge.streaming import binned_ports, encoded_by_map


def test_names_from_side_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a, b,c\n1,2,3\n")
    assert I.names_from_line(spark, str(tmp_path / "n.csv")) == ["a", "b", "c"]
    (tmp_path / "d.names").write_text("duration: continuous.\nskip\nproto: symbolic.\n")
    assert I.names_from_pattern(spark, str(tmp_path / "d.names"), r"^(\w+):") == ["duration", "proto"]


def test_log_with_comments(spark, tmp_path):
    (tmp_path / "x.log").write_text("#h\n1\t-\n#m\n2\ty\n")
    assert [tuple(r) for r in I.csv_named(spark, str(tmp_path / "x.log"), ["a", "b"], "\t", "#").orderBy("a").collect()] == [("1", "-"), ("2", "y")]


def test_folder_by_name_and_label(spark, tmp_path):
    for name in ("TCP_Flood1_train.csv", "Benign_test.csv", "notes.csv"):
        (tmp_path / name).write_text("x\n1\n")
    df = I.folder(spark, str(tmp_path), "*.csv", recursive=True, matches="_(train|test)")
    assert {r[0] for r in df.select(I.label_from_name(I.TRAIN_TEST_NAME)).collect()} == {"TCP_Flood", "Benign"}


def test_malformed_and_repeated_header_lines(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StructField, StructType

    (tmp_path / "m.csv").write_text("a,b\n1,2\nx,y\n3,4\n")
    schema = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
    assert I.csv_with_header(spark, str(tmp_path / "m.csv"), schema, skip_malformed=True).agg(F.sum("a")).first()[0] == 4
    (tmp_path / "h.csv").write_text("ts,v\n1,2\nts,v\n3,4\n")
    assert I.without_repeated_headers(I.csv_with_header(spark, str(tmp_path / "h.csv")), "ts").count() == 2


def test_metric_files(spark, tmp_path):
    (tmp_path / "A_complexity.json").write_text(json.dumps({"f": {"mean": 1.5}, "errors": ["none"]}))
    (tmp_path / "B_complexity.json").write_text(json.dumps({"f": {"mean": 2}}))
    assert [tuple(r) for r in I.metric_files(spark, str(tmp_path), exclude=("B",)).collect()] == [("A", "f", "mean", 1.5)]


def test_restored_types_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("y", "z")], "a string, b string")
    assert [r["a"] for r in I.restored(df, {"a": "int"}).collect()] == [1, None]
    made = []
    build = lambda: made.append(1) or df
    for _ in range(2):
        assert I.cached(spark, build, str(tmp_path / "t")).count() == 2
    assert made == [1]


def test_adapters(spark, tmp_path):
    kdd = spark.createDataFrame([(1, "normal."), (2, "smurf.")], "x int, label string")
    assert [r["label"] for r in adapted(kdd, ADAPTERS["KDD_Cup_1999"], binary=True).orderBy("x").collect()] == ["Benign", "Malign"]
    bot = spark.createDataFrame([("0x50", "80", "DDoS", "UDP", 1)], "sport string, dport string, category string, subcategory string, pkSeqID int")
    out = adapted(bot, ADAPTERS["BoT_IoT_Micro"])
    assert out.columns == ["sport", "dport", "label"] and tuple(out.first()) == (80, 80, "DDoS_UDP")
    ton = spark.createDataFrame([("1.5K 3", "2", "1K", "normal", "0")], "VGROW string, WRDSK string, RSIZE string, type string, label string")
    assert tuple(adapted(ton, ADAPTERS["ToN_IoT"]).first()) == ("1.5K", 2.0, 1000.0, "normal")
    iot = spark.createDataFrame([("-", "5", "-   Malicious   C&C"), ("-", "5", "-   Malicious   C&C")], "duration string, orig_bytes string, label string")
    assert [tuple(r) for r in adapted(iot, ADAPTERS["IoT_23"]).collect()] == [(0.0, 5.0, "C&C")]
    mqtt = tmp_path / "mqtt"
    mqtt.mkdir()
    (mqtt / "biflow_scan_A.csv").write_text("ip_src,x,is_attack\n1,2,0\n1,3,1\n")
    read = lambda p: spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(p))
    assert [tuple(r) for r in adapted(read(mqtt), ADAPTERS["MQTT_Biflow"]).orderBy("x").collect()] == [("2", "normal"), ("3", "scan_A")]
    bot = tmp_path / "device"
    (bot / "mirai_attacks").mkdir(parents=True)
    (bot / "benign_traffic.csv").write_text("x\n1\n")
    (bot / "mirai_attacks" / "ack.csv").write_text("x\n2\n")
    assert {r["label"] for r in adapted(read(bot), ADAPTERS["N_BaIoT"]).collect()} == {"benign_traffic", "mirai_ack"}
    tmp_path = tmp_path / "evse"
    tmp_path.mkdir()
    (tmp_path / "EVSE-A-Charging-Flood.csv").write_text("x\n1\n")
    assert adapted(spark.read.option("header", True).csv(str(tmp_path)), ADAPTERS["CICEVSE2024_Macro"]).first()["label"] == "flood"


@pytest.mark.parametrize("name", sorted(ADAPTERS))
def test_every_adapter_names_a_benign_label(name):
    spec = ADAPTERS[name]
    assert spec.benign and (spec.label or spec.from_name or spec.from_path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.00049, "train", "a"), (2.0015, "test", "b")], "x double, subset string, label string")
    sinks.save(df, str(tmp_path / "t"), ("parquet", "csv"), target="label")
    assert spark.read.parquet(str(tmp_path / "t/label_counts")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "t/csv")).count() == 2
    sinks.save_rounded(df, str(tmp_path / "r"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [1.0, 2.002]
    sinks.save_mappings(df, ["label", "subset"], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    sinks.publish(df.withColumn("kind", F.lit("k")), str(tmp_path / "p"), "kind", "label")
    sinks.publish(df.where("label = 'a'").withColumn("kind", F.lit("k")).withColumn("x", F.lit(9.0)), str(tmp_path / "p"), "kind", "label")
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2.0015, 9.0]


def test_streams_take_row_local_operators(spark, tmp_path):
    spark.createDataFrame([(80, "a"), (443, "z")], "port int, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("port int, c string").parquet(str(tmp_path / "in"))
    codes = spark.createDataFrame([("a", 0)], "value string, code int")
    q = encoded_by_map(binned_ports(stream, ["port"]), "c", codes).writeStream.format("memory").queryName("ports").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select port, code from ports").collect()) == [("HTTP", 0), ("HTTPS", -1)]
