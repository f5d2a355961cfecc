"""Readings of descriptions where a number stands beside them."""

from pyspark.sql import functions as F

from partwise.operators import kg


def test_no_designation_is_read_out_of_a_longer_number(spark):
    rows = [
        ("BRG 6008 2RS PN-010460", []),
        ("GATE VALVE 6\" 150# WCB FLANGED PN-014571", ["WCB"]),
        ("BAR 1.4571", ["SS316TI"]),
        ("BAR 4 1.4404 PN-000001", ["SS316L"]),
        ("FLANGE A 105 150#", ["CS_A105"]),
        ("FLANGE A1053", []),
        ("BOLT SS-316 50 MM", ["SS316"]),
    ]
    df = spark.createDataFrame(rows, "t string, want array<string>").select("t", "want", kg.find_designations(F.col("t")).alias("got"))
    assert [(r.t, [f for f in r.got if f in ("SS316TI", "SS316L", "CS_A105", "WCB", "SS316")]) for r in df.collect()] == rows


def test_no_service_is_read_out_of_a_longer_number(spark):
    got = spark.createDataFrame([("VALVE API 607",), ("VALVE API 6071",)], "t string").select(kg.find_services(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == [["FIRE_SAFE"], []]
