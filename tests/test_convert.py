import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from strata.functions.convert import convert, utf16_length
from strata.plans.manifest import Field, Kind


def values(spark, field, texts, **options):
    value, fault = convert(F.col("x"), field, **options)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", value.alias("v"), fault.alias("f")).orderBy("i").collect()
    return [(r.v, r.f is not None) for r in rows]


@pytest.mark.parametrize(
    ("field", "given"),
    [
        (Field("f", type=Kind.INT32), {"42": 42, " +42 ": 42, " -7\t": -7, "1.5": None, "9999999999": None, "1e3": None}),
        (Field("f", type=Kind.INT64), {"9000000000": 9000000000, "99999999999999999999": None}),
        (Field("f", type=Kind.DECIMAL), {"123.45": D("123.450000"), "1.5e3": D("1500.000000"), "-0.0000005": D("-0.000001"), "999999999999": D("999999999999.000000"), "1234567890123": None, "1,5": None}),
        (Field("f", type=Kind.DECIMAL, precision=4, scale=2), {"99.994": D("99.99"), "99.999": None, "-99.995": None}),
        (Field("f", type=Kind.DECIMAL, precision=38, scale=0), {"9" * 38: D("9" * 38), "9" * 39: None}),
        (Field("f", type=Kind.DOUBLE), {"1.5": 1.5, "1e-3": 0.001, ".5": 0.5, "1.5d": None, "NaN": None}),
        (Field("f", type=Kind.BOOLEAN), {"true": True, "1": True, "Y": True, "yes": True, "false": False, "0": False, "No": False, "t": None, "on": None}),
        (Field("f", type=Kind.DATE), {"2026-01-15": dt.date(2026, 1, 15), "01/15/2026": dt.date(2026, 1, 15), "2026": None, "not-a-date": None, "2026-02-30": None}),
        (Field("f", type=Kind.DATE, format="yyyyMMdd"), {"20260115": dt.date(2026, 1, 15), "2026011x": None, "2026-01-15": None}),
        (Field("f", type=Kind.DATETIME), {"2026-01-15T10:30:00": dt.datetime(2026, 1, 15, 10, 30), "2026-01-15 10:30": dt.datetime(2026, 1, 15, 10, 30), "2026-01-15T10:30:00+02:00": dt.datetime(2026, 1, 15, 8, 30), "10:30": None}),
        (Field("f", type=Kind.TIME), {"10:30": 37_800_000_000, "23:59:59.5": 86_399_500_000, "24:00": None, "x": None}),
        (Field("f", type=Kind.TIME, format="hh:mm tt"), {"01:30 PM": 48_600_000_000, "13:30": None}),
        (Field("f", type=Kind.GUID), {"{0F8FAD5B-D9CB-469F-A165-70867728950E}": "0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5bd9cb469fa16570867728950e": "0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5b": None}),
    ],
)
def test_kinds(spark, field, given):
    assert values(spark, field, list(given)) == [(v, v is None) for v in given.values()]


def test_blank_default_required(spark):
    assert values(spark, Field("f", type=Kind.INT32, default="7"), ["  ", None, "8"]) == [(7, False), (7, False), (8, False)]
    assert values(spark, Field("f", type=Kind.INT32), ["", None]) == [(None, False)] * 2
    assert values(spark, Field("f", required=True), ["", None, "x"]) == [(None, True), (None, True), ("x", False)]


def test_lengths_count_utf16_units_after_trimming(spark):
    assert values(spark, Field("f", max_length=2), [" ab ", "abc", "😀", "😀a"]) == [("ab", False), (None, True), ("😀", False), (None, True)]
    assert values(spark, Field("f"), ["x" * 401], key=True) == [(None, True)] and values(spark, Field("f"), ["x" * 401])[0][1] is False
    assert spark.range(1).select(utf16_length(F.lit("😀"))).first()[0] == 2


def test_messages_show_the_value_shortened(spark):
    _, fault = convert(F.lit("y" * 100), Field("f", type=Kind.INT32))
    text = spark.range(1).select(fault).first()[0]
    assert "y" * 57 + "..." in text and "y" * 58 not in text
