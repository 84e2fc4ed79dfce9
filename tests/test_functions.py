import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from helpers import ms, records
from refreshgate.functions import names, times


def values(spark, ddl, items):
    return spark.createDataFrame([(i,) for i in items], ddl)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_utc_text_is_the_same_in_every_session_zone(spark, zone):
    rng = random.Random(1)
    items = [0, 1791800590292, ms("2026-03-08 07:30")] + [rng.randrange(0, 4_000_000_000_000) for _ in range(300)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = dict(values(spark, "ms bigint", items).select("ms", times.utc_text(F.col("ms"))).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for item in items:
        at = datetime.fromtimestamp(item // 1000, tz=timezone.utc)
        assert got[item] == f"{at:%Y-%m-%d %H:%M:%S}.{item % 1000:03d} UTC"


def test_utc_text_of_null(spark):
    assert values(spark, "ms bigint", [None]).select(times.utc_text(F.col("ms"))).first()[0] == "none"


def test_age_text_rounds_like_python(spark):
    rng = random.Random(2)
    items = [0, 9000, 15000, 21000, 90_000, 7_200_000, 7_199_999, 172_800_000, -30_000, 123_456_789_000]
    items += [3000 * rng.randrange(0, 100_000) for _ in range(300)] + [rng.randrange(0, 10**12) for _ in range(300)]

    def expected(age):
        minutes = age / 1000 / 60
        if minutes < 120:
            return f"{minutes:.1f} min"
        return f"{minutes / 60:.1f} h" if minutes < 2880 else f"{minutes / 1440:.1f} days"

    got = dict(values(spark, "age bigint", items).select("age", times.age_text(F.col("age"))).collect())
    assert {i: got[i] for i in items} == {i: expected(i) for i in items}


def test_iso_text_with_and_without_offset(spark):
    items = ["2026-10-12T07:30:00+05:30", "2026-10-12T02:00:00Z", "2026-10-12T02:00:00.250Z", "2026-10-12T02:00:00"]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = dict(values(spark, "t string", items).select("t", times.iso_ms(F.col("t"))).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    two = ms("2026-10-12 02:00")
    assert [got[i] for i in items] == [two, two, two + 250, two]


def test_names(spark):
    row = spark.createDataFrame([("c.s.t", ["a", "b", "a"], ["b"], " x, y  x,,")],
                                "t string, l array<string>, skip array<string>, text string").select(
        names.dotted_suffixes(F.col("t")), names.short_name(F.col("t")), names.without(F.col("l"), F.col("skip")),
        names.name_list(F.col("text")), names.list_text(F.col("l"))).first()
    assert tuple(row) == (["c.s.t", "s.t", "t"], "t", ["a", "a"], ["x", "y"], "['a', 'b', 'a']")


def test_group_name(spark):
    df = values(spark, "g string", [None, "", "daily"]).select(names.group_name(F.col("g")))
    assert records(df) == [("daily",), ("default",), ("default",)]


def test_option_value_is_not_cut(spark):
    value = "main.some_schema.some_table," * 50_000
    got = spark.createDataFrame([([f"--src_tables={value}"],)], "p array<string>").select(names.option_value(F.col("p"), "--src_tables")).first()
    assert got[0] == value and len(value) > 1_000_000


def test_option_value_takes_the_last_of_both_forms(spark):
    lists = [(["--a=1", "--a", "2", "--b=x"], "2"), (["--a", "2", "--a=3=4"], "3=4"), (["--b=1"], None), (["--a"], None)]
    df = spark.createDataFrame([(x,) for x, _ in lists], "p array<string>").select(names.option_value(F.col("p"), "--a"))
    assert [r[0] for r in df.collect()] == [want for _, want in lists]
