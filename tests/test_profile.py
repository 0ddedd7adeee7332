import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from meterline.sources import pages, profile


def test_links(spark):
    html = (
        '<a class="x" href="/a">One <b>two</b>\n  three</a><a href="https://h.org/b"> </a><A HREF="http://h.org/c"\nid=1>C&nbsp;</A>'
        '<a href="/d"> D d</a><a name="n">no link</a>'
    )
    df = spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string")
    rows = pages.extract_links(df, "https://base").orderBy("pos").collect()
    assert [(r.pos, r.label, r.url) for r in rows] == [
        (0, "One two three", "https://base/a"), (2, "C&nbsp;", "http://h.org/c"), (3, "D d", "https://base/d"),
    ]


def test_link_of_a_year(spark):
    links = [
        (1, 0, "RLP 20270 electricity", "u0"), (1, 1, "RLP 2027 gas elec", "u1"), (1, 2, "rlp elec", "https://x/RLP%202027%20Electricity"),
        (1, 3, "RLP 2027 electricity", "u3"), (2, 0, "RLP 2028 elec 2029", "u4"), (2, 1, "RLP 2028 parameter elec", "u5"),
        (2, 2, "RLP 2026 elec", "u6"), (2, 3, "rlp 100% elec 2031", "u7"),
    ]
    df = spark.createDataFrame(links, "page_id long, pos int, label string, url string")
    got = pages.links_per_year(df, 2025, 2031, {2026: "fixed", 2020: "out"})
    assert {r.year: r.url for r in got.collect()} == {
        2026: "fixed", 2027: "https://x/RLP%202027%20Electricity", 2028: "u4", 2029: "u4", 2031: "u7",
    }
    assert pages.links_per_year(df, 2030, 2030).isEmpty()


def cells(spark, rows):
    names = ["file", "cet", "year", "month", "day", "h", "min"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_times_from_day_numbers_or_parts(spark):
    rows = [
        ("a", "45292.010416666664", "1", "1", "1", "1", "1"), ("a", "x", "2024", "1", "1", "0", "0"), ("a", "45292.5", "", "", "", "", ""),
        ("b", "x", "2024", "2", "30", "0", "0"), ("b", "y", "2024", "2", "29", "23", "45"), ("b", "45292", "2024", "3", "1", "0", "q"),
    ]
    got = profile.profile_times(cells(spark, rows)).orderBy("file", "cet").collect()
    assert [str(r.ts) for r in got] == [
        "2024-01-01 00:15:00", "2024-01-01 12:00:00", "None", "None", "None", "2024-02-29 23:45:00",
    ]


@pytest.mark.parametrize("columns,want", [
    ([("SMALL", "a"), (" Aim ", "b"), ("X", "aim")], (1, "Aim", 1)),
    ([("SMALL", "a"), ("X", " AIM "), ("Y", "aim")], (1, "X", 2)),
    ([("SMALL.1", "a"), ("SMALL", "b")], (1, "SMALL", 3)),
    ([("B", "a"), ("SMALL.2", "b"), ("SMALL.1", "c")], (1, "SMALL.2", 4)),
])
def test_column_choice(spark, columns, want):
    rows = [("f", i, name, row, cell if row == 3 else "1") for i, (name, cell) in enumerate(columns) for row in range(6)]
    df = spark.createDataFrame(rows, "file string, col_pos int, col_name string, row_pos int, cell string")
    row = profile.choose_column(df, "aim", "small").first()
    assert (row.col_pos, row.col_name, row.rule) == want


def test_label_below_the_head_does_not_count(spark):
    rows = [("f", 0, "X", 4, "aim")]
    df = spark.createDataFrame(rows, "file string, col_pos int, col_name string, row_pos int, cell string")
    with pytest.raises(SparkRuntimeException, match="no column for operator aim"):
        profile.choose_column(df, "aim", "small").collect()


def points(spark, n):
    return spark.range(n).select(
        F.lit("f").alias("file"), F.timestamp_seconds(F.col("id") * 900 + 1_600_000_000).alias("ts"), F.col("id").cast("double").alias("value"), "id"
    )


def test_too_few_points(spark):
    df = points(spark, 100).unionByName(points(spark, 5)).unionByName(points(spark, 1).withColumn("ts", F.lit("1999-01-01").cast("timestamp")))
    assert profile.clean_profile(df, order=["id"], least=100).count() == 100
    with pytest.raises(SparkRuntimeException, match="too few points: 100"):
        profile.clean_profile(df, order=["id"], least=101).collect()
    assert profile.clean_profile(df, order=["id"], on_short="drop").isEmpty()


@pytest.mark.parametrize("values,want", [
    ([0.5, 0.5], [0.5 * 3500 * 4000, 0.5 * 3500 * 4000]), ([60.0, 40.0], [0.6 * 3500 * 4000, 0.4 * 3500 * 4000]),
    ([2.0, 3.0], [2000.0, 3000.0]), ([70.0, 3.0], [70.0, 3.0]), ([0.75, 0.1], [0.75 * 14e6, 0.1 * 14e6]),
])
def test_units(spark, values, want):
    df = spark.createDataFrame([(2024, i, v) for i, v in enumerate(values)], "year int, ts int, value double")
    got = [r.power_w for r in profile.to_watts(df).orderBy("ts").collect()]
    assert got == pytest.approx(want)


def test_curve(spark, path):
    parts = [
        points(spark, 3).select("ts", F.col("value").alias("power_w"), F.lit(y).alias("year")) for y in (2021, 2020)
    ]
    curve = profile.demand_curve(parts)
    assert curve.count() == 6 and curve.first().ts == "2020-09-13 12:26:40"
    profile.write_demand(curve, path)
    assert spark.read.option("header", True).csv(path).count() == 6
