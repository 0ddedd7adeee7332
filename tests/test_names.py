import pytest
from pyspark.sql import functions as F

from meterline.functions.names import normal_site, parse_file_name, parse_site_key, site_key

CASES = [
    ("std_A.B_12.csv", ("A.B", "12", False)),
    ("std_2015_EP_AND_0.csv", ("EP_AND", "0", False)),
    ("std_2009_EP_0.csv", ("2009_EP", "0", False)),
    ("std_X_P_7.csv", ("X", "7", True)),
    ("std_X_C_7.csv", ("X", "7", False)),
    ("std_Y-_8.csv", ("Y", "8", True)),
    ("std_Y-_C_8.csv", ("Y", "8", True)),
    ("std_Z+_9.csv", ("Z", "9", False)),
    ("std__DOUBLE__1.csv", ("DOUBLE", "1", False)),
    ("std_5.csv", ("", "5", False)),
    ("std_2016_5.csv", ("", "5", False)),
    ("std_ROOF_77.csv", ("ROOF", "77", True)),
]


@pytest.mark.parametrize("name,want", CASES)
def test_file_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "f string")
    row = df.select(parse_file_name(F.col("f"), [("ROOF", "77")]).alias("x")).first().x
    assert tuple(row) == want


def test_site_keys(spark):
    df = spark.createDataFrame([("A.B-C~D+", "12", True)], "s string, n string, p boolean")
    row = df.select(normal_site(F.col("s")), site_key(F.col("s"), F.col("n"), F.col("p"))).first()
    assert row[0] == "A_B_C_D" and row[1] == "/site_A_B_C_D_12/production"


@pytest.mark.parametrize("key", ["/site_EP_AND_0/consumption", "site_EP_AND_0/production", "EP_AND_0", "EP.AND_0/x/y"])
def test_keys_come_apart_at_the_last_underscore(spark, key):
    df = spark.createDataFrame([(key,)], "k string")
    assert tuple(df.select(parse_site_key(F.col("k")).alias("x")).first().x) == ("EP_AND", "0")
