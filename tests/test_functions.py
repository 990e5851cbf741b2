import pytest
from pyspark.sql import functions as F

from cloakwork.functions import placeholders, text
from cloakwork.operators import submap

WORKED = [
    ("email", "j.doe@acmebank.com", 1, "user1@vendor.examp"),
    ("hostname", "api.acme.com", 1, "api1.example"),
    ("ipv4", "93.184.216.34", 1, "203.0.113.1"),
    ("brand", "AcmeBank", 1, "Vendor01"),
    ("app_pkg", "com.acmebank.app", 1, "com.vendor.app01"),
    ("header", "X-Acme-Auth", 1, "X-Vendor001"),
    ("credentials", "Hunter2!", 1, "Bcdefg0!"),
    ("generic_keep_prefix", "ACME-CHAIN-A", 1, "ACME00000001"),
    ("infra_id", "123e4567-e89b-12d3-a456-426614174000", 1, "123e4567-0000-0000-0000-000000000001"),
    ("infra_id", "arn:aws:iam::123456789012:role/MyRoleNam", 1, "arn:aws:iam::000000000001:role/vendor-10"),
    ("infra_id", "i-0a1b2c3d", 1, "i-0a1b2c3d"),
    ("hex_keep_prefix", "9f86d081884c7d659a2feaa0c55ad015", 10, "9f86d08100000000000000000000000a"),
    ("hex_zero_seq", "9f86d081", 255, "000000ff"),
    ("phone_intl", "+1 (415) 555-1234", 1, "+1 (415) 000-0001"),
    ("phone_intl", "+44 7700 900123", 12, "+44 7700 000012"),
    ("nothing", "x", 1, None),
]


@pytest.mark.parametrize("strategy,value,n,want", WORKED)
def test_worked_examples(spark, strategy, value, n, want):
    row = spark.createDataFrame([(strategy, value, n)], "s string, v string, n long").select(placeholders.resolve(F.col("s"), F.col("v"), F.col("n")).alias("p")).head()
    assert row.p == want


def test_credentials_collide_26_apart(spark):
    rows = spark.createDataFrame([("Abc", 3), ("Abc", 29)], "v string, n long").select(placeholders.credentials(F.col("v"), F.col("n")).alias("p")).collect()
    assert rows[0].p == rows[1].p


def test_normalise(spark):
    rows = [("&#49;92.0.2.1&amp;", "192.0.2.1&"), ("1​92", "192"), ("１２", "12"), ("", ""), (None, None)]
    got = [r.n for r in spark.createDataFrame(rows, "t string, w string").select(text.normalize(F.col("t")).alias("n")).collect()]
    assert got == [w for _, w in rows]


@pytest.mark.parametrize("ref,target,want", [("customerbrand", "VendorVoice", "vendorvoice"), ("CUSTOMER", "VendorVoice", "VENDORVOICE"), ("Customer Brand", "vendor voice", "Vendor Voice"), ("customerBrand", "VendorVoice", "VendorVoice"), ("", "x", "x"), ("123", "Abc", "Abc")])
def test_match_case(spark, ref, target, want):
    assert spark.createDataFrame([(ref, target)], "r string, t string").select(text.match_case(F.col("r"), F.col("t")).alias("o")).head().o == want


@pytest.mark.parametrize("base,used,want", [("Vendor09", {"Vendor09"}, "Vendor10"), ("Vendor9", {"Vendor9", "Vendor10"}, "Vendor11"), ("xbeef", {"xbeef"}, "xbef0"), ("name", {"name"}, "name-2"), ("", set(), "placeholder-2")])
def test_bump(base, used, want):
    assert submap.bump(base, used) == want


def test_loose_json(spark):
    rows = [('{"a": 1}', True), ('so: {"a": 1} ok', True), ("[1]", False), ("{broken", False), ("", False), (None, False)]
    got = [r.s for r in spark.createDataFrame(rows, "t string, w boolean").select(text.json_object(F.col("t")).isNotNull().alias("s")).collect()]
    assert got == [w for _, w in rows]
