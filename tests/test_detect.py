import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cloakwork.functions import matching
from cloakwork.operators import detect
from cloakwork.rules import DEFAULT_RULES, Rule
from pyspark.sql import functions as F

SEG = "file_rel string, seg_ord int, seg_id string, text string"
SAMPLES = {
    "hex_credentials_32": ("k = 9f86d081884c7d659a2feaa0c55ad015", "k = 9f86d081000000000000000000000001"),
    "hex_credentials_64": ("9f86d081" * 8, "9f86d081" + "0" * 48 + "0000000a"),
    "aws_arn": ("arn:aws:iam::123456789012:role/Admin", "arn:aws:iam::000:vendor-1"),
    "ec2_instance_id": ("i-0a1b2c3d4e5f6789a", "i-0a1b2c3d000000001"),
    "cloud_uuid": ("123e4567-e89b-12d3-a456-426614174000", "123e4567-0000-0000-0000-000000000001"),
    "ad_sid": ("S-1-5-21-397955417-626881126", "S-1-5-21-000"),
    "italian_mobile": ("call +39 344 0405580 now", "call +39 344 0000001 now"),
    "bare_it_mobile": ("call 3440405580 now", "call 3440000001 now"),
    "e164_generic": ("call +447700900123 now", "call +447700000001 now"),
    "intl_phone_separated": ("call +44 7711 912345 now", "call +33 1 70 00 00 03 now"),
    "real_ipv4": ("at 93.184.216.34.", "at 10.1.2.3."),
}


def test_each_rule_finds_and_allows(spark):
    rows = [(f"{n}:{k}", 0, "0", t) for n, pair in SAMPLES.items() for k, t in enumerate(pair)]
    got = {(r.file_rel, r.rule) for r in detect.occurrences(spark.createDataFrame(rows, SEG)).collect()}
    for rule in DEFAULT_RULES:
        assert (f"{rule.name}:0", rule.name) in got
        assert (f"{rule.name}:1", rule.name) not in got


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("1.23a \U0001f600é", max_size=30), min_size=1, max_size=20))
def test_offsets_are_those_of_finditer(spark, texts):
    pattern = r"[0-9]+\.[0-9]"
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", matching.find_all(F.col("text"), pattern).alias("m")).collect()
    assert {r.i: [(m.off, m.value) for m in r.m] for r in rows} == {i: [(m.start(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_first_rule_wins_by_start_only(spark):
    seg = spark.createDataFrame([("f", 0, "0", "3440405580 and +39 344 0405580")], SEG)
    got = {(r.rule, r.off) for r in detect.detect(seg).collect()}
    assert ("bare_it_mobile", 0) in got and ("italian_mobile", 15) in got
    assert len({off for _, off in got}) == len(got)


def test_empty_and_null_segments(spark):
    seg = spark.createDataFrame([("a", 0, "0", None), ("b", 0, "0", "")], SEG)
    assert detect.detect(seg).count() == 0
    assert detect.with_placeholders(detect.candidates(detect.detect(seg.limit(0)))).count() == 0


def test_one_phone_in_three_spellings_has_one_index(spark):
    seg = spark.createDataFrame([("a", 0, "0", "+39 344 0405580"), ("b", 0, "0", "3440405580"), ("c", 0, "0", "393440405580")], SEG)
    rows = detect.with_placeholders(detect.candidates(detect.detect(seg))).collect()
    assert {r.value: r.placeholder for r in rows} == {"+39 344 0405580": "+39 344 0000001", "3440405580": "3440000001", "393440405580": "344000000001"}


def test_templates(spark):
    rules = (Rule("code", "ids", r"C-\d+", "", "X{n}-{zeros}"), Rule("plain", "ids", r"P-\d+"))
    seg = spark.createDataFrame([("a", 0, "0", "C-12 C-3 P-1")], SEG)
    rows = detect.with_templates(detect.with_placeholders(detect.candidates(detect.detect(seg, rules))), rules).collect()
    assert {r.value: r.placeholder for r in rows} == {"C-12": "X1-0000", "C-3": "X2-000", "P-1": "P-1"}
