"""Driver tables as segments and small derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placeholders
from ..operators import detect, index
from ..rules import DEFAULT_RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segments(df: DataFrame, key: str, text: str, ordinal: str | None = None) -> DataFrame:
    ord_ = F.col(ordinal).cast("int") if ordinal else F.lit(0)
    return df.select(F.lpad(F.col(key).cast("string"), 12, "0").alias("file_rel"), ord_.alias("seg_ord"), ord_.cast("string").alias("seg_id"), F.col(text).alias("text"))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "pages"), "page_id", "html")


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


def secret_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as texts with a hex key of either length, an ARN, an instance, a UUID and a SID each; every seventh holds values that are allowed."""
    c = table(spark, sf_dir, "customer").withColumn("h", F.md5(F.col("c_name").cast("binary"))).withColumn("k", F.col("c_custkey").cast("string"))
    uuid = F.concat_ws("-", *(F.substring("h", at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    plain = F.concat(F.lit("key "), "h", F.lit(", long "), "h", F.reverse("h"), F.lit(" arn:aws:iam::"), F.lpad("k", 12, "7"), F.lit(":user/"), "k", F.lit(" on i-"), F.substring("h", 1, 12), F.lit("; id "), uuid, F.lit(" sid S-1-5-21-"), "k", F.lit("-500 +39 333 "), F.lpad("k", 7, "1"))
    zeros = F.concat(F.lit("key "), F.repeat(F.lit("0"), F.lit(32)), F.lit(" on i-12345678000a, S-1-5-21-0 "), "k")
    return _segments(c.withColumn("said", F.when(F.col("c_custkey") % 7 == 0, zeros).otherwise(plain)), "c_custkey", "said")


def word_map(spark: SparkSession, sf_dir: str, lead: str = " ") -> DataFrame:
    """The words of ``benchmark`` as map entries behind ``lead``, in any case or as they are by their length; their first four letters as shorter entries."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    whole = words.select(F.when(F.length("w") % 2 == 0, "brand").otherwise("ids").alias("category"), F.concat(F.lit(lead), "w").alias("from"), F.concat(F.lit(lead), F.reverse("w")).alias("to"))
    stems = words.select(F.lit("headers").alias("category"), F.concat(F.lit(lead), F.substring("w", 1, 4)).alias("from"), F.lit(lead + "#").alias("to")).distinct()
    entries = index.running(whole.unionByName(stems), ["category", "from"])
    return entries.select("category", F.col("rank").cast("int").alias("entry_ord"), "from", "to", F.concat("category", F.lit(":"), "rank").alias("id"))


IPV4 = tuple(r for r in DEFAULT_RULES if r.name == "real_ipv4")
PHONES_AND_IPV4 = DEFAULT_RULES[:5]


def smap_of(cands: DataFrame) -> DataFrame:
    """Candidates with placeholders as map entries in order of first sighting."""
    rows = index.running(cands.select("category", "first", F.col("value").alias("from"), F.col("placeholder").alias("to")), ["category", "first"])
    base = rows.groupBy("category").agg(F.min("rank").alias("base"))  # at most twelve rows
    nth = (F.col("rank") - F.col("base")).cast("int")
    return rows.join(F.broadcast(base), "category").select("category", nth.alias("entry_ord"), "from", "to", F.concat("category", F.lit(":"), placeholders.zfill(nth + 1, F.lit(4))).alias("id"))


def ipv4_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all IPv4 addresses that documents hold."""
    return smap_of(detect.with_placeholders(detect.candidates(detect.detect(doc_segments(spark, sf_dir), IPV4))))
