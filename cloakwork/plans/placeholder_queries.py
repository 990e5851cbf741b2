"""Queries of placeholder strategies over names made from whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phones, placeholders
from . import sql
from .catalogue import query
from .tables import table


def _over(name: str, source: str, key: str, value: str, value_sql: str, make: Callable[[Column, Column], Column], make_sql: str) -> None:
    """Register ph_<name>: (value, n, placeholder) of values made from ``source``, n being its key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(F.expr(value).alias("value"), F.col(key).cast("long").alias("n"))
        return rows.select("value", "n", make(F.col("value"), F.col("n")).alias("placeholder"))

    run.__name__ = f"ph_{name}"
    rows = f"select {value_sql} as value, {key}::bigint as n from {source}"
    query(make_sql if "{rows}" not in make_sql else make_sql.replace("{rows}", rows))(run)


def _plain(expression: str) -> str:
    return f"select value, n, {expression} as placeholder from ({{rows}})"


def _head(head: str) -> str:
    return sql.fit(f"({head} || {sql.zfill('n', f'greatest(1, length(value) - length({head}))')})", "length(value)")


_PHONE = "concat(element_at(array('+39 3', '+1 (', '3', '+44 7', '+353-'), cast(c_custkey % 5 as int) + 1), lpad(cast(c_custkey * 7919 % 100 as string), 2, '4'), element_at(array(' ', ') ', '', ' ', '-'), cast(c_custkey % 5 as int) + 1), lpad(cast(c_custkey * 104729 % 10000000 as string), 7, '5'))"
_PHONE_SQL = "concat((['+39 3', '+1 (', '3', '+44 7', '+353-'])[(c_custkey % 5 + 1)::int], lpad((c_custkey * 7919 % 100)::varchar, 2, '4'), ([' ', ') ', '', ' ', '-'])[(c_custkey % 5 + 1)::int], lpad((c_custkey * 104729 % 10000000)::varchar, 7, '5'))"
_over("phone", "customer", "c_custkey", _PHONE, _PHONE_SQL, placeholders.phone, "select value, n, placeholder from (" + sql.phone_placeholders("{rows}") + ")")
_over("hex", "customer", "c_custkey", "md5(c_name)", "md5(c_name)", placeholders.hex_keep_prefix, _plain(f"substr(value, 1, 8) || {sql.last(sql.hexfill('n', '24'), '24')}"))
_over("hex_zero", "customer", "c_custkey", "md5(c_name)", "md5(c_name)", placeholders.hex_zero_seq, _plain(sql.last(sql.hexfill("n", "32"), "32")))
_over("email", "customer", "c_custkey", "concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.com')", "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com'", placeholders.email, _plain("case when position('@' in value) = 0 then value else " + sql.fit(f"('user' || {sql.zfill('n', 'greatest(1, length(value) - 19)')} || '@vendor.example')", "length(value)") + " end"))
_HOST = "(case when regexp_extract(value, '^[A-Za-z][A-Za-z\\-_]*', 0) = '' then 'host' else regexp_extract(value, '^[A-Za-z][A-Za-z\\-_]*', 0) end)"
_over("hostname", "supplier", "s_suppkey", "concat(if(s_suppkey % 4 = 0, '9', 'db-'), lower(replace(s_name, '#', '-')), '.acme.com')", "(case when s_suppkey % 4 = 0 then '9' else 'db-' end) || lower(replace(s_name, '#', '-')) || '.acme.com'", placeholders.hostname, _plain(sql.fit(f"({_HOST} || {sql.zfill('n', f'greatest(1, length(value) - length({_HOST}) - 13)')} || '.example.test')", "length(value)")))
_over("ipv4", "supplier", "s_suppkey", "concat_ws('.', s_suppkey % 223 + 1, s_suppkey % 251, s_suppkey % 13, s_suppkey % 7)", "concat_ws('.', s_suppkey % 223 + 1, s_suppkey % 251, s_suppkey % 13, s_suppkey % 7)", placeholders.ipv4, _plain("'203.0.113.' || n::varchar"))
_over("brand", "part", "p_partkey", "p_brand", "p_brand", placeholders.brand, _plain(_head("'Vendor'")))
_over("app_pkg", "part", "p_partkey", "concat('com.', lower(replace(p_brand, '#', '')), '.a', p_size)", "'com.' || lower(replace(p_brand, '#', '')) || '.a' || p_size::varchar", placeholders.app_pkg, _plain(f"case when length(value) <= 14 then substr('com.vendor.app', 1, length(value)) else 'com.vendor.app' || {sql.zfill('n', 'length(value) - 14')} end"))
_over("header", "part", "p_partkey", "concat(if(p_partkey % 2 = 0, 'X-', ''), replace(p_type, ' ', '-'))", "(case when p_partkey % 2 = 0 then 'X-' else '' end) || replace(p_type, ' ', '-')", placeholders.header, _plain(_head("(case when lower(substr(value, 1, 2)) = 'x-' then 'X-Vendor' else 'Vendor' end)")))
_CLASS = "regexp_replace(substr(value, 1, i - 1), '{}', '', 'g')"
_over(
    "credentials", "customer", "c_custkey", "concat(c_name, '!', substr(md5(c_name), 1, 6))", "c_name || '!' || substr(md5(c_name), 1, 6)", placeholders.credentials,
    _plain(
        "array_to_string(list_transform(range(1, length(value) + 1), lambda i: case when regexp_matches(substr(value, i, 1), '[0-9]') then substr("
        + sql.zfill("n", "10")
        + f", (length({_CLASS.format('[^0-9]')}) % 10 + 1)::int, 1) when regexp_matches(substr(value, i, 1), '[A-Z]') then chr((65 + (n + length({_CLASS.format('[^A-Za-z]')})) % 26)::int) when regexp_matches(substr(value, i, 1), '[a-z]') then chr((97 + (n + length({_CLASS.format('[^A-Za-z]')})) % 26)::int) else substr(value, i, 1) end), '')"
    ),
)
_GENERIC = f"substr(value, 1, 4) || {sql.last(sql.zfill('n', 'greatest(0, length(value) - 4)'), 'greatest(0, length(value) - 4)')}"
_over("generic", "part", "p_partkey", "p_name", "p_name", placeholders.generic_keep_prefix, _plain(_GENERIC))
_H = "md5(c_name)"
_over(
    "infra", "customer", "c_custkey",
    f"case c_custkey % 5 when 0 then concat('arn:aws:iam::', lpad(cast(c_custkey as string), 12, '7'), ':role/', c_mktsegment, 'Admin') when 1 then concat('i-', substr({_H}, 1, 17)) when 2 then concat_ws('-', substr({_H}, 1, 8), substr({_H}, 9, 4), substr({_H}, 13, 4), substr({_H}, 17, 4), substr({_H}, 21, 12)) when 3 then concat('S-1-5-21-', c_custkey * 7919, '-', c_custkey * 31) else c_name end",
    f"case c_custkey % 5 when 0 then concat('arn:aws:iam::', lpad(c_custkey::varchar, 12, '7'), ':role/', c_mktsegment, 'Admin') when 1 then concat('i-', substr({_H}, 1, 17)) when 2 then concat_ws('-', substr({_H}, 1, 8), substr({_H}, 9, 4), substr({_H}, 13, 4), substr({_H}, 17, 4), substr({_H}, 21, 12)) when 3 then concat('S-1-5-21-', c_custkey * 7919, '-', c_custkey * 31) else c_name end",
    placeholders.infra_id,
    _plain(
        "case n % 5 when 0 then " + sql.fit(f"('arn:aws:iam::' || {sql.last(sql.zfill('n', '12'), '12')} || ':role/vendor-' || n::varchar)", "length(value)")
        + f" when 1 then substr(value, 1, 10) || {sql.last(sql.hexfill('n', '9'), '9')} when 2 then substr(value, 1, 8) || '-0000-0000-0000-0000' || {sql.hexfill('n', '8')}"
        + f" when 3 then 'S-1-5-21-' || {sql.last(sql.zfill('n', 'length(value) - 9'), 'length(value) - 9')} else {_GENERIC} end"
    ),
)


_PHONE_ROWS = f"select c_custkey, {_PHONE_SQL} as value from customer"


@query(f"select c_custkey, {sql.canonical_phone('value')} as canonical from ({_PHONE_ROWS})")
def phone_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", phones.canonical(F.expr(_PHONE)).alias("canonical"))


@query(
    f"select c_custkey, cc, substr(rest, 1, {sql.carrier_length('length(rest)')}) as carrier, substr(rest, 1 + {sql.carrier_length('length(rest)')}) as local"
    f" from (select c_custkey, cc, substr(d, length(cc) + 1) as rest from (select c_custkey, d, {sql.country_code('d')} as cc from (select c_custkey, {sql.digits('value')} as d from ({_PHONE_ROWS}))))"
)
def phone_country_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = phones.split_number(phones.digits(F.expr(_PHONE)))
    return table(spark, sf_dir, "customer").select("c_custkey", parts["cc"].alias("cc"), parts["carrier"].alias("carrier"), parts["local"].alias("local"))


@query(f"select p_partkey, {sql.overlong('p_brand', 'p_type')} as overlong, {sql.clamp('p_brand', 'p_type')} as clamped from part")
def placeholder_overlong_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, p = F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", placeholders.overlong(v, p).alias("overlong"), placeholders.clamp(v, p).alias("clamped"))


@query("select c_custkey, '[REDACTED-' || upper(c_mktsegment) || '-' || substr(sha256(c_mktsegment || '::' || c_name), 1, 8) || ']' as token from customer")
def redacted_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", placeholders.redacted(F.col("c_mktsegment"), F.col("c_name")).alias("token"))
