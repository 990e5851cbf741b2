"""Shape-preserving placeholders as column expressions.

Every strategy is a pure function of the value and its index ``n`` within a
bucket (see :mod:`cloakwork.operators.index`).  The length of the value is kept
unless the strategy says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phones

PHONE_BUCKET = "_phone_canonical"


def zfill(n: Column, width: Column) -> Column:
    """Decimal digits padded with zeros to ``width``; longer numbers stay whole."""
    s = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(s))), s)


def hexfill(n: Column, width: Column) -> Column:
    s = F.lower(F.hex(n.cast("long")))
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(s))), s)


def last(s: Column, k: Column) -> Column:
    """The last ``k`` characters, none for 0."""
    return F.when(k <= 0, F.lit("")).otherwise(F.substr(s, F.greatest(F.lit(1), F.length(s) - k + 1)))


def fit(s: Column, width: Column) -> Column:
    """Cut or pad with zeros at the end to exactly ``width``."""
    return F.when(F.length(s) > width, F.substr(s, F.lit(1), width)).otherwise(F.concat(s, F.repeat(F.lit("0"), width - F.length(s))))


def _numbered(value: Column, n: Column, head: Column) -> Column:
    size = F.length(value)
    return fit(F.concat(head, zfill(n, F.greatest(F.lit(1), size - F.length(head)))), size)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _laid_over(value: Column, fresh: Column) -> Column:
    """The digits of ``fresh`` at the places of the digits of ``value``."""

    def step(st: Column, c: Column) -> Column:
        digit = c.rlike(r"\d")
        return F.struct((st["i"] + digit.cast("int")).alias("i"), F.concat(st["s"], F.when(digit, F.substr(fresh, st["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("s")), step, lambda st: st["s"])


def phone(value: Column, n: Column) -> Column:
    """Country code, carrier and separators stay, the rest is the index; one digit moves where nothing would change."""
    d, plus = phones.digits(value), F.ltrim(value).startswith("+")

    def fresh(p: Column) -> Column:
        cc = F.when(plus, p["cc"]).otherwise(F.lit(""))
        room = F.greatest(F.lit(0), F.length(d) - F.length(p["carrier"]) - F.length(cc))
        return fit(F.concat(cc, p["carrier"], last(zfill(n, F.greatest(room, F.lit(1))), room)), F.length(d))

    parts = bound(F.when(plus, d).otherwise(phones.digits(phones.canonical(value))), phones.split_number)
    tail = F.regexp_extract(value, r"(\d)\D*$", 1).cast("int")
    moved = F.concat(F.regexp_extract(value, r"^(.*)\d\D*$", 1), ((tail + 1) % 10).cast("string"), F.regexp_extract(value, r"\d(\D*)$", 1))
    laid = bound(bound(parts, fresh), lambda f: _laid_over(value, f))
    return F.when(d == "", value).otherwise(bound(laid, lambda x: F.when(x == value, moved).otherwise(x)))


def hex_keep_prefix(value: Column, n: Column, keep: int = 8) -> Column:
    body = F.greatest(F.lit(0), F.length(value) - keep)
    return F.concat(F.substring(value, 1, keep), last(hexfill(n, body), body))


def hex_zero_seq(value: Column, n: Column) -> Column:
    return last(hexfill(n, F.length(value)), F.length(value))


def email(value: Column, n: Column) -> Column:
    domain, user = "vendor.example", "user"
    width = F.greatest(F.lit(1), F.length(value) - len(domain) - 1 - len(user))
    return F.when(~value.contains("@"), value).otherwise(fit(F.concat(F.lit(user), zfill(n, width), F.lit("@" + domain)), F.length(value)))


def hostname(value: Column, n: Column) -> Column:
    domain = ".example.test"
    lead = F.regexp_extract(value, r"^[A-Za-z][A-Za-z\-_]*", 0)
    prefix = F.when(lead == "", F.lit("host")).otherwise(lead)
    width = F.greatest(F.lit(1), F.length(value) - F.length(prefix) - len(domain))
    return F.when(value == "", value).otherwise(fit(F.concat(prefix, zfill(n, width), F.lit(domain)), F.length(value)))


def ipv4(value: Column, n: Column) -> Column:
    """An address of the documentation block; its length is not kept, and n beyond 255 is no address."""
    return F.concat(F.lit("203.0.113."), n.cast("string"))


def brand(value: Column, n: Column) -> Column:
    return F.when(value == "", value).otherwise(_numbered(value, n, F.lit("Vendor")))


def app_pkg(value: Column, n: Column) -> Column:
    head = "com.vendor.app"
    return F.when(F.length(value) <= len(head), F.substr(F.lit(head), F.lit(1), F.length(value))).otherwise(F.concat(F.lit(head), zfill(n, F.length(value) - len(head))))


def header(value: Column, n: Column) -> Column:
    head = F.when(F.lower(F.substring(value, 1, 2)) == "x-", F.lit("X-Vendor")).otherwise(F.lit("Vendor"))
    return F.when(value == "", value).otherwise(_numbered(value, n, head))


def credentials(value: Column, n: Column) -> Column:
    """Digits walk the ten-digit index, letters the alphabet from n mod 26; all else stays."""
    tens = zfill(n, F.lit(10))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def step(st: Column, c: Column) -> Column:
        digit, upper, lower = c.rlike(r"^\p{Nd}$"), c.rlike(r"^\p{Lu}$"), c.rlike(r"^\p{Ll}$")
        letter = F.substr(F.lit(letters), (n + st["l"]) % 26 + 1, F.lit(1))
        put = F.when(digit, F.substr(tens, st["d"] % F.length(tens) + 1, F.lit(1))).when(upper, F.upper(letter)).when(lower, letter).otherwise(c)
        return F.struct((st["d"] + digit.cast("int")).alias("d"), (st["l"] + (upper | lower).cast("int")).alias("l"), F.concat(st["s"], put).alias("s"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("l"), F.lit("").alias("s")), step, lambda st: st["s"])


def generic_keep_prefix(value: Column, n: Column, keep: int = 4) -> Column:
    body = F.greatest(F.lit(0), F.length(value) - keep)
    return F.concat(F.substring(value, 1, keep), last(zfill(n, body), body))


def infra_id(value: Column, n: Column) -> Column:
    """Cloud resource names, instance ids, UUIDs and security ids; anything else as generic."""
    arn = r"(?i)^(arn:[a-z][a-z0-9-]*:[a-z0-9-]*:[a-z0-9-]*:)([0-9]*)(:.*)$"
    account, tail = F.regexp_extract(value, arn, 2), F.regexp_extract(value, arn, 3)
    width = F.greatest(F.lit(1), F.length(account))
    resource = F.concat(F.when(tail.contains("/"), F.concat(F.substring_index(tail, "/", 1), F.lit("/vendor-"))).otherwise(F.lit(":vendor-")), n.cast("string"))
    as_arn = fit(F.concat(F.regexp_extract(value, arn, 1), last(zfill(n, width), width), resource), F.length(value))
    ec2 = r"(?i)^(i-)([0-9a-f]{8,17})$"
    hexes = F.lower(F.regexp_extract(value, ec2, 2))
    as_ec2 = F.concat(F.regexp_extract(value, ec2, 1), F.substring(hexes, 1, 8), last(hexfill(n, F.length(hexes) - 8), F.length(hexes) - 8))
    uuid = r"(?i)^([0-9a-f]{8})-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    as_uuid = F.concat(F.lower(F.regexp_extract(value, uuid, 1)), F.lit("-0000-0000-0000-0000"), hexfill(n, F.lit(8)))
    sid = r"(?i)^(S-1-5-(?:21|32))-([0-9-]+)$"
    authority = F.regexp_extract(value, sid, 1)
    pad = F.greatest(F.lit(1), F.length(value) - F.length(authority) - 1)
    as_sid = F.concat(authority, F.lit("-"), last(zfill(n, pad), pad))
    return F.when(value.rlike(arn), as_arn).when(value.rlike(ec2), as_ec2).when(value.rlike(uuid), as_uuid).when(value.rlike(sid), as_sid).otherwise(generic_keep_prefix(value, n))


#: Strategies by name; add your own function of (value, n) to extend them.
STRATEGIES: dict[str, Callable[[Column, Column], Column]] = {
    "phone_intl": phone,
    "phone_it": phone,
    "hex_keep_prefix": hex_keep_prefix,
    "hex_zero_seq": hex_zero_seq,
    "email": email,
    "hostname": hostname,
    "ipv4": ipv4,
    "brand": brand,
    "app_pkg": app_pkg,
    "android_pkg": app_pkg,
    "header": header,
    "credentials": credentials,
    "infra_id": infra_id,
    "generic_keep_prefix": generic_keep_prefix,
}

#: What a category without a rule uses; network is told apart by shape.
BY_CATEGORY = {
    "phones": "phone_intl",
    "keys": "hex_keep_prefix",
    "emails": "email",
    "brand": "brand",
    "app_packages": "app_pkg",
    "headers": "header",
    "credentials": "credentials",
    "infra_ids": "infra_id",
}

DOTTED_QUAD = r"^(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}$"


def canonical(strategy: Column, value: Column) -> Column:
    """The key under which a value has its index."""
    return F.when(strategy.isin("phone_intl", "phone_it"), phones.canonical(value)).when(strategy.isin("ipv4", "credentials"), value).otherwise(F.lower(value))


def bucket(strategy: Column, rule: Column) -> Column:
    """Phones of all rules share one bucket; other strategies count within their rule."""
    return F.when(strategy.isin("phone_intl", "phone_it"), F.lit(PHONE_BUCKET)).otherwise(rule)


def resolve(strategy: Column, value: Column, n: Column) -> Column:
    """The placeholder of a strategy named by a column; null where the name is unknown."""
    out = F.lit(None).cast("string")
    for name, make in STRATEGIES.items():
        out = F.when(strategy == name, make(value, n)).otherwise(out)
    return out


def category_strategy(category: Column, value: Column) -> Column:
    """Which strategy fills a placeholder that nobody proposed."""
    out = F.lit("generic_keep_prefix")
    for name, strategy in BY_CATEGORY.items():
        out = F.when(category == name, strategy).otherwise(out)
    return F.when(category == "network", F.when(value.rlike(DOTTED_QUAD), "ipv4").otherwise("hostname")).otherwise(out)


def overlong(value: Column, placeholder: Column, extra: int = 4) -> Column:
    return (value != "") & (placeholder != "") & (F.length(placeholder) > F.length(value) + extra)


def clamp(value: Column, placeholder: Column) -> Column:
    """Cut to the value's length, the last three characters as zeros."""
    n = F.length(value)
    head = F.greatest(F.lit(1), n - 3)
    return F.when((n <= 0) | (F.length(placeholder) <= n), placeholder).otherwise(F.concat(F.substr(placeholder, F.lit(1), head), F.repeat(F.lit("0"), n - head)))


def redacted(category: Column, value: Column) -> Column:
    """A token that says the category and eight hex digits of a hash."""
    return F.concat(F.lit("[REDACTED-"), F.upper(category), F.lit("-"), F.substring(F.sha2(F.concat_ws("::", category, value), 256), 1, 8), F.lit("]"))
