"""Scalar text functions."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: invisible characters that normalisation deletes.
ZERO_WIDTH = "[​-‏‪-‮⁠﻿]"
#: Letters whose capitals are several letters, and the one letter that stands for those.
ONE_CAPITAL = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")
# End of fixed values.


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


@F.pandas_udf(T.StringType())
def _unescape_nfkc(texts):
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def normalize_text(text: str) -> str:
    """What ``normalize`` does to one string."""
    return re.sub(ZERO_WIDTH, "", unicodedata.normalize("NFKC", html.unescape(text)))


def normalize(text: Column) -> Column:
    """HTML unescape, NFKC, no zero-width characters; plain ASCII without entities never leaves the JVM's value."""
    return strip_zero_width(_unescape_nfkc(text))


def match_case(reference: Column, target: Column) -> Column:
    """``target`` in the case shape of ``reference``: all upper, all lower, or every word capitalised."""
    upper = (F.upper(reference) == reference) & (F.lower(reference) != reference)
    lower = (F.lower(reference) == reference) & (F.upper(reference) != reference)
    words = F.filter(F.split(reference, r"\s+"), lambda w: w != "")
    titled = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"))
    return F.when((reference == "") | (target == ""), target).when(upper, F.upper(target)).when(lower, F.lower(target)).when(titled, title(target)).otherwise(target)


def upper_by_letter(text: Column) -> Column:
    """Capitals letter for letter: a sharp s stays one letter, and so do ligatures."""
    one = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, *ONE_CAPITAL)).otherwise(F.upper(c))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def title(text: Column) -> Column:
    """Capitals after anything that is no letter, small letters after letters."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def parse_json(text: Column, schema: str) -> Column:
    """A JSON object, strictly or from the first brace to the last; null if there is none."""
    whole = F.from_json(F.when(F.trim(text).startswith("{"), F.trim(text)), schema)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.from_json(F.when(inner != "", inner), schema))


def json_object(text: Column) -> Column:
    """The object's text if it parses, strictly or from the first brace to the last; else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    sound = lambda c: F.when(F.json_object_keys(c).isNotNull(), c)
    return F.coalesce(sound(F.trim(text)), sound(F.when(inner != "", inner)))


def request_tokens(chars: Column, output: int = 2048, per_token: float = 3.5, system: int = 3700, few_shot: int = 250) -> Column:
    """Tokens of one request over a chunk of so many characters."""
    return (F.floor(chars / per_token) + system + few_shot + output).cast("long")


def category_of_pattern(name: Column) -> Column:
    """Guess a category from a rule's name."""
    p = F.lower(name)
    has = lambda *words: _any(p.contains(w) for w in words)
    return (
        F.when(has("phone", "mobile", "e164"), "phones").when(has("email", "mail"), "emails").when(has("hex", "credential", "key"), "keys").when(has("ip"), "network")
        .when(has("package", "bundle", "android", "ios", "app_pkg"), "app_packages").when(has("header"), "headers").when(has("user") & has("agent"), "user_agents")
        .when(has("brand", "vendor"), "brand").when(has("arn", "ec2", "uuid", "sid", "infra", "cloud"), "infra_ids").otherwise("other")
    )


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
