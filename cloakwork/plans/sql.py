"""Pieces of ANSI SQL that say what the Spark operators compute."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import phones
from ..rules import Rule

DOC_SEGMENTS = "select lpad(doc_id::varchar, 12, '0') as file_rel, 0 as seg_ord, '0' as seg_id, text from documents"
PAGE_SEGMENTS = "select lpad(page_id::varchar, 12, '0') as file_rel, 0 as seg_ord, '0' as seg_id, html as text from pages"
TURN_SEGMENTS = "select lpad(conv_id::varchar, 12, '0') as file_rel, turn::int as seg_ord, turn::varchar as seg_id, text from conversations"


SECRET_SEGMENTS = """select lpad(c_custkey::varchar, 12, '0') as file_rel, 0 as seg_ord, '0' as seg_id, case when c_custkey % 7 = 0
    then 'key ' || repeat('0', 32) || ' on i-12345678000a, S-1-5-21-0 ' || c_custkey
    else 'key ' || h || ', long ' || h || reverse(h) || ' arn:aws:iam::' || lpad(c_custkey::varchar, 12, '7') || ':user/' || c_custkey || ' on i-' || h[1:12] || '; id '
      || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || ' sid S-1-5-21-' || c_custkey || '-500 +39 333 ' || lpad(c_custkey::varchar, 7, '1') end as text
  from (select *, md5(c_name) as h from customer)"""
WORDS = "(select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from benchmark)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(source: str, pattern: str, test: str = "true") -> str:
    """(file_rel, seg_ord, seg_id, value, off) of all matches of a pattern in ``source``'s text."""
    p = quote(pattern)
    return f"""select file_rel, seg_ord, seg_id, v[i] as value,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::int as off
      from (select file_rel, seg_ord, seg_id, v, g, unnest(range(1, len(v) + 1)) as i
            from (select file_rel, seg_ord, seg_id, regexp_extract_all(text, {p}) as v, string_split_regex(text, {p}) as g from ({source}) where regexp_matches(text, {p})))
      where {test.replace('VALUE', 'v[i]')}"""


def occurrences(source: str, rules: Sequence[Rule], allow: bool = True) -> str:
    """All rules' matches.  The bare mobile rule, which looks around, is said by whole runs of digits."""
    parts = []
    for k, r in enumerate(rules):
        pattern, test = r.regex, "true"
        if r.name == "bare_it_mobile":
            pattern, test = r"\d+", "length(VALUE) = 10 and VALUE[1] = '3'"
        if allow and r.allow:
            test += "".join(f" and not regexp_matches(VALUE, {quote(a)})" for a in r.allow)
        parts.append(f"select file_rel, seg_ord, seg_id, {k} as rule_ord, {quote(r.name)} as rule, {quote(r.category)} as category, {quote(r.strategy)} as strategy, value, off from ({matches(source, pattern, test)})")
    return "\nunion all\n".join(parts)


def first_wins(occ: str) -> str:
    return f"select file_rel, seg_ord, seg_id, rule_ord, rule, category, strategy, value, off from (select *, row_number() over (partition by file_rel, seg_id, off order by rule_ord) as rn from ({occ})) where rn = 1"


def candidates(occ: str) -> str:
    return f"""select value, first(category order by file_rel, seg_ord, rule_ord, off) as category, first(rule order by file_rel, seg_ord, rule_ord, off) as rule,
        first(strategy order by file_rel, seg_ord, rule_ord, off) as strategy, count(*) as count,
        min(row(file_rel, seg_ord, rule_ord, off)) as first,
        array_to_string(list(file_rel || ':' || seg_id || '@' || off::varchar order by file_rel, seg_ord, rule_ord, off)[1:5], ' ') as examples
      from ({occ}) group by value"""


def digits(v: str) -> str:
    return f"regexp_replace({v}, '\\D', '', 'g')"


def canonical_phone(v: str) -> str:
    d = digits(v)
    return f"case when {d} = '' then {v} when {d} like '39%' and length({d}) >= 11 then '+' || {d} when length({d}) = 10 and {d} like '3%' then '+39' || {d} else '+' || {d} end"


def country_code(d: str) -> str:
    three = ", ".join(map(quote, phones.CODES_OF_THREE))
    two = ", ".join(map(quote, phones.CODES_OF_TWO))
    return f"case when length({d}) >= 3 and substr({d}, 1, 3) in ({three}) then substr({d}, 1, 3) when length({d}) >= 2 and substr({d}, 1, 2) in ({two}) then substr({d}, 1, 2) else substr({d}, 1, 1) end"


def carrier_length(n: str) -> str:
    return f"case when {n} >= 7 then 3 when {n} >= 5 then {n} - 4 else 0 end"


def zfill(n: str, width: str) -> str:
    return f"(repeat('0', greatest(0, {width} - length(({n})::varchar))::int) || ({n})::varchar)"


def hexfill(n: str, width: str) -> str:
    h = f"lower(to_hex({n}))"
    return f"(repeat('0', greatest(0, {width} - length({h}))::int) || {h})"


def last(s: str, k: str) -> str:
    return f"(case when {k} <= 0 then '' else right({s}, ({k})::int) end)"


def fit(s: str, width: str) -> str:
    return f"(case when length({s}) > {width} then substr({s}, 1, {width}) else {s} || repeat('0', ({width} - length({s}))::int) end)"


def phone_placeholders(rows: str) -> str:
    """Adds ``placeholder`` to rows that have value and n: phone numbers keep country code, carrier and separators."""
    return f"""select * exclude (d, plus, cd, cc, carrier, room, fresh, laid),
        case when d = '' then value when laid = value then regexp_extract(value, '^(.*)\\d\\D*$', 1) || ((regexp_extract(value, '(\\d)\\D*$', 1)::int + 1) % 10)::varchar || regexp_extract(value, '\\d(\\D*)$', 1) else laid end as placeholder
      from (select *, array_to_string(list_transform(range(1, length(value) + 1), lambda i: case when regexp_matches(substr(value, i, 1), '\\d') then substr(fresh, length({digits('substr(value, 1, i)')}), 1) else substr(value, i, 1) end), '') as laid
      from (select *, {fit(f"((case when plus then cc else '' end) || carrier || {last(zfill('n', 'greatest(room, 1)'), 'room')})", 'length(d)')} as fresh
      from (select *, greatest(0, length(d) - length(carrier) - (case when plus then length(cc) else 0 end)) as room
      from (select *, substr(substr(cd, length(cc) + 1), 1, {carrier_length('length(substr(cd, length(cc) + 1))')}) as carrier
      from (select *, {country_code('cd')} as cc
      from (select *, case when plus then d else {digits(canonical_phone('value'))} end as cd
      from (select *, {digits('value')} as d, ltrim(value) like '+%' as plus from ({rows}))))))))"""


def numbered(cands: str) -> str:
    """Candidates with bucket, key, n: running numbers of canonical values in order of first sighting."""
    keyed = f"select *, case when strategy = 'phone_intl' then '_phone_canonical' else rule end as bucket, case when strategy = 'phone_intl' then {canonical_phone('value')} when strategy in ('ipv4', 'credentials') then value else lower(value) end as key from ({cands})"
    return f"""with keyed as ({keyed}), ranked as (select bucket, key, row_number() over (partition by bucket order by min(first)) as n from keyed group by bucket, key)
      select keyed.*, ranked.n from keyed join ranked using (bucket, key)"""


def with_placeholders(cands: str) -> str:
    """Numbered IPv4 and phone candidates with their placeholders."""
    return f"select * replace (case when strategy = 'ipv4' then '203.0.113.' || n::varchar else placeholder end as placeholder) from ({phone_placeholders(numbered(cands))})"


def overlong(v: str, p: str) -> str:
    return f"({v} <> '' and {p} <> '' and length({p}) > length({v}) + 4)"


def clamp(v: str, p: str) -> str:
    head = f"greatest(1, length({v}) - 3)"
    return f"(case when length({v}) <= 0 or length({p}) <= length({v}) then {p} else substr({p}, 1, {head}) || repeat('0', (length({v}) - {head})::int) end)"
