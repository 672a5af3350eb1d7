"""HTML entities decoded by built-in functions, as the fifth version of HTML says, and the same in SQL."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names with a semicolon, and those that may do without one; both come from the standard library's table.
NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
BARE = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
LONGEST_BARE = max(map(len, BARE))
_BUCKETS = 64
_NAME = r"^[^\t\n\f <&#;]{1,32};?"
_NUMBER, _HEX = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?"


def _bucket(name: str) -> int:
    return (ord(name[0]) * 31 + ord(name[1])) % _BUCKETS


def _lookup(name: Column) -> Column:
    """A name's text from a literal that is cut into small maps by its first two letters."""
    maps: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for k, v in (NAMED | BARE).items():
        maps[_bucket(k)][k] = v
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    at = F.pmod(F.ascii(F.substring(name, 1, 1)) * 31 + F.ascii(F.substring(name, 2, 1)), F.lit(_BUCKETS))
    return F.get(table, at)[name]


def windows_letters() -> dict[int, str]:
    """What the numbers 128 to 159 stand for: the letters of code page 1252, or themselves where it has none."""
    return {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}


def _letter(number: Column) -> Column:
    """The character of a number: what stands for a wrong one, nothing for one that stands for none."""
    windows = F.array(*map(F.lit, windows_letters().values()))
    none = ((number >= 1) & (number <= 8)) | ((number >= 14) & (number <= 31)) | (number == 11) | (number == 127) | ((number >= 0xFDD0) & (number <= 0xFDEF)) | ((number % 65536) >= 0xFFFE)
    code = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    wrong = number.isNull() | (number == 0) | (number > 0x10FFFF) | ((number >= 0xD800) & (number <= 0xDFFF))
    return F.when(wrong, "�").when((number >= 128) & (number <= 159), F.get(windows, (number - 128).cast("int"))).when(none, "").otherwise(code)


def _number(digits: Column, base: int) -> Column:
    """The number of a run of digits, null if it is beyond any character."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(bare == "", F.lit(0).cast("long")).when(F.length(bare) <= 8, F.conv(bare, base, 10).cast("long"))


def _decode_part(part: Column) -> Column:
    """What follows an ampersand, decoded, or with its ampersand as it was."""
    name = F.regexp_extract(part, _NAME, 0)
    decimal, hexa = F.regexp_extract(part, _NUMBER, 0), F.regexp_extract(part, _HEX, 0)
    rest = lambda of: F.substr(part, F.length(of) + 1)
    bare = [F.when(F.length(name) > k, F.concat(_lookup(F.substring(part, 1, k)), F.substr(part, F.lit(k + 1)))) for k in range(LONGEST_BARE, 1, -1)]
    named = F.coalesce(F.concat(_lookup(name), rest(name)), *bare, F.concat(F.lit("&"), part))
    return (
        F.when(~part.rlike("^[#A-Za-z]"), F.concat(F.lit("&"), part))
        .when(decimal != "", F.concat(_letter(_number(F.regexp_extract(part, _NUMBER, 1), 10)), rest(decimal)))
        .when(hexa != "", F.concat(_letter(_number(F.regexp_extract(part, _HEX, 1), 16)), rest(hexa)))
        .when(F.length(name) >= 2, named)
        .otherwise(F.concat(F.lit("&"), part))
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric entities decoded: split at ampersands, each part by its beginning. A null stays null."""
    parts = F.split(text, "&", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _decode_part), ""))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entities_sql(source: str, key: str, text: str) -> str:
    """Tables that lead to ``decoded`` (key, raw, decoded), for an engine with ``chr`` and lambda functions."""
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted((NAMED | BARE).items()))
    windows = ", ".join(_quoted(x) for x in windows_letters().values())
    prefixes = " union all ".join(f"select {key}, o, {k} as len, substr(part, 1, {k}) as name from parts where o > 1 and length(nm) > {k}" for k in range(2, LONGEST_BARE + 1))
    number = lambda digits, value: f"case when length(ltrim({digits}, '0')) > 8 then 99999999 else {value} end"
    hexa = "coalesce(nullif(ltrim(hx, '0'), ''), '0')"
    return f"""ent(name, txt) as (values {rows}),
parts as (select {key}, o, part, regexp_extract(part, '^[^\\t\\n\\f <&#;]{{1,32}};?') as nm, regexp_extract(part, '^#([0-9]+);?', 1) as dc, regexp_extract(part, '^#[0-9]+;?') as dcall, regexp_extract(part, '^#[xX]([0-9a-fA-F]+);?', 1) as hx, regexp_extract(part, '^#[xX][0-9a-fA-F]+;?') as hxall
  from (select {key}, unnest(string_split({text}, '&')) as part, generate_subscripts(string_split({text}, '&'), 1) as o from {source} where {text} is not null)),
tried as (select {key}, o, length(nm) as len, nm as name from parts where o > 1 and nm <> '' union all {prefixes}),
best as (select {key}, o, max(len) as len from tried join ent using (name) group by {key}, o),
told as (select b.{key}, b.o, b.len, e.txt from best b join tried t on t.{key} = b.{key} and t.o = b.o and t.len = b.len join ent e on e.name = t.name),
nums as (select *, case when dcall <> '' then {number("dc", "try_cast(dc as bigint)")} when hxall <> '' then {number("hx", f"('0x' || {hexa})::bigint")} end as num from parts),
letters as (select *, case when num is null then null when num = 0 or num > 1114111 or num between 55296 and 57343 then chr(65533) when num between 128 and 159 then [{windows}][num - 127] when num between 1 and 8 or num between 14 and 31 or num = 11 or num = 127 or num between 64976 and 65007 or num % 65536 >= 65534 then '' else chr(num::int) end as letter from nums),
pieces as (select l.{key}, l.o, case when l.o = 1 then part when num is not null then letter || substr(part, length(case when dcall <> '' then dcall else hxall end) + 1) when told.txt is not null and regexp_matches(part, '^[A-Za-z]') then told.txt || substr(part, told.len + 1) else '&' || part end as piece from letters l left join told on told.{key} = l.{key} and told.o = l.o),
decoded as (select {key}, string_agg(piece, '' order by o) as decoded from pieces group by {key})"""
