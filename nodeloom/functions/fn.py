"""The XPath function library over Columns. An empty sequence is null, a sequence an array; names follow fn:, math:, map: and array:."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Lit = F.lit


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), Lit(""))


# -- strings ------------------------------------------------------------------------------------


def concat(*parts: Column) -> Column:
    return F.concat(*map(_s, parts))


def string_join(items: Column, separator: str = "") -> Column:
    return F.coalesce(F.array_join(items.cast("array<string>"), separator), Lit(""))


def fn_round(x: Column) -> Column:
    """Half towards positive infinity."""
    return F.floor(x + Lit(0.5))


def substring(text: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at places p with round(start) <= p < round(start) + round(length); places count from 1."""
    nan = F.isnan(start.cast("double")) if length is None else F.isnan(start.cast("double")) | F.isnan(length.cast("double"))
    return F.when(F.coalesce(nan, Lit(False)), "").otherwise(_substring(text, F.nanvl(start.cast("double"), Lit(1.0)), None if length is None else F.nanvl(length.cast("double"), Lit(0.0))))


def _substring(text: Column, start: Column, length: Column | None) -> Column:
    first = fn_round(start)
    low = F.greatest(first, Lit(1))
    if length is None:
        return F.substring(_s(text), low.cast("int"), F.length(_s(text)) + 1)
    stop = first + fn_round(length.cast("double"))
    return F.when(stop <= low, Lit("")).otherwise(F.substring(_s(text), low.cast("int"), (stop - low).cast("int")))


def string_length(text: Column) -> Column:
    return F.length(_s(text)).cast("long")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(_s(text), "[ \t\r\n]+", " "))


def upper_case(text: Column) -> Column:
    return F.upper(_s(text))


def lower_case(text: Column) -> Column:
    return F.lower(_s(text))


def translate(text: Column, old: str, new: str) -> Column:
    return F.translate(_s(text), old, new)


def contains(text: Column, part: Column) -> Column:
    return _s(text).contains(_s(part))


def starts_with(text: Column, part: Column) -> Column:
    return _s(text).startswith(_s(part))


def ends_with(text: Column, part: Column) -> Column:
    return _s(text).endswith(_s(part))


def substring_before(text: Column, part: Column) -> Column:
    at = F.instr(_s(text), _s(part))
    return F.when(at > 0, F.substring(_s(text), Lit(1), at - 1)).otherwise("")


def substring_after(text: Column, part: Column) -> Column:
    at = F.instr(_s(text), _s(part))
    return F.when(at > 0, F.substring(_s(text), at + F.length(_s(part)), F.length(_s(text)) + 1)).otherwise("")


def flags(pattern: str, given: str = "") -> str:
    """A Java pattern for an XPath one: the flags s, m, i, x and q as inline flags or quoting."""
    kept = "".join(f for f in given if f in "smix")
    if "q" in given:
        kept = kept.replace("x", "")
        return (f"(?{kept})" if kept else "") + "\\Q" + pattern + "\\E"
    pattern = re.sub(r"-\[(\^?)([^\[\]]+)\]\]", lambda m: f"&&[{'' if m[1] else '^'}{m[2]}]]", pattern)  # [a-z-[aeiou]]
    pattern = pattern.replace("\\i", "[\\p{L}_:]").replace("\\c", "[\\p{L}\\p{N}._:-]")
    return f"(?{kept}){pattern}" if kept else pattern


def matches(text: Column, pattern: str, given: str = "") -> Column:
    return _s(text).rlike(flags(pattern, given))


def replace(text: Column, pattern: str, new: str, given: str = "") -> Column:
    if "q" in given:
        new = new.replace("\\", "\\\\").replace("$", "\\$")
    java = flags(pattern, given)
    empty = F.raise_error(Lit(f"FORX0003: {pattern} matches an empty text")).cast("string")
    return F.when(Lit("").rlike(java), empty).otherwise(F.regexp_replace(_s(text), java, new))


def tokenize(text: Column, pattern: str | None = None, given: str = "") -> Column:
    """One argument: words between white space; an empty text has no tokens."""
    if pattern is None:
        return F.filter(F.split(normalize_space(text), " "), lambda x: x != "")
    return F.when(_s(text) == "", F.array().cast("array<string>")).otherwise(F.split(_s(text), flags(pattern, given), -1))


def contains_token(text: Column, token: str) -> Column:
    return F.array_contains(tokenize(text), token.strip())


def analyze_string(text: Column, pattern: str) -> Column:
    """Matching parts, as an array; the parts between them are ``tokenize(text, pattern)``."""
    return F.regexp_extract_all(_s(text), Lit(pattern), 0)


def string_to_codepoints(text: Column) -> Column:
    return F.transform(F.filter(F.split(_s(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def codepoints_to_string(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("long")), 8, "0")), "UTF-32")), "")


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def codepoint_equal(a: Column, b: Column) -> Column:
    return a == b


def encode_for_uri(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(_s(text)), Lit("+"), Lit("%20")), Lit("*"), Lit("%2A")), Lit("%7E"), Lit("~"))


def collation_key(text: Column, ascii_ci: bool = False) -> Column:
    return F.encode(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ascii_ci else text, "UTF-8")


# -- numbers ------------------------------------------------------------------------------------


def number(x: Column) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), Lit(float("nan")))


def kept(f):
    """``f`` with the type of its argument kept: doubles stay doubles."""
    from functools import wraps

    @wraps(f)
    def run(x: Column) -> Column:
        return F.when(F.abs(x.cast("double")) < 2.0**53, f(F.when(F.abs(x.cast("double")) < 2.0**53, x)).cast("double")).otherwise(x.cast("double"))

    return run


def round_to(x: Column, digits: Column) -> Column:
    """Half towards positive infinity, at a decimal place."""
    unit = F.pow(Lit(10.0), digits.cast("double"))
    return F.floor(x * unit + Lit(0.5)).cast("double") / unit


def round_half_to_even_at(x: Column, digits: Column) -> Column:
    unit = F.pow(Lit(10.0), digits.cast("double"))
    return F.bround(x * unit, 0) / unit


def cardinality(items: Column, least: int, most: int, code: str) -> Column:
    """The item, or none; error where there are fewer or more."""
    return F.when(F.size(items).between(least, most), F.try_element_at(items, Lit(1))).otherwise(F.raise_error(Lit(f"{code}: not {least} to {most} items")))


def at_least_one(items: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(F.raise_error(Lit("FORG0004: no item")))


def round_half_to_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def ceiling(x: Column) -> Column:
    return F.ceil(x)


def divide(a: Column, b: Column) -> Column:
    """Doubles as in IEEE 754."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.when(a > 0, Lit(float("inf"))).when(a < 0, Lit(float("-inf"))).otherwise(Lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(inf)).otherwise(a / F.when(b != 0, b))


def idiv(a: Column, b: Column) -> Column:
    """Towards zero; division by zero is an error, as under ANSI."""
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def mod(a: Column, b: Column) -> Column:
    return a % b


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def format_integer(x: Column, picture: str = "1") -> Column:
    """Pictures 1, 001 (leading zeros), i and I (roman, below 4000), a and A (letters)."""
    if picture in "iI":
        left, out = x.cast("int"), Lit("")
        for v, r in _ROMAN:
            out, left = F.concat(out, F.repeat(Lit(r), F.floor(left / v).cast("int"))), left % v
        return F.upper(out) if picture == "I" else out
    if picture in "aA":
        base = ord(picture)
        from nodeloom.functions import pictures

        return pictures.letters(x, chr(base))
    return F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), Lit(len(picture))), "0")


def format_number(x: Column, decimals: int) -> Column:
    """Picture ``#,##0.00``."""
    return F.format_number(x, decimals)


# -- sequences ----------------------------------------------------------------------------------


def empty(items: Column) -> Column:
    return F.coalesce(F.size(items) <= 0, Lit(True))


def exists(items: Column) -> Column:
    return ~empty(items)


def head(items: Column) -> Column:
    return F.try_element_at(items, Lit(1))


def tail(items: Column) -> Column:
    return F.slice(items, Lit(2), F.greatest(F.size(items) - 1, Lit(0)))


def to(a: Column, b: Column) -> Column:
    """The range a to b, empty if a is above b."""
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def insert_before(items: Column, at: Column, new: Column) -> Column:
    n = F.greatest(F.least(at.cast("int"), F.size(items) + 1), Lit(1))
    return F.concat(F.slice(items, Lit(1), n - 1), new, F.slice(items, n, F.size(items)))


def remove(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, i: i != at - 1)


def reverse(items: Column) -> Column:
    return F.reverse(items)


def subsequence(items: Column, start: Column, length: Column | None = None) -> Column:
    """Start and length are rounded half away from zero."""
    first = F.round(start.cast("double"))
    stop = first + F.round(length.cast("double")) if length is not None else None
    return F.filter(items, lambda _, i: (i + 1 >= first) if stop is None else (i + 1 >= first) & (i + 1 < stop))


def distinct_values(items: Column) -> Column:
    return F.array_distinct(items)


def index_of(items: Column, x: Column) -> Column:
    return F.filter(F.transform(items, lambda v, i: F.when(v == x, i + 1)), lambda v: v.isNotNull())


def deep_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def fn_count(items: Column) -> Column:
    return F.coalesce(F.size(items), Lit(0)).cast("long")


def fn_sum(items: Column) -> Column:
    return F.aggregate(items, Lit(0.0), lambda s, x: s + x)


def fn_avg(items: Column) -> Column:
    return F.when(F.size(items) > 0, fn_sum(items) / F.size(items))


def fn_max(items: Column, doubles: bool = False) -> Column:
    """NaN if any item is; Spark has NaN above all numbers."""
    return F.array_max(items)


def fn_min(items: Column, doubles: bool = False) -> Column:
    """NaN if any item is, where the items are doubles."""
    return F.when(F.exists(items, lambda x: F.isnan(x)), Lit(float("nan"))).otherwise(F.array_min(items)) if doubles else F.array_min(items)


def general_equal(a: Column, b: Column) -> Column:
    """Whether any item of one equals any of the other."""
    return F.arrays_overlap(a, b)


def general_less(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_min(a) < F.array_max(b), Lit(False))


def some(items: Column, holds) -> Column:
    return F.exists(items, holds)


def every(items: Column, holds) -> Column:
    return F.forall(items, holds)


def for_each(items: Column, f) -> Column:
    return F.transform(items, f)


def fn_filter(items: Column, f) -> Column:
    return F.filter(items, f)


def fold_left(items: Column, zero: Column, f) -> Column:
    return F.aggregate(items, zero, f)


def fold_right(items: Column, zero: Column, f) -> Column:
    return F.aggregate(F.reverse(items), zero, lambda s, x: f(x, s))


def for_each_pair(a: Column, b: Column, f) -> Column:
    """Up to the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, Lit(1), n), F.slice(b, Lit(1), n), f)


def fn_sort(items: Column) -> Column:
    return F.array_sort(items)


# -- maps and arrays ----------------------------------------------------------------------------

map_size, map_keys, map_contains, map_entry = F.size, F.map_keys, F.map_contains_key, F.create_map
array_size, array_append, array_reverse, array_flatten, array_join = F.size, F.array_append, F.reverse, F.flatten, F.concat


def map_get(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def map_put(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def map_remove(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def map_merge(a: Column, b: Column, duplicates: str = "use-first") -> Column:
    if duplicates == "use-last":
        a, b = b, a
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def map_for_each(m: Column, f) -> Column:
    return F.transform(F.map_entries(m), lambda e: f(e["key"], e["value"]))


def array_get(a: Column, i: Column) -> Column:
    return F.element_at(a, i)


def _within(a: Column, ok: Column, out: Column, code: str = "FOAY0001") -> Column:
    return F.when(~ok, F.raise_error(Lit(f"{code}: no such place in the array"))).otherwise(out)


def array_put(a: Column, i: Column, v: Column) -> Column:
    """Error FOAY0001 where there is no place ``i``."""
    return _within(a, i.between(1, F.size(a)), F.transform(a, lambda x, n: F.when(n == i - 1, v).otherwise(x)))


def array_subarray(a: Column, start: Column, length: Column | None = None) -> Column:
    """Error FOAY0001 where the part is not within the array, FOAY0002 for a negative length."""
    n = F.size(a) - start + 1 if length is None else length
    inside = _within(a, (start >= 1) & (start + n <= F.size(a) + 1), F.slice(a, F.greatest(start, Lit(1)), F.greatest(n, Lit(0))))
    return _within(a, n >= 0, inside, "FOAY0001" if length is None else "FOAY0002")


def array_remove(a: Column, places: Column) -> Column:
    return _within(a, F.forall(places, lambda i: i.between(1, F.size(a))), F.filter(a, lambda _, n: ~F.array_contains(F.transform(places, lambda i: i.cast("int")), n + 1)))


def array_insert_before(a: Column, i: Column, v: Column) -> Column:
    return _within(a, i.between(1, F.size(a) + 1), F.concat(F.slice(a, Lit(1), F.greatest(i - 1, Lit(0))), F.array(v), F.slice(a, F.greatest(i, Lit(1)), F.size(a))))


def array_head(a: Column) -> Column:
    return _within(a, F.size(a) > 0, F.try_element_at(a, Lit(1)))


def array_tail(a: Column) -> Column:
    return _within(a, F.size(a) > 0, F.slice(a, Lit(2), F.size(a)))


# -- dates --------------------------------------------------------------------------------------

year_from, month_from, day_from, hours_from, minutes_from = F.year, F.month, F.dayofmonth, F.hour, F.minute


def seconds_from(t: Column) -> Column:
    return F.extract(Lit("SECOND"), t)


def add_months(d: Column, n: Column) -> Column:
    """Years and months of a duration; the day is clamped to the month's last."""
    return F.add_months(d, n)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def format_date(d: Column, picture: str) -> Column:
    """Pictures of [Y], [M], [D], [H], [m], [s] with widths, such as ``[Y0001]-[M01]-[D01]``."""
    for a, b in (("[Y0001]", "yyyy"), ("[Y]", "y"), ("[M01]", "MM"), ("[M]", "M"), ("[D01]", "dd"), ("[D]", "d"), ("[H01]", "HH"), ("[m01]", "mm"), ("[s01]", "ss")):
        picture = picture.replace(a, b)
    return F.date_format(d, picture)


# -- names and JSON -----------------------------------------------------------------------------


def local_name_from_qname(q: Column) -> Column:
    return F.substring_index(F.regexp_replace(q, r"^Q\{[^}]*\}", ""), ":", -1)


def prefix_from_qname(q: Column) -> Column:
    q = F.regexp_replace(q, r"^Q\{[^}]*\}", "")
    return F.when(F.contains(q, Lit(":")), F.substring_index(q, ":", 1))


def qname(uri: Column, name: Column) -> Column:
    """An expanded name as ``Q{uri}name``, prefix kept; without a namespace the name."""
    return F.when(F.coalesce(uri, Lit("")) == "", name).otherwise(F.concat(Lit("Q{"), uri, Lit("}"), name))


def namespace_uri_from_qname(q: Column) -> Column:
    return F.regexp_extract(q, r"^Q\{([^}]*)\}", 1)


def checked_json(text: Column) -> Column:
    """The JSON value in text; text that is none is an error."""
    return F.to_json(F.parse_json(text))


def parse_json(text: Column) -> Column:
    return F.try_parse_json(text)


def json_member(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def castable(x: Column, kind: str) -> Column:
    return x.try_cast(kind).isNotNull()
