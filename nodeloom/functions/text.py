"""URIs, Unicode forms, dates of mail headers, and number pictures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Lit = F.lit


def _encoded(text: Column, kept: str) -> Column:
    """Every code point outside the class ``kept`` as percent escapes of its UTF-8 bytes."""
    escape = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(F.split(F.coalesce(text, Lit("")), ""), lambda c: F.when(c.rlike(f"^{kept}?$"), c).otherwise(escape(c))), "")


def iri_to_uri(text: Column) -> Column:
    return _encoded(text, r'[!-~&&[^<>"{}|\\^`]]')


def escape_html_uri(text: Column) -> Column:
    return _encoded(text, "[ -~]")


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """Forms NFC, NFD, NFKC, NFKD; an empty form changes nothing. Spark has no such expression, hence Arrow batches."""
    form = form.strip().upper()
    if not form:
        return F.coalesce(text, Lit(""))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").str.normalize(form)

    return run(text)


def resolve_uri(relative: Column, base: Column) -> Column:
    """RFC 3986 resolution in Arrow batches."""

    @F.pandas_udf("string")
    def run(r: pd.Series, b: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        return pd.Series([None if x is None else x if y is None else urljoin(y, x) for x, y in zip(r, b, strict=True)], dtype=object)

    return run(relative, base)


#: Hours of the zones that mail headers name.
_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_ietf_date(text: Column) -> Column:
    """Dates such as ``Wed, 06 Jun 1994 07:29:35 -0500`` and ``Jun 6 07:29:35 1994`` as struct<local timestamp_ntz, tz_min int>; a missing zone is UTC; null if it is none."""
    names = "|".join(_MONTHS)
    day = r"^(?i)\s*(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|satu?r?|sun)(?:day)?,?\s+)?"
    time, zone = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", r"\s*([+-]\d{1,2}:?\d{2}|[a-z]{2,3})?(?:\s*\([^)]*\))?"
    first = rf"{day}(\d{{1,2}})[\s-]+({names})[\s-]+(\d{{2}}|\d{{4}})\s+{time}{zone}\s*$"
    second = rf"{day}({names})[\s-]+(\d{{1,2}})\s+{time}{zone}\s+(\d{{2}}|\d{{4}})\s*$"
    one = text.rlike(first)
    g = lambda i, j: F.when(one, F.regexp_extract(text, first, i)).otherwise(F.regexp_extract(text, second, j))
    month = F.array_position(F.array(*map(Lit, _MONTHS)), F.lower(g(2, 1)))
    year = g(3, 7).try_cast("int")
    year = F.when(F.length(g(3, 7)) == 2, year + 1900).otherwise(year)
    z = F.upper(g(7, 6))
    offset = F.replace(z, Lit(":"), Lit(""))
    size = F.regexp_extract(offset, "([0-9]{1,2})[0-9]{2}$", 1).try_cast("int") * 60 + F.right(offset, Lit(2)).try_cast("int")
    minutes = F.when(z == "", 0).when(z.startswith("-"), -size).when(z.startswith("+"), size)
    named = F.create_map(*[x for name, hours in _ZONES.items() for x in (Lit(name), Lit(hours * 60))])
    minutes = F.coalesce(F.try_element_at(named, z), minutes)
    second_ = F.coalesce(g(6, 5).try_cast("decimal(16,6)"), Lit(0).cast("decimal(16,6)"))
    local = F.try_make_timestamp_ntz(year, month.cast("int"), g(1, 2).try_cast("int"), g(4, 3).try_cast("int"), g(5, 4).try_cast("int"), second_)
    good = (one | text.rlike(second)) & minutes.isNotNull() & local.isNotNull()
    return F.when(good, F.struct(local.alias("local"), minutes.cast("int").alias("tz_min")))


# -- numbers ------------------------------------------------------------------------------------


def math_log(x: Column, base10: bool = False) -> Column:
    """-INF at 0 and NaN below it, as in IEEE 754."""
    x = x.cast("double")
    edge = F.when(x == 0, Lit(float("-inf"))).when(x < 0, Lit(float("nan")))
    return F.coalesce(edge, (F.log10 if base10 else F.ln)(x))


def exp10(x: Column) -> Column:
    return F.pow(Lit(10.0), x)


def random_number(seed: Column, n: int = 0) -> Column:
    """The n-th number in [0, 1) of the generator with this seed; the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(seed, Lit(n)), 11) / Lit(2.0**53)


def permute(items: Column, seed: Column) -> Column:
    keyed = F.transform(items, lambda x, i: F.struct(F.xxhash64(seed, i).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


#: English number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
_GROUPS = ((10**9, "billion"), (10**6, "million"), (1000, "thousand"))
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def number_words(x: Column, ordinal: bool = False) -> Column:
    """Cardinal or ordinal number words below a million million."""
    ones, tens = F.array(*map(Lit, _ONES)), F.array(*map(Lit, _TENS))

    def small(n: Column) -> Column:
        low = F.when(n % 100 < 20, F.when((n % 100 == 0), Lit("")).otherwise(F.element_at(ones, (n % 100 + 1).cast("int"))))
        low = low.otherwise(F.concat(F.element_at(tens, (n % 100 / 10).cast("int") + 1), F.when(n % 10 == 0, "").otherwise(F.concat(Lit("-"), F.element_at(ones, (n % 10 + 1).cast("int"))))))
        hundred = F.when(n >= 100, F.concat(F.element_at(ones, (n / 100).cast("int") + 1), Lit(" hundred"))).otherwise("")
        return F.concat_ws(" and ", F.when(hundred != "", hundred), F.when(low != "", low))

    n = F.abs(x.cast("bigint"))
    parts = [F.when(n % (1000 * size) >= size, F.concat(small((n % (1000 * size) / size).cast("bigint")), Lit(f" {name}"))) for size, name in _GROUPS]
    rest = F.when(n % 1000 > 0, small(n % 1000))
    words = F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *parts, rest))
    if ordinal:
        last = F.regexp_extract(words, "[a-z]+$", 0)
        changed = F.when(last.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, Lit("th")))
        for a, b in _ORDINALS.items():
            changed = F.when(last == a, b).otherwise(changed)
        words = F.concat(F.regexp_replace(words, "[a-z]+$", ""), changed)
    return F.when(x < 0, F.concat(Lit("-"), words)).otherwise(words)


def ordinal_number(x: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, ..."""
    n = F.abs(x.cast("bigint"))
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(x.cast("bigint").cast("string"), suffix)


def format_number(x: Column, picture: str) -> Column:
    """fn:format-number in the default decimal format: ``#``, ``0``, grouping commas, a point, ``%``, ``‰``, text around, and a second picture for negative numbers."""
    positive, _, negative = picture.partition(";")
    m = re.fullmatch(r"([^#0,.]*)([#0,]*)(?:\.([0#]*))?([^#0,.]*)", positive)
    if not m:
        raise ValueError(f"FODF1310: {picture}")
    before, whole, part, after = m[1], m[2], m[3] or "", m[4]
    factor = 100 if "%" in before + after else 1000 if "‰" in before + after else 1
    least, fewest, most = whole.count("0"), part.count("0"), len(part)
    least = max(least, 0 if part else 1)
    group = len(whole) - whole.rfind(",") - 1 if "," in whole else 0
    value = F.bround(F.abs(x.cast("decimal(30,12)")) * factor, most)
    digits = F.split(value.cast("string"), "[.]")
    left = F.when(digits[0] == "0", "").otherwise(digits[0])
    left = F.lpad(left, F.greatest(F.length(left), Lit(least)), "0") if least else left
    if group:
        left = F.regexp_replace(left, rf"(?<=\d)(?=(\d{{{group}}})+$)", ",")
    right = F.rpad(F.substring(F.coalesce(F.try_element_at(digits, Lit(2)), Lit("")), 1, most), most, "0") if most else Lit("")
    if most > fewest:
        right = F.regexp_replace(right, f"0{{0,{most - fewest}}}$", "")
    number = F.concat(left, F.when(right != "", F.concat(Lit("."), right)).otherwise(""))
    head, tail = re.fullmatch(r"([^#0,.]*)[#0,.]*([^#0,.]*)", negative).groups() if negative else (f"-{before}", after)
    shown = F.when(x < 0, F.concat(Lit(head), number, Lit(tail))).otherwise(F.concat(Lit(before), number, Lit(after)))
    return F.when(F.isnan(x.cast("double")), "NaN").otherwise(shown)
