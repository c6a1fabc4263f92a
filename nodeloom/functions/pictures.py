"""Integers, dates and times by picture, and xs:time values in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions import fn, text, values

Lit = F.lit

#: English names.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def letters(x: Column, base: str = "a") -> Column:
    """a, b, ..., z, aa, ab, ...: digits of a number system without a zero, the last one first; enough of them for 64 bits."""
    step = lambda s, _: F.struct(
        F.when(s["n"] > 0, F.concat(F.char(Lit(ord(base)) + ((s["n"] - 1) % 26).cast("int")), s["t"])).otherwise(s["t"]).alias("t"),
        F.when(s["n"] > 0, (s["n"] - 1 - (s["n"] - 1) % 26) / 26).otherwise(0).cast("bigint").alias("n"),
    )
    start = F.struct(Lit("").alias("t"), x.cast("bigint").alias("n"))
    return F.aggregate(F.sequence(Lit(1), Lit(14)), start, step, lambda s: s["t"])


def format_integer(x: Column, picture: str) -> Column:
    return once(x, lambda v: _format_integer(v, picture))


def _format_integer(x: Column, picture: str) -> Column:
    """fn:format-integer: decimal digits with leading zeros and grouping, ``a``, ``A``, ``i``, ``I``, ``w``, ``W``, ``Ww``; ``;o`` gives ordinals."""
    primary, _, modifier = picture.partition(";")
    ordinal = modifier.startswith("o")
    n = F.abs(x)
    if primary in ("a", "A"):
        out = F.when(n == 0, "0").otherwise(letters(n, primary))
    elif primary in ("i", "I"):
        out = F.when(n.between(1, 3999), fn.format_integer(n, primary)).otherwise(n.cast("string"))
    elif primary in ("w", "W", "Ww"):
        out = text.number_words(n, ordinal)
        out = {"w": out, "W": F.upper(out), "Ww": F.initcap(out)}[primary]
    else:
        if not re.fullmatch(r"[#0-9]+([^\w#][#0-9]+)*", primary) or not re.search("[0-9]", primary):
            raise ValueError(f"FODF1310: {picture}")
        digits = [c for c in primary if c in "#0123456789"]
        least = sum(c != "#" for c in digits)
        out = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), Lit(least)), "0")
        marks = [(len([c for c in primary[i + 1 :] if c in "#0123456789"]), c) for i, c in enumerate(primary) if c not in "#0123456789"]
        places = [p for p, _ in marks]
        sign = marks[0][1] if marks else ""
        if marks and len({c for _, c in marks}) == 1 and sorted(places) == [places[-1] * (i + 1) for i in range(len(places))]:
            out = F.regexp_replace(out, rf"(?<=\d)(?=(\d{{{places[-1]}}})+$)", re.escape(sign) if sign in "$\\" else sign)
        else:
            for p, c in sorted(marks):
                at = p + sum(1 for q, _ in marks if q < p)
                out = F.regexp_replace(out, rf"(?<=\d)(?=.{{{at}}}$)", c)
        if ordinal:
            out = F.concat(out, F.substring(text.ordinal_number(n), -2, 2))
    return F.when(x < 0, F.concat(Lit("-"), out)).otherwise(out)


def _named(names: list[str], at: Column, style: str, most: int | None) -> Column:
    out = F.element_at(F.split(Lit(" ".join(names)), " "), at.cast("int"))
    out = F.upper(out) if style == "N" else F.lower(out) if style == "n" else out
    return F.substring(out, 1, most) if most else out


def _component(marker: str, z: Column) -> Column:
    marker = re.sub(r"\s", "", marker)
    kind, rest = marker[0], marker[1:]
    rest, _, width = rest.partition(",")
    low, _, high = width.partition("-")
    least, most = (int(w) if w.isdigit() else None for w in (low, high))
    ordinal = rest.endswith("o") and len(rest) > 1
    style = rest.rstrip("ot") if len(rest) > 1 else rest
    t = z["local"]
    if kind in "Zz":
        minutes, size = z["tz_min"], F.abs(z["tz_min"])
        two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
        sign = F.when(minutes < 0, "-").otherwise("+")
        shown = F.concat(sign, two(size / 60), Lit("" if style == "0000" else ":"), two(size % 60))
        if style in ("0", "1"):
            shown = F.concat(sign, (size / 60).cast("int").cast("string"), F.when(size % 60 != 0, F.concat(Lit(":"), two(size % 60))).otherwise(""))
        if style == "Z":
            shown = F.when(minutes == 0, "Z").otherwise(shown)
        if kind == "z":
            shown = F.concat(Lit("GMT"), shown)
        return F.coalesce(shown, Lit(""))
    if kind == "P":
        return _named(["am", "pm"], F.when(F.hour(t) < 12, 1).otherwise(2), style or "n", most)
    if kind == "F" and style in ("", "n", "N", "Nn"):
        return _named(DAYS, F.weekday(t) + 1, style or "n", most)
    if kind == "M" and style in ("n", "N", "Nn"):
        return _named(MONTHS, F.month(t), style, most)
    if kind in "CE":
        return Lit("ISO" if kind == "C" else "AD")
    if kind == "f":
        digits = F.rpad(F.substring(F.date_format(t, "SSSSSS"), 1, 6), 6, "0")
        n = most or max(len(style), least or 1)
        shown = F.substring(F.rpad(digits, max(n, 6), "0"), 1, n)
        return F.regexp_replace(shown, f"0{{0,{n - (least or 1)}}}$", "") if most and n > (least or 1) else shown
    number = {
        "Y": F.year(t), "M": F.month(t), "D": F.dayofmonth(t), "d": F.dayofyear(t), "F": F.weekday(t) + 1, "W": F.weekofyear(t), "H": F.hour(t), "h": (F.hour(t) + 11) % 12 + 1, "m": F.minute(t), "s": F.second(t),
        "w": F.floor((F.dayofmonth(t) + (F.weekday(F.trunc(t.cast("date"), "month"))) - 1) / 7) + 1,
    }.get(kind)
    if number is None:
        raise ValueError(f"FOFD1340: [{marker}]")
    style = style or ("01" if kind in "ms" else "1")
    if style in ("i", "I", "a", "A", "w", "W", "Ww"):
        return format_integer(number.cast("bigint"), style + (";o" if ordinal else ""))
    if kind == "Y":
        most = most or (len(style) if len(style) == 2 else None)
        if most:
            return F.lpad((number % 10**most).cast("string"), most, "0")
    fill = max(len(style), least or 1)
    shown = F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), Lit(fill)), "0")
    return F.concat(shown, F.substring(text.ordinal_number(number), -2, 2)) if ordinal else shown


def _formatted(value: Column, picture: str) -> Column:
    return once(value, lambda z: _of_zoned(z, picture))


def _of_zoned(z: Column, picture: str) -> Column:
    out = []
    for literal, marker in re.findall(r"((?:[^\[\]]|\[\[|\]\])+)|\[([^\]]+)\]", picture):
        out.append(Lit(literal.replace("[[", "[").replace("]]", "]")) if literal else _component(marker, z))
    return F.when(z["local"].isNotNull(), F.concat(*out))


def _zoned(value: Column) -> Column:
    return values.zoned(F.replace(value, Lit(" "), Lit("T")))


def format_date_time(value: Column, picture: str) -> Column:
    """fn:format-date and fn:format-dateTime of a value in text, English names, ISO calendar."""
    return _formatted(_zoned(value), picture)


def format_time(value: Column, picture: str) -> Column:
    return _formatted(values.zoned(F.concat(Lit("2000-01-01T"), value)), picture)


def time_part(value: Column, part: int) -> Column:
    """Hours (1), minutes (2) or seconds (3) of an xs:time in text; null for other text."""
    found = F.regexp_extract(value, r"^([0-9]{2}):([0-9]{2}):([0-9]{2}(?:[.][0-9]+)?)", part)
    found = F.when(found != "", found).try_cast("double")
    return found if part == 3 else found.cast("bigint")


def timezone_from_time(value: Column) -> Column:
    return once(F.concat(Lit("2000-01-01T"), value), timezone)


def timezone(value: Column) -> Column:
    """The zone of a date or date-time in text, as a dayTimeDuration."""
    return once(once(value, values.zoned), lambda z: once(F.struct(Lit(0).alias("months"), (z["tz_min"] * 60).cast("decimal(38,6)").alias("seconds")), lambda d: values.duration_text(d, "dayTimeDuration")))


def _minutes(zone: str) -> int | None:
    """Minutes of a dayTimeDuration such as -PT5H30M; none for an empty text."""
    if not zone:
        return None
    m = re.fullmatch(r"(-?)PT(?:(\d+)H)?(?:(\d+)M)?(?:0S)?", zone)
    if not m or 60 * int(m[2] or 0) + int(m[3] or 0) > 840:
        raise ValueError(f"FODT0003: {zone}")
    return (-1 if m[1] else 1) * (60 * int(m[2] or 0) + int(m[3] or 0))


def adjust_date_time(value: Column, zone: str) -> Column:
    return once(once(_zoned(value), lambda z: values.adjust_to_timezone(z, _minutes(zone))), values.zoned_text)


def adjust_date(value: Column, zone: str) -> Column:
    return F.regexp_replace(adjust_date_time(value, zone), "T[0-9:.]+", "")


def adjust_time(value: Column, zone: str) -> Column:
    return F.regexp_replace(adjust_date_time(F.concat(Lit("2000-01-02T"), value), zone), "^.*T", "")
