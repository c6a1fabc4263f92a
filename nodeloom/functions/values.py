"""Typed values: zoned date-times, durations, and the constructors of simple types. Text that is no value of the type gives null; ``construct`` raises instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Lit = F.lit

# -- date-times with an optional zone: struct<local timestamp_ntz, tz_min int> --------------------

_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _zone_minutes(text: Column) -> Column:
    zone = F.regexp_extract(text, _ZONE, 1)
    size = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    return F.when(zone == "", F.lit(None).cast("int")).when(zone == "Z", Lit(0)).when(zone.startswith("-"), -size).otherwise(size)


def zoned(text: Column) -> Column:
    """An xs:dateTime, or an xs:date as its midnight."""
    text = F.trim(text)
    local = F.replace(F.regexp_replace(text, _ZONE, ""), Lit("T"), Lit(" "))
    return F.struct(F.to_timestamp_ntz(F.when(local.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?)?$"), local)).alias("local"), _zone_minutes(text).alias("tz_min"))


def date_time(date: Column, time: Column) -> Column:
    """fn:dateTime of two texts: the zone is that of either."""
    d, t = F.regexp_replace(date, _ZONE, ""), F.regexp_replace(time, _ZONE, "")
    a, b = _zone_minutes(date), _zone_minutes(time)
    clash = F.when(a != b, F.raise_error(Lit("FORG0008: the zones differ")).cast("int"))
    return F.struct(F.to_timestamp_ntz(F.concat(d, Lit(" "), t)).alias("local"), F.coalesce(clash, a, b).alias("tz_min"))


def timezone_from(z: Column) -> Column:
    """The zone as a dayTimeDuration in text."""
    return duration_text(F.struct(Lit(0).alias("months"), (z["tz_min"] * 60).cast("decimal(38,6)").alias("seconds")), "dayTimeDuration")


def _plus_minutes(local: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, local).cast("timestamp_ntz")


def instant(z: Column, implicit: int = 0) -> Column:
    """The moment in UTC, for comparison and sorting; values without a zone take the implicit one."""
    return _plus_minutes(z["local"], -F.coalesce(z["tz_min"], Lit(implicit)))


def adjust_to_timezone(z: Column, minutes: int | None) -> Column:
    """The same moment in another zone; None takes the zone away, and a value without one only receives it."""
    if minutes is None:
        return F.struct(z["local"].alias("local"), F.lit(None).cast("int").alias("tz_min"))
    moved = _plus_minutes(z["local"], Lit(minutes) - z["tz_min"])
    return F.struct(F.coalesce(moved, z["local"]).alias("local"), Lit(minutes).alias("tz_min"))


def zone_text(minutes: Column) -> Column:
    size = F.abs(minutes)
    shown = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), Lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.when(minutes.isNull(), "").when(minutes == 0, "Z").otherwise(shown)


def zoned_text(z: Column) -> Column:
    whole = F.date_format(z["local"], "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_extract(z["local"].cast("string"), "[.][0-9]+$", 0)
    return F.concat(whole, part, zone_text(z["tz_min"]))


# -- durations: struct<months int, seconds decimal(38,6)> -----------------------------------------

_DURATION = r"^(-?)P(?=[0-9T])(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?=[0-9])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.][0-9]+)?)S)?)?$"


def _held(x: Column, made) -> Column:
    """``made`` of a value that is worked out once, however often it is named: else nested calls repeat all that they are given."""
    return F.element_at(F.transform(F.array(x), made), 1)


def duration(text: Column) -> Column:
    def read(p):
        part = lambda i, kind: F.when(p[i] != "", p[i].try_cast(kind)).otherwise(Lit(0).cast(kind))
        sign = F.when(p[0] == "-", -1).otherwise(1)
        months = sign * (part(1, "int") * 12 + part(2, "int"))
        seconds = sign * (part(3, "bigint") * 86400 + part(4, "bigint") * 3600 + part(5, "bigint") * 60 + part(6, "decimal(20,6)"))
        return F.when(p.isNotNull(), F.struct(months.cast("int").alias("months"), seconds.cast("decimal(38,6)").alias("seconds")))

    # one match gives all parts
    parts = lambda t: F.when(t.rlike(_DURATION), F.split(F.regexp_replace(t, _DURATION, "$1;$2;$3;$4;$5;$6;$7"), ";"))
    return _held(_held(F.trim(text), parts), read)


def years_from_duration(d: Column) -> Column:
    return (d["months"] / 12).cast("int")


def months_from_duration(d: Column) -> Column:
    return d["months"] % 12


def days_from_duration(d: Column) -> Column:
    return (d["seconds"].cast("bigint") / 86400).cast("bigint")


def hours_from_duration(d: Column) -> Column:
    return (d["seconds"].cast("bigint") % 86400 / 3600).cast("bigint")


def minutes_from_duration(d: Column) -> Column:
    return (d["seconds"].cast("bigint") % 3600 / 60).cast("bigint")


def seconds_from_duration(d: Column) -> Column:
    return (d["seconds"] % 60).cast("decimal(8,6)")


def add_duration(local: Column, d: Column, sign: int = 1) -> Column:
    """Months first, with the day clamped to the month's last, then seconds."""
    moved = F.timestamp_add("MONTH", d["months"] * sign, local)
    return F.timestamp_add("MICROSECOND", (d["seconds"] * 1000000).cast("bigint") * sign, moved).cast("timestamp_ntz")


def scale_duration(d: Column, by: Column) -> Column:
    return F.struct(F.floor(d["months"] * by + 0.5).cast("int").alias("months"), (d["seconds"] * by).cast("decimal(38,6)").alias("seconds"))


def duration_text(d: Column, kind: str = "duration") -> Column:
    """Canonical text."""
    return _held(d, lambda x: _duration_text(x, kind))


def _duration_text(d: Column, kind: str) -> Column:
    months, seconds = F.abs(d["months"]), F.abs(d["seconds"])
    whole = seconds.cast("bigint")
    some = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), Lit(unit))).otherwise("")
    exact = F.regexp_replace((seconds % 60).cast("decimal(8,6)").cast("string"), r"[.]?0+$", "")
    exact = F.when(seconds % 60 == 0, "").otherwise(F.concat(F.when(seconds % 60 < 10, F.regexp_replace((seconds % 60).cast("decimal(8,6)").cast("string"), r"[.]?0{1,6}$", "")).otherwise(exact), Lit("S")))
    clock = F.concat(some((whole % 86400 / 3600).cast("bigint"), "H"), some((whole % 3600 / 60).cast("bigint"), "M"), exact)
    body = F.concat(some((months / 12).cast("int"), "Y"), some(months % 12, "M"), some((whole / 86400).cast("bigint"), "D"), F.when(clock != "", F.concat(Lit("T"), clock)).otherwise(""))
    zero = "P0M" if kind == "yearMonthDuration" else "PT0S"
    negative = (d["months"] < 0) | (d["seconds"] < 0)
    return F.when(body == "", Lit(zero)).otherwise(F.concat(F.when(negative, "-").otherwise(""), Lit("P"), body))


# -- simple types -------------------------------------------------------------------------------

_INT, _NAME = "[+-]?[0-9]+", r"[\p{L}_:][\p{L}\p{N}\p{M}._:-]*"
_NCNAME = r"[\p{L}_][\p{L}\p{N}\p{M}._-]*"
_DAY, _TZ = "(0[1-9]|[12][0-9]|3[01])", "(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_MONTH, _TIME = "(0[1-9]|1[0-2])", "(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?|24:00:00([.]0+)?)"

#: Lexical form and Spark type of the simple types.
TYPES = {
    "string": (".*", "string"), "normalizedString": (".*", "string"), "token": (".*", "string"), "anyURI": (".*", "string"), "untypedAtomic": (".*", "string"),
    "language": ("[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*", "string"), "NMTOKEN": (r"[\p{L}\p{N}\p{M}._:-]+", "string"), "Name": (_NAME, "string"),
    "NCName": (_NCNAME, "string"), "ID": (_NCNAME, "string"), "IDREF": (_NCNAME, "string"), "ENTITY": (_NCNAME, "string"), "QName": (f"({_NCNAME}:)?{_NCNAME}", "string"),
    "boolean": ("true|false|0|1", "boolean"), "decimal": (r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)", "decimal(38,18)"),
    "double": (r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([Ee][+-]?[0-9]+)?|[+-]?INF|NaN", "double"), "float": (r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([Ee][+-]?[0-9]+)?|[+-]?INF|NaN", "float"),
    "integer": (_INT, "decimal(38,0)"), "date": (f"-?[0-9]{{4,}}-{_MONTH}-{_DAY}{_TZ}", "date"), "dateTime": (f"-?[0-9]{{4,}}-{_MONTH}-{_DAY}T{_TIME}{_TZ}", "string"),
    "time": (f"{_TIME}{_TZ}", "string"), "gYear": (f"-?[0-9]{{4,}}{_TZ}", "string"), "gYearMonth": (f"-?[0-9]{{4,}}-{_MONTH}{_TZ}", "string"), "gMonth": (f"--{_MONTH}{_TZ}", "string"),
    "gMonthDay": (f"--{_MONTH}-{_DAY}{_TZ}", "string"), "gDay": (f"---{_DAY}{_TZ}", "string"), "hexBinary": ("([0-9A-Fa-f]{2})*", "binary"), "base64Binary": ("([A-Za-z0-9+/ ]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", "binary"),
    "duration": (_DURATION[1:-1], "string"), "yearMonthDuration": ("-?P(?=[0-9])([0-9]+Y)?([0-9]+M)?", "string"), "dayTimeDuration": ("-?P(?=[0-9T])([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+([.][0-9]+)?S)?)?", "string"),
}

#: Least and greatest value of the integer types.
BOUNDS = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-(2**7), 2**7 - 1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 2**8 - 1),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}


def cast_as(text: Column, kind: str) -> Column:
    """``text`` as a value of the simple type, null where it is none."""
    low, high = BOUNDS.get(kind, (None, None))
    pattern, spark = TYPES["integer" if kind in BOUNDS else kind]
    if kind in ("string", "untypedAtomic"):
        return text
    if kind == "normalizedString":
        return F.translate(text, "\t\n\r", "   ")
    text = F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))
    held = F.when(text.rlike(f"^(?:{pattern})$"), text)
    if spark == "boolean":
        return F.when(held.isin("true", "1"), True).when(held.isin("false", "0"), False)
    if kind in ("double", "float"):
        return F.regexp_replace(held, "INF", "Infinity").try_cast(spark)
    if kind == "hexBinary":
        return F.unhex(held)
    if kind == "base64Binary":
        return F.unbase64(F.replace(held, Lit(" "), Lit("")))
    if kind == "date":
        return F.regexp_replace(held, _TZ + "$", "").try_cast("date")
    if kind == "dateTime":
        return F.when(F.regexp_extract(held, "^-?[0-9]+-[0-9]{2}-[0-9]{2}", 0).try_cast("date").isNotNull(), held)
    value = held.try_cast(spark)
    if low is not None:
        value = F.when(value >= Lit(low).cast("decimal(38,0)"), value)
    if high is not None:
        value = F.when(value <= Lit(high).cast("decimal(38,0)"), value)
    return value


def castable_as(text: Column, kind: str) -> Column:
    return cast_as(text, kind).isNotNull()


def construct(text: Column, kind: str) -> Column:
    """As ``cast_as``, with error FORG0001 for text that is no value; null stays null."""
    value = cast_as(text, kind)
    wrong = F.raise_error(F.concat(Lit(f"FORG0001: no xs:{kind}: "), text))
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(wrong.cast(TYPES["integer" if kind in BOUNDS else kind][1]))
