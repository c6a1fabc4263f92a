"""The function library by name and number of arguments, for expressions.

A signature has a letter for each argument: ``s`` text (empty: ''), ``S`` text (empty stays null), ``d`` double, ``i`` integer, ``n`` number of
its own type, ``q`` sequence, ``t`` sequence of texts, ``D`` sequence of doubles, ``b`` boolean, ``l`` literal text, ``x`` the Seq itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions import fn, pictures, text, values

FUNCTIONS: dict[tuple[str, int | None], Callable] = {}
SPECIAL: dict[str, Callable] = {}


def _seq(col, kind, many=False):
    from nodeloom.plans.xpath import Seq

    return Seq(col, kind, many)


def _argument(x, s, letter: str):
    if letter == "x":
        return s
    if letter == "l":
        return literal(s)
    if letter == "b":
        return x._effective(s)
    if letter in "sS":
        c = x.strings(x.atoms(s)).one()
        return F.coalesce(c, F.lit("")) if letter == "s" else c
    if letter == "d":
        return x.numbers(s).one().cast("double")
    if letter == "i":
        return x.numbers(s).one().cast("bigint")
    if letter == "n":
        return x.numbers(s).one()
    if letter == "t":
        return x.strings(x.atoms(s)).array()
    if letter == "D":
        c = x.numbers(s)
        return F.transform(c.array(), lambda v: v.cast("double"))
    return x.atoms(s).array()


def literal(s) -> str:
    """The text of a literal; patterns, pictures and flags have to be known when the plan is made."""
    if s.text is None:
        raise SyntaxError("a literal is wanted here")
    return s.text


def define(name: str, signature: str, result: str, f: Callable) -> None:
    """result: a type, with * for a sequence; ``=`` for that of the first argument."""

    def call(x, *args):
        kind = x.atoms(args[0]).type if result[0] == "=" else result.rstrip("*")
        if signature[0:1] == "n" and result == "=":
            s = x.numbers(args[0])
            value = f(s.one())
            return _seq(value.cast("bigint") if s.type == "integer" else value.cast("double"), s.type)
        return _seq(f(*[_argument(x, a, c) for a, c in zip(args, signature, strict=True)]), kind, result.endswith("*"))

    FUNCTIONS[name, len(signature)] = call


def _of_duration(f: Callable, kind: str) -> Callable:
    return lambda s: pictures.once(pictures.once(s, values.duration), lambda d: f(d).cast(kind))


#: Characters that output escapes.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}


def _escaped(s: Column, which: str) -> Column:
    for c in which:
        s = F.replace(s, F.lit(c), F.lit(ESCAPES[c]))
    return s


def _define_all() -> None:
    for name, signature, result, f in (
        ("string", "s", "string", lambda s: s), ("codepoints-to-string", "q", "string", fn.codepoints_to_string), ("string-to-codepoints", "s", "integer*", fn.string_to_codepoints),
        ("compare", "SS", "integer", lambda a, b: fn.compare(a, b).cast("bigint")), ("codepoint-equal", "SS", "boolean", fn.codepoint_equal),
        ("substring", "sd", "string", fn.substring), ("substring", "sdd", "string", fn.substring), ("string-length", "s", "integer", fn.string_length), ("normalize-space", "s", "string", fn.normalize_space),
        ("normalize-unicode", "s", "string", text.normalize_unicode), ("normalize-unicode", "sl", "string", lambda s, form: text.normalize_unicode(s, form.strip() or "NFC")),
        ("upper-case", "s", "string", fn.upper_case), ("lower-case", "s", "string", fn.lower_case), ("translate", "sll", "string", fn.translate),
        ("contains", "ss", "boolean", fn.contains), ("starts-with", "ss", "boolean", fn.starts_with), ("ends-with", "ss", "boolean", fn.ends_with),
        ("substring-before", "ss", "string", fn.substring_before), ("substring-after", "ss", "string", fn.substring_after),
        ("matches", "sl", "boolean", fn.matches), ("matches", "sll", "boolean", fn.matches), ("replace", "sll", "string", fn.replace), ("replace", "slll", "string", fn.replace),
        ("tokenize", "s", "string*", fn.tokenize), ("tokenize", "sl", "string*", fn.tokenize), ("tokenize", "sll", "string*", fn.tokenize),
        ("contains-token", "sl", "boolean", fn.contains_token), ("collation-key", "S", "string", lambda s: F.base64(fn.collation_key(s))),
        ("encode-for-uri", "s", "string", fn.encode_for_uri), ("iri-to-uri", "s", "string", text.iri_to_uri), ("escape-html-uri", "s", "string", text.escape_html_uri), ("resolve-uri", "SS", "string", text.resolve_uri),
        ("string-join", "t", "string", fn.string_join), ("parse-ietf-date", "S", "string", text.parse_ietf_date),
        ("abs", "n", "=", F.abs), ("ceiling", "n", "=", fn.kept(F.ceil)), ("floor", "n", "=", fn.kept(F.floor)), ("round", "n", "=", fn.kept(fn.fn_round)),
        ("round", "di", "double", fn.round_to), ("round-half-to-even", "n", "=", fn.kept(fn.round_half_to_even)), ("round-half-to-even", "di", "double", fn.round_half_to_even_at),
        ("number", "S", "double", fn.number), ("format-integer", "il", "string", pictures.format_integer), ("format-number", "dl", "string", text.format_number),
        ("math:pi", "", "double", F.pi), ("math:exp", "d", "double", F.exp), ("math:exp10", "d", "double", text.exp10), ("math:log", "d", "double", text.math_log), ("math:log10", "d", "double", lambda d: text.math_log(d, True)),
        ("math:pow", "dd", "double", F.pow), ("math:sqrt", "d", "double", F.sqrt), ("math:sin", "d", "double", F.sin), ("math:cos", "d", "double", F.cos), ("math:tan", "d", "double", F.tan),
        ("math:asin", "d", "double", F.asin), ("math:acos", "d", "double", F.acos), ("math:atan", "d", "double", F.atan), ("math:atan2", "dd", "double", F.atan2),
        ("xml:text", "s", "string", lambda s: _escaped(s, "&<>")), ("xml:attribute", "s", "string", lambda s: _escaped(s, '&<"')),
        ("true", "", "boolean", lambda: F.lit(True)), ("false", "", "boolean", lambda: F.lit(False)),
        ("empty", "q", "boolean", lambda q: F.size(q) == 0), ("exists", "q", "boolean", lambda q: F.size(q) > 0), ("head", "q", "=", fn.head), ("tail", "q", "=*", fn.tail),
        ("count", "q", "integer", fn.fn_count), ("reverse", "q", "=*", fn.reverse), ("distinct-values", "q", "=*", fn.distinct_values), ("unordered", "q", "=*", lambda q: q),
        ("subsequence", "qd", "=*", fn.subsequence), ("subsequence", "qdd", "=*", fn.subsequence), ("insert-before", "qiq", "=*", fn.insert_before), ("remove", "qi", "=*", fn.remove),
        ("zero-or-one", "q", "=", lambda q: fn.cardinality(q, 0, 1, "FORG0003")), ("one-or-more", "q", "=*", lambda q: fn.at_least_one(q)), ("exactly-one", "q", "=", lambda q: fn.cardinality(q, 1, 1, "FORG0005")),
        ("deep-equal", "tt", "boolean", fn.deep_equal), ("QName", "SS", "string", fn.qname), ("prefix-from-QName", "S", "string", fn.prefix_from_qname), ("local-name-from-QName", "S", "string", fn.local_name_from_qname),
        ("namespace-uri-from-QName", "S", "string", fn.namespace_uri_from_qname),
        ("year-from-date", "x", "integer", None), ("month-from-date", "x", "integer", None), ("day-from-date", "x", "integer", None), ("timezone-from-date", "S", "string", pictures.timezone),
        ("year-from-dateTime", "x", "integer", None), ("month-from-dateTime", "x", "integer", None), ("day-from-dateTime", "x", "integer", None), ("hours-from-dateTime", "x", "integer", None), ("minutes-from-dateTime", "x", "integer", None),
        ("seconds-from-dateTime", "x", "decimal", None), ("timezone-from-dateTime", "S", "string", pictures.timezone),
        ("hours-from-time", "S", "integer", lambda s: pictures.time_part(s, 1)), ("minutes-from-time", "S", "integer", lambda s: pictures.time_part(s, 2)), ("seconds-from-time", "S", "decimal", lambda s: pictures.time_part(s, 3)),
        ("timezone-from-time", "S", "string", pictures.timezone_from_time), ("adjust-time-to-timezone", "Sl", "string", pictures.adjust_time), ("adjust-dateTime-to-timezone", "Sl", "string", pictures.adjust_date_time), ("adjust-date-to-timezone", "Sl", "string", pictures.adjust_date),
        ("dateTime", "SS", "string", lambda d, t: pictures.once(values.date_time(d, t), values.zoned_text)),
        ("years-from-duration", "S", "integer", _of_duration(values.years_from_duration, "bigint")), ("months-from-duration", "S", "integer", _of_duration(values.months_from_duration, "bigint")),
        ("days-from-duration", "S", "integer", _of_duration(values.days_from_duration, "bigint")), ("hours-from-duration", "S", "integer", _of_duration(values.hours_from_duration, "bigint")),
        ("minutes-from-duration", "S", "integer", _of_duration(values.minutes_from_duration, "bigint")), ("seconds-from-duration", "S", "decimal", _of_duration(values.seconds_from_duration, "double")),
        ("format-date", "Sl", "string", pictures.format_date_time), ("format-dateTime", "Sl", "string", pictures.format_date_time), ("format-time", "Sl", "string", pictures.format_time),
        ("current-date", "", "date", F.current_date), ("current-dateTime", "", "dateTime", lambda: F.current_timestamp().cast("timestamp_ntz")), ("current-time", "", "string", lambda: F.date_format(F.current_timestamp(), "HH:mm:ss.SSS'Z'")),
        ("implicit-timezone", "", "string", lambda: F.lit("PT0S")), ("default-collation", "", "string", lambda: F.lit("http://www.w3.org/2005/xpath-functions/collation/codepoint")), ("default-language", "", "string", lambda: F.lit("en")),
        ("available-environment-variables", "", "string*", lambda: F.array().cast("array<string>")), ("environment-variable", "S", "string", lambda _: F.lit(None).cast("string")), ("static-base-uri", "", "string", lambda: F.lit(None).cast("string")),
        ("error", "", "string", lambda: F.raise_error(F.lit("FOER0000")).cast("string")), ("error", "S", "string", lambda s: F.raise_error(s).cast("string")), ("error", "SS", "string", lambda c, s: F.raise_error(F.concat_ws(": ", c, s)).cast("string")),
        ("trace", "q", "=*", lambda q: q), ("trace", "qs", "=*", lambda q, _: q), ("parse-json", "S", "string", fn.checked_json),
    ):
        if f is not None:
            define(name, signature, result, f)


def _part_of(name: str, kind: str, f: Callable, result: str) -> None:
    def call(x, s):
        value = x.cast(s, kind) if s.type != kind else s
        return _seq(f(value.one()).cast("double" if result == "decimal" else "bigint"), result)

    FUNCTIONS[f"{name}-from-{kind}", 1] = call


def function(name: str, n: int | None):
    def register(f):
        FUNCTIONS[name, n] = f
        return f

    return register


def special(*names: str):
    def register(f):
        for name in names:
            SPECIAL[name] = f
        return f

    return register


@function("concat", None)
def _concat(x, *args):
    return _seq(fn.concat(*[_argument(x, a, "s") for a in args]), "string")


@function("string-join", 2)
def _string_join(x, items, separator):
    return _seq(fn.string_join(_argument(x, items, "t"), literal(separator)), "string")


@function("sum", 1)
def _sum(x, s, zero=None):
    c = x.numbers(s)
    if c.type == "integer":
        return _seq(F.aggregate(c.array(), F.lit(0).cast("bigint"), lambda a, b: a + b), "integer")
    total = fn.fn_sum(F.transform(c.array(), lambda v: v.cast("double")))
    if zero is not None:
        total = F.when(F.size(c.array()) == 0, x.numbers(zero).one().cast("double")).otherwise(total)
    return _seq(total, c.type)


FUNCTIONS["sum", 2] = _sum


@function("avg", 1)
def _avg(x, s):
    c = x.numbers(s)
    return _seq(fn.fn_avg(F.transform(c.array(), lambda v: v.cast("double"))), "decimal" if c.type in ("integer", "decimal") else "double")


def _least(name: str, f: Callable) -> None:
    def call(x, s):
        c = x.numbers(s) if s.type in ("node", "untyped", "integer", "decimal", "double") else s
        return _seq(f(c.array(), c.type in ("double", "decimal")), c.type)

    FUNCTIONS[name, 1] = call


_least("max", fn.fn_max)
_least("min", fn.fn_min)


@function("index-of", 2)
def _index_of(x, items, item):
    a, b = x.atoms(items), x.atoms(item)
    if a.type != b.type:
        a, b = x.strings(a), x.strings(b)
    return _seq(F.transform(fn.index_of(a.array(), b.one()), lambda v: v.cast("bigint")), "integer", True)


@function("data", 1)
def _data(x, s):
    return x.atoms(s)


@function("boolean", 1)
def _boolean(x, s):
    return _seq(x._effective(s), "boolean")


@function("not", 1)
def _not(x, s):
    return _seq(~x._effective(s), "boolean")


# -- functions of the context and of nodes -------------------------------------------------------


SPECIAL["position"] = lambda x, args, f: _seq(x._placed(f, "position"), "integer")
SPECIAL["last"] = lambda x, args, f: _seq(x._placed(f, "last"), "integer")


def _truths(name: str) -> None:
    SPECIAL[name] = lambda x, args, f: _seq(x._truth(("call", name, args), f) if name != "boolean" else x._truth(args[0], f), "boolean")


for _name in ("not", "boolean"):
    _truths(_name)


def _existence(name: str) -> None:
    def call(x, args, f):
        if x._is_nodes(args[0], f) and not f.in_lambda:
            return _seq(x._truth(("call", name, args), f), "boolean")
        s = x._seq(args[0], f)
        there = F.size(s.col) > 0 if s.many else s.col.isNotNull()
        return _seq(there if name == "exists" else ~there, "boolean")

    SPECIAL[name] = call


_existence("exists")
_existence("empty")


@special("count")
def _count(x, args, f):
    e = args[0]
    if x._is_nodes(e, f) and not x._is_attribute(e) and e[0] != "context":
        name = x._name("count")
        found = x._nodes(e, f).groupBy(*f.keys).agg(F.count("*").alias(name))
        f.pending.append(found)
        return _seq(F.coalesce(F.col(name), F.lit(0)).cast("bigint"), "integer")
    s = x._seq(e, f)
    return _seq(F.size(s.col).cast("bigint") if s.many else F.when(s.col.isNull(), 0).otherwise(1).cast("bigint"), "integer")


def _of_context(name: str, made: Callable) -> None:
    """A function whose argument is the context item where it is left out."""

    def call(x, args, f):
        return made(x, x._seq(args[0] if args else ("context",), f))

    SPECIAL[name] = call
    FUNCTIONS.setdefault((name, 1), made)


def _called(name: str) -> Callable:
    return lambda x, s: FUNCTIONS[name, 1](x, s)


def _names() -> None:
    no_name = lambda x, s: F.coalesce(F.when(s.one().isNotNull(), x), F.lit(""))
    _of_context("local-name", lambda x, s: _seq(no_name(s.one()["local"], s), "string"))
    _of_context("namespace-uri", lambda x, s: _seq(no_name(s.one()["ns_uri"], s), "string"))
    qualified = lambda n: F.when(n["prefix"] != "", F.concat(n["prefix"], F.lit(":"), n["local"])).otherwise(n["local"])
    _of_context("name", lambda x, s: _seq(no_name(qualified(s.one()), s), "string"))
    _of_context("node-name", lambda x, s: _seq(qualified(s.one()), "string"))
    _of_context("nilled", lambda x, s: _seq(F.when(s.one()["kind"] == 1, F.lit(False)), "boolean"))
    _of_context("data", lambda x, s: x.atoms(s))
    _of_context("generate-id", lambda x, s: _seq(F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("n"), s.one()["pre"].cast("string")), F.lit("")), "string"))
    for name in ("string", "string-length", "normalize-space", "number"):
        _of_context(name, _called(name))


@special("has-children")
def _has_children(x, args, f):
    base = args[0] if args else ("context",)
    return _seq(x._truth(("path", base, [("child", ("node",), [])]), f), "boolean")


@special("base-uri", "document-uri")
def _no_uri(x, args, f):
    return _seq(F.lit(None).cast("string"), "string")


@special("path")
def _path(x, args, f):
    """Steps from the root with their places: ancestors joined within the document."""
    base = args[0] if args else ("context",)
    found = x._nodes(("path", base, [("ancestor-or-self", ("element",), [])]), f)
    name = x._name("path")
    step = F.concat(F.lit("/Q{"), F.coalesce("ns_uri", F.lit("")), F.lit("}"), F.col("local"), F.lit("["), F.col("__n").cast("string"), F.lit("]"))
    before = x.nodes.where(F.col("kind") == 1).select(F.col("doc_id"), F.col("parent"), F.col("pre").alias("b_pre"), F.coalesce("ns_uri", F.lit("")).alias("b_uri"), F.col("local").alias("b_local"))
    on = ["doc_id", "parent"]
    placed = found.join(before, on).where((F.col("b_pre") <= F.col("pre")) & (F.col("b_local") == F.col("local")) & (F.col("b_uri") == F.coalesce("ns_uri", F.lit(""))))
    placed = placed.groupBy(*f.keys, "pre", "ns_uri", "local").agg(F.count("*").alias("__n"))
    made = placed.groupBy(*f.keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", step.alias("s")))), lambda v: v["s"]), "").alias(name))
    f.pending.append(made)
    return _seq(F.coalesce(F.col(name), F.lit("/")), "string")


# -- higher-order functions ----------------------------------------------------------------------


def _item(c, s):
    from nodeloom.plans.xpath import Seq

    return Seq(c, s.type, False, False)


def _mapped(x, s, f) -> object:
    kinds = []

    def one(c):
        r = f.col(_item(c, s))
        kinds.append(r)
        return r.array() if r.many else r.col

    made = F.transform(s.array(), one)
    r = kinds[-1]
    return _seq(F.flatten(made) if r.many else F.filter(made, lambda v: v.isNotNull()), r.type, True)


@function("for-each", 2)
def _for_each(x, s, f):
    return _mapped(x, s, f)


@function("filter", 2)
def _fn_filter(x, s, f):
    return _seq(F.filter(s.array(), lambda c: x._effective(f.col(_item(c, s)))), s.type, True)


def _fold(x, s, zero, f, right: bool):
    kind = {"integer": "bigint", "decimal": "double", "double": "double", "boolean": "boolean"}
    if zero.type == "empty":
        zero = _seq_free(F.array().cast(f"array<{kind.get(x.atoms(s).type, 'string')}>"), x.atoms(s).type, True)
    items = x.atoms(s)
    probe = f.col(zero, _item(F.lit(None).cast(kind.get(items.type, "string")), items)) if not right else f.col(_item(F.lit(None).cast(kind.get(items.type, "string")), items), zero)
    state = probe.type if probe.type in kind or probe.type == "string" else zero.type
    start = zero.array().cast(f"array<{kind.get(state, 'string')}>") if probe.many else zero.one().cast(kind.get(state, "string"))
    held = lambda c: _seq_free(c, state, probe.many)
    step = lambda a, c: (f.col(held(a), _item(c, items)) if not right else f.col(_item(c, items), held(a)))
    grown = lambda a, c: step(a, c).array() if probe.many else step(a, c).one().cast(kind.get(state, "string"))
    return _seq(F.aggregate(F.reverse(items.array()) if right else items.array(), start, grown), state, probe.many)


def _seq_free(c, kind, many):
    from nodeloom.plans.xpath import Seq

    return Seq(c, kind, many, False)


FUNCTIONS["fold-left", 3] = lambda x, s, zero, f: _fold(x, s, zero, f, False)
FUNCTIONS["fold-right", 3] = lambda x, s, zero, f: _fold(x, s, zero, f, True)


@function("for-each-pair", 3)
def _for_each_pair(x, a, b, f):
    kinds = []

    def one(p, q):
        r = f.col(_item(p, a), _item(q, b))
        kinds.append(r)
        return r.one()

    made = fn.for_each_pair(a.array(), b.array(), one)
    return _seq(made, kinds[-1].type, True)


@function("sort", 1)
def _sort(x, s):
    return _seq(fn.fn_sort(x.atoms(s).array()), x.atoms(s).type, True)


@function("sort", 3)
def _sort_by(x, s, _, key):
    pairs = F.transform(s.array(), lambda c, i: F.struct(key.col(_item(c, s)).one().alias("k"), i.alias("i"), c.alias("v")))
    return _seq(F.transform(F.array_sort(pairs), lambda p: p["v"]), s.type, True)


@function("apply", 2)
def _apply(x, f, array):
    kind, many = x.inner(array)
    n = f.col.arity
    return f.col(*[_seq(F.element_at(array.col, i + 1), kind, many) for i in range(n)])


@special("function-lookup")
def _lookup(x, args, f):
    name, n = args[0][1] if args[0][0] == "string" else args[0][2][-1][1], args[1][2]
    there = (name, n) in FUNCTIONS or (name, None) in FUNCTIONS or name in x.functions
    return _seq((lambda *got: x.call(name, got, f)) if there else None, "function")


SPECIAL["function-name"] = lambda x, args, f: _seq(F.lit(args[0][1] if args[0][0] == "named" else None).cast("string"), "string")
SPECIAL["function-arity"] = lambda x, args, f: _seq(F.lit(args[0][2] if args[0][0] == "named" else len(args[0][1])).cast("bigint"), "integer")


# -- maps and arrays -----------------------------------------------------------------------------


def _key(x, s) -> Column:
    return x.strings(x.atoms(s)).one()


@special("map:merge")
def _map_merge(x, args, f):
    maps = [x._seq(m, f) for m in (args[0][1] if args[0][0] == "seq" else [args[0]])]
    policy = "use-first"
    if len(args) > 1 and args[1][0] == "entries":
        policy = args[1][1][0][1][1]
    out = maps[0].col
    for m in maps[1:]:
        out = fn.map_merge(out, m.col, policy)
    return _seq(out, maps[0].type)


def _maps() -> None:
    reg = FUNCTIONS
    reg["map:size", 1] = lambda x, m: _seq(F.size(m.col).cast("bigint"), "integer")
    reg["map:keys", 1] = lambda x, m: _seq(F.map_keys(m.col), "string", True)
    reg["map:contains", 2] = lambda x, m, k: _seq(F.map_contains_key(m.col, _key(x, k)), "boolean")
    reg["map:get", 2] = lambda x, m, k: _seq(m.col[_key(x, k)], *x.inner(m))
    reg["map:put", 3] = lambda x, m, k, v: _seq(fn.map_put(m.col, _key(x, k), v.array() if x.inner(m)[1] else v.one()), m.type)
    reg["map:remove", 2] = lambda x, m, k: _seq(fn.map_remove(m.col, _key(x, k)), m.type)
    reg["map:entry", 2] = lambda x, k, v: _seq(F.create_map(_key(x, k), v.col), f"map:{v.type}{'*' if v.many else ''}")
    reg["map:find", 2] = lambda x, m, k: _seq(F.array(m.col[_key(x, k)]), f"array:{x.inner(m)[0]}")

    def for_each(x, m, f):
        kind, many = x.inner(m)
        kinds = []

        def one(e):
            r = f.col(_seq_free(e["key"], "string", False), _seq_free(e["value"], kind, many))
            kinds.append(r)
            return r.array() if r.many else r.col

        made = F.transform(F.map_entries(m.col), one)
        r = kinds[-1]
        return _seq(F.flatten(made) if r.many else made, r.type, True)

    reg["map:for-each", 2] = for_each

    member = lambda x, a, v: v.array() if x.inner(a)[1] else v.one()
    place = lambda x, i: x.numbers(i).one().cast("int")
    reg["array:size", 1] = lambda x, a: _seq(F.size(a.col).cast("bigint"), "integer")
    reg["array:get", 2] = lambda x, a, i: _seq(fn.array_get(a.col, place(x, i)), *x.inner(a))
    reg["array:put", 3] = lambda x, a, i, v: _seq(fn.array_put(a.col, place(x, i), member(x, a, v)), a.type)
    reg["array:append", 2] = lambda x, a, v: _seq(F.concat(a.col, F.array(member(x, a, v))), a.type)
    reg["array:subarray", 2] = lambda x, a, i: _seq(fn.array_subarray(a.col, place(x, i)), a.type)
    reg["array:subarray", 3] = lambda x, a, i, n: _seq(fn.array_subarray(a.col, place(x, i), place(x, n)), a.type)
    reg["array:remove", 2] = lambda x, a, i: _seq(fn.array_remove(a.col, x.numbers(i).array()), a.type)
    reg["array:insert-before", 3] = lambda x, a, i, v: _seq(fn.array_insert_before(a.col, place(x, i), member(x, a, v)), a.type)
    reg["array:head", 1] = lambda x, a: _seq(fn.array_head(a.col), *x.inner(a))
    reg["array:tail", 1] = lambda x, a: _seq(fn.array_tail(a.col), a.type)
    reg["array:reverse", 1] = lambda x, a: _seq(F.reverse(a.col), a.type)
    reg["array:flatten", 1] = lambda x, a: _seq(F.flatten(a.col) if x.inner(a)[1] else a.col, x.inner(a)[0], True)
    reg["array:sort", 1] = lambda x, a: _seq(fn.fn_sort(a.col), a.type)
    as_items = lambda x, a: _seq(a.col, x.inner(a)[0], True)
    reg["array:filter", 2] = lambda x, a, f: _seq(_fn_filter(x, as_items(x, a), f).col, a.type)
    reg["array:for-each", 2] = lambda x, a, f: (lambda r: _seq(r.col, f"array:{r.type}"))(_mapped(x, as_items(x, a), f))
    reg["array:fold-left", 3] = lambda x, a, z, f: _fold(x, as_items(x, a), z, f, False)
    reg["array:fold-right", 3] = lambda x, a, z, f: _fold(x, as_items(x, a), z, f, True)
    reg["array:for-each-pair", 3] = lambda x, a, b, f: (lambda r: _seq(r.col, f"array:{r.type}"))(_for_each_pair(x, as_items(x, a), as_items(x, b), f))
    reg["array:flat-map", 2] = lambda x, a, f: _mapped(x, as_items(x, a), f)


@special("array:join")
def _array_join(x, args, f):
    arrays = [x._seq(a, f) for a in (args[0][1] if args[0][0] == "seq" else [args[0]])]
    return _seq(F.concat(*[a.col for a in arrays]), arrays[0].type)


_define_all()
_names()
_maps()
for _kind in ("date", "dateTime"):
    for _part, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
        _part_of(_part, _kind, _f, "integer")
for _part, _f in (("hours", F.hour), ("minutes", F.minute)):
    _part_of(_part, "dateTime", _f, "integer")
_part_of("seconds", "dateTime", lambda t: F.extract(F.lit("SECOND"), t), "decimal")
