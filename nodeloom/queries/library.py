"""Function-library queries: each evaluates functions over a base table's columns next to SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.functions import fn
from nodeloom.sources import fixtures
from nodeloom.sources.fixtures import table

QUERIES: dict = {}
ORACLE: dict = {}


def _over(name: str, source: str, key: str, columns: dict) -> None:
    """columns: alias to (Column, SQL)."""

    def run(spark, sf_dir):
        return fixtures.spread(table(spark, sf_dir, source), key).select(key, *[c().alias(a) for a, (c, _) in columns.items()])

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, " + ", ".join(f"{sql} AS {a}" for a, (_, sql) in columns.items()) + f" FROM {source}"


C, L = F.col, F.lit

_over("fn_strings", "customer", "c_custkey", {
    "concatenated": (lambda: fn.concat(C("c_name"), L("-"), C("c_nationkey")), "c_name || '-' || c_nationkey"),
    "len": (lambda: fn.string_length(C("c_name")), "length(c_name)"),
    "up": (lambda: fn.upper_case(C("c_name")), "upper(c_name)"),
    "low": (lambda: fn.lower_case(C("c_name")), "lower(c_name)"),
    "translated": (lambda: fn.translate(C("c_name"), "0123#", "abcd"), "translate(c_name, '0123#', 'abcd')"),
    "has": (lambda: fn.contains(C("c_name"), L("9")), "contains(c_name, '9')"),
    "starts": (lambda: fn.starts_with(C("c_name"), L("Cust")), "starts_with(c_name, 'Cust')"),
    "ends": (lambda: fn.ends_with(C("c_name"), L("7")), "suffix(c_name, '7')"),
    "before": (lambda: fn.substring_before(C("c_name"), L("#")), "CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END"),
    "after": (lambda: fn.substring_after(C("c_name"), L("#")), "CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END"),
    "sub2": (lambda: fn.substring(C("c_name"), L(3)), "substr(c_name, 3)"),
    "sub3": (lambda: fn.substring(C("c_name"), L(1.5), L(2.6)), "substr(c_name, 2, 3)"),
    "sub0": (lambda: fn.substring(C("c_name"), L(0), L(3)), "substr(c_name, 1, 2)"),
    "compared": (lambda: fn.compare(C("c_name"), L("Customer#5")), "CASE WHEN c_name < 'Customer#5' THEN -1 WHEN c_name > 'Customer#5' THEN 1 ELSE 0 END"),
    "normal": (lambda: fn.normalize_space(F.concat(L("  "), C("c_mktsegment"), L(" \n x "))), "c_mktsegment || ' x'"),
})

_over("fn_regex", "orders", "o_orderkey", {
    "matched": (lambda: fn.matches(C("o_orderpriority"), "^[1-3]-"), "regexp_matches(o_orderpriority, '^[1-3]-')"),
    "matched_i": (lambda: fn.matches(C("o_orderpriority"), "urgent", "i"), "regexp_matches(o_orderpriority, 'urgent', 'i')"),
    "replaced": (lambda: fn.replace(C("o_orderpriority"), "[A-Z]+", "x"), "regexp_replace(o_orderpriority, '[A-Z]+', 'x', 'g')"),
    "tokens": (lambda: F.array_join(fn.tokenize(C("o_orderpriority"), "-"), "|"), "array_to_string(string_split(o_orderpriority, '-'), '|')"),
    "digits": (lambda: F.array_join(fn.analyze_string(C("o_orderpriority"), "[0-9]+"), ""), "array_to_string(regexp_extract_all(o_orderpriority, '[0-9]+'), '')"),
    "points": (lambda: F.array_join(fn.string_to_codepoints(C("o_orderstatus")).cast("array<string>"), ","), "unicode(o_orderstatus)::VARCHAR"),
    "back": (lambda: fn.codepoints_to_string(F.array(L(72), L(233), L(128512))), "'Hé😀'"),
    "uri": (lambda: fn.encode_for_uri(F.concat(C("o_orderpriority"), L(" é/~*"))), "url_encode(o_orderpriority || ' é/~*')"),
    "token": (lambda: fn.contains_token(F.regexp_replace("o_orderpriority", "-", " "), "HIGH"), "list_contains(string_split(replace(o_orderpriority, '-', ' '), ' '), 'HIGH')"),
})

_over("fn_numbers", "customer", "c_custkey", {
    "absolute": (lambda: F.abs(C("c_acctbal")), "abs(c_acctbal)"),
    "ceil": (lambda: fn.ceiling(C("c_acctbal")), "ceil(c_acctbal)::BIGINT"),
    "floor": (lambda: F.floor(C("c_acctbal")), "floor(c_acctbal)::BIGINT"),
    "rounded": (lambda: fn.fn_round(C("c_acctbal")), "floor(c_acctbal + 0.5)::BIGINT"),
    "even": (lambda: fn.round_half_to_even(C("c_custkey") / L(2.0)), "round_even(c_custkey / 2.0, 0)"),
    "divided": (lambda: fn.divide(C("c_acctbal"), C("c_nationkey") % 3), "CASE WHEN c_nationkey % 3 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'inf'::DOUBLE WHEN c_acctbal < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE c_acctbal / (c_nationkey % 3)::DOUBLE END"),
    "whole": (lambda: fn.idiv(C("c_custkey"), L(7)), "c_custkey // 7"),
    "rest": (lambda: fn.mod(-C("c_custkey"), L(7)), "(-c_custkey) % 7"),
    "roman": (lambda: fn.format_integer(C("c_nationkey") + 1, "I"), "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII','XXIV','XXV'][c_nationkey + 1]"),
    "letter": (lambda: fn.format_integer(C("c_nationkey") + 1, "a"), "chr(97 + c_nationkey)"),
    "padded": (lambda: fn.format_integer(C("c_nationkey"), "0001"), "lpad(c_nationkey::VARCHAR, 4, '0')"),
    "not_number": (lambda: F.isnan(fn.number(C("c_name"))), "true"),
})

_over("math_functions", "part", "p_partkey", {
    "root": (lambda: F.round(F.sqrt(C("p_retailprice")), 6), "round(sqrt(p_retailprice), 6)"),
    "natural": (lambda: F.round(F.log(C("p_retailprice")), 6), "round(ln(p_retailprice), 6)"),
    "decadic": (lambda: F.round(F.log10(C("p_retailprice")), 6), "round(log10(p_retailprice), 6)"),
    "power": (lambda: F.round(F.pow(C("p_size"), L(1.5)), 6), "round(pow(p_size, 1.5), 6)"),
    "exponential": (lambda: F.round(F.exp(C("p_size") / 50), 6), "round(exp(p_size / 50.0), 6)"),
    "sine": (lambda: F.round(F.sin(C("p_size")), 6), "round(sin(p_size), 6)"),
    "cosine": (lambda: F.round(F.cos(C("p_size")), 6), "round(cos(p_size), 6)"),
    "tangent": (lambda: F.round(F.tan(C("p_size")), 6), "round(tan(p_size), 6)"),
    "arc": (lambda: F.round(F.atan2(C("p_size"), L(3.0)), 6), "round(atan2(p_size, 3.0), 6)"),
    "arcsine": (lambda: F.round(F.asin(C("p_size") / 100), 6), "round(asin(p_size / 100.0), 6)"),
    "arccosine": (lambda: F.round(F.acos(C("p_size") / 100), 6), "round(acos(p_size / 100.0), 6)"),
    "pi": (lambda: F.round(F.pi(), 6), "round(pi(), 6)"),
})


def _xs():
    return fn.to(L(1).cast("bigint"), C("p_size").cast("bigint") % 12)


_X = "range(1, (p_size % 12) + 1)"
_text = lambda c: F.array_join(c.cast("array<string>"), ",")
_sql = lambda s: f"array_to_string({s}, ',')"

_over("fn_sequences", "part", "p_partkey", {
    "counted": (lambda: fn.fn_count(_xs()), f"len({_X})::BIGINT"),
    "none": (lambda: fn.empty(_xs()), f"len({_X}) = 0"),
    "first": (lambda: fn.head(_xs()), f"({_X})[1]"),
    "rest": (lambda: _text(fn.tail(_xs())), _sql(f"({_X})[2:]")),
    "reversed": (lambda: _text(fn.reverse(_xs())), _sql(f"list_reverse({_X})")),
    "middle": (lambda: _text(fn.subsequence(_xs(), L(2), L(3))), _sql(f"({_X})[2:4]")),
    "inserted": (lambda: _text(fn.insert_before(_xs(), L(2), F.array(L(99).cast("bigint")))), _sql(f"list_concat(list_concat(({_X})[1:1], [99]), ({_X})[2:])")),
    "removed": (lambda: _text(fn.remove(_xs(), L(2))), _sql(f"list_concat(({_X})[1:1], ({_X})[3:])")),
    "places": (lambda: _text(fn.index_of(_xs(), L(3).cast("bigint"))), "CASE WHEN p_size % 12 >= 3 THEN '3' ELSE '' END"),
    "distinct_n": (lambda: F.size(fn.distinct_values(F.transform(_xs(), lambda x: x % 4))).cast("long"), f"len(list_distinct(list_transform({_X}, lambda x: x % 4)))::BIGINT"),
    "total": (lambda: fn.fn_sum(_xs().cast("array<double>")), f"coalesce(list_sum({_X}), 0)::DOUBLE"),
    "mean": (lambda: fn.fn_avg(_xs().cast("array<double>")), f"list_avg({_X})"),
    "highest": (lambda: fn.fn_max(_xs()), f"list_max({_X})"),
    "lowest": (lambda: fn.fn_min(_xs()), f"list_min({_X})"),
    "joined": (lambda: fn.string_join(_xs(), "+"), f"array_to_string({_X}, '+')"),
    "any_even": (lambda: fn.some(_xs(), lambda x: x % 2 == 0), "p_size % 12 >= 2"),
    "all_small": (lambda: fn.every(_xs(), lambda x: x < 9), "p_size % 12 < 9"),
    "equal_any": (lambda: fn.general_equal(_xs(), F.array(L(5).cast("bigint"), L(77).cast("bigint"))), "p_size % 12 >= 5"),
    "less_any": (lambda: fn.general_less(_xs(), F.array(L(2).cast("bigint"))), "p_size % 12 >= 1"),
})

_over("fn_higher_order", "part", "p_partkey", {
    "squares": (lambda: _text(fn.for_each(_xs(), lambda x: x * x)), _sql(f"list_transform({_X}, lambda x: x * x)")),
    "odd": (lambda: _text(fn.fn_filter(_xs(), lambda x: x % 2 == 1)), _sql(f"list_filter({_X}, lambda x: x % 2 = 1)")),
    "left": (lambda: fn.fold_left(_xs(), L(0).cast("bigint"), lambda s, x: s * 2 + x), f"coalesce(list_reduce(list_concat([0], {_X}), lambda s, x: s * 2 + x), 0)::BIGINT"),
    "right": (lambda: fn.fold_right(_xs(), L(0).cast("bigint"), lambda x, s: s * 2 + x), f"coalesce(list_reduce(list_concat([0], list_reverse({_X})), lambda s, x: s * 2 + x), 0)::BIGINT"),
    "pairs": (lambda: _text(fn.for_each_pair(_xs(), fn.reverse(_xs()), lambda a, b: a * 100 + b)), _sql(f"list_transform({_X}, lambda x: x * 100 + (p_size % 12 + 1 - x))")),
    "sorted": (lambda: _text(fn.fn_sort(F.transform(_xs(), lambda x: (x * 7) % 5))), _sql(f"list_sort(list_transform({_X}, lambda x: (x * 7) % 5))")),
    "deep": (lambda: fn.deep_equal(_xs(), fn.fn_sort(fn.reverse(_xs()))), "true"),
})

_m = lambda: F.map_from_arrays(F.array(L("a"), L("b"), L("c")), F.array(C("p_size"), C("p_size") + 1, C("p_size") + 2))
_over("fn_maps_arrays", "part", "p_partkey", {
    "size": (lambda: fn.map_size(_m()), "3"),
    "keys": (lambda: _text(fn.map_keys(_m())), "'a,b,c'"),
    "held": (lambda: fn.map_contains(_m(), "b"), "true"),
    "got": (lambda: fn.map_get(_m(), L("b")), "p_size + 1"),
    "missing": (lambda: fn.map_get(_m(), L("z")), "NULL::INTEGER"),
    "put": (lambda: fn.map_get(fn.map_put(_m(), L("b"), L(0)), L("b")), "0"),
    "removed": (lambda: fn.map_size(fn.map_remove(_m(), L("a"))), "2"),
    "merged_first": (lambda: fn.map_get(fn.map_merge(_m(), F.create_map(L("a"), L(-1))), L("a")), "p_size"),
    "merged_last": (lambda: fn.map_get(fn.map_merge(_m(), F.create_map(L("a"), L(-1)), "use-last"), L("a")), "-1"),
    "each": (lambda: _text(fn.map_for_each(_m(), lambda k, v: F.concat(k, v.cast("string")))), "'a' || p_size || ',b' || (p_size + 1) || ',c' || (p_size + 2)"),
    "second": (lambda: fn.array_get(F.array(C("p_size"), L(7)), L(2)), "7"),
    "replaced": (lambda: _text(fn.array_put(F.array(C("p_size"), L(7)), L(2), L(8))), "p_size || ',8'"),
    "part": (lambda: _text(fn.array_subarray(F.array(L(1), L(2), L(3)), L(2), L(2))), "'2,3'"),
    "flat": (lambda: _text(fn.array_flatten(F.array(F.array(L(1)), F.array(L(2), C("p_size"))))), "'1,2,' || p_size"),
})

_over("fn_dates", "orders", "o_orderkey", {
    "y": (lambda: fn.year_from(C("o_orderdate")).cast("long"), "year(o_orderdate)"),
    "m": (lambda: fn.month_from(C("o_orderdate")).cast("long"), "month(o_orderdate)"),
    "d": (lambda: fn.day_from(C("o_orderdate")).cast("long"), "day(o_orderdate)"),
    "later": (lambda: fn.format_date(fn.add_months(C("o_orderdate"), L(1)), "[Y0001]-[M01]-[D01]"), "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    "days": (lambda: fn.days_between(C("o_orderdate"), L("1992-01-01").cast("date")).cast("long"), "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"),
    "shown": (lambda: fn.format_date(C("o_orderdate"), "[D01]/[M01]/[Y0001]"), "strftime(o_orderdate, '%d/%m/%Y')"),
})

_over("fn_json_types", "events", "event_id", {
    "member": (lambda: fn.json_member(C("props"), "$.k"), "json_extract_string(props, '$.k')"),
    "parsed": (lambda: fn.parse_json(C("props")).isNotNull(), "json_valid(props)"),
    "castable": (lambda: fn.castable(C("event_type"), "int"), "try_cast(event_type AS INTEGER) IS NOT NULL"),
    "local_name": (lambda: fn.local_name_from_qname(F.concat(L("p:"), C("event_type"))), "event_type"),
    "prefix": (lambda: fn.prefix_from_qname(F.concat(L("p:"), C("event_type"))), "'p'"),
    "folded": (lambda: F.decode(fn.collation_key(F.upper("event_type"), True), "UTF-8"), "lower(event_type)"),
})
