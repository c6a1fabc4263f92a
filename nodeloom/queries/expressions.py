"""Queries whose columns are XPath 3.1 expressions, evaluated at each order document, next to SQL over the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.plans.xpath import XPath
from nodeloom.sources import fixtures

QUERIES: dict = {}
ORACLE: dict = {}

_IN = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag"
#: One row an order, lists of its lines' values in document order.
_ORDERS = f"""(SELECT o.*, coalesce(no, []) AS no, coalesce(qty, []) AS qty, coalesce(disc, []) AS disc, coalesce(ret, []) AS ret, coalesce(part, []) AS part FROM orders o LEFT JOIN (SELECT l_orderkey,
list(l_linenumber {_IN}) AS no, list(l_quantity {_IN}) AS qty, list(l_discount {_IN}) AS disc, list(l_returnflag {_IN}) AS ret, list(l_partkey {_IN}) AS part FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""


def over_orders(name: str, columns: dict[str, tuple[str, str]], variables: dict | None = None) -> None:
    """columns: alias to (expression, SQL)."""

    def run(spark, sf_dir):
        x = XPath(fixtures.nodes(spark, sf_dir, "order_xml"))
        return x.evaluate({a: e for a, (e, _) in columns.items()}, x.select("/order"), variables, distinct=True).drop("pre")

    QUERIES[name] = run
    ORACLE[name] = "SELECT o_orderkey AS doc_id, " + ", ".join(f"{sql}{'::BIGINT' if sql.lstrip('-').isdigit() else ''} AS {a}" for a, (_, sql) in columns.items()) + f" FROM {_ORDERS}"


def _joined(sql: str, by: str = ",") -> str:
    return f"coalesce(array_to_string({sql}, '{by}'), '')"


over_orders("expr_flwor", {
    "pairs": ("string-join(for $l in line return concat($l/@no, ':', $l/@ret), ' ')", _joined("list_transform(range(1, len(no) + 1), lambda i: no[i] || ':' || ret[i])", " ")),
    "two_for": ("string-join(for $l in line, $i in 1 to 2 return concat($l/@no, '.', $i), ',')", _joined("flatten(list_transform(no, lambda n: [n || '.1', n || '.2']))")),
    "let_bound": ("let $n := count(line), $m := $n * 2 return $m + 1", "len(no) * 2 + 1"),
    "let_nodes": ("let $r := line[@ret = 'R'] return count($r) * 10 + count($r[@qty > 25])", "len(list_filter(ret, lambda r: r = 'R')) * 10 + len(list_filter(range(1, len(no) + 1), lambda i: ret[i] = 'R' AND qty[i] > 25))"),
    "correlated": ("string-join(for $r in sort(distinct-values(line/@ret)) return concat($r, '=', count(line[@ret = $r])), ',')", _joined("list_transform(list_sort(list_distinct(ret)), lambda r: r || '=' || len(list_filter(ret, lambda s: s = r)))")),
    "self_join": ("count(for $a in line return line[@part = $a/@part])", "len(flatten(list_transform(part, lambda a: list_filter(part, lambda b: b = a))))"),
    "nested": ("string-join(for $l in line[@qty > 30] return string(count(line[@qty > $l/@qty])), ',')", _joined("list_transform(list_filter(qty, lambda a: a > 30), lambda a: len(list_filter(qty, lambda b: b > a)))")),
})

over_orders("expr_conditions", {
    "if_else": ("if (count(line) > 3) then 'many' else if (line) then 'few' else 'none'", "CASE WHEN len(no) > 3 THEN 'many' WHEN len(no) > 0 THEN 'few' ELSE 'none' END"),
    "some_holds": ("some $l in line satisfies $l/@qty > 45 and $l/@ret = 'N'", "len(list_filter(range(1, len(no) + 1), lambda i: qty[i] > 45 AND ret[i] = 'N')) > 0"),
    "every_holds": ("every $l in line satisfies $l/@qty > 5", "len(list_filter(qty, lambda q: q <= 5)) = 0"),
    "some_item": ("some $i in 1 to 3 satisfies $i = count(line)", "len(no) BETWEEN 1 AND 3"),
    "effective": ("boolean(line[9]) or (@status = 'O' and not(line/@ret = 'R'))", "len(no) >= 9 OR (o_orderstatus = 'O' AND NOT list_contains(ret, 'R'))"),
    "general_ne": ("line/@ret != 'N'", "len(list_filter(ret, lambda r: r <> 'N')) > 0"),
    "general_lt": ("line/@qty < 10", "len(list_filter(qty, lambda q: q < 10)) > 0"),
    "of_lists": ("line/@no = (2, 9)", "list_contains(no, 2) OR list_contains(no, 9)"),
    "of_paths": ("line[1]/@ret = line[2]/@ret", "coalesce(ret[1] = ret[2], false)"),
    "value_eq": ("@status eq 'F'", "o_orderstatus = 'F'"),
    "value_lt": ("xs:double(@total) lt 100000", "o_totalprice < 100000"),
    "before": ("line[1] << line[2]", "CASE WHEN len(no) >= 2 THEN true END"),
    "same": ("line[1] is line[last()]", "CASE WHEN len(no) >= 1 THEN len(no) = 1 END"),
    "not_number": ("@priority != 5", "true"),
})

over_orders("expr_operators", {
    "precedence": ("1 + 2 * 3 - count(line)", "7 - len(no)"), "whole": ("(@cust + 7) idiv 3", "(o_custkey + 7) // 3"), "rest": ("xs:integer(@cust) mod 7", "o_custkey % 7"), "divided": ("xs:integer(@cust) div 4", "o_custkey / 4.0::DOUBLE"),
    "negated": ("-count(line) + +1", "1 - len(no)"), "two_bars": ("@status || '-' || count(line)", "o_orderstatus || '-' || len(no)"), "ranged": ("sum(1 to count(line))", "len(no) * (len(no) + 1) // 2"),
    "arrow": ("@priority => substring-after('-') => lower-case()", "lower(split_part(o_orderpriority, '-', 2))"), "mapped": ("string-join(line ! (@no || @ret), ' ')", _joined("list_transform(range(1, len(no) + 1), lambda i: no[i] || ret[i])", " ")),
    "mapped_items": ("sum((1 to 4) ! (. * .))", "30"), "sequence": ("string-join((count(line), 5, 'x'), '/')", "len(no) || '/5/x'"), "lists": ("count((line, line[1]))", "len(no)"),
    "external": ("$low + $high", "7"), "zero": ("string(1e0 div 0)", "'INF'"), "odd": ("string(number('x') + 1)", "'NaN'"),
}, {"low": 3, "high": 4})

over_orders("expr_paths", {
    "general_step": ("count(line/(@no | @ret))", "2 * len(no)"), "function_step": ("string-join(distinct-values(line/name()), ',')", "CASE WHEN len(no) > 0 THEN 'line' ELSE '' END"), "filtered": ("string((line)[2]/@no)", "coalesce(no[2]::VARCHAR, '')"),
    "filtered_items": ("string-join((1 to 6)[. mod 2 = 0], ',')", "'2,4,6'"), "item_at": ("('a', 'b', 'c')[2]", "'b'"), "item_last": ("('a', 'b', 'c')[last()]", "'c'"),
    "position_not": ("string-join(line[not(position() = 1)]/@no, ',')", _joined("no[2:]")), "last_less": ("string(line[last() - 1]/@no)", "CASE WHEN len(no) >= 2 THEN no[len(no) - 1]::VARCHAR ELSE '' END"), "positions": ("string-join(line[position() = (1, 3)]/@no, ',')", _joined("list_concat(no[1:1], no[3:3])")),
    "any_prefix": ("count(*:line)", "len(no)"), "no_namespace": ("count(Q{}line)", "len(no)"), "kind": ("count(element(line)) + count(attribute(total))", "len(no) + 1"), "doc_test": ("count(ancestor::document-node())", "1"),
    "variable_path": ("let $o := . return string-join($o/line/@no, ',')", _joined("no")), "above": ("string-join(distinct-values(line/../@id), ',')", "CASE WHEN len(no) > 0 THEN o_orderkey::VARCHAR ELSE '' END"),
    "intersected": ("count(line intersect line[@qty > 20])", "len(list_filter(qty, lambda q: q > 20))"), "without": ("count(line except line[1])", "greatest(len(no) - 1, 0)"), "both_attributes": ("string-join(line[contains(@part, @no)]/@no, ',')", _joined("list_transform(list_filter(range(1, len(no) + 1), lambda i: contains(part[i]::VARCHAR, no[i]::VARCHAR)), lambda i: no[i])")),
    "not_a_number": ("count(line[@ret != 5])", "len(no)"), "rooted": ("count(/order/line)", "len(no)"), "inner": ("count(innermost(//*))", "greatest(len(no), 1)"), "outer": ("string-join(outermost(//*) ! name(), ',')", "'order'"),
})

over_orders("expr_types", {
    "cast_integer": ("'12' cast as xs:integer", "12"), "cast_empty": ("count(() cast as xs:integer?)", "0"), "cast_boolean": ("xs:boolean('1')", "true"), "cast_date": ("string(xs:date(@date))", "strftime(o_orderdate, '%Y-%m-%d')"),
    "cast_decimal": ("xs:decimal('2.50') * 2", "5.0::DOUBLE"), "cast_token": ("xs:token('  a  b ')", "'a b'"), "cast_byte": ("xs:byte('-128')", "-128"), "cast_positive": ("xs:positiveInteger('7')", "7"), "cast_number": ("xs:integer(3.9)", "3"),
    "can_number": ("@priority castable as xs:double", "false"), "can_date": ("@date castable as xs:date", "true"), "can_byte": ("'128' castable as xs:byte", "false"), "can_name": ("'a b' castable as xs:NCName", "false"), "can_empty": ("() castable as xs:integer?", "true"),
    "is_integer": ("count(line) instance of xs:integer", "true"), "is_many": ("(1, 2) instance of xs:integer", "false"), "is_plus": ("line instance of element(line)+", "len(no) > 0"), "is_attribute": ("@id instance of attribute(id)", "true"), "is_empty": ("() instance of empty-sequence()", "true"),
    "is_decimal": ("1 instance of xs:decimal", "true"), "treated": ("(count(line) treat as xs:integer) + 1", "len(no) + 1"), "is_item": ("1 instance of item()", "true"),
})

over_orders("expr_maps_arrays", {
    "map_lookup": ("map{'n': count(line), 'm': 2}?n", "len(no)"), "map_call": ("map{'n': count(line), 'm': 2}('m')", "2"), "map_all": ("sum(map{'a': 1, 'b': 2}?*)", "3"), "keys": ("string-join(sort(map:keys(map{'b': 1, 'a': 2})), ',')", "'a,b'"),
    "sized": ("map:size(map:put(map{'a': 1}, 'b', 2))", "2"), "held": ("map:contains(map{'a': 1}, 'b')", "false"), "got": ("map:get(map{'a': 5}, 'a')", "5"), "less": ("map:size(map:remove(map{'a': 1, 'b': 2}, 'a'))", "1"), "entry": ("map:entry('k', 3)?k", "3"),
    "merged": ("map:merge((map{'a': 1}, map{'a': 2, 'b': 3}))?a", "1"), "merged_last": ("map:merge((map{'a': 1}, map{'a': 2}), map{'duplicates': 'use-last'})?a", "2"), "each_entry": ("string-join(map:for-each(map{'a': 1}, function($k, $v) { $k || $v }), ',')", "'a1'"),
    "member": ("[4, 5, 6](2)", "5"), "members": ("sum([4, 5, 6]?*)", "15"), "computed": ("array:size(array{ line/@no })", "len(no)"), "put": ("string-join(array:put([1, 2], 2, 9)?*, ',')", "'1,9'"), "appended": ("array:size(array:append([1], 2))", "2"),
    "part": ("string-join(array:subarray([1, 2, 3], 2)?*, ',')", "'2,3'"), "part2": ("string-join(array:subarray([1, 2, 3], 1, 2)?*, ',')", "'1,2'"), "removed": ("string-join(array:remove([1, 2, 3], 2)?*, ',')", "'1,3'"), "inserted": ("string-join(array:insert-before([1, 2], 2, 9)?*, ',')", "'1,9,2'"),
    "first": ("array:head([7, 8])", "7"), "rest": ("string-join(array:tail([7, 8, 9])?*, ',')", "'8,9'"), "reversed": ("string-join(array:reverse([1, 2])?*, ',')", "'2,1'"), "linked": ("string-join(array:join(([1], [2, 3]))?*, ',')", "'1,2,3'"), "flat": ("count(array:flatten([1, (2, 3)]))", "3"),
    "kept": ("string-join(array:filter([1, 2, 3, 4], function($i) { $i > 2 })?*, ',')", "'3,4'"), "doubled": ("string-join(array:for-each([1, 2], function($i) { $i * 2 })?*, ',')", "'2,4'"), "folded": ("array:fold-left([1, 2, 3], 0, function($a, $b) { $a + $b })", "6"),
    "folded_right": ("array:fold-right(['a', 'b'], '', function($a, $b) { $b || $a })", "'ba'"), "paired": ("string-join(array:for-each-pair([1, 2], [3, 4], function($a, $b) { $a * $b })?*, ',')", "'3,8'"), "sorted": ("string-join(array:sort([3, 1, 2])?*, ',')", "'1,2,3'"),
    "flat_mapped": ("string-join(array:flat-map([1, 2], function($i) { 1 to $i }), ',')", "'1,1,2'"), "of_orders": ("map{'O': 'open', 'F': 'done', 'P': 'part'}(@status)", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END"),
})

over_orders("expr_functions_higher", {
    "each": ("string-join(for-each(line/@no, function($n) { number($n) * 10 }), ',')", _joined("list_transform(no, lambda n: n * 10)")), "kept": ("count(filter(line/@qty, function($q) { number($q) > 25 }))", "len(list_filter(qty, lambda q: q > 25))"),
    "left": ("fold-left(1 to count(line), 0, function($a, $b) { $a * 2 + $b })", "list_reduce(list_concat([0], range(1, len(no) + 1)), lambda a, b: a * 2 + b)"), "right": ("fold-right(('a', 'b', 'c'), '', function($a, $b) { $b || $a })", "'cba'"), "pairs": ("sum(for-each-pair(1 to 3, 4 to 6, function($a, $b) { $a * $b }))", "32"),
    "sort_by": ("string-join(sort(('bb', 'a', 'ccc'), (), function($s) { -string-length($s) }), ',')", "'ccc,bb,a'"), "applied": ("apply(function($a, $b) { $a - $b }, [7, 3])", "4"), "named": ("upper-case#1(@status)", "o_orderstatus"), "partial": ("concat('x', ?, 'z')(@status)", "'x' || o_orderstatus || 'z'"),
    "bound": ("let $f := function($x) { $x + 1 } return $f($f(1))", "3"), "passed": ("sum(for-each((1, 2, 3), math:sqrt#1) ! (. * .))  => round()", "6.0::DOUBLE"), "arity": ("function-arity(substring#3)", "3"), "name": ("function-name(concat#2)", "'concat'"), "looked_up": ("function-lookup('string-length', 1)('abcd')", "4"),
    "empties": ("fold-left(1 to 3, (), function($a, $b) { ($b, $a) }) => string-join(',')", "'3,2,1'"),
})

over_orders("expr_functions_text", {
    "a": ("upper-case(@priority)", "upper(o_orderpriority)"), "b": ("string-length(@priority)", "length(o_orderpriority)"), "c": ("substring(@priority, 3, 4)", "substr(o_orderpriority, 3, 4)"), "d": ("substring-before(@priority, '-')", "split_part(o_orderpriority, '-', 1)"), "e": ("contains(@priority, 'GH')", "contains(o_orderpriority, 'GH')"),
    "f": ("starts-with(@priority, '1')", "starts_with(o_orderpriority, '1')"), "g": ("ends-with(@priority, 'M')", "suffix(o_orderpriority, 'M')"), "h": ("translate(@priority, 'ABC', 'xy')", "translate(o_orderpriority, 'ABC', 'xy')"), "i": ("replace(@priority, '[A-Z]+', 'x')", "regexp_replace(o_orderpriority, '[A-Z]+', 'x', 'g')"), "j": ("matches(@priority, 'urgent', 'i')", "regexp_matches(o_orderpriority, 'urgent', 'i')"),
    "k": ("string-join(tokenize(@priority, '-'), '|')", "replace(o_orderpriority, '-', '|')"), "l": ("normalize-space('  a  b ')", "'a b'"), "m": ("codepoints-to-string((72, 233))", "'Hé'"), "n": ("sum(string-to-codepoints('AB'))", "131"), "o": ("compare(@status, 'P')", "(CASE WHEN o_orderstatus < 'P' THEN -1 WHEN o_orderstatus > 'P' THEN 1 ELSE 0 END)::BIGINT"), "p": ("codepoint-equal('a', 'a')", "true"),
    "q": ("encode-for-uri('a b/')", "'a%20b%2F'"), "r": ("normalize-unicode('é')", "'é'"), "s": ("matches('e', '[a-z-[aeiou]]')", "false"), "t": ("matches('a.B', 'A.b', 'qi')", "true"), "u": ("substring('abc', number('x'))", "''"), "v": ("contains-token('a b c', 'b')", "true"), "w": ("collation-key('a') eq collation-key('a')", "true"), "x": ("concat('a', 1, true())", "'a1true'"), "y": ("iri-to-uri('http://x/é')", "'http://x/%C3%A9'"), "z": ("resolve-uri('b', 'http://x/a')", "'http://x/b'"), "za": ("escape-html-uri('é')", "'%C3%A9'"),
})

over_orders("expr_functions_numbers", {
    "a": ("abs(-3)", "3"), "b": ("ceiling(2.1)", "3.0::DOUBLE"), "c": ("floor(-2.1)", "-3.0::DOUBLE"), "d": ("round(-2.5)", "-2.0::DOUBLE"), "e": ("round(2.345, 2)", "2.35::DOUBLE"), "f": ("round-half-to-even(3.5)", "4.0::DOUBLE"), "g": ("round-half-to-even(2.125, 2)", "2.12::DOUBLE"), "h": ("floor(count(line))", "len(no)"),
    "i": ("format-integer(703, 'a')", "'aaa'"), "j": ("format-integer(1234567, '#,##0')", "'1,234,567'"), "k": ("format-integer(14, 'I')", "'XIV'"), "l": ("format-integer(3, '1;o')", "'3rd'"), "m": ("format-integer(-7, '001')", "'-007'"), "n": ("format-number(xs:double(@cust), '#,##0.00')", "format('{:,.2f}', o_custkey::DOUBLE)"),
    "o": ("round(math:sqrt(count(line)) * 1000) div 1000", "round(sqrt(len(no)) * 1000) / 1000"), "p": ("round(math:atan(1) * 1000) div 1000", "0.785::DOUBLE"), "q": ("math:pow(2, 10)", "1024.0::DOUBLE"), "r": ("round(math:pi() * 100) div 100", "3.14::DOUBLE"), "s": ("math:exp10(2)", "100.0::DOUBLE"), "t": ("math:log10(1000)", "3.0::DOUBLE"), "u": ("sum(line/@no)", "coalesce(list_sum(no), 0)::DOUBLE"),
    "v": ("max(line/@qty)", "list_max(qty)::DOUBLE"), "w": ("min((line/@qty, number('x'))) != 0", "true"), "x": ("avg(line/@qty)", "list_avg(qty)"), "y": ("sum((), 5)", "5.0::DOUBLE"), "z": ("count(line/@qty)", "len(no)"), "za": ("number(@cust)", "o_custkey::DOUBLE"), "zb": ("string(number(@status)) = 'NaN'", "true"),
})

over_orders("expr_functions_dates", {
    "a": ("year-from-date(@date)", "year(o_orderdate)"), "b": ("month-from-date(@date)", "month(o_orderdate)"), "c": ("day-from-date(@date)", "day(o_orderdate)"), "d": ("format-date(@date, '[D01]/[M01]/[Y0001]')", "strftime(o_orderdate, '%d/%m/%Y')"), "e": ("format-date(@date, '[FNn], [D1] [MNn] [Y]')", "dayname(o_orderdate) || ', ' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate)"),
    "f": ("format-date(@date, '[MN,*-3] [Y,2-2] [d] [W]')", "upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, ' %y ') || dayofyear(o_orderdate) || ' ' || weekofyear(o_orderdate)"), "g": ("string(xs:date(@date) + xs:dayTimeDuration('P10D'))", "strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d')"), "h": ("string(xs:date(@date) - xs:yearMonthDuration('P1Y2M'))", "strftime(o_orderdate - INTERVAL 14 MONTH, '%Y-%m-%d')"),
    "i": ("xs:date(@date) lt xs:date('1995-01-01')", "o_orderdate < DATE '1995-01-01'"), "j": ("hours-from-time('10:20:30.5')", "10"), "k": ("minutes-from-time('10:20:30.5')", "20"), "l": ("seconds-from-time('10:20:30.5')", "30.5::DOUBLE"), "m": ("timezone-from-time('10:20:30+02:00')", "'PT2H'"), "n": ("adjust-time-to-timezone('10:20:30Z', 'PT2H')", "'12:20:30+02:00'"), "o": ("adjust-time-to-timezone('10:20:30Z', '')", "'10:20:30'"),
    "p": ("adjust-date-to-timezone('2024-01-05Z', '-PT5H')", "'2024-01-04-05:00'"), "q": ("adjust-dateTime-to-timezone('2024-01-05T01:00:00Z', '-PT5H')", "'2024-01-04T20:00:00-05:00'"), "r": ("format-time('13:05:09Z', '[h]:[m]:[s] [P] [Z]')", "'1:05:09 pm +00:00'"), "s": ("format-dateTime('2024-02-29T13:05:09.25Z', '[Y]-[M01]-[D01]T[H01]:[m]:[s].[f001] [z]')", "'2024-02-29T13:05:09.250 GMT+00:00'"), "t": ("format-date(@date, '[Dwo] [MNn]') = ''", "false"),
    "u": ("days-from-duration('P3DT4H')", "3"), "v": ("hours-from-dateTime('2024-01-05T07:08:09')", "7"), "w": ("minutes-from-dateTime('2024-01-05T07:08:09')", "8"), "x": ("seconds-from-dateTime('2024-01-05T07:08:09')", "9.0::DOUBLE"), "y": ("current-date() > xs:date('2020-01-01')", "true"), "z": ("string-length(current-time()) > 0 and exists(current-dateTime())", "true"), "za": ("implicit-timezone()", "'PT0S'"), "zb": ("format-date(@date, '[Y]') = format-date(@date, '[Y]')", "true"),
})

over_orders("expr_functions_sequences", {
    "a": ("string-join(reverse(line/@no), ',')", _joined("list_reverse(no)")), "b": ("string-join(subsequence(line/@no, 2, 2), ',')", _joined("no[2:3]")), "c": ("string-join(remove(line/@no, 1), ',')", _joined("no[2:]")), "d": ("string-join(insert-before(line/@no, 1, 'x'), ',')", "'x' || CASE WHEN len(no) > 0 THEN ',' || array_to_string(no, ',') ELSE '' END"),
    "e": ("string(head(line/@no))", "coalesce(no[1]::VARCHAR, '')"), "f": ("string-join(tail(line/@no), ',')", _joined("no[2:]")), "g": ("string-join(index-of(line/@ret, 'N'), ',')", _joined("list_filter(range(1, len(no) + 1), lambda i: ret[i] = 'N')")), "h": ("count(distinct-values(line/@ret))", "len(list_distinct(ret))"), "i": ("deep-equal(line/@no, line/@no)", "true"), "j": ("empty(line)", "len(no) = 0"), "k": ("exists(line[@ret = 'R'])", "list_contains(ret, 'R')"),
    "l": ("count(unordered(line/@no))", "len(no)"), "m": ("zero-or-one(@id) = @id", "true"), "n": ("exactly-one(@id) = @id", "true"), "o": ("count(one-or-more((1, 2)))", "2"), "p": ("string-join(sort((3, 1, 2)), ',')", "'1,2,3'"), "q": ("true() and not(false())", "true"), "r": ("string-join(trace((1, 2)), ',')", "'1,2'"), "s": ("parse-json('{\"a\": [1, 2]}')", "'{\"a\":[1,2]}'"), "t": ("empty(environment-variable('HOME'))", "true"), "u": ("string(default-language())", "'en'"),
})

over_orders("expr_functions_nodes", {
    "a": ("name()", "'order'"), "b": ("local-name(line[1])", "CASE WHEN len(no) > 0 THEN 'line' ELSE '' END"), "c": ("namespace-uri(.)", "''"), "d": ("string(node-name(.))", "'order'"), "e": ("string(root()/order/@id)", "o_orderkey::VARCHAR"), "f": ("has-children()", "len(no) > 0"), "g": ("path(.)", "'/Q{}order[1]'"),
    "h": ("string-join(data(line/@no), ',')", _joined("no")), "i": ("generate-id() eq generate-id(.)", "true"), "j": ("string(id(@id)/@id)", "o_orderkey::VARCHAR"), "k": ("string(.)", "''"), "l": ("string-length()", "0"), "m": ("local-name-from-QName(QName('urn:x', 'p:a'))", "'a'"), "n": ("prefix-from-QName(QName('urn:x', 'p:a'))", "'p'"), "o": ("namespace-uri-from-QName(QName('urn:x', 'p:a'))", "'urn:x'"), "p": ("nilled(.)", "false"), "q": ("count(base-uri(.))", "0"),
    "r": ("string-join(for $l in line return path($l), ' ')", _joined("list_transform(range(1, len(no) + 1), lambda i: '/Q{}order[1]/Q{}line[' || i || ']')", " ")), "s": ("count(line[has-children()])", "0"),
})

_LINES = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey {_IN}) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

#: Nodes that paths select, by document and line: name, path, condition in SQL.
SELECTED = [
    ("second", "/order/line[2]", "r = 2"), ("last", "//line[last()]", "r = n"), ("but_last", "/order/line[position() < last()]", "r < n"), ("following", "//line[1]/following-sibling::line[1]", "r = 2"), ("preceding", "//line[last()]/preceding-sibling::line[1]", "r = n - 1"),
    ("by_attribute", "//line[@ret = 'R']", "l_returnflag = 'R'"), ("by_number", "//line[@qty >= 25]", "l_quantity >= 25"), ("both", "//line[@ret = 'N' and @qty < 10]", "l_returnflag = 'N' AND l_quantity < 10"), ("not_first", "//line[not(position() = 1)]", "r > 1"), ("last_less", "//line[last() - 1]", "r = n - 1"),
    ("of_order", "/order[@status = 'F']/line", "o_orderstatus = 'F'"), ("union_", "//line[1] | //line[@qty > 45]", "r = 1 OR l_quantity > 45"), ("sibling_value", "//line[../line/@qty > 49]", "l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)"), ("whole_sequence", "(//line)[3]", "r = 3"),
    ("positional_and", "//line[@ret = 'R'][1]", "l_returnflag = 'R' AND l_orderkey || '.' || r IN (SELECT l_orderkey || '.' || min(r) FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey " + _IN + ") AS r FROM lineitem) WHERE l_returnflag = 'R' GROUP BY l_orderkey)"),
]


def _selected(path: str):
    def run(spark, sf_dir):
        found = XPath(fixtures.nodes(spark, sf_dir, "order_xml")).select(path)
        return found.select("doc_id", ((F.col("pre") - 8) / 8 + 1).cast("long").alias("place"), F.col("attrs")["no"].alias("no"), "local")

    return run


for _name, _path, _where in SELECTED:
    QUERIES[f"select_{_name}"] = _selected(_path)
    ORACLE[f"select_{_name}"] = f"SELECT l_orderkey AS doc_id, r AS place, l_linenumber::VARCHAR AS no, 'line' AS local FROM {_LINES} WHERE {_where}"
