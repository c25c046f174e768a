"""The named functions of the SQL surface, a query for each family.

Each family reads one table; each row of its list is a column: its name, the
call, and the oracle's counterpart where that has another form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectrove.functions.dialect import register_dialect, translated

#: Texts of several words, and numbers in a list.
_WORDS = "CONCAT(p_brand, ' ', p_type)"
_SPARK_LIST, _DUCK_LIST = "array(3, label, 1, 3)", "[3, label, 1, 3]"


def _six(*calls: str) -> list[tuple[str, ...]]:
    """Calls of doubles that both engines spell alike, to six places."""
    return [(c.split("(")[0], f"ROUND({c}, 6)") for c in calls]


def _whole(name: str, call: str, other: str | None = None) -> tuple[str, str, str]:
    return name, f"CAST({call} AS BIGINT)", f"CAST({other or call} AS BIGINT)"


def _list(name: str, call: str, other: str, sort: bool = False) -> tuple[str, str, str]:
    """A list of numbers as text; sorted where the order is the engine's own."""
    if sort:
        call, other = f"sort_array({call})", f"list_sort({other})"
    return name, f"array_join(CAST({call} AS ARRAY<STRING>), ',')", f"array_to_string({other}, ',')"


# Family: key columns, what follows FROM, columns; keys are grouped by where the family's name has agg in it.
FAMILIES: dict[str, tuple[str, str, list[tuple[str, ...]]]] = {
    "fn_math": (
        "l_orderkey, l_linenumber",
        "lineitem",
        [
            *_six("acos(l_discount)", "acosh(l_quantity)", "asin(l_discount)", "asinh(l_quantity)", "atan(l_quantity)", "atanh(l_discount)"),
            *_six("cosh(l_discount)", "sinh(l_discount)", "tan(l_discount)", "tanh(l_discount)", "cot(l_quantity)", "log2(l_quantity)", "radians(l_quantity)", "pow(l_tax, 2)", "pi()"),
            ("log", "ROUND(log(2, l_quantity), 6)", "ROUND(log2(l_quantity), 6)"),
            _whole("factorial", "factorial(CAST(l_linenumber AS INT))"),
            _whole("signum", "signum(l_tax - 0.04)", "sign(l_tax - 0.04)"),
            ("isnan", "isnan(l_tax)"),
            ("nanvl", "nanvl(CAST('NaN' AS DOUBLE), l_tax)", "l_tax"),
            ("random", "random() BETWEEN 0 AND 1"),
        ],
    ),
    "fn_string": (
        "p_partkey",
        "part",
        [
            _whole("bit_length", "bit_length(p_name)"),
            _whole("octet_length", "octet_length(p_name)", "strlen(p_name)"),
            _whole("char_length", "char_length(p_name)"),
            ("btrim", "btrim(CONCAT('  ', p_brand, ' '))", "trim(CONCAT('  ', p_brand, ' '))"),
            ("ltrim", "CONCAT(ltrim(CONCAT('  ', p_brand, ' ')), '|')"),
            ("rtrim", "CONCAT(rtrim(CONCAT('  ', p_brand, ' ')), '|')"),
            ("rpad", "rpad(p_brand, 12, '*')"),
            ("chr", "chr(CAST(65 + p_size % 26 AS INT))"),
            ("concat_ws", "concat_ws('-', p_brand, NULL, p_type)"),
            ("contains", "contains(p_name, 'a')"),
            _whole("find_in_set", "find_in_set(p_brand, 'Brand#11,Brand#23,Brand#12')", "COALESCE(list_position(['Brand#11', 'Brand#23', 'Brand#12'], p_brand), 0)"),
            ("initcap", f"initcap({_WORDS})", f"array_to_string(list_transform(string_split({_WORDS}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"),
            _whole("instr", "instr(p_name, 'e')"),
            _whole("position", "position('#' IN p_brand)"),
            ("overlay", "overlay(p_brand PLACING '__' FROM 2 FOR 3)", "left(p_brand, 1) || '__' || substr(p_brand, 5)"),
            ("substr", "substr(p_name, 2, 3)"),
            ("substring_index", "substring_index(p_brand, '#', 1)", "split_part(p_brand, '#', 1)"),
            ("encode", "hex(encode(p_name, 'UTF-8'))", "hex(encode(p_name))"),
            ("decode", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "decode(encode(p_name))"),
            _whole("uuid", "length(uuid())", "36"),
            _whole("regexp_count", f"regexp_count({_WORDS}, '[aeiouAEIOU]')", f"len(regexp_extract_all({_WORDS}, '[aeiouAEIOU]'))"),
            _whole("regexp_instr", "regexp_instr(p_name, '[g-m]')", "CASE WHEN regexp_matches(p_name, '[g-m]') THEN instr(p_name, regexp_extract(p_name, '[g-m]')) ELSE 0 END"),
            ("regexp_extract_all", "array_join(regexp_extract_all(p_name, '([a-f]+)', 1), ',')", "array_to_string(regexp_extract_all(p_name, '([a-f]+)', 1), ',')"),
        ],
    ),
    "fn_conditional": (
        "c_custkey",
        "customer",
        [
            ("nvl", "nvl(NULLIF(c_mktsegment, 'BUILDING'), 'none')", "COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none')"),
            ("nvl2", "nvl2(NULLIF(c_mktsegment, 'BUILDING'), c_name, 'none')", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name ELSE 'none' END"),
            ("ifnull", "ifnull(NULLIF(c_mktsegment, 'BUILDING'), c_name)"),
        ],
    ),
    "fn_date": (
        "o_orderkey",
        "orders",
        [
            ("to_date", "CAST(to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
            ("to_timestamp", "CAST(to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) AS TIMESTAMP_NTZ)", "date_trunc('second', o_orderdate)"),
            ("to_char", "to_char(o_orderdate, 'yyyy/MM')", "strftime(o_orderdate, '%Y/%m')"),
            ("from_unixtime", "from_unixtime(o_orderkey * 1000)", "strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S')"),
            ("make_time", "CAST(make_time(CAST(o_orderkey % 24 AS INT), 20, 30) AS STRING)", "CAST(make_time(o_orderkey % 24, 20, 30) AS VARCHAR)"),
            ("to_timestamp_seconds", "CAST(to_timestamp_seconds(o_orderkey) AS TIMESTAMP_NTZ)", "make_timestamp(o_orderkey * 1000000)"),
            ("to_timestamp_millis", "CAST(to_timestamp_millis(o_orderkey) AS TIMESTAMP_NTZ)", "make_timestamp(o_orderkey * 1000)"),
            ("to_timestamp_micros", "CAST(to_timestamp_micros(o_orderkey) AS TIMESTAMP_NTZ)", "make_timestamp(o_orderkey)"),
            ("to_unixtime", "to_unixtime(CAST(o_orderdate AS TIMESTAMP))", "CAST(epoch(o_orderdate) AS BIGINT)"),
            ("current_date", "current_date() IS NOT NULL", "TRUE"),
            ("current_time", "current_time() IS NOT NULL", "TRUE"),
            ("now", "now() = current_timestamp()", "TRUE"),
        ],
    ),
    "fn_array": (
        "vec_id",
        "embeddings",
        [
            _list("array_append", f"array_append({_SPARK_LIST}, 7)", f"list_append({_DUCK_LIST}, 7)"),
            _list("array_prepend", f"array_prepend({_SPARK_LIST}, 7)", f"list_prepend(7, {_DUCK_LIST})"),
            _list("array_distinct", f"array_distinct({_SPARK_LIST})", f"list_distinct({_DUCK_LIST})", sort=True),
            _list("array_except", f"array_except({_SPARK_LIST}, array(1, 2))", f"list_distinct(list_filter({_DUCK_LIST}, lambda x: x NOT IN (1, 2)))", sort=True),
            _list("array_intersect", f"array_intersect({_SPARK_LIST}, array(1, 2, 5))", f"list_intersect({_DUCK_LIST}, [1, 2, 5])", sort=True),
            _list("array_union", f"array_union({_SPARK_LIST}, array(2, 9))", f"list_distinct(list_concat({_DUCK_LIST}, [2, 9]))", sort=True),
            _list("array_remove", f"array_remove({_SPARK_LIST}, 3)", f"list_filter({_DUCK_LIST}, lambda x: x <> 3)"),
            _list("array_repeat", "array_repeat(label, 3)", "list_transform(range(3), lambda x: label)"),
            _list("array_sort", f"array_sort({_SPARK_LIST})", f"list_sort({_DUCK_LIST})"),
            _list("array_concat", f"array_concat({_SPARK_LIST}, make_array(8, label))", f"list_concat({_DUCK_LIST}, [8, label])"),
            _list("flatten", f"flatten(array(array(label), {_SPARK_LIST}))", f"flatten([[label], {_DUCK_LIST}])"),
            _whole("array_position", f"array_position({_SPARK_LIST}, 1)", f"list_position({_DUCK_LIST}, 1)"),
            _whole("array_min", f"array_min({_SPARK_LIST})", f"list_min({_DUCK_LIST})"),
            _whole("arrays_zip", "element_at(arrays_zip(array(1, 2), array(4, label)), 2).`1`", "list_zip([1, 2], [4, label])[2][2]"),
            _whole("cardinality", f"cardinality({_SPARK_LIST})", "4"),
            _whole("array_element", f"array_element({_SPARK_LIST}, 2)", "label"),
            ("array_has", f"array_has({_SPARK_LIST}, 5)", f"list_contains({_DUCK_LIST}, 5)"),
            ("array_has_any", f"array_has_any({_SPARK_LIST}, array(5, 6))", f"list_has_any({_DUCK_LIST}, [5, 6])"),
            ("array_to_string", "array_to_string(string_to_array(concat('a.', label, '.b'), '.'), '|')", "array_to_string(string_split(concat('a.', label, '.b'), '.'), '|')"),
        ],
    ),
    "fn_map_json": (
        "c_custkey",
        "customer",
        [
            ("map_keys", "array_join(map_keys(map('a', c_name, 'b', c_mktsegment)), '|')", "array_to_string(map_keys(MAP {'a': c_name, 'b': c_mktsegment}), '|')"),
            ("map_values", "array_join(map_values(map('a', c_name, 'b', c_mktsegment)), '|')", "array_to_string(map_values(MAP {'a': c_name, 'b': c_mktsegment}), '|')"),
            ("map_entries", "map_entries(map('a', c_name))[0].value", "map_entries(MAP {'a': c_name})[1].value"),
            ("struct", "struct(c_name, c_nationkey).c_name", "c_name"),
            ("to_json", "to_json(named_struct('a', c_nationkey, 'b', c_mktsegment))", "CAST(to_json({'a': c_nationkey, 'b': c_mktsegment}) AS VARCHAR)"),
            _whole("from_json", "from_json(concat('{\"a\":', c_nationkey, '}'), 'a INT').a", "json_extract(concat('{\"a\":', c_nationkey, '}'), '$.a')"),
            ("variant_get", "variant_get(parse_json(concat('{\"a\":[', c_nationkey, ',7]}')), '$.a[1]', 'string')", "json_extract_string(concat('{\"a\":[', c_nationkey, ',7]}'), '$.a[1]')"),
            ("schema_of_json", "schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"),
        ],
    ),
    "fn_json_tuple": ("event_id", "events", [("k", "json_tuple(props, 'k')", "json_extract_string(props, '$.k')")]),
    "fn_agg": (
        "l_returnflag, l_linestatus",
        "lineitem",
        [
            ("stddev", "ROUND(stddev(l_quantity), 6)"),
            ("covar_samp", "ROUND(covar_samp(l_quantity, l_discount), 6)"),
            ("regr_avgx", "ROUND(regr_avgx(l_discount, l_quantity), 6)"),
            ("regr_avgy", "ROUND(regr_avgy(l_discount, l_quantity), 6)"),
            _whole("regr_count", "regr_count(l_discount, l_quantity)"),
            ("regr_intercept", "ROUND(regr_intercept(l_discount, l_quantity), 6)"),
            ("regr_r2", "ROUND(regr_r2(l_discount, l_quantity), 6)"),
            ("regr_sxx", "ROUND(regr_sxx(l_discount, l_quantity), 3)"),
            ("regr_sxy", "ROUND(regr_sxy(l_discount, l_quantity), 3)"),
            ("regr_syy", "ROUND(regr_syy(l_discount, l_quantity), 3)"),
            ("first_value", "first_value(l_returnflag)", "min(l_returnflag)"),
            ("median", "ROUND(median(l_quantity), 6)"),
        ],
    ),
    "fn_agg_text": (
        "n_regionkey",
        "nation",
        [
            ("string_agg", "string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name)", "string_agg(n_name, ',' ORDER BY n_name)"),
            # Estimates of so few values are exact.
            _whole("approx_distinct", "approx_distinct(n_nationkey)", "count(DISTINCT n_nationkey)"),
        ],
    ),
}


def _text(name: str, side: int) -> str:
    keys, source, columns = FAMILIES[name]
    made = ", ".join(f"{c[min(side, len(c) - 1)]} AS {c[0]}_" for c in columns)
    return f"SELECT {keys}, {made} FROM {source}" + (f" GROUP BY {keys}" if "agg" in name else "")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = spark.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        session.conf.set("spark.sql.timeType.enabled", "true")
        register_dialect(session)
        source = FAMILIES[name][1]
        session.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(source)
        return session.sql(translated(_text(name, 1)))

    return run


QUERIES = {name: _query(name) for name in FAMILIES}
ORACLE_SQL = {name: _text(name, 2) for name in FAMILIES}
