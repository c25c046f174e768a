"""The relational surface: a query for each form that SQL over collections offers.

Where Spark and the oracle read the same text, it stands once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrove.operators.frames import range_count

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Text that both engines read.
SHARED = {
    "rel_projection": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity >= 25 THEN 'large' WHEN l_quantity >= 10 THEN 'medium' ELSE 'small' END AS size_class FROM lineitem",
    "rel_predicates": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND (p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR p_name LIKE '%a%') AND NOT p_retailprice IS NULL AND COALESCE(NULLIF(p_size, 7), 0) <> 0",
    "rel_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'",
    "rel_join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "rel_join_left": "SELECT c_custkey, COUNT(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "rel_join_right": "SELECT s_suppkey, COUNT(l_orderkey) AS n_lines FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey",
    "rel_join_full": "SELECT c_nationkey, s_nationkey, COUNT(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 15) c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 8) s ON c_nationkey = s_nationkey GROUP BY c_nationkey, s_nationkey",
    "rel_join_star": "SELECT r_name, n_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "rel_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "rel_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority < '2')",
    "rel_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "rel_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 40)",
    "rel_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "rel_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "rel_group_having": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10",
    "rel_agg_filter": "SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, ROUND(SUM(o_totalprice) FILTER (WHERE o_totalprice > 50000), 2) AS big FROM orders GROUP BY o_orderpriority",
    "rel_stats": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(STDDEV_POP(l_quantity), 6) AS sdp, ROUND(VAR_SAMP(l_quantity), 6) AS v, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS cp, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag",
    "rel_bool_agg": "SELECT l_linestatus, BOOL_AND(l_quantity > 0) AS all_pos, BOOL_OR(l_discount > 0.09) AS any_disc, BIT_AND(l_orderkey) AS ba, BIT_OR(l_orderkey) AS bo, BIT_XOR(l_orderkey) AS bx FROM lineitem GROUP BY l_linestatus",
    "rel_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "rel_distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_grouping_sets": "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
    "rel_ranking": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER w2 AS BIGINT) AS rk, CAST(DENSE_RANK() OVER w2 AS BIGINT) AS dr, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd, CAST(NTILE(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "rel_lag_lead": "SELECT event_id, LAG(value, 1) OVER w AS prev, LEAD(value, 2, -1.0) OVER w AS next2, value - LAG(value) OVER w AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "rel_first_last_nth": "SELECT event_id, FIRST_VALUE(event_id) OVER w AS f, LAST_VALUE(event_id) OVER w AS l, NTH_VALUE(event_id, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "rel_rows_frame": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM events",
    "rel_range_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders",
    "rel_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "rel_limit_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 40",
    "rel_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "rel_union_all": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier) GROUP BY k",
    "rel_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey AS k FROM supplier",
    "rel_intersect_all": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier) GROUP BY k",
    "rel_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "rel_except_all": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier) GROUP BY k",
    "rel_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM orders)",
    "rel_correlated": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT 1.9 * AVG(l_quantity) FROM lineitem b WHERE b.l_suppkey = a.l_suppkey)",
    "rel_cte": "WITH spent AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey, total FROM spent WHERE total > 300000) SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total FROM top JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "rel_recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "rel_string": "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, CONCAT(p_brand, '-', p_type) AS c, SUBSTRING(p_name, 2, 4) AS s, TRIM(CONCAT('  ', p_brand, ' ')) AS t, CAST(LENGTH(p_name) AS BIGINT) AS n, REPLACE(p_brand, '#', '_') AS r, SPLIT_PART(p_brand, '#', 2) AS sp, LPAD(p_brand, 12, '*') AS lp, REVERSE(p_brand) AS rv, REPEAT('ab', 2) AS rp, TRANSLATE(p_brand, 'Bd', 'Xy') AS tr, LEFT(p_name, 3) AS lf, RIGHT(p_name, 3) AS rt, CAST(LEVENSHTEIN(p_brand, 'Brand#11') AS BIGINT) AS lv, md5(p_name) AS m, CAST(ASCII(p_brand) AS BIGINT) AS a FROM part",
    "rel_date": "SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS m, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(DOY FROM o_orderdate) AS BIGINT) AS d, CAST(DATE_PART('quarter', o_orderdate) AS BIGINT) AS q, o_orderdate + INTERVAL '3' DAY AS plus3 FROM orders",
    "rel_math": "SELECT l_orderkey, l_linenumber, ROUND(ABS(l_tax - 0.05), 6) AS a, ROUND(SQRT(l_quantity), 6) AS s, ROUND(POWER(l_discount + 1, 3), 6) AS p, CAST(FLOOR(l_extendedprice) AS BIGINT) AS f, CAST(CEIL(l_extendedprice) AS BIGINT) AS c, ROUND(LN(l_quantity), 6) AS ln, ROUND(LOG10(l_extendedprice), 6) AS lg, l_orderkey % 7 AS md, ROUND(SIN(l_tax) + COS(l_tax) + ATAN2(l_tax, 1.0), 6) AS trig, ROUND(EXP(l_discount), 6) AS ex, CAST(SIGN(l_tax - 0.04) AS BIGINT) AS sg, GREATEST(l_tax, l_discount) AS gr, LEAST(l_tax, l_discount) AS le, ROUND(CBRT(l_quantity), 6) AS cb, ROUND(DEGREES(l_tax), 6) AS dg FROM lineitem",
    "rel_conditional": "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS k, c_acctbal IS NOT NULL AS has FROM customer",
    "rel_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b) WHERE a >= 2",
    "rel_tpch_q1": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "rel_tpch_q6": "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "rel_documents_by_lang": "SELECT lang, source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source",
    "rel_conversation_turns": "SELECT conv_id, COUNT(*) AS turns, MAX(turn) AS last_turn, COUNT(DISTINCT role) AS roles FROM conversations GROUP BY conv_id",
}

# Text for Spark and for the oracle where they differ.
PAIRS = {
    "rel_regex": (
        "SELECT p_partkey, regexp_replace(p_type, '[aeiou]', '_') AS r, regexp_like(p_name, '^[a-m]') AS m, regexp_extract(p_brand, '#([0-9]+)', 1) AS e FROM part",
        "SELECT p_partkey, regexp_replace(p_type, '[aeiou]', '_', 'g') AS r, regexp_matches(p_name, '^[a-m]') AS m, regexp_extract(p_brand, '#([0-9]+)', 1) AS e FROM part",
    ),
    "rel_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, ROUND(CAST(element_at(embedding, 3) AS DOUBLE), 6) AS third, ROUND(CAST(array_max(embedding) AS DOUBLE), 6) AS mx, CAST(size(slice(embedding, 2, 5)) AS BIGINT) AS sl, array_contains(array(1, 2, 3), label) AS has FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, ROUND(CAST(embedding[3] AS DOUBLE), 6) AS third, ROUND(CAST(list_max(embedding) AS DOUBLE), 6) AS mx, CAST(len(embedding[2:6]) AS BIGINT) AS sl, list_contains([1, 2, 3], label) AS has FROM embeddings",
    ),
    "rel_unnest": (
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS pos, word",
        "SELECT doc_id, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)",
    ),
    "rel_json": (
        "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS missing FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    ),
    "rel_groups_frame": (
        "WITH g AS (SELECT o_orderstatus, o_orderdate, COUNT(*) AS c FROM orders GROUP BY o_orderstatus, o_orderdate), w AS (SELECT o_orderstatus, o_orderdate, SUM(c) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM g) SELECT o_orderkey, n FROM orders JOIN w USING (o_orderstatus, o_orderdate)",
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
    ),
    "rel_qualify": (
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    ),
    "rel_date_bin": (
        "SELECT event_type, date_bin(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))::timestamp_ntz AS hour, COUNT(*) AS n FROM events GROUP BY event_type, date_bin(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))",
        "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, COUNT(*) AS n FROM events GROUP BY ALL",
    ),
    "rel_dialect_names": (
        "SELECT p_partkey, starts_with(p_brand, 'Brand') AS sw, ends_with(p_brand, '1') AS ew, CAST(strpos(p_brand, '#') AS BIGINT) AS sp, to_hex(p_partkey) AS hx, sha256(p_brand) AS sh, gcd(p_partkey, 12) AS g, lcm(p_size, 4) AS l, trunc_number(p_retailprice, 1) AS t FROM part",
        "SELECT p_partkey, starts_with(p_brand, 'Brand') AS sw, ends_with(p_brand, '1') AS ew, CAST(strpos(p_brand, '#') AS BIGINT) AS sp, lower(to_hex(p_partkey)) AS hx, sha256(p_brand) AS sh, CAST(gcd(p_partkey, 12) AS BIGINT) AS g, CAST(lcm(p_size::BIGINT, 4::BIGINT) AS BIGINT) AS l, sign(p_retailprice) * floor(abs(p_retailprice) * power(10, 1)) / power(10, 1) AS t FROM part",
    ),
    "rel_map_struct": (
        "SELECT c_custkey, element_at(map('seg', c_mktsegment, 'name', c_name), 'seg') AS seg, named_struct('a', c_nationkey, 'b', c_name).b AS b, CAST(size(map_keys(map('x', 1, 'y', 2))) AS BIGINT) AS n FROM customer",
        "SELECT c_custkey, c_mktsegment AS seg, struct_pack(a := c_nationkey, b := c_name).b AS b, CAST(2 AS BIGINT) AS n FROM customer",
    ),
    "rel_string_agg": (
        "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names, CAST(median(n_nationkey) AS DOUBLE) AS med, percentile_cont(0.25) WITHIN GROUP (ORDER BY n_nationkey) AS p25 FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(median(n_nationkey) AS DOUBLE) AS med, quantile_cont(n_nationkey, 0.25)::DOUBLE AS p25 FROM nation GROUP BY n_regionkey",
    ),
    "rel_sequence": (
        "SELECT i, i * i AS sq FROM (SELECT explode(sequence(CAST(1 AS BIGINT), CAST(50 AS BIGINT))) AS i)",
        "SELECT i, i * i AS sq FROM generate_series(CAST(1 AS BIGINT), CAST(50 AS BIGINT)) AS t(i)",
    ),
    "rel_to_timestamp": (
        "SELECT o_orderkey, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS s, date_format(o_orderdate, 'yyyy-MM-dd') AS d, CAST(make_date(2024, 2, 29) AS STRING) AS md FROM orders",
        "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(make_date(2024, 2, 29) AS VARCHAR) AS md FROM orders",
    ),
}

# Estimators differ between engines: no oracle.
ROWS_ONLY = {
    "rel_approx": "SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts, percentile_approx(l_quantity, 0.5) AS med FROM lineitem GROUP BY l_returnflag",
}


def _session(spark: SparkSession, sf_dir: str, text: str) -> SparkSession:
    """Views of the tables that the text names, in a session of their own."""
    from vectrove.functions.dialect import register_dialect

    session = spark.newSession()
    # Without a zone in the data, one zone for all that needs one.
    session.conf.set("spark.sql.session.timeZone", "UTC")
    for name in TABLES:
        if name in text:
            session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    if "rel_dialect" in text or any(f"{n}(" in text for n in ("date_bin", "gcd", "strpos")):
        register_dialect(session)
    return session


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir, text).sql(text)

    return run


def rel_frame_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same surface by the DataFrame API: join, window, aggregate."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    last = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    latest = orders.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return latest.join(customer, latest.o_custkey == customer.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def rel_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's frame by running counts: Spark's own sliding frame reads the whole frame for each price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return range_count(orders, "o_orderstatus", "o_totalprice", 1000, 1000, "near").select("o_orderkey", "near")


QUERIES = {
    **{n: _sql(t) for n, t in SHARED.items()},
    **{n: _sql(t) for n, (t, _) in PAIRS.items()},
    **{n: _sql(t) for n, t in ROWS_ONLY.items()},
    "rel_range_frame": rel_range_frame,
    "rel_frame_api": rel_frame_api,
}

ORACLE_SQL = {
    **SHARED,
    **{n: t for n, (_, t) in PAIRS.items()},
    "rel_frame_api": "WITH l AS (SELECT * FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM l JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
}
