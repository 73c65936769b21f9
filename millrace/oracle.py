"""The queries of queries.py in SQL."""

ORACLE_SQL: dict[str, str] = {}

_SUM = "CAST(sum(CAST({0} AS DECIMAL(28,{1}))) AS DOUBLE)"
_AVG = "CAST(sum(CAST({0} AS DECIMAL(28,{1}))) AS DOUBLE) / count({0})"


def _sum(column: str, n: int = 2) -> str:
    return _SUM.format(column, n)


def _avg(column: str, n: int = 2) -> str:
    return _AVG.format(column, n)


O = ORACLE_SQL  # noqa: E741
O["agg_all_methods"] = f"""
SELECT l_returnflag, l_linestatus, {_sum("l_quantity")} AS sum_qty,
       CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(28,4))) AS DOUBLE) AS revenue,
       min(l_extendedprice) AS least_price, max(l_linenumber)::BIGINT AS greatest_line, {_avg("l_discount")} AS mean_discount, count(*) AS lines
FROM lineitem GROUP BY ALL"""
O["agg_first_last"] = "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id"
O["agg_sum_string"] = "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM events GROUP BY user_id"
O["agg_sum_date"] = "SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ts, event_id) AS times FROM events GROUP BY user_id"
O["agg_avg_date"] = "SELECT user_id, (sum(floor(epoch(ts))::BIGINT) // count(*))::BIGINT AS mean_seconds FROM events GROUP BY user_id"
O["agg_minmax_string_date"] = "SELECT user_id, min(event_type) AS least_type, max(event_type) AS greatest_type, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY user_id"
O["agg_running"] = """
SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER w AS DOUBLE) AS total,
       CAST(sum(CAST(value AS DECIMAL(28,2))) OVER w AS DOUBLE) / count(*) OVER w AS mean,
       min(value) OVER w AS least, max(value) OVER w AS greatest, first_value(event_type) OVER w AS first_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
O["agg_delta"] = "SELECT user_id, event_id, 1::BIGINT AS n, coalesce(value, 0) AS total FROM events"
_NULLS = "FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY o_orderpriority"
O["agg_null_zero"] = f"""
SELECT o_orderpriority, count(*) AS n, min(coalesce(c_acctbal, 0)) AS least_balance,
       CAST(sum(CAST(coalesce(c_acctbal, 0) AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS mean_balance,
       max(coalesce(c_mktsegment, '')) AS greatest_segment, min(coalesce(c_mktsegment, '')) AS least_segment {_NULLS}"""
O["agg_null_sql"] = f"SELECT o_orderpriority, count(c_acctbal) AS n, min(c_acctbal) AS least_balance, {_avg('c_acctbal')} AS mean_balance {_NULLS}"
O["project_constant"] = "SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS one, 'a.b' AS word, 0.5::DOUBLE AS half, 'true' AS yes FROM nation"
O["project_field"] = "SELECT l_orderkey AS okey, l_linenumber::BIGINT AS line, l_returnflag AS flag, l_extendedprice AS price FROM lineitem"
O["project_expr"] = "SELECT l_orderkey AS okey, l_linenumber::BIGINT AS line, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS big FROM lineitem"
O["expr_logical"] = "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'O' AS both, o_totalprice > 300000 OR NOT o_orderpriority < '3' AS either FROM orders"
O["expr_arith_string"] = "SELECT o_orderkey, o_orderstatus || ',' || o_custkey AS joined, o_custkey * 2 - (o_orderkey + 1) AS number FROM orders"
O["expr_regex_ternary"] = r"""SELECT event_id, CASE WHEN regexp_matches(coalesce(props, ''), '"(\w+)":\s*(\d+)') THEN regexp_extract(props, '"(\w+)":\s*(\d+)', 2) ELSE 'unknown' END AS captured, reverse(coalesce(props, '')) AS reversed FROM events"""
O["expr_reverse2"] = "SELECT event_id, reverse(coalesce(event_type, '')) || reverse(coalesce(props, '')) AS both FROM events"
O["expr_date_to_string"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y%m%d')::BIGINT AS day FROM events"
O["expr_long"] = r"SELECT event_id, try_cast(regexp_extract(props, '(\d+)', 1) AS BIGINT) - 1 AS number, try_cast(event_type AS BIGINT) AS none FROM events"
O["expr_digit_prefix"] = r"SELECT event_id, try_cast(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS whole, try_cast(regexp_extract(props, '(\d+)', 1) || '.64364' AS DOUBLE) AS number, try_cast(regexp_extract(event_type, '^\s*([+-]?\d+)', 1) AS BIGINT) AS none FROM events"
O["expr_truthy_filter"] = "SELECT event_id FROM events WHERE value - 50 > 1e-6 AND trim(event_type) <> '' AND user_id > 0"
O["class_udf"] = "SELECT event_id, reverse(event_type) || reverse(user_id::VARCHAR) AS built_in, reverse(user_id::VARCHAR) || reverse(event_type) AS python FROM events"
O["macro_dates"] = "SELECT r_regionkey, '2024' AS n_yyyy, '24' AS n_yy, '01' AS n_mm, '1' AS n_m, '31' AS n_dd, '31' AS n_d, '04' AS n_hh, '05' AS n_mi, '06' AS n_ss, '20240131' AS n_yyyymmdd, '202401' AS n_yyyymm, '202312' AS n_yyyymmp, '20240201' AS n_yyyymmddn, '202402' AS n_yyyymmn, '20240130' AS n_yyyymmddp FROM region"
_SPENT = f"SELECT o_custkey, count(*) AS orders, {_sum('o_totalprice')} AS spent FROM orders"
O["filter_input"] = f"{_SPENT} WHERE o_orderstatus = 'F' GROUP BY o_custkey"
O["filter_output"] = f"{_SPENT} GROUP BY o_custkey HAVING count(*) > 10"
O["filter_store"] = f"SELECT o_custkey AS customer, spent FROM ({_SPENT} GROUP BY o_custkey) WHERE spent - 1500000 > 1e-6"
O["filter_push"] = "SELECT o_custkey, 1::BIGINT AS orders, o_totalprice AS spent FROM orders WHERE o_totalprice > 400000"
O["push_keys"] = "SELECT 'long' AS kind, n_nationkey::VARCHAR AS key, n_name AS name FROM nation UNION ALL SELECT 'text', n_regionkey || n_name, n_name FROM nation WHERE n_regionkey > 1"
O["sink_mapping"] = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders"
O["sink_key_string"] = "SELECT o_orderkey, o_custkey || ':' || o_orderstatus || ':' AS key FROM orders"
O["sink_partition"] = "SELECT o_orderkey, (o_custkey % 7)::INTEGER AS by_number, (o_custkey % 7)::INTEGER AS by_text FROM orders"
O["coerce_types"] = r"""
SELECT event_id, coalesce(try_cast(n AS BIGINT), 0) AS number, 0::BIGINT AS no_number, -coalesce(try_cast(n AS BIGINT), 0) AS cut, coalesce(try_cast(n AS DOUBLE), 0) AS fraction,
       CASE WHEN user_id > 50 THEN event_type ELSE '' END AS text, 0::BIGINT AS no_date, substr(value::VARCHAR, 1, 2) AS other
FROM (SELECT *, regexp_extract(props, '(\d+)', 1) AS n FROM events)"""
O["lookup_memory"] = "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(c_mktsegment, '') AS segment, coalesce(c_acctbal, 0) AS balance, coalesce(c_nationkey, 0)::BIGINT AS nation FROM lineitem LEFT JOIN customer ON l_partkey = c_custkey"
O["lookup_store_composite_key"] = "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, o) AS part, arg_max(l_extendedprice, o) AS price FROM (SELECT *, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o FROM lineitem) GROUP BY ALL"
O["lookup_chain_snowflake"] = "SELECT o_orderkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
O["lookup_last_wins"] = """
SELECT o_orderkey, o_custkey, coalesce(t, '') AS last_type, coalesce(v, 0) AS last_value FROM orders LEFT JOIN
(SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type <> 'view' GROUP BY user_id) ON o_custkey = user_id"""
O["lookup_group_by_joined"] = f"SELECT coalesce(c_mktsegment, '') AS segment, count(*) AS orders, {_sum('o_totalprice')} AS spent FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"
O["lookup_sharded_union"] = "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"
_BOTH = "FROM (SELECT o_custkey AS person, {0} FROM orders GROUP BY 1) FULL JOIN (SELECT user_id AS person, {1} FROM events GROUP BY 1) USING (person)"
O["multi_group"] = "SELECT person, coalesce(a, 0) AS spent, coalesce(b, 0) AS greatest_order, coalesce(c, 0) AS mean_value, coalesce(e, '') AS least_type " + _BOTH.format(f"{_sum('o_totalprice')} AS a, max(o_orderkey) AS b", f"{_avg('value')} AS c, min(event_type) AS e")
O["multi_count_per_input"] = "SELECT person, coalesce(a, 0) AS orders, coalesce(b, 0) AS events, coalesce(a, 0) + coalesce(b, 0) AS rows " + _BOTH.format("count(*) AS a", "count(*) AS b")
_LAST = _BOTH.format("arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status", "arg_max(value, (ts, event_id)) AS last_value, arg_max(event_type, (ts, event_id)) AS last_type")
O["multi_merge"] = f"SELECT person, last_price, last_status, last_value, last_type {_LAST}"
_NEWEST = _BOTH.format("arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS r", "arg_max(value, (ts, event_id)) AS v, arg_max(event_type, (ts, event_id)) AS t")
O["multi_deferred_expr"] = f"SELECT person, coalesce(p, 0) AS last_price, coalesce(t, '') AS last_type, p + v AS both, s || ' value of ' || t AS text, r || ':' || t AS renamed {_NEWEST}"
O["stream_multi_merge"] = O["multi_deferred_expr"]
O["project_variables"] = "SELECT o_orderkey, coalesce(o_orderstatus || ' status ' || coalesce(c_mktsegment, '') || o_custkey, '') AS text FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
O["graph_store"] = f"SELECT coalesce(c_mktsegment, '') AS name, count(*) AS n, {_sum('o_totalprice')} AS spent FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"
O["graph_push_delta"] = "SELECT coalesce(c_mktsegment, '') AS key, count(*) AS pushed, count(*) AS ones FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"
O["multi_union_disjoint"] = "SELECT n_nationkey + 100 AS place, n_name AS name, n_regionkey AS above FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region"
_DEDUP = """
SELECT event_id, user_id, event_type, b AS bucket_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY b, user_id, event_type ORDER BY ts, event_id) AS k
  FROM (SELECT *, (floor(epoch(ts))::BIGINT // {0}) * {0} AS b FROM events)) WHERE k = 1"""
O["dedup_minute30"], O["dedup_hour"], O["dedup_day"] = (_DEDUP.format(s) for s in (1800, 3600, 86400))
O["dedup_membership"] = "SELECT event_id, user_id FROM events a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND date_trunc('day', b.ts) = date_trunc('day', a.ts))"
O["dedup_seen_flag"] = "SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts), user_id, event_type ORDER BY ts, event_id) > 1 AS seen FROM events"
_PER_ORDER = f"(SELECT l_orderkey, count(*) AS lines, {_sum('l_quantity')} AS q FROM lineitem GROUP BY 1)"
O["chain_full"] = f"SELECT lines, count(*) AS orders, {_sum('q')} AS qty FROM {_PER_ORDER} GROUP BY 1"
O["chain_delta"] = f"SELECT 1::BIGINT AS lines, count(*) AS rows, {_sum('l_quantity')} AS qty FROM lineitem"
O["fanout_two_consumers"] = "SELECT user_id AS person, count(*) AS events, max(value) AS greatest FROM events GROUP BY 1"
O["wire_roundtrip"] = "SELECT event_id, event_type, value, epoch_us(ts) // 1000 AS ms, props FROM events"
O["text_scheme"] = "SELECT text AS logInfo FROM documents"
O["run_log_summary"] = "SELECT event_type, count(*) AS entries, sum(event_id % 97)::BIGINT AS total_elapsed, min(event_id % 97) AS least_elapsed, max(event_id % 97) AS greatest_elapsed FROM events GROUP BY 1"
O["stream_agg"] = f"SELECT user_id, count(*) AS n, {_sum('value')} AS total, max(value) AS greatest, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1"
O["stream_lookup"] = "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(c_mktsegment, '') AS segment FROM lineitem LEFT JOIN customer ON l_partkey = c_custkey"
O["stream_dedup"] = "SELECT DISTINCT floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket_seconds, user_id, event_type FROM events"
O["stream_multi_group"] = "SELECT person, coalesce(a, 0) AS spent, coalesce(b, 0) AS orders, coalesce(c, 0) AS events, coalesce(d, 0) AS total_value " + _BOTH.format(f"{_sum('o_totalprice')} AS a, count(*) AS b", f"count(*) AS c, {_sum('value')} AS d")
O["stream_running"] = """
SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER w AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER w AS DOUBLE) / count(*) OVER w AS mean,
       min(value) OVER w AS least, max(value) OVER w AS greatest, first_value(event_type) OVER w AS first_type, event_type AS last_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
O["time_bucket"] = "SELECT event_id, s // 1800 * 1800 AS half_hour, s // 21600 * 21600 AS six_hours, s // 604800 * 604800 AS week FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events)"
O["inputs_full_join"] = f"""
SELECT person, coalesce(a, 0) AS orders, coalesce(b, 0) AS events, coalesce(c, 0) AS balance FROM (SELECT o_custkey AS person, count(*) AS a FROM orders GROUP BY 1)
FULL JOIN (SELECT user_id AS person, count(*) AS b FROM events GROUP BY 1) USING (person) FULL JOIN (SELECT c_custkey AS person, {_sum('c_acctbal')} AS c FROM customer GROUP BY 1) USING (person)"""
