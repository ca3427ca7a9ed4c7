"""Conformance of the SQL surface: one query per relational category, on the given tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.plans.registry import query
from eventlake.plans.tables import with_view

# Money is summed as DECIMAL, so that the order of addition does not matter.
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"


def both(name: str, tables: str, text: str, spark_text: str | None = None) -> None:
    """Register a query whose SQL runs in both engines (or has a Spark spelling of its own)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with_view(spark, sf_dir, *tables.split())
        return spark.sql(spark_text or text)

    query(name, text)(run)


both(
    "sql_filter_project",
    "part",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'mid' ELSE 'small' END AS bucket
       FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_name LIKE '%ring%' AND p_size BETWEEN 5 AND 45""",
)
both(
    "sql_join_inner",
    "customer orders nation region",
    f"""SELECT r_name, n_name, count(*) AS n, CAST(sum({_TOTAL}) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)
both(
    "sql_join_left",
    "customer orders",
    """SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
both(
    "sql_join_right",
    "supplier nation",
    """SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
both(
    "sql_join_full",
    "supplier customer",
    """SELECT coalesce(s.k, c.k) AS k, s.n AS suppliers, c.n AS customers
       FROM (SELECT CAST(floor(s_acctbal) AS BIGINT) AS k, count(*) AS n FROM supplier GROUP BY 1) s
       FULL JOIN (SELECT CAST(floor(c_acctbal) AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1) c ON s.k = c.k""",
)
both(
    "sql_join_semi",
    "customer orders",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
both(
    "sql_join_anti",
    "part lineitem",
    """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""",
)
both(
    "sql_join_range",
    "events",
    """SELECT band, count(*) AS n FROM events JOIN (VALUES ('low', 0.0, 10.0), ('mid', 10.0, 100.0), ('high', 100.0, 1e9)) b(band, lo, hi)
       ON value >= lo AND value < hi GROUP BY band""",
)
both(
    "sql_agg_group",
    "lineitem",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_PRICE}) AS DOUBLE) AS price, min(l_discount) AS low,
        max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
)
both(
    "sql_agg_filter",
    "events",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS big,
       count(*) AS n FROM events GROUP BY user_id""",
)
both(
    "sql_agg_distinct",
    "events",
    """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type""",
)
both(
    "sql_agg_rollup",
    "orders",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
both(
    "sql_agg_cube",
    "part",
    """SELECT p_type, p_brand, count(*) AS n, max(p_size) AS top FROM part GROUP BY CUBE (p_type, p_brand)""",
)
both(
    "sql_agg_sets",
    "customer",
    """SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""",
)
both(
    "sql_agg_approx",
    "events",
    """SELECT count(*) AS n, approx_count_distinct(user_id) BETWEEN 0.85 * count(DISTINCT user_id) AND 1.15 * count(DISTINCT user_id) AS distinct_close,
       (SELECT count(*) FROM events WHERE value <= m) BETWEEN 0.48 * count(*) AND 0.52 * count(*) AS median_close
       FROM events, (SELECT approx_quantile(value, 0.5) AS m FROM events) GROUP BY m""",
    """SELECT count(*) AS n, approx_count_distinct(user_id) BETWEEN 0.85 * count(DISTINCT user_id) AND 1.15 * count(DISTINCT user_id) AS distinct_close,
       sum(CASE WHEN value <= m THEN 1 ELSE 0 END) BETWEEN 0.48 * count(*) AND 0.52 * count(*) AS median_close
       FROM events CROSS JOIN (SELECT percentile_approx(value, 0.5, 1000) AS m FROM events)""",
)
both(
    "sql_window_rank",
    "orders",
    """SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3""",
)
both(
    "sql_window_lag",
    "events",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(event_id) OVER w AS next FROM events
       WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)""",
)
both(
    "sql_window_frame",
    "events",
    """SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE)
       ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
both(
    "sql_sort_topk",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
both(
    "sql_setop_union",
    "customer supplier",
    """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT -1""",
)
both(
    "sql_setop_intersect",
    "customer supplier",
    """SELECT CAST(floor(c_acctbal) AS BIGINT) AS k FROM customer INTERSECT SELECT CAST(floor(s_acctbal) AS BIGINT) FROM supplier""",
)
both(
    "sql_setop_except",
    "part lineitem",
    """SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08""",
)
both(
    "sql_subquery_scalar",
    "customer",
    f"""SELECT c_custkey FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > (SELECT 1.5 * CAST(avg(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) FROM customer)""",
)
both(
    "sql_subquery_correlated",
    "orders customer",
    """SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
       AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
both(
    "sql_cte",
    "lineitem orders",
    f"""WITH big AS (SELECT l_orderkey, CAST(sum({_PRICE}) AS DOUBLE) AS price FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150),
        picked AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM big))
        SELECT o_orderpriority, count(*) AS n, max(price) AS top FROM picked JOIN big ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
)
both(
    "sql_lateral",
    "events",
    """SELECT event_id, twice, CASE WHEN twice > 100 THEN 'y' ELSE 'n' END AS high FROM events, LATERAL (SELECT value * 2 AS twice) t""",
)
both(
    "sql_unnest",
    "documents",
    """SELECT source, word, count(*) AS n FROM (SELECT source, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ('the', 'de', 'der', 'el')
       GROUP BY source, word""",
    """SELECT source, word, count(*) AS n FROM documents LATERAL VIEW explode(split(lower(text), ' ')) w AS word WHERE word IN ('the', 'de', 'der', 'el')
       GROUP BY source, word""",
)
both(
    "sql_json",
    "events",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""",
    """SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""",
)
both(
    "sql_arrays",
    "embeddings",
    """SELECT vec_id, len(embedding) AS size, list_max(embedding) > 0.3 AS peak, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings""",
    """SELECT vec_id, CAST(size(embedding) AS BIGINT) AS size, array_max(embedding) > 0.3 AS peak, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive
       FROM embeddings""",
)
both(
    "sql_strings",
    "customer",
    """SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS dashed,
       lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS code, trim(concat(' ', c_mktsegment, ' ')) AS segment FROM customer""",
    """SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS dashed,
       lpad(CAST(c_nationkey AS STRING), 3, '0') AS code, trim(concat(' ', c_mktsegment, ' ')) AS segment FROM customer""",
)
both(
    "sql_dates",
    "orders",
    """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n,
       sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 30 DAYS THEN 1 ELSE 0 END)::BIGINT AS late
       FROM orders GROUP BY 1, 2""",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n,
       CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00' - INTERVAL 30 DAYS THEN 1 ELSE 0 END) AS BIGINT) AS late
       FROM orders GROUP BY 1, 2""",
)
both(
    "sql_math",
    "lineitem",
    """SELECT l_linenumber, CAST(sum(CAST(floor(l_quantity / 7) AS BIGINT)) AS BIGINT) AS weeks, CAST(sum(abs(CAST(l_quantity AS BIGINT) - 25)) AS BIGINT) AS off,
       CAST(sum(CAST(l_orderkey % 10 AS BIGINT)) AS BIGINT) AS rest FROM lineitem GROUP BY l_linenumber""",
)
