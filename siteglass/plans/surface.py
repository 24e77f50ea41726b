"""The ad-hoc SQL surface: statements that engine and oracle run alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteglass.plans.sql import guard

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

STATEMENTS = {
    "sql_join_inner": "SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 4) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "sql_join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "sql_join_right": "SELECT n.n_nationkey, count(s.s_suppkey) AS suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
    "sql_join_full": "SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k",
    "sql_join_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_join_cross": "SELECT r.r_name, s.q FROM region r CROSS JOIN (SELECT DISTINCT o_orderstatus AS q FROM orders) s",
    "sql_join_multi": "SELECT r.r_name, n.n_name, count(*) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
    "sql_join_range": "SELECT b.lo, count(*) AS parts FROM part p JOIN (SELECT * FROM (VALUES (0, 10), (11, 25), (26, 50)) AS v(lo, hi)) b ON p.p_size BETWEEN b.lo AND b.hi GROUP BY b.lo",
    "sql_join_natural": "SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d USING (doc_id)",
    "sql_group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(avg(DISTINCT l_quantity), 6) AS quantity FROM lineitem GROUP BY l_returnflag",
    "sql_filter_aggregates": "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS large, round(sum(l_tax) FILTER (WHERE l_discount = 0), 6) AS tax FROM lineitem GROUP BY l_linestatus",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_cube": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS all_flags, grouping(l_linestatus) AS all_statuses, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "sql_grouping_sets": "SELECT event_type, user_id % 5 AS u, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())",
    "sql_window_rank": "SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "sql_window_share": "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
    "sql_window_lag": "SELECT event_id, lag(value) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after, first_value(event_id) OVER w AS opener, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM events",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS m FROM big) SELECT b.o_custkey, round(b.total / t.m, 6) AS share FROM big b, top t WHERE b.total > 0.5 * t.m",
    "sql_recursive_cte": "WITH RECURSIVE up(id, n) AS (SELECT CAST(1 AS BIGINT), 1 UNION ALL SELECT id * 2, n + 1 FROM up WHERE n < 20) SELECT id, n FROM up",
    "sql_union": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "sql_union_all": "SELECT 'c' AS kind, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 's', s_acctbal FROM supplier WHERE s_acctbal > 9000",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "sql_scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT 0.98 * max(p_retailprice) FROM part)",
    "sql_correlated_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.6 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_in_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
    "sql_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
    "sql_case_null": "SELECT l_returnflag, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS cheap, count(nullif(l_linestatus, 'O')) AS closed, coalesce(max(nullif(l_quantity, 50)), 0) AS most FROM lineitem GROUP BY l_returnflag",
    "sql_string_functions": "SELECT n_name, upper(n_name) AS u, length(n_name) AS n, substr(n_name, 2, 3) AS mid, replace(n_name, 'A', '-') AS r, n_name LIKE '%AN%' AS has_an FROM nation",
}


def tables_of(sql: str) -> list[str]:
    words = set(re.findall(r"\b\w+\b", sql))
    return [t for t in TABLES if t in words]


def runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables_of(sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(guard(sql))

    return run
