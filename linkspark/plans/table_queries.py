"""The relational operators that record linkage is made of, on the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("scan_parquet", "SELECT n_nationkey, n_name FROM nation")
def _scan(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("distinct_sorted", "SELECT DISTINCT c_mktsegment AS segment FROM customer ORDER BY segment")
def _distinct_sorted(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct().orderBy("segment")


@query("values_insert", "SELECT v.k, v.name, count(n.n_nationkey) AS n FROM (VALUES (0, 'a'), (1, 'b'), (9, 'c')) v(k, name) LEFT JOIN nation n ON n.n_regionkey = v.k GROUP BY v.k, v.name")
def _values(spark, d):
    values = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k int, name string")
    return values.join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("k"), "left").groupBy("k", "name").agg(F.count("n_nationkey").alias("n"))


@query("project_computed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, lower(c_mktsegment) || '-' || c_nationkey AS tag FROM customer")
def _project(spark, d):
    return table(spark, d, "customer").withColumn("tag", F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string")))


@query("filter_param", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def _filter(spark, d, priority="1-URGENT"):
    return table(spark, d, "orders").filter(F.col("o_orderpriority") == F.lit(priority)).select("o_orderkey", "o_totalprice")


@query("regex_filter", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[5-9]$') AND NOT regexp_matches(c_name, '00[0-9]$')")
def _regex(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").rlike("[5-9]$") & ~F.col("c_name").rlike("00[0-9]$")).select("c_custkey", "c_name")


@query("in_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 7)")
def _in_list(spark, d):
    return table(spark, d, "supplier").filter(F.col("s_nationkey").isin(1, 3, 7)).select("s_suppkey", "s_name")


@query("semi_filter", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _semi_filter(spark, d):
    keys = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left_semi")


@query("anti_filter", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _anti_filter(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("case_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 100000 THEN 2.0 ELSE 0 END::DOUBLE AS bonus FROM orders")
def _case(spark, d):
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.element_at(names, F.col("o_orderstatus")), "o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, 2.0).otherwise(0.0).alias("bonus"))


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_using", "SELECT k, seg, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY ALL) a JOIN (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL) b USING (k, seg)")
def _using(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return c.groupBy("k", "seg").agg(F.count("*").alias("n_a")).join(c.filter("c_acctbal > 0").groupBy("k", "seg").agg(F.count("*").alias("n_b")), ["k", "seg"])


@query("join_residual", "SELECT l_orderkey, l_linenumber, d.df FROM lineitem l JOIN (SELECT l_partkey AS k, count(*) AS df FROM lineitem GROUP BY 1) d ON l.l_partkey = d.k AND d.df BETWEEN 20 AND 30")
def _residual(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(lines.groupBy("l_partkey").agg(F.count("*").alias("df")).filter(F.col("df").between(20, 30)), "l_partkey").select("l_orderkey", "l_linenumber", "df")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _left(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("anti_join_null", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
def _anti_null(spark, d):
    part = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(part, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("anti_join_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def _anti_exists(spark, d):
    large = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(large, "p_partkey", "left_anti")


@query("semi_join", "SELECT DISTINCT o_custkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def _semi(spark, d):
    pool = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(pool, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_custkey").distinct()


@query("coverage", "SELECT count(*) AS n, count(o_orderkey) AS n_with FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _coverage(spark, d):
    return _left(spark, d).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("n_with"))


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <= 8")
def _having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n <= 8")


@query("cond_sum", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f FROM lineitem GROUP BY l_returnflag")
def _cond_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("n_f"))


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def _count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n"))


@query("distinct_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("topk_per_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 3")
def _topk(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(order).cast("long")).filter("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("lag_lead_k", "SELECT o_orderkey, " + ", ".join(f"lag(o_orderkey, {k}) OVER w AS lag{k}, lead(o_orderkey, {k}) OVER w AS lead{k}" for k in range(1, 4)) + " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", *[f("o_orderkey", k).over(w).alias(f"{n}{k}") for k in range(1, 4) for n, f in (("lag", F.lag), ("lead", F.lead))])


@query("order_by", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _order(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")


@query("limit_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _limit(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("union_all", "SELECT c_custkey AS k, 'c' AS typ FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def _union(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("typ")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("typ")))


@query("set_diff", "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem")
def _diff(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_partkey").alias("k")).distinct().join(lines.select(F.col("l_suppkey").alias("k")), "k", "left_anti")


@query("set_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem")
def _intersect(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_partkey").alias("k")).distinct().join(lines.select(F.col("l_suppkey").alias("k")), "k", "left_semi")
