"""Relational categories of SURVEY 2.O on the star-schema tables, each as the planner of this engine would write it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators.metrics import last_of
from pagemill.plans.registry import query, table

R = lambda c, n=2: F.round(c, n).alias(c)
MONEY = "decimal(18,4)"


def money(c):
    """Exact sums: doubles to decimals before adding, so that the order of rows does not matter."""
    return F.round(c, 4).cast(MONEY)


@query("SELECT n_name, count(*) AS n_orders, sum(round(o_totalprice, 4)::DECIMAL(18,4))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def rel_inner_join(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    # orders are added up per customer before they meet the customers
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("t"))
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.sum("t").cast("double").alias("total"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(last_priority, 'none') AS last_priority FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def rel_left_join_default(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    return table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("p", F.lit("none")).alias("last_priority"))


@query("WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT coalesce(s.k, c.k) AS nation, suppliers, customers FROM s FULL JOIN c ON s.k = c.k")
def rel_full_join(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "nation", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_semi_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name, r_regionkey = n_regionkey AS own FROM region CROSS JOIN nation")
def rel_grid(spark, d):
    """The full grid of two dimension tables of fixed size (a stated query set)."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


@query("SELECT a.l_orderkey, a.l_linenumber AS first_line, b.l_linenumber AS later_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_shipdate > b.l_shipdate AND a.l_returnflag = 'R'")
def rel_theta_join(spark, d):
    """Equality on the order, inequality as the residual: a shuffled hash or merge join, never a nested loop."""
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("first_line"), F.col("l_shipdate").alias("x"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("later_line"), F.col("l_shipdate").alias("y"))
    return a.join(b, "l_orderkey").where("first_line < later_line and x > y").select("l_orderkey", "first_line", "later_line")


@query("SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS status, count(*) AS n, sum(round(l_quantity, 4)::DECIMAL(18,4))::DOUBLE AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rel_rollup(spark, d):
    g = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").alias("a"), F.grouping("l_linestatus").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).cast("double").alias("quantity"))
    return g.select(F.when(F.col("a") == 1, "all").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("b") == 1, "all").otherwise(F.col("l_linestatus")).alias("status"), "n", "quantity")


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark, d):
    g = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").alias("a"), F.grouping("o_orderpriority").alias("b"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return g.select(F.when(F.col("a") == 1, "all").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("b") == 1, "all").otherwise(F.col("o_orderpriority")).alias("priority"), "n", "most")


@query("SELECT DISTINCT nation FROM (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rel_intersect(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"))
    return s.intersect(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey"))


@query("SELECT p_brand, p_size FROM part WHERE p_retailprice > 1000 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_size > 25")
def rel_except_all(spark, d):
    p = table(spark, d, "part")
    return p.where("p_retailprice > 1000").select("p_brand", "p_size").exceptAll(p.where("p_size > 25").select("p_brand", "p_size"))


@query("SELECT kind, nation, count(*) AS n FROM (SELECT 'supplier' AS kind, s_nationkey AS nation FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer) GROUP BY kind, nation")
def rel_union(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def rel_group_top_n(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(order)).where("place <= 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_type) OVER w AS first, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rel_window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return e.select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.first("event_type").over(w).alias("first"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("recent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def rel_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) is not null").alias("valid"))


@query("SELECT c_mktsegment, list(DISTINCT c_nationkey ORDER BY c_nationkey) AS nations, len(list(DISTINCT c_nationkey)) AS n FROM customer GROUP BY c_mktsegment")
def rel_arrays(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).alias("nations"), F.count_distinct("c_nationkey").alias("n"))


@query("SELECT item_id, CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN reverse(text) ELSE 'none' END AS chosen FROM benchmark")
def rel_option_map(spark, d):
    b = table(spark, d, "benchmark")
    options = F.map_concat(F.create_map(F.lit("A"), F.col("text")), F.create_map(F.lit("B"), F.reverse("text")))
    letter = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("item_id") % 6 + 1).cast("int"))
    return b.select("item_id", F.coalesce(F.try_element_at(options, letter), F.lit("none")).alias("chosen"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def rel_last_wins(spark, d):
    return last_of(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
def rel_aggregates(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R_("mean", F.avg("value")), R_("median", F.percentile("value", F.lit(0.5))), F.max("value").alias("most"), F.count_if(F.col("value") > 50).alias("high"))


def R_(name, c):
    return F.round(c, 6).alias(name)


@query("SELECT c_custkey, greatest(coalesce(try_cast(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS INTEGER), 1), 1) AS n FROM customer")
def rel_default_casts(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.int_or(F.regexp_replace("c_name", "[^0-9]", ""), 1, 1).alias("n"))
