"""Filters, joins, aggregates, set operations and top-k over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.membership import not_in
from tessera.operators.running import exact_percentiles
from tessera.plans.base import Registry, cents, total
from tessera.sources.tables import table

registry = Registry()
query = registry.query

REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))"


def _revenue():
    return cents("l_extendedprice") * (1 - cents("l_discount"))


@query("""
    SELECT l_returnflag, l_linestatus,
      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
      round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE), 2) AS sum_disc_price,
      round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-08-01'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        total(cents("l_quantity")).alias("sum_qty"),
        total(cents("l_extendedprice")).alias("sum_base_price"),
        F.round(total(_revenue()), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query(f"""
    SELECT l_orderkey, round(CAST(sum({REVENUE}) AS DOUBLE), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "timestamp_ntz'1998-03-15'"
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where(f"o_orderdate < {day}").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").where(f"l_shipdate > {day}").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    summed = joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(total(_revenue()), 2).alias("revenue"))
    return summed.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(f"""
    SELECT n_name, round(CAST(sum({REVENUE}) AS DOUBLE), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name""")
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1999-01-01'")
    buyers = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.round(total(_revenue()), 2).alias("revenue"))


@query("""
    SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01' and l_discount between 0.05d and 0.07d and l_quantity < 24")
    return lines.agg(F.round(total(cents("l_extendedprice") * cents("l_discount")), 2).alias("revenue"))


@query(f"""
    SELECT round(100.0 * CAST(sum(CASE WHEN p_type = 'PROMO' THEN {REVENUE} ELSE 0 END) AS DOUBLE) / CAST(sum({REVENUE}) AS DOUBLE), 6) AS promo_share
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def promotion_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_discount")
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    promo = F.when(F.col("p_type") == "PROMO", _revenue()).otherwise(F.lit(0))
    return joined.agg(F.round(F.lit(100.0) * total(promo) / total(_revenue()), 6).alias("promo_share"))


@query(f"""
    SELECT c_custkey, c_name, round(CAST(sum({REVENUE}) AS DOUBLE), 2) AS revenue, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'
    GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def returned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1997-07-01'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    sums = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(total(_revenue()), 2).alias("revenue"))
    named = sums.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", "c_name", "revenue", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query(f"""
    WITH r AS (SELECT l_suppkey, sum({REVENUE}) AS t FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
    SELECT s_suppkey, s_name, round(CAST(t AS DOUBLE), 2) AS total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE t = (SELECT max(t) FROM r)""")
def top_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-04-01'")
    sums = lines.groupBy("l_suppkey").agg(F.sum(_revenue()).alias("t"))
    best = sums.agg(F.max("t").alias("best"))
    top = sums.join(F.broadcast(best), F.col("t") == F.col("best"))  # one row
    named = table(spark, sf_dir, "supplier").join(top, F.col("s_suppkey") == F.col("l_suppkey"))
    return named.select("s_suppkey", "s_name", F.round(F.col("t").cast("double"), 2).alias("total_revenue"))


@query("""
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY ALL HAVING sum(l_quantity) > 250 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total(cents("l_quantity")).alias("quantity")).where("quantity > 250")
    joined = big.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"), "quantity").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# joins of every kind


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("SELECT o_orderkey, s.n AS n_lines FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s RIGHT JOIN orders ON l_orderkey = o_orderkey")
def right_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return counts.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "right").select("o_orderkey", "n_lines")


@query("""
    SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 4 GROUP BY 1) b ON a.k = b.k""")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").select(F.col("k").alias("nationkey"), "customers", "suppliers")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 49 THEN l_partkey ELSE -1 END FROM lineitem)")
def null_aware_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct members are shuffled, not broadcast."""
    member = F.when(F.col("l_quantity") > 49, F.col("l_partkey")).otherwise(-1)
    return not_in(table(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey"), table(spark, sf_dir, "lineitem"), member)


@query("SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a CROSS JOIN region b WHERE a.n_nationkey % 5 <> b.r_regionkey")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.crossJoin(regions).where("n_nationkey % 5 <> r_regionkey").select(F.col("n_name").alias("a_name"), F.col("r_name").alias("b_name"))


@query("SELECT a.s_suppkey AS low, count(*) AS above FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal GROUP BY 1")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier, how many have a higher balance: ranks, not pairs."""
    from tessera.operators.running import rows_above

    return rows_above(table(spark, sf_dir, "supplier"), "s_acctbal", "above").where("above > 0").select(F.col("s_suppkey").alias("low"), "above")


@query("SELECT n.n_name AS nation, t.c_custkey, t.c_acctbal FROM nation n, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("_lateral_nation")
    table(spark, sf_dir, "customer").createOrReplaceTempView("_lateral_customer")
    return spark.sql("""
        SELECT n.n_name AS nation, t.c_custkey, t.c_acctbal FROM _lateral_nation n,
        LATERAL (SELECT c_custkey, c_acctbal FROM _lateral_customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t""")


@query("""
    SELECT p_partkey FROM part WHERE p_retailprice > (SELECT 1.02 * avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = part.p_brand)""")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    means = parts.groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("mean"))
    return parts.join(means, F.col("p_brand") == F.col("brand")).where("p_retailprice > 1.02d * mean").select("p_partkey")


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM lineitem JOIN events ON l_suppkey = user_id % 40 WHERE event_type = 'purchase' GROUP BY 1")
def skewed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A many-to-many join on few keys: both sides are summed up before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(cents("l_quantity")).alias("q"))
    keys = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy((F.col("user_id") % 40).alias("k")).agg(F.count("*").alias("n"))
    return lines.join(keys, F.col("l_suppkey") == F.col("k")).select("l_suppkey", (F.col("q") * F.col("n")).cast("double").alias("quantity"))


_URGENCY = "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 GROUP BY 1"


def _hinted(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.hint(hint).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(_URGENCY)
def sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir, "merge")


@query(_URGENCY)
def shuffled_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task holds its part of the hinted side; for sides whose parts fit, and that have no hot key."""
    return _hinted(spark, sf_dir, "shuffle_hash")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def cartesian_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy that compares all pairs, by hint, between the two tables that never grow."""
    nations = table(spark, sf_dir, "nation").hint("shuffle_replicate_nl")
    return nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


# aggregates


@query("SELECT c_nationkey, min(c_name) AS first_name, max(c_mktsegment) AS last_segment FROM customer GROUP BY 1")
def sort_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of strings, which no hash aggregate holds."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("first_name"), F.max("c_mktsegment").alias("last_segment"))


@query("""
    SELECT c_nationkey, (SELECT s FROM (SELECT c2.c_mktsegment AS s, count(*) AS n FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey GROUP BY 1) ORDER BY n DESC, s LIMIT 1) AS most_common,
      string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer c GROUP BY 1""")
def mode_and_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, the least of several, and distinct values in order as text."""
    segments = F.expr("listagg(distinct c_mktsegment, '|') within group (order by c_mktsegment)")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.mode("c_mktsegment", True).alias("most_common"), segments.alias("segments"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS theta_close, true AS union_close, true AS kll_close FROM events GROUP BY 1")
def sketches_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta and KLL sketches beside exact counts and places, and whether they agree within their error bounds."""
    events = table(spark, sf_dir, "events")
    parts = events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.theta_sketch_agg("user_id").alias("theta"), F.kll_sketch_agg_double("value").alias("kll")
    ).join(exact_percentiles(events, "event_type", "value", {"low": 0.47, "high": 0.53}), "event_type")
    whole = events.agg(F.count_distinct("user_id").alias("all_users"))
    union = parts.agg(F.theta_union_agg("theta").alias("both"))
    close = lambda got, want, part: F.abs(got / want - 1) <= part
    one = whole.crossJoin(union).select(close(F.theta_sketch_estimate("both"), F.col("all_users"), 0.1).alias("union_close"))  # one row
    held = parts.select("event_type", "users", close(F.theta_sketch_estimate("theta"), F.col("users"), 0.1).alias("theta_close"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).between(F.col("low"), F.col("high")).alias("kll_close"))
    return held.crossJoin(F.broadcast(one))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), total(cents("o_totalprice")).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high, min(value) AS lo, max(value) AS hi,
      round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var, round(median(value), 6) AS mid, bool_or(value > 99) AS any_high, bool_and(value >= 0) AS all_low
    FROM events GROUP BY event_type""")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sums = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_pop("value"), 6).alias("var"),
        F.bool_or(F.col("value") > 99).alias("any_high"), F.bool_and(F.col("value") >= 0).alias("all_low"),
    )
    mids = exact_percentiles(events, "event_type", "value", {"mid": 0.5})
    return sums.join(mids.withColumn("mid", F.round("mid", 6)), "event_type", "left")


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS p25, round(corr(value, user_id), 6) AS r, round(regr_slope(value, user_id), 6) AS slope, round(covar_samp(value, user_id), 4) AS cov FROM events GROUP BY 1")
def percentiles_and_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    fits = events.groupBy("event_type").agg(
        F.round(F.corr("value", "user_id"), 6).alias("r"), F.round(F.regr_slope("value", "user_id"), 6).alias("slope"), F.round(F.covar_samp("value", "user_id"), 4).alias("cov")
    )
    places = exact_percentiles(events, "event_type", "value", {"p90": 0.9, "p25": 0.25})
    return fits.join(places.select("event_type", F.round("p90", 6).alias("p90"), F.round("p25", 6).alias("p25")), "event_type", "left")


@query("SELECT user_id, max_by(event_type, ts) AS last_type, min_by(event_type, ts) AS first_type, count(*) AS n FROM events GROUP BY user_id")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.min_by("event_type", "ts").alias("first_type"), F.count("*").alias("n"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def list_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    return grouped.select("n_regionkey", F.array_join("names", ",").alias("names"), "keys")


@query("""
    SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders GROUP BY 1""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).cast("long").alias("urgent"), F.coalesce("5-LOW", F.lit(0)).cast("long").alias("low"))


@query("SELECT s_suppkey, 'nation' AS what, CAST(s_nationkey AS DOUBLE) AS amount FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return suppliers.unpivot("s_suppkey", ["nation", "balance"], "what", "amount")


@query()
def approximate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog and quantile sketches per type, and their union; tests hold them to their error bounds."""
    events = table(spark, sf_dir, "events")
    parts = events.groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("s"), F.approx_count_distinct("event_id").alias("ids"), F.percentile_approx("value", 0.5, 10000).alias("mid"))
    whole = parts.agg(F.lit("all").alias("event_type"), F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"), F.sum("ids").alias("ids"), F.lit(None).cast("double").alias("mid"))
    return parts.select("event_type", F.hll_sketch_estimate("s").alias("users"), "ids", "mid").unionByName(whole)


@query("SELECT width_bucket AS bucket, count(*) AS n FROM (SELECT CAST(least(floor(value / 10), 9) AS BIGINT) AS width_bucket FROM events) GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("long")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


# sets, sorts and limits


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).alias("k"))


_A, _B = "SELECT n_regionkey AS k FROM nation", "SELECT s_nationkey % 7 AS k FROM supplier"


@query(f"{_A} UNION {_B}")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b)


@query(f"{_A} INTERSECT {_B}")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_B} EXCEPT {_A}")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return b.subtract(a)


@query(f"{_B} EXCEPT ALL {_A}")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return b.exceptAll(a)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(5).limit(25)


@query("""
    SELECT * FROM (SELECT 'first' AS side, o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status ASC NULLS FIRST, o_orderkey LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'last' AS side, o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 30)""")
def nulls_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    first = rows.orderBy(F.asc_nulls_first("status"), "o_orderkey").limit(20)
    last = rows.orderBy(F.desc_nulls_last("status"), "o_orderkey").limit(30)
    return first.select(F.lit("first").alias("side"), "o_orderkey", "status").unionByName(last.select(F.lit("last").alias("side"), "o_orderkey", "status"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
