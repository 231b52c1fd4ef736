"""One golden query per shape that evaluation items exercise, over the star schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stats import exact_quantiles

Tables = Mapping[str, DataFrame]
_MONEY = "decimal(18,2)"


def _money(c: str):
    return F.col(c).cast(_MONEY)


def _revenue():
    return _money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))


def _double(c, name: str):
    return c.cast("double").alias(name)


def aggregation(t: Tables) -> DataFrame:
    """Sums per return flag and line status."""
    return t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        _double(F.sum(_money("l_extendedprice")), "sum_price"),
        _double(F.sum(_revenue()), "sum_revenue"),
        F.count("*").alias("n"),
    )


def multi_condition(t: Tables) -> DataFrame:
    """Lines within a literal date range, discount range and quantity bound."""
    return (
        t["lineitem"]
        .where(
            (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
            & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
            & F.col("l_discount").between(0.03, 0.07)
            & (F.col("l_quantity") < 24)
        )
        .agg(F.count("*").alias("n"), _double(F.sum(_money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")), "saved"))
    )


def time_series(t: Tables) -> DataFrame:
    """Orders and spend per month."""
    return t["orders"].groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(
        F.count("*").alias("n_orders"), _double(F.sum(_money("o_totalprice")), "spend")
    )


def ranking(t: Tables, n: int = 10) -> DataFrame:
    """Top customers by spend, ties by key, with a condition on another aggregate."""
    return (
        t["orders"].groupBy("o_custkey")
        .agg(F.sum(_money("o_totalprice")).alias("s"), F.count("*").alias("n_orders"))
        .where(F.col("n_orders") >= 5)
        .orderBy(F.desc("s"), "o_custkey").limit(n)
        .select("o_custkey", _double(F.col("s"), "spend"), "n_orders")
    )


def distinct_count(t: Tables) -> DataFrame:
    """Distinct users per event type: of the buyers' cohort and overall.

    Users are made distinct first, so the counts run on one row per user and type.
    """
    per = t["events"].groupBy("event_type", "user_id").agg(F.max("value").alias("top"))
    return per.groupBy("event_type").agg(F.count("*").alias("n_users"), F.count_if(F.col("top") >= 100).alias("n_big_users"))


def distinct_count_approx(t: Tables) -> DataFrame:
    return t["events"].groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("n_users"),
        F.approx_count_distinct(F.when(F.col("value") >= 100, F.col("user_id"))).alias("n_big_users"),
    )


def ratio_or_delta(t: Tables) -> DataFrame:
    """Spend per priority and month: share of all spend, and change on the month before."""
    orders = t["orders"]
    total = orders.agg(F.sum(_money("o_totalprice")).alias("total"))
    monthly = orders.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(
        F.sum(_money("o_totalprice")).alias("s")
    )
    before = F.lag("s").over(Window.partitionBy("o_orderpriority").orderBy("month"))
    return monthly.select(
        "o_orderpriority", "month",
        _double(F.col("s"), "spend"),
        F.round(F.lit(100.0) * F.col("s").cast("double") / total.scalar().cast("double"), 6).alias("pct"),
        _double(F.col("s") - before, "delta"),
    )


def windowed(t: Tables) -> DataFrame:
    """Six window functions over nations within each market segment, on aggregated rows."""
    spend = (
        t["orders"].groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("s"))
        .join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
        .groupBy("c_mktsegment", "c_nationkey").agg(F.sum("s").alias("s"))
    )
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("s"), "c_nationkey")
    return spend.select(
        "c_mktsegment", "c_nationkey", _double(F.col("s"), "spend"),
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.rank().over(w).cast("bigint").alias("rk"),
        F.dense_rank().over(w).cast("bigint").alias("drk"),
        F.ntile(4).over(w).cast("bigint").alias("quarter"),
        _double(F.lag("s").over(w), "prev_spend"),
        _double(F.lead("s").over(w), "next_spend"),
    )


def percentile(t: Tables) -> DataFrame:
    """Exact median and 90th percentile of order value per priority."""
    # a coarse sketch is enough: the bracket is searched exactly
    p = exact_quantiles(t["orders"], "o_totalprice", {"p50": 0.5, "p90": 0.9}, ["o_orderpriority"], accuracy=100)
    return p.select("o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


def percentile_approx(t: Tables) -> DataFrame:
    return t["orders"].groupBy("o_orderpriority").agg(
        F.percentile_approx("o_totalprice", [0.5, 0.9], 10_000).alias("p")
    ).select("o_orderpriority", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


def self_join(t: Tables) -> DataFrame:
    """Users active in a week and again in the next; one row per user and week before the join."""
    weeks = t["events"].select("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).distinct()
    again = weeks.select("user_id", F.date_add("week", -7).alias("week"), F.lit(1).alias("back"))
    return weeks.join(again, ["user_id", "week"], "left").groupBy("week").agg(
        F.count("*").alias("active"), F.count("back").alias("retained")
    )


def semi_anti(t: Tables) -> DataFrame:
    """Customers with an order, but none pending, per segment."""
    orders = t["orders"]
    keys = lambda df: df.select(F.col("o_custkey").alias("c_custkey"))
    return (
        t["customer"].join(keys(orders), "c_custkey", "left_semi")
        .join(keys(orders.where(F.col("o_orderstatus") == "P")), "c_custkey", "left_anti")
        .groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    )


def conditional(t: Tables) -> DataFrame:
    """Several branches of a condition inside one aggregation."""
    v, k = F.col("value"), F.col("event_type")
    return t["events"].groupBy("event_type").agg(
        F.sum(F.when(v < 5, 1).when(v < 50, 2).otherwise(3)).cast("bigint").alias("weight"),
        F.count_if((k == "purchase") & (v >= 50)).alias("n_big_purchases"),
        F.count_if(v < 5).alias("n_small"),
    )


def with_cte(t: Tables) -> DataFrame:
    """Nations whose mean spend per customer exceeds the mean over all customers."""
    per = (
        t["orders"].groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("s"))
        .join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    )
    overall = per.agg((F.sum("s").cast("double") / F.count("*")).alias("m"))
    return (
        per.groupBy("c_nationkey").agg((F.sum("s").cast("double") / F.count("*")).alias("m"), F.count("*").alias("n_customers"))
        .where(F.col("m") > overall.scalar())
        .select("c_nationkey", F.round("m", 4).alias("mean_spend"), "n_customers")
    )


def pivot_table(t: Tables) -> DataFrame:
    """Orders per priority with a column per status; the values are given, so no extra pass finds them."""
    return (
        t["orders"].groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
        .select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s.lower()}") for s in "FOP"])
    )


def lateral_explode(t: Tables) -> DataFrame:
    """Lines and their characters per language, every document split whole."""
    return (
        t["documents"].select("lang", F.explode(F.split("text", "\n")).alias("line"))
        .groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"), F.max(F.length("line")).cast("bigint").alias("longest"))
    )


def funnel(t: Tables) -> DataFrame:
    """Users who view, then click, then purchase, in this order of first times."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(k)
    u = t["events"].groupBy("user_id").agg(first("view"), first("click"), first("purchase"))
    clicked = F.col("click") > F.col("view")
    return u.agg(
        F.count("view").alias("n_view"),
        F.count_if(clicked).alias("n_click"),
        F.count_if(clicked & (F.col("purchase") > F.col("click"))).alias("n_purchase"),
    )
