"""Counting, profiling and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import (
    SQL_CUSTOMERS,
    SQL_PANEL,
    SQL_PURCHASES,
    SQL_REGIONAL,
    SQL_SCORED,
    customer_facts,
    nation_panel,
    purchases,
    query,
    regional_orders,
    rnd,
    scored_orders,
)
from tallygrid.operators import summary
from tallygrid.operators.ordered import attach_scalars, exact_quantiles
from tallygrid.sources.files import load


@query("d1_table_shape", "SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def _(spark, d):
    return summary.table_shape(load(spark, d, "lineitem"))


@query("d2_count_by", f"WITH {SQL_REGIONAL} SELECT r_name, year, count(*)::BIGINT AS n FROM regional GROUP BY 1, 2")
def _(spark, d):
    return summary.count_by(regional_orders(spark, d), ["r_name", "year"])


@query("d3_value_counts", "SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*)::BIGINT AS count, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 8) AS pct FROM customer GROUP BY 1")
def _(spark, d):
    c = load(spark, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return rnd(summary.value_counts(c, "segment"), pct=8)


@query("d4_distinct_values", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 10")
def _(spark, d):
    return summary.distinct_values(load(spark, d, "part"), "p_brand", 10)


@query("d5_count_distinct", """WITH t AS (SELECT nullif(l_returnflag, 'N') AS flag, l_suppkey, l_quantity FROM lineitem)
SELECT 'flag' AS "column", (count(DISTINCT flag) + max(CASE WHEN flag IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_distinct FROM t UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey)::BIGINT FROM t UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity)::BIGINT FROM t""")
def _(spark, d):
    t = load(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_suppkey", "l_quantity")
    return summary.count_distinct(t, ["flag", "l_suppkey", "l_quantity"], dropna=False)


@query("d6_group_mean", f"WITH {SQL_PURCHASES} SELECT p_type, round(avg(l_quantity), 8) AS avg_l_quantity, round(avg(l_extendedprice), 6) AS avg_l_extendedprice FROM purchases GROUP BY 1")
def _(spark, d):
    return rnd(summary.group_mean(purchases(spark, d), ["p_type"], ["l_quantity", "l_extendedprice"]), avg_l_quantity=8, avg_l_extendedprice=6)


@query("d7_group_mean_sd", "SELECT p_type, p_brand, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean_p_retailprice, round(stddev_samp(p_retailprice), 6) AS sd_p_retailprice FROM part WHERE p_size > 10 GROUP BY 1, 2")
def _(spark, d):
    out = summary.group_mean_sd(load(spark, d, "part"), ["p_type", "p_brand"], ["p_retailprice"], F.col("p_size") > 10)
    return rnd(out, mean_p_retailprice=6, sd_p_retailprice=6)


@query("d8_brand_stats", f"""WITH {SQL_PURCHASES} SELECT p_brand, count(*)::BIGINT AS n_people, sum(l_quantity) AS total_qty, round(avg(l_quantity), 8) AS avg_qty,
 round(sum(l_extendedprice), 2) AS total_spend, round(avg(l_extendedprice), 6) AS avg_spend, round(sum(l_extendedprice) / sum(l_quantity), 6) AS spend_per_unit FROM purchases GROUP BY 1""")
def _(spark, d):
    items = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice")
    out = summary.brand_stats_joined(items, load(spark, d, "part"), "p_partkey", ["p_brand"], "l_quantity", "l_extendedprice")
    return rnd(out, avg_qty=8, total_spend=2, avg_spend=6, spend_per_unit=6)


@query("d8_heavy_brand_stats", f"""WITH {SQL_PURCHASES}, q AS (SELECT quantile_cont(l_quantity, 0.75) AS q75 FROM purchases) SELECT p_brand, count(*)::BIGINT AS n_people, sum(l_quantity) AS total_qty, round(avg(l_quantity), 8) AS avg_qty,
 round(sum(l_extendedprice), 2) AS total_spend, round(avg(l_extendedprice), 5) AS avg_spend, round(sum(l_extendedprice) / sum(l_quantity), 6) AS spend_per_unit FROM purchases, q WHERE l_quantity >= q75 GROUP BY 1""")
def _(spark, d):
    p = purchases(spark, d)
    marked = attach_scalars(p, exact_quantiles(load(spark, d, "lineitem"), ["l_quantity"], [0.75]), "edge")
    heavy = marked.filter(F.col("l_quantity") >= F.col("edge.q_l_quantity")[0])
    out = summary.brand_stats(heavy, ["p_brand"], "l_quantity", "l_extendedprice")
    return rnd(out, avg_qty=8, total_spend=2, avg_spend=5, spend_per_unit=6)


@query("d9_top_groups", f"WITH {SQL_REGIONAL} SELECT n_name, round(sum(o_totalprice), 2) AS total FROM regional GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return rnd(summary.top_groups(regional_orders(spark, d), "n_name", "o_totalprice", 5), total=2)


@query("d10_stat_summary", "SELECT count(o_totalprice)::BIGINT AS n, (count(o_totalprice) - 1)::BIGINT AS df, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(var_samp(o_totalprice), 0) AS var, round(stddev_samp(o_totalprice), 4) AS sd FROM orders")
def _(spark, d):
    return rnd(summary.stat_summary(load(spark, d, "orders"), "o_totalprice"), mean=4, median=4, var=0, sd=4)


_DESCRIBE = ' UNION ALL '.join(
    f"""SELECT '{c}' AS "column", count({c})::BIGINT AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 5) AS q25,
 round(quantile_cont({c}::DOUBLE, 0.5), 5) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 5) AS q75, max({c})::DOUBLE AS max{{extra}} FROM lineitem""".replace(
        "{extra}", "{" + f"{i}" + "}"
    )
    for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
)
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d11_describe", _DESCRIBE.format("", "", "", ""))
def _(spark, d):
    return rnd(summary.describe(load(spark, d, "lineitem"), _COLS), mean=5, std=5, q25=5, median=5, q75=5)


@query("d12_describe_extended", _DESCRIBE.format(*[f", round(stddev_samp({c}) / nullif(avg({c}), 0), 7) AS cv, round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 5) AS iqr" for c in _COLS]))
def _(spark, d):
    return rnd(summary.describe(load(spark, d, "lineitem"), _COLS, extended=True), mean=5, std=5, q25=5, median=5, q75=5, cv=7, iqr=5)


@query("d13_null_profile", """WITH t AS (SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN user_id > 50 THEN user_id END AS user_id, props FROM events)
SELECT 'event_id' AS "column", 'bigint' AS dtype, sum(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, count(event_id)::BIGINT AS non_nulls, (count(DISTINCT event_id) + max(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_distinct, round(100.0 - count(event_id) * 100.0 / count(*), 8) AS pct_null FROM t
UNION ALL SELECT 'event_type', 'string', sum(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END)::BIGINT, count(event_type)::BIGINT, (count(DISTINCT event_type) + max(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END))::BIGINT, round(100.0 - count(event_type) * 100.0 / count(*), 8) FROM t
UNION ALL SELECT 'user_id', 'bigint', sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END)::BIGINT, count(user_id)::BIGINT, (count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END))::BIGINT, round(100.0 - count(user_id) * 100.0 / count(*), 8) FROM t
UNION ALL SELECT 'props', 'string', sum(CASE WHEN props IS NULL THEN 1 ELSE 0 END)::BIGINT, count(props)::BIGINT, (count(DISTINCT props) + max(CASE WHEN props IS NULL THEN 1 ELSE 0 END))::BIGINT, round(100.0 - count(props) * 100.0 / count(*), 8) FROM t""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("user_id") > 50, F.col("user_id")).alias("user_id"), "props"
    )
    return rnd(summary.null_profile(t), pct_null=8)


@query("d14_profile_numbers_by", " UNION ALL ".join(
    f"""SELECT p_type, '{c}' AS variable, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, round(count(v) * 1.0::DOUBLE / count(*), 8) AS complete_rate, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
 round(quantile_cont(v, 0), 4) AS p0, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 1), 4) AS p100
 FROM (SELECT p_type, {e}::DOUBLE AS v FROM part) t GROUP BY 1""" for c, e in (("size", "nullif(p_size, 7)"), ("price", "p_retailprice"))))
def _(spark, d):
    p = load(spark, d, "part").select("p_type", F.nullif("p_size", F.lit(7)).alias("size"), F.col("p_retailprice").alias("price"))
    out = summary.profile_numbers_by(p, "p_type", ["size", "price"])
    return rnd(out, complete_rate=8, mean=6, sd=6, p0=4, p25=4, p50=4, p75=4, p100=4)


@query("d14_profile_categories_by", """WITH l AS (SELECT o_orderstatus, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, level) AS rn FROM l)
SELECT o_orderstatus, 'o_orderpriority' AS variable, 0::BIGINT AS n_missing, 1.0::DOUBLE AS complete_rate, count(DISTINCT level)::BIGINT AS n_distinct, string_agg(level || ': ' || n, ', ' ORDER BY rn) FILTER (rn <= 3) AS top_levels FROM r GROUP BY 1""")
def _(spark, d):
    return summary.profile_categories_by(load(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"])


@query("d15_pivot_mean", "SELECT p_brand, round(avg(p_size), 8) AS avg_p_size FROM part GROUP BY 1")
def _(spark, d):
    return rnd(summary.group_mean(load(spark, d, "part"), ["p_brand"], ["p_size"]), avg_p_size=8)


@query("d16_crosstab_pct", """SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS "A", round(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS "N", round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS "R" FROM lineitem GROUP BY 1""")
def _(spark, d):
    return rnd(summary.crosstab_pct(load(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"]), A=9, N=9, R=9)


@query("d17_confusion_table", f"WITH {SQL_SCORED} SELECT y, pred, count(*)::BIGINT AS n FROM scored GROUP BY 1, 2")
def _(spark, d):
    return summary.confusion_table(scored_orders(spark, d), "y", "pred")


@query("d18_quantiles", " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem GROUP BY 1" for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def _(spark, d):
    return rnd(summary.quantiles(load(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9], ["l_returnflag"]), value=4)


@query("d19_entity_medians", f"WITH {SQL_PANEL} SELECT n_name, round(median(x), 9) AS x, round(median(y), 9) AS y FROM panel GROUP BY 1")
def _(spark, d):
    return rnd(summary.entity_medians(nation_panel(spark, d), ["n_name"], ["x", "y"]), x=9, y=9)


@query("d20_cluster_summary", f"""WITH {SQL_CUSTOMERS} SELECT c_mktsegment, count(*)::BIGINT AS n, round(median(spend), 4) AS med_spend, round(quantile_cont(spend, 0.25), 4) AS p25_spend, round(quantile_cont(spend, 0.75), 4) AS p75_spend,
 round(median(acctbal), 4) AS med_acctbal, round(median(n_orders::DOUBLE), 4) AS med_n_orders FROM cust GROUP BY 1""")
def _(spark, d):
    out = summary.cluster_summary(customer_facts(spark, d), "c_mktsegment", "spend", ["acctbal", "n_orders"])
    return rnd(out, med_spend=4, p25_spend=4, p75_spend=4, med_acctbal=4, med_n_orders=4)


@query("d21_basket_totals", """WITH t AS (SELECT l_orderkey AS basket, l_partkey, l_suppkey, (l_quantity / 4)::DECIMAL(18,4) AS q, l_extendedprice::DECIMAL(18,4) AS p FROM lineitem),
u AS (SELECT *, CASE WHEN q < 1 THEN 1 ELSE floor(q) END::DECIMAL(18,0) AS pieces FROM t)
SELECT basket, count(*)::BIGINT AS n_rows, round(sum(q * p), 2)::DOUBLE AS total_value, sum(pieces)::BIGINT AS units, round(sum(pieces * p), 2)::DOUBLE AS total_by_units,
 (array_agg(l_partkey ORDER BY p DESC, l_partkey))[1] AS dearest, max(p)::DOUBLE AS dearest_price FROM u GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey", (F.col("l_quantity") / 4).alias("q"), "l_extendedprice")
    out = summary.basket_totals(t, "l_partkey", "q", "l_extendedprice", "l_partkey", ["basket"])
    return out.withColumns(
        {
            "total_value": F.round("total_value", 2).cast("double"),
            "total_by_units": F.round("total_by_units", 2).cast("double"),
            "dearest_price": F.col("dearest_price").cast("double"),
        }
    )


@query("d22_arg_max", """WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderpriority, o_orderkey, o_totalprice FROM r WHERE rn = 1""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return summary.arg_max(o, "o_orderkey", "o_totalprice", "o_orderkey", ["o_orderpriority"])


@query("d23_baseline_error", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS rn, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM c)
SELECT o_orderpriority, o_orderstatus AS majority, n::BIGINT AS n, round((1 - n / total)::DOUBLE, 9) AS error FROM r WHERE rn = 1""")
def _(spark, d):
    return rnd(summary.majority_class(load(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"]), error=9)


@query("d24_discrepancy_rate", """WITH b AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
SELECT count(*)::BIGINT AS n_units, round(avg(CASE WHEN abs(total - o_totalprice) / nullif(o_totalprice, 0) > 0.1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS pct_discrepant FROM orders JOIN b ON o_orderkey = l_orderkey""")
def _(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    b = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"))
    return rnd(summary.discrepancy_rate(a, b, ["k"], "total"), pct_discrepant=8)


@query("d25_level_and_spread", "SELECT 'customer' AS source, count(*)::BIGINT AS n, round(avg(c_acctbal), 6) AS mean_acctbal, round(stddev_samp(c_acctbal), 6) AS sd_acctbal FROM customer UNION ALL SELECT 'supplier', count(*)::BIGINT, round(avg(s_acctbal), 6), round(stddev_samp(s_acctbal), 6) FROM supplier")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_acctbal").alias("acctbal"))
    s = load(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"))
    return rnd(summary.level_and_spread({"customer": c, "supplier": s}, ["acctbal"]), mean_acctbal=6, sd_acctbal=6)


@query("d26_histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem), b AS (SELECT i, lo + i * ((hi - lo) / 20) AS a, lo + (i + 1) * ((hi - lo) / 20) AS z FROM range(20) t(i), e), c AS (SELECT i AS bin, count(*) AS k FROM lineitem, b WHERE l_extendedprice >= a AND (l_extendedprice < z OR i = 19) GROUP BY 1)
SELECT i AS bin, round(lo + i * ((hi - lo) / 20), 6) AS lo, round(lo + (i + 1) * ((hi - lo) / 20), 6) AS hi, coalesce(k, 0)::BIGINT AS count, round(coalesce(k, 0) / (n * ((hi - lo) / 20)), 12) AS density FROM range(20) t(i) LEFT JOIN c ON bin = i, e""")
def _(spark, d):
    return rnd(summary.histogram(load(spark, d, "lineitem"), "l_extendedprice", 20), lo=6, hi=6, density=12)


@query("d26_histogram_whole_numbers", """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem), b AS (SELECT i, lo + i * ((hi - lo) / 49) AS a, lo + (i + 1) * ((hi - lo) / 49) AS z FROM range(49) t(i), e), c AS (SELECT i AS bin, count(*) AS k FROM lineitem, b WHERE l_quantity >= a AND (l_quantity < z OR i = 48) GROUP BY 1)
SELECT i AS bin, coalesce(k, 0)::BIGINT AS count FROM range(49) t(i) LEFT JOIN c ON bin = i""")
def _(spark, d):
    return summary.histogram(load(spark, d, "lineitem"), "l_quantity", 49).select("bin", "count")


@query("d27_box_stats", """WITH q AS (SELECT o_orderstatus AS g, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS md, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY 1)
SELECT o_orderstatus, count(*)::BIGINT AS n, round(max(q25), 4) AS q25, round(max(md), 4) AS median, round(max(q75), 4) AS q75,
 round(min(o_totalprice) FILTER (o_totalprice BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25)), 4) AS whisker_low, round(max(o_totalprice) FILTER (o_totalprice BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25)), 4) AS whisker_high,
 (count(*) FILTER (o_totalprice NOT BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25)))::BIGINT AS n_outliers FROM orders JOIN q ON o_orderstatus = g GROUP BY 1""")
def _(spark, d):
    return rnd(summary.box_stats(load(spark, d, "orders"), "o_orderstatus", "o_totalprice"), q25=4, median=4, q75=4, whisker_low=4, whisker_high=4)


@query("d28_kde", """WITH f AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, stddev_samp(l_quantity) AS sd FROM lineitem),
g AS (SELECT i, lo - 0.5 * (hi - lo) + i * (4 * (0.5 * (hi - lo)) / 199) AS x, n, pow(n::DOUBLE, -0.2::DOUBLE) * sd AS h FROM range(200) t(i), f), v AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1)
SELECT i::INTEGER AS i, round(max(x), 8) AS x, round(sum(exp(-0.5::DOUBLE * ((x - v) / h) * ((x - v) / h)) * c / (h * n * sqrt(2 * pi()))), 10) AS density FROM g, v GROUP BY 1""")
def _(spark, d):
    return rnd(summary.kde(load(spark, d, "lineitem"), "l_quantity", 200), x=8, density=10)


@query("d29_row_sums", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS row_sum FROM embeddings")
def _(spark, d):
    return rnd(summary.row_sums(load(spark, d, "embeddings"), "embedding").select("vec_id", "row_sum"), row_sum=6)


@query("d30_limits", "SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders")
def _(spark, d):
    return summary.limits(load(spark, d, "orders"), ["o_totalprice", "o_orderkey"])



