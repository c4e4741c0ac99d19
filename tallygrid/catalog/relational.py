"""Sources, projections, joins, windows, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
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
from tallygrid.operators import frames, joins, nearest, sets, topk, windows
from tallygrid.session import shared_path
from tallygrid.sources import files
from tallygrid.sources.files import load

YEARS = range(1995, 2002)


@query("a1_read_csv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def _(spark, d):
    path = shared_path(spark, "part-csv")
    cols = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    load(spark, d, "part").select(*cols).write.option("header", True).csv(path)
    return files.read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")


@query("a2_read_delimited_tolerant", "SELECT p_name AS product, p_size::DOUBLE AS qty, round(p_retailprice, 2) AS price FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def _(spark, d):
    path = shared_path(spark, "part-text")
    p = load(spark, d, "part")
    price = F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ",")
    line = (
        F.when(F.col("p_type") == "PROMO", F.concat_ws(";", "p_name", F.lit("n/a"), price))
        .when(F.col("p_type") == "SMALL", F.concat_ws(";", "p_name", "p_size"))
        .when(F.col("p_type") == "LARGE", F.concat_ws(";", "p_name", "p_size", price, F.lit("more"), F.lit("fields")))
        .otherwise(F.concat_ws(";", F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_size").cast("string"), price))
    )
    p.select(line.alias("value")).write.text(path)
    out = files.read_delimited_tolerant(spark, path, ";", "product string, qty decimal(18,3), price decimal(18,2)", header=False)
    return out.select("product", F.col("qty").cast("double").alias("qty"), F.round(F.col("price").cast("double"), 2).alias("price"))


@query("a3_read_csv_preamble", "SELECT s_name AS name, s_suppkey AS code, s_acctbal AS value FROM supplier")
def _(spark, d):
    path = shared_path(spark, "supplier-preamble")
    s = load(spark, d, "supplier")
    rows = s.select(F.concat_ws(",", "s_name", "s_suppkey", "s_acctbal", F.lit("")).alias("value"))
    head = spark.createDataFrame([("Data Source,Indicators,",), ("",), ("Last Updated,2024-01-01,",), ("",), ("name,code,value,",)], "value string")
    head.unionByName(rows).write.text(path)
    return files.read_csv_preamble(spark, path, "name string, code bigint, value double", F.col("name").startswith("Supplier"))


@query("a4_inline_table", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, d):
    names = files.inline_table(spark, [("F", "finished"), ("O", "open"), ("P", "partial")], "o_orderstatus string, status string")
    counts = load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.join(names, "o_orderstatus").select("status", "n")


@query("a5_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("a6_conform", """SELECT c_name AS country, round((CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END) * (c_nationkey + 1), 2) AS gdp,
 (c_nationkey + 1)::DOUBLE AS population, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS gdp_pc FROM customer""")
def _(spark, d):
    c = load(spark, d, "customer").select(
        F.col("c_name").alias("País"),
        (F.col("c_nationkey") + 1).cast("string").alias("População"),
        F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise(F.col("c_acctbal").cast("string")).alias("gdp_pc"),
    )
    out = files.conform(
        c, {"País": "country", "População": "population"}, ["country", "population"], ["gdp", "population", "gdp_pc"],
        ("gdp", "gdp_pc", "population"), ["country", "gdp", "population", "gdp_pc"],
    )
    return rnd(out, gdp=2)


@query("a7_write_csv", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer")
def _(spark, d):
    path = shared_path(spark, "customer-csv")
    files.write_csv(load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal"), path)
    return files.read_csv(spark, path, "c_custkey bigint, segment string, c_acctbal double")


@query("b1_select", "SELECT p_brand, p_size FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_brand", "p_size")


@query("b2_select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    return frames.select_numeric(load(spark, d, "part"))


@query("b3_filter_range", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05 AND l_returnflag <> 'R'")
def _(spark, d):
    keep = F.col("l_quantity").between(10, 20) & (F.col("l_discount") > 0.05) & (F.col("l_returnflag") != "R")
    return load(spark, d, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("b4_parity", """SELECT l_quantity::BIGINT % 2 = 0 AS is_even, (l_quantity::BIGINT * l_quantity::BIGINT) % 2 = 0 AS square_is_even,
 count(*)::BIGINT AS n, sum(l_quantity::BIGINT * l_quantity::BIGINT)::BIGINT AS sum_square FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    p = frames.with_parity(load(spark, d, "lineitem").select("l_quantity"), "l_quantity")
    return p.groupBy("is_even", "square_is_even").agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("sum_square"))


@query("b5_derived_columns", """SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) AS ratio, 10 + 1.5::DOUBLE * (o_custkey % 20) + 2.0::DOUBLE * (o_orderkey % 10) AS score,
 round(o_totalprice / nullif((o_custkey % 5) * 30, 0), 6) AS unit_cost, round(o_totalprice / nullif((o_custkey % 7)::DOUBLE * (o_custkey % 7)::DOUBLE, 0), 6) AS bmi FROM orders""")
def _(spark, d):
    o = load(spark, d, "orders")
    h = (F.col("o_custkey") % 7).cast("double")
    return rnd(
        o.select(
            "o_orderkey",
            frames.ratio(F.col("o_totalprice"), F.col("o_custkey")).alias("ratio"),
            frames.linear_score(F.col("o_custkey") % 20, F.col("o_orderkey") % 10).alias("score"),
            frames.unit_cost(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("unit_cost"),
            frames.body_mass_index(F.col("o_totalprice"), h).alias("bmi"),
        ),
        unit_cost=6, bmi=6,
    )


@query("b6_pack_cost", "SELECT p_partkey, ceil(p_retailprice / 3.0::DOUBLE / 18.0::DOUBLE)::BIGINT AS packs, ceil(p_retailprice / 3.0::DOUBLE / 18.0::DOUBLE) * 80.0::DOUBLE AS cost FROM part")
def _(spark, d):
    area = F.col("p_retailprice")
    return load(spark, d, "part").select("p_partkey", frames.packs(area).cast("bigint").alias("packs"), frames.pack_cost(area).cast("double").alias("cost"))


@query("b7_drop_nulls", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0")
def _(spark, d):
    c = load(spark, d, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal")
    )
    return c.dropna(subset=["c_mktsegment", "bal"]).drop("bal")


@query("b8_clean_and_feature", """WITH t AS (SELECT c_custkey, c_acctbal AS gdp, (c_nationkey * 1.0::DOUBLE) AS population, (c_custkey % 150 - 20)::DOUBLE AS higher_ed_pct, (c_custkey % 11)::DOUBLE AS area FROM customer)
SELECT c_custkey, higher_ed_pct, round(ln(gdp), 8) AS log_gdp, round(ln(population), 8) AS log_population, round(ln(area), 8) AS log_area, round(gdp / population, 8) AS gdp_pc, round(ln(gdp / population), 8) AS log_gdp_pc
FROM t WHERE higher_ed_pct BETWEEN 0 AND 100 AND gdp > 0 AND population > 0 AND area > 0""")
def _(spark, d):
    t = load(spark, d, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("gdp"),
        F.col("c_nationkey").cast("double").alias("population"),
        (F.col("c_custkey") % 150 - 20).alias("higher_ed_pct"),
        (F.col("c_custkey") % 11).cast("double").alias("area"),
    )
    out = frames.clean_and_feature(t).drop("gdp", "population", "area")
    return rnd(out, log_gdp=8, log_population=8, log_area=8, gdp_pc=8, log_gdp_pc=8)


@query("b9_recode", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' ELSE c_mktsegment END AS segment, nullif(c_nationkey::DOUBLE, 0) AS nation,
 greatest(c_acctbal, 0) AS balance, coalesce(CASE WHEN c_nationkey < 5 THEN NULL ELSE greatest(c_acctbal, 100) END, -1) AS filled FROM customer""")
def _(spark, d):
    c = frames.recode(load(spark, d, "customer"), "c_mktsegment", {"BUILDING": "yes"})
    partial = F.when(F.col("c_nationkey") >= 5, F.col("c_acctbal"))
    return c.select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        frames.zero_to_null(F.col("c_nationkey").cast("double")).alias("nation"),
        frames.clip_low(F.col("c_acctbal")).alias("balance"),
        frames.clip_low(partial, 100.0, -1.0).alias("filled"),
    )


@query("b10_with_levels", """SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN p_type END AS p_type,
 CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS size_rank FROM part""")
def _(spark, d):
    return frames.with_levels(load(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["SMALL", "MEDIUM", "LARGE"], "size_rank")


@query("b11_segments", f"""WITH {SQL_PURCHASES}, q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM purchases)
SELECT CASE WHEN l_quantity <= a THEN 'Light' WHEN l_quantity <= b THEN 'Moderate' ELSE 'Heavy' END AS segment, p_brand,
 sum(l_quantity) AS total_qty, round(sum(l_extendedprice), 2) AS total_spend, count(*)::BIGINT AS n_people, round(sum(l_extendedprice) / sum(l_quantity), 6) AS spend_per_unit
FROM purchases, q GROUP BY 1, 2""")
def _(spark, d):
    s = frames.segment_by_quantiles(purchases(spark, d), "l_quantity")
    out = s.groupBy("segment", "p_brand").agg(
        F.sum("l_quantity").alias("total_qty"), F.sum("l_extendedprice").alias("total_spend"), F.count(F.lit(1)).alias("n_people")
    )
    return rnd(out.withColumn("spend_per_unit", F.col("total_spend") / F.col("total_qty")), total_spend=2, spend_per_unit=6)


@query("b12_label_by_threshold", f"WITH {SQL_SCORED} SELECT o_orderkey, prob, CASE WHEN prob >= 0.5::DOUBLE THEN 'yes' ELSE 'no' END AS pred FROM scored")
def _(spark, d):
    return frames.label_by_threshold(scored_orders(spark, d).select("o_orderkey", "prob"))


@query("b13_provided_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS pred FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "sim").otherwise("no").alias("pred"))
    return frames.provided_label(o)


@query("b14_share_above", "SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 9) AS share FROM orders GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderpriority").agg(frames.share_true(F.col("o_totalprice") > 150000).alias("share"))
    return rnd(o, share=9)


@query("b15_rename_prefixed", "SELECT p_partkey, p_brand AS geo_p_brand, p_size AS geo_p_size FROM part")
def _(spark, d):
    p = load(spark, d, "part").drop("p_name", "p_type", "p_retailprice")
    return frames.rename_prefixed(p, ["p_brand", "p_size"], "geo")


@query("b16_casts", "SELECT l_orderkey, l_quantity::INTEGER AS qty, l_linenumber::DOUBLE AS line, try_cast(CASE WHEN l_returnflag = 'R' THEN 'x' ELSE l_quantity::VARCHAR END AS DOUBLE) AS parsed FROM lineitem")
def _(spark, d):
    text = F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_quantity").cast("string"))
    return load(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("int").alias("qty"), F.col("l_linenumber").cast("double").alias("line"), text.try_cast("double").alias("parsed")
    )


@query("b17_transpose", """WITH t AS (SELECT p_type, avg(p_retailprice) AS m, avg(p_size) AS s FROM part GROUP BY 1), u AS (SELECT 'm' AS key, p_type, m AS v FROM t UNION ALL SELECT 's', p_type, s FROM t)
SELECT key, round(max(v) FILTER (p_type = 'ECONOMY'), 6) AS "ECONOMY", round(max(v) FILTER (p_type = 'LARGE'), 6) AS "LARGE", round(max(v) FILTER (p_type = 'MEDIUM'), 6) AS "MEDIUM",
 round(max(v) FILTER (p_type = 'PROMO'), 6) AS "PROMO", round(max(v) FILTER (p_type = 'SMALL'), 6) AS "SMALL", round(max(v) FILTER (p_type = 'STANDARD'), 6) AS "STANDARD" FROM u GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("m"), F.round(F.avg("p_size"), 6).alias("s"))
    return frames.transpose_small(t, "p_type")


def _wide_by_year(spark, d: str, measure) -> DataFrame:
    return regional_orders(spark, d).groupBy("n_name").pivot("year", [str(y) for y in YEARS]).agg(measure)


@query("b18_unpivot_years", f"""WITH {SQL_REGIONAL} SELECT n_name, year, round(sum(o_totalprice) / count(*), 4) AS value FROM regional WHERE year BETWEEN 1995 AND 2001 GROUP BY 1, 2""")
def _(spark, d):
    wide = _wide_by_year(spark, d, F.sum("o_totalprice") / F.count(F.lit(1)))
    return rnd(frames.unpivot_years(wide, ["n_name"], range(1990, 2005)), value=4)


@query("b19_reset_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def _(spark, d):
    return frames.reset_index(load(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("b20_number_grid", f"""WITH g AS (SELECT i, CASE WHEN i = 24 THEN 0.7::DOUBLE ELSE 0.1::DOUBLE + i * ((0.7::DOUBLE - 0.1::DOUBLE) / 24) END AS threshold FROM range(25) t(i)), {SQL_SCORED},
p AS (SELECT (SELECT count(*) FROM g WHERE threshold <= prob) AS pos FROM scored)
SELECT pos::INTEGER AS pos, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def _(spark, d):
    at = frames.grid_position(F.col("prob"), 0.1, 0.7, 25).cast("int").alias("pos")
    return scored_orders(spark, d).groupBy(at).agg(F.count(F.lit(1)).alias("n"))


@query("c1_assemble_panel", f"""WITH {SQL_REGIONAL} SELECT n_name, year, round(sum(o_totalprice), 2) AS gdp, count(DISTINCT o_custkey)::DOUBLE AS population, count(*)::DOUBLE AS area,
 round(avg(o_totalprice), 4) AS higher_ed_pct FROM regional WHERE year BETWEEN 1996 AND 2001 GROUP BY 1, 2""")
def _(spark, d):
    tables = {
        "gdp": _wide_by_year(spark, d, F.sum("o_totalprice")),
        "population": _wide_by_year(spark, d, F.count_distinct("o_custkey")),
        "area": _wide_by_year(spark, d, F.count(F.lit(1))),
        "higher_ed_pct": _wide_by_year(spark, d, F.avg("o_totalprice")),
    }
    return rnd(joins.assemble_panel(tables, "n_name", range(1996, 2030)), gdp=2, higher_ed_pct=4)


@query("c2_join_suffixed", """SELECT o_orderkey, o_totalprice AS total_1, round(t.total, 2) AS total_2 FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) t ON o_orderkey = l_orderkey""")
def _(spark, d):
    a = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    b = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    return rnd(joins.join_suffixed(a, b, ["o_orderkey"]), total_2=2)


@query("c3_keep_members", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey IN (2, 7, 9))")
def _(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    listed = [r[0].title() for r in n.filter(F.col("c_nationkey").isin(2, 7, 9)).select("n_name").collect()]
    named = joins.keep_named(n, "n_name", listed)
    return joins.keep_members(c, named, ["c_nationkey"]).join(n, "c_nationkey").select("c_custkey", "n_name")


@query("c4_exclude_rows", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    big = load(spark, d, "orders").filter(F.col("o_totalprice") > 200000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.exclude_rows(load(spark, d, "customer").select("c_custkey"), big, ["c_custkey"])


@query("c5_train_sets", "SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS fold, f::INTEGER AS test_fold FROM orders, range(4) t(f) WHERE o_orderkey % 4 <> f")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("fold"))
    return joins.train_sets(o, "fold", range(4))


@query("c6_neighbour_search", """WITH d AS (SELECT q.vec_id AS q, t.vec_id AS t, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS dist FROM embeddings q, embeddings t WHERE q.vec_id <> t.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rank FROM d) SELECT q AS vec_id, rank::INTEGER AS rank, t AS neighbour, round(dist, 8) AS distance FROM r WHERE rank <= 3""")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding", F.col("vec_id").alias("self"))
    return rnd(nearest.nearest(e, e, "embedding", 3, "vec_id", "vec_id", exclude="self"), distance=8)


@query("c7_pair_up", "SELECT a.o_orderkey, a.o_totalprice, b.items FROM orders a JOIN (SELECT l_orderkey, count(*)::BIGINT AS items FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey")
def _(spark, d):
    a = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    return joins.pair_up(a, b, "o_orderkey")


@query("c8_attach_global", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 7) AS gap FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = joins.attach_global(o, o, mean=F.avg("o_totalprice"))
    return rnd(out.select("o_orderkey", (F.col("o_totalprice") - F.col("mean")).alias("gap")), gap=7)


@query("c9_count_and_pct", "SELECT o_orderpriority, count(*)::BIGINT AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f, round(avg(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END), 8) AS pct_f FROM orders GROUP BY 1")
def _(spark, d):
    f = F.col("o_orderstatus") == "F"
    out = load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_f"), (frames.share_true(f) * 100).alias("pct_f")
    )
    return rnd(out, pct_f=8)


@query("c10_lookup_table", "SELECT DISTINCT l_suppkey AS code, l_returnflag AS name FROM lineitem WHERE l_returnflag <> 'N'")
def _(spark, d):
    items = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.nullif("l_returnflag", F.lit("N")).alias("name"))
    return joins.lookup_table(items, "code", "name")


@query("c11_value_pairs", "SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand")
def _(spark, d):
    return joins.value_pairs(load(spark, d, "part"), "p_brand")


@query("w1_demean", "WITH t AS (SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS dev FROM orders) SELECT o_orderkey, CASE WHEN dev = 0 THEN 0.0::DOUBLE ELSE dev END AS o_totalprice_dev FROM t")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rnd(windows.demean(o, "o_custkey", ["o_totalprice"]).select("o_orderkey", "o_totalprice_dev"), o_totalprice_dev=8)


@query("w2_trajectory", f"""WITH {SQL_PANEL} SELECT n_name, year, round(x, 9) AS x, round(y, 9) AS y, year = min(year) OVER (PARTITION BY n_name) AS is_first, year = max(year) OVER (PARTITION BY n_name) AS is_last,
 CASE WHEN round(x - lag(x) OVER w, 9) = 0 THEN 0.0::DOUBLE ELSE round(x - lag(x) OVER w, 9) END AS dx, CASE WHEN round(y - lag(y) OVER w, 9) = 0 THEN 0.0::DOUBLE ELSE round(y - lag(y) OVER w, 9) END AS dy FROM panel WINDOW w AS (PARTITION BY n_name ORDER BY year)""")
def _(spark, d):
    return rnd(windows.trajectory(nation_panel(spark, d), "n_name", "year", "x", "y"), x=9, y=9, dx=9, dy=9)


@query("w3_cumulative_lift", f"""WITH {SQL_SCORED} SELECT o_orderkey, prob, row_number() OVER w AS rank, sum(y) OVER w ::BIGINT AS cum_positive,
 round(sum(y) OVER w / (row_number() OVER w * (SELECT avg(y) FROM scored)), 8) AS lift FROM scored WINDOW w AS (ORDER BY prob DESC, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return rnd(windows.cumulative_lift(scored_orders(spark, d), "prob", "y", "o_orderkey"), lift=8)


@query("w4_stratified_folds", """WITH n AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1) SELECT o_orderstatus, f::INTEGER AS fold, ((c - f + 4) // 5)::BIGINT AS n FROM n, range(5) t(f)""")
def _(spark, d):
    folded = windows.stratified_folds(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5)
    return folded.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("w5_stratified_split", """WITH n AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1) SELECT o_orderstatus, true AS is_train, floor(c * 0.7 + 1e-9)::BIGINT AS n FROM n UNION ALL SELECT o_orderstatus, false, c - floor(c * 0.7 + 1e-9)::BIGINT FROM n""")
def _(spark, d):
    split = windows.stratified_split(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.7)
    return split.groupBy("o_orderstatus", "is_train").agg(F.count(F.lit(1)).alias("n"))


@query("w6_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def _(spark, d):
    return windows.average_rank(load(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("w7_nearest_rank", """WITH d AS (SELECT l_suppkey, l_orderkey, min(abs(l_extendedprice - 30000)) AS dist FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY dist, l_orderkey) AS rank FROM d)
SELECT l_suppkey, l_orderkey, round(dist, 2) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def _(spark, d):
    far = load(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min(F.abs(F.col("l_extendedprice") - 30000)).alias("dist"))
    return rnd(windows.nearest_rank(far, "l_suppkey", "dist", "l_orderkey", 5), dist=2)


@query("w8_integrate_derivative", """WITH t AS (SELECT o_orderpriority AS g, o_orderkey AS x, o_totalprice AS y FROM orders),
n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM t WINDOW w AS (PARTITION BY g ORDER BY x))
SELECT g, round(sum((x - px) * (y + py) / 2), 0) AS integral, round(max((ny - py) / nullif(nx - px, 0)), 6) AS steepest, count((ny - py) / nullif(nx - px, 0))::BIGINT AS inner_points FROM n GROUP BY 1""")
def _(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("y"))
    area = windows.integrate_table(t, "x", "y", ["g"])
    slope = windows.derivative_table(t, "x", "y", ["g"]).groupBy("g").agg(F.max("dydx").alias("steepest"), F.count("dydx").alias("inner_points"))
    return rnd(area.join(slope, "g"), integral=0, steepest=6)


@query("e1_sort_by", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return topk.sort_by(o, {"o_orderpriority": True, "o_totalprice": False})


@query("e2_first_last", "(SELECT 'first' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'last', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sets.union_tagged({"first": topk.first_n(o, "o_orderkey"), "last": topk.last_n(o, "o_orderkey")}, "part")


@query("e3_n_largest_smallest", "(SELECT 'large' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'small', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sets.union_tagged(
        {"large": topk.n_largest(o, "o_totalprice", 10, "o_orderkey"), "small": topk.n_smallest(o, "o_totalprice", 10, "o_orderkey")}, "part"
    )


@query("e4_group_landmarks", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS b,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC, o_orderkey) AS c FROM o) SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM r WHERE a = 1 OR b = 1 OR c = 1""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    return topk.group_landmarks(o, "o_orderstatus", "o_totalprice", "o_custkey", "o_orderkey")


@query("e5_metric_subsets", f"""WITH {SQL_CUSTOMERS}, m AS (SELECT c_custkey, round(spend, 2) AS spend, n_name FROM cust JOIN nation ON c_nationkey = n_nationkey),
b3 AS (SELECT * FROM m ORDER BY spend, c_custkey LIMIT 3), t3 AS (SELECT * FROM m ORDER BY spend DESC, c_custkey LIMIT 3),
rest AS (SELECT * FROM m WHERE c_custkey NOT IN (SELECT c_custkey FROM b3 UNION SELECT c_custkey FROM t3)), med AS (SELECT median(spend) AS v FROM rest),
mid AS (SELECT rest.* FROM rest, med ORDER BY abs(spend - v), spend, c_custkey LIMIT 3)
SELECT 'bottom3' AS subset, * FROM b3 UNION ALL SELECT 'top3', * FROM t3 UNION ALL SELECT 'mid3', * FROM mid
UNION ALL SELECT 'bottom10', * FROM (SELECT * FROM m ORDER BY spend, c_custkey LIMIT 10) UNION ALL SELECT 'top10', * FROM (SELECT * FROM m ORDER BY spend DESC, c_custkey LIMIT 10)
UNION ALL SELECT 'named', * FROM m WHERE lower(n_name) IN ('nation_3', 'nation_7', 'brazil', 'germany', 'united states')""")
def _(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    m = customer_facts(spark, d).join(n, "c_nationkey").select("c_custkey", F.round("spend", 2).alias("spend"), "n_name")
    return topk.metric_subsets(m, "spend", "c_custkey", "n_name", ["Nation_3", "NATION_7", "Brazil", "Germany", "United States"])


@query("e6_flag_extremes", f"""WITH {SQL_CUSTOMERS}, f AS (SELECT regr_slope(log_spend, acctbal) AS b, regr_intercept(log_spend, acctbal) AS a FROM cust),
r AS (SELECT c_custkey, acctbal, log_spend, log_spend - a - b * acctbal AS resid FROM cust, f),
e AS (SELECT stddev_samp(resid) AS s, quantile_cont(acctbal, 0.1) AS x1, quantile_cont(acctbal, 0.9) AS x9, quantile_cont(log_spend, 0.1) AS y1, quantile_cont(log_spend, 0.9) AS y9 FROM r)
SELECT c_custkey, round(resid, 8) AS resid, row_number() OVER (ORDER BY abs(resid) DESC, c_custkey)::INTEGER AS rank FROM r, e
WHERE abs(resid) >= 2 * s OR acctbal <= x1 OR acctbal >= x9 OR log_spend <= y1 OR log_spend >= y9 ORDER BY abs(resid) DESC, c_custkey LIMIT 12""")
def _(spark, d):
    from tallygrid.operators.regression import fit_ols, with_fit

    c = customer_facts(spark, d)
    r = with_fit(c, fit_ols(c, "log_spend", ["acctbal"]))
    return rnd(topk.flag_extremes(r, "acctbal", "log_spend", "resid", "c_custkey").select("c_custkey", "resid", "rank"), resid=8)


@query("e7_sample_n")
def _(spark, d):
    return topk.sample_n(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


@query("g1_union_tagged", "SELECT c_nationkey AS nation, c_acctbal AS acctbal, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))
    s = load(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return sets.union_tagged({"customer": c, "supplier": s})


@query("g2_distinct_rows", "SELECT DISTINCT l_suppkey, l_linestatus, l_returnflag FROM lineitem")
def _(spark, d):
    return sets.distinct_rows(load(spark, d, "lineitem"), ["l_suppkey", "l_linestatus", "l_returnflag"])


@query("g3_union_keys", "SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def _(spark, d):
    a = load(spark, d, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("custkey"))
    b = load(spark, d, "customer").filter(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("custkey"))
    return sets.union_keys([a, b], "custkey")



