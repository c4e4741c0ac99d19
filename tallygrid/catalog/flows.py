"""Queries over the composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import SQL_PURCHASES, SQL_REGIONAL, purchases, query, regional_orders, rnd
from tallygrid.plans import study, survey
from tallygrid.sources.files import load

YEARS = [str(y) for y in range(1995, 2002)]


def indicators(spark, d):
    """Nation × year indicators as wide tables, one column per year."""
    o = regional_orders(spark, d)
    big = F.avg(F.when(F.col("o_totalprice") > 150000, 100.0).otherwise(0.0))
    measures = {
        "gdp": F.sum("o_totalprice"),
        "population": F.count_distinct("o_custkey").cast("double"),
        "area": F.count(F.lit(1)).cast("double"),
        "higher_ed_pct": big,
    }
    coded = o.withColumn("iso", F.upper(F.substring("n_name", -6, 6)))
    return {k: coded.groupBy("n_name", "iso").pivot("year", YEARS).agg(m) for k, m in measures.items()}


_STUDY = f"""WITH {SQL_REGIONAL}, p AS (SELECT n_name, year, sum(o_totalprice) AS gdp, count(DISTINCT o_custkey) AS pop, count(*) AS area, avg(CASE WHEN o_totalprice > 150000 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct
 FROM regional WHERE year BETWEEN 1995 AND 2001 GROUP BY 1, 2)"""


@query("flow_study_panel", f"{_STUDY} SELECT n_name, year, round(pct, 8) AS higher_ed_pct, round(ln(gdp / pop), 9) AS log_gdp_pc, round(ln(area), 9) AS log_area FROM p")
def _(spark, d):
    out = study.build_panel(indicators(spark, d), "n_name", "iso", 2024)
    return rnd(out.select("n_name", "year", "higher_ed_pct", "log_gdp_pc", "log_area"), higher_ed_pct=8, log_gdp_pc=9, log_area=9)


@query("flow_study_cross_section", f"{_STUDY} SELECT n_name, round(median(pct), 8) AS higher_ed_pct, round(median(ln(gdp / pop)), 9) AS log_gdp_pc, round(median(ln(area)), 9) AS log_area FROM p GROUP BY 1")
def _(spark, d):
    panel = study.build_panel(indicators(spark, d), "n_name", "iso", 2024)
    out = study.cross_section(panel, "n_name", "iso").drop("iso")
    return rnd(out, higher_ed_pct=8, log_gdp_pc=9, log_area=9)


@query("flow_survey_segments", f"""WITH {SQL_PURCHASES}, q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM purchases), s AS (SELECT CASE WHEN l_quantity <= a THEN 'Light' WHEN l_quantity <= b THEN 'Moderate' ELSE 'Heavy' END AS segment, p_type, l_quantity, l_extendedprice FROM purchases, q)
SELECT segment, p_type, count(*)::BIGINT AS n_people, sum(l_quantity) AS total_qty, round(sum(l_extendedprice), 2) AS total_spend FROM s GROUP BY 1, 2""")
def _(spark, d):
    report = survey.survey_report(purchases(spark, d), "p_size", "p_type", "p_type", "p_type", "l_quantity", "l_extendedprice")
    return rnd(report["segment_brand_stats"].select("segment", "p_type", "n_people", "total_qty", "total_spend"), total_spend=2)


@query("flow_versions", """WITH b AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS n_units, round(avg(CASE WHEN abs(v - o_totalprice) / o_totalprice > 0.1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS pct_discrepant FROM orders JOIN b ON o_orderkey = l_orderkey""")
def _(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rnd(study.compare_versions(a, b, "k", "v")["discrepancy"], pct_discrepant=8)
