"""Scalar-function and geospatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import SQL_COORDS, SQL_REGIONAL, coordinates, query, regional_orders, rnd
from tallygrid.functions import distributions as dist
from tallygrid.functions import geo
from tallygrid.functions import scalars as s
from tallygrid.sources.files import load


@query("h1_arithmetic", """SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 9) AS lg, round(exp(c_acctbal / 10000), 9) AS ex, round(sqrt(abs(c_acctbal)), 9) AS sq, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down,
 round(pow(c_acctbal / 100, 2), 6) AS pw, floor((c_custkey - 750) / 7.0)::BIGINT AS fdiv, ((((c_custkey - 750) % 7) + 7) % 7)::BIGINT AS fmod, round(tanh(c_acctbal / 1000), 9) AS th FROM customer""")
def _(spark, d):
    b, k = F.col("c_acctbal"), F.col("c_custkey") - 750
    out = load(spark, d, "customer").select(
        "c_custkey", F.log(F.abs(b) + 1).alias("lg"), F.exp(b / 10000).alias("ex"), F.sqrt(F.abs(b)).alias("sq"), F.ceil(b).alias("up"),
        F.floor(b).alias("down"), F.pow(b / 100, F.lit(2)).alias("pw"), s.floor_div(k, F.lit(7)).alias("fdiv"),
        s.floor_mod(k, F.lit(7)).cast("bigint").alias("fmod"), F.tanh(b / 1000).alias("th"),
    )
    return rnd(out, lg=9, ex=9, sq=9, pw=6, th=9)


@query("h2_trigonometry", f"WITH {SQL_COORDS} SELECT c_custkey, round(radians(lat_a), 9) AS rad, round(degrees(radians(lon_a)), 9) AS deg, round(sin(radians(lat_a)), 9) AS s, round(cos(radians(lat_a)), 9) AS c, round(acos(cos(radians(lat_a))), 7) AS ac, round(atan2(lat_a, lon_a), 9) AS at FROM coords")
def _(spark, d):
    a, o = F.col("lat_a"), F.col("lon_a")
    out = coordinates(spark, d).select(
        "c_custkey", F.radians(a).alias("rad"), F.degrees(F.radians(o)).alias("deg"), F.sin(F.radians(a)).alias("s"), F.cos(F.radians(a)).alias("c"),
        F.acos(F.cos(F.radians(a))).alias("ac"), F.atan2(a, o).alias("at"),
    )
    return rnd(out, rad=9, deg=9, s=9, c=9, ac=7, at=9)


@query("h3_rounding", "SELECT l_orderkey, l_extendedprice, round(l_extendedprice::DECIMAL(38,10), 1)::DOUBLE AS half_up, round_even(l_quantity / 4, 0) AS half_even FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_extendedprice", s.round_half_up(F.col("l_extendedprice"), 1).cast("double").alias("half_up"), s.round_half_even(F.col("l_quantity") / 4, 0).alias("half_even")
    )


@query("h4_parse_decimal", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_retailprice END AS price FROM part")
def _(spark, d):
    text = F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.concat(F.lit("  "), F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ","), F.lit(" ")))
    return load(spark, d, "part").select("p_partkey", s.parse_decimal(text).cast("double").alias("price"))


@query("h5_case_and_trim", "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, trim('  ' || p_name || ' ') AS cut FROM part")
def _(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("cut"))


@query("h6_slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', '_', 'g'), '_') AS slug FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", s.slug(F.col("text")).alias("slug"))


@query("h7_fold_key", "SELECT doc_id, md5(replace(strip_accents(lower(trim(text, ' \n\t\r'))), 'ß', 'ss')) AS digest, strip_accents(lower(lang)) = lower(lang) AS same FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(s.fold_key(F.col("text"))).alias("digest"), s.folded_equal(F.col("lang"), F.upper("lang")).alias("same"))


@query("h8_palindrome", """WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM documents), f AS (SELECT word, regexp_replace(replace(strip_accents(lower(word)), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM w)
SELECT word, t = reverse(t) AS is_palindrome FROM f WHERE word <> ''""")
def _(spark, d):
    words = load(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter(F.col("word") != "").distinct()
    return words.select("word", s.is_palindrome(F.col("word")).alias("is_palindrome"))


@query("h9_short_label", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN upper(p_brand) WHEN length(p_name) > 13 THEN substring(p_name, 1, 12) || '…' ELSE p_name END AS label FROM part")
def _(spark, d):
    code = F.when(F.col("p_type") == "PROMO", F.col("p_brand"))
    return load(spark, d, "part").select("p_partkey", s.short_label(code, F.col("p_name")).alias("label"))


@query("h10_format", "SELECT p_partkey, printf('%.2f km', p_retailprice) AS km, p_brand || ' (n=' || p_size || ')' AS label, format('{:,.2f}', p_retailprice) AS grouped FROM part")
def _(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", F.format_string("%.2f km", "p_retailprice").alias("km"), F.concat("p_brand", F.lit(" (n="), "p_size", F.lit(")")).alias("label"), F.format_number("p_retailprice", 2).alias("grouped")
    )


@query("h11_collections", """WITH t AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
SELECT doc_id, list_contains(words, 'the') AS has_the, words[1] AS first_word, words[len(words)] AS last_word, array_to_string(words[1:3], '|') AS first_three, len(words)::BIGINT AS n_words, contains(array_to_string(words, ' '), 'copyright') AS mentions FROM t""")
def _(spark, d):
    w = F.split("text", " ")
    t = load(spark, d, "documents").select("doc_id", "text", w.alias("w"))
    return t.select(
        "doc_id", F.array_contains("w", "the").alias("has_the"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"),
        F.array_join(F.slice("w", 1, 3), "|").alias("first_three"), F.size("w").cast("bigint").alias("n_words"), F.col("text").contains("copyright").alias("mentions"),
    )


@query("h11_maps", """SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'z') AS has_z, json_keys(props)[1] AS first_key FROM events""")
def _(spark, d):
    m = F.from_json("props", "map<string,string>")
    e = load(spark, d, "events").select("event_id", m.alias("m"))
    return e.select(
        "event_id", F.element_at("m", "k").cast("bigint").alias("k"), F.map_contains_key("m", "k").alias("has_k"),
        F.map_contains_key("m", "z").alias("has_z"), F.element_at(F.map_keys("m"), 1).alias("first_key"),
    )


@query("h11_enumerate", """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT i::INTEGER AS pos, w[i + 1] AS word, count(*)::BIGINT AS n FROM t, range(10) r(i) WHERE i < len(w) GROUP BY 1, 2""")
def _(spark, d):
    words = load(spark, d, "part").select(F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return words.groupBy("pos", "word").agg(F.count(F.lit(1)).alias("n"))


@query("h12_conditions", """SELECT o_orderkey, (o_totalprice > 100000 AND o_orderstatus = 'F') OR NOT (o_orderpriority = '1-URGENT') AS flag, o_totalprice BETWEEN 50000 AND 150000 AS mid,
 CASE WHEN o_totalprice >= 300000 THEN 'A' WHEN o_totalprice >= 150000 THEN 'B' WHEN o_totalprice >= 50000 THEN 'C' ELSE 'D' END AS grade FROM orders""")
def _(spark, d):
    p = F.col("o_totalprice")
    flag = ((p > 100000) & (F.col("o_orderstatus") == "F")) | ~(F.col("o_orderpriority") == "1-URGENT")
    return load(spark, d, "orders").select("o_orderkey", flag.alias("flag"), p.between(50000, 150000).alias("mid"), s.grade(p, [(300000, "A"), (150000, "B"), (50000, "C")], "D").alias("grade"))


@query("h13_year_window", f"WITH {SQL_REGIONAL} SELECT year, count(*)::BIGINT AS n FROM regional WHERE year BETWEEN 1999 AND 2001 GROUP BY 1")
def _(spark, d):
    return regional_orders(spark, d).filter(s.in_last_years(F.col("year"), 2001, 3)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("h14_normal_pdf", """WITH m AS (SELECT avg(c_acctbal) AS mu, stddev_samp(c_acctbal) AS sd FROM customer) SELECT c_custkey, round(exp(-((c_acctbal - mu) / sd) * ((c_acctbal - mu) / sd) / 2) / (sd * sqrt(2 * pi())), 14) AS density FROM customer, m""")
def _(spark, d):
    from tallygrid.operators.joins import attach_global

    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    c = attach_global(c, c, mu=F.avg("c_acctbal"), sd=F.stddev_samp("c_acctbal"))
    return rnd(c.select("c_custkey", dist.normal_pdf(F.col("c_acctbal"), F.col("mu"), F.col("sd")).alias("density")), density=14)


@query("h14_poisson_binomial", """WITH k AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1), o AS (SELECT k, count(*) AS n FROM k GROUP BY 1), m AS (SELECT avg(k) AS lam, count(*) AS total, max(k) AS top FROM k)
SELECT k::BIGINT AS k, n::BIGINT AS observed, round(total * exp(k * ln(lam) - lam - lgamma(k + 1)), 4) AS poisson, round(total * exp(lgamma(2 * top + 1) - lgamma(k + 1) - lgamma(2 * top - k + 1) + k * ln(lam / (2 * top)) + (2 * top - k) * ln(1 - lam / (2 * top))), 4) AS binomial FROM o, m""")
def _(spark, d):
    from tallygrid.operators.joins import attach_global

    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    seen = per.groupBy("k").agg(F.count(F.lit(1)).alias("observed"))
    t = attach_global(seen, per, lam=F.avg("k"), total=F.count(F.lit(1)), top=F.max("k"))
    n = F.col("top") * 2
    out = t.select(
        "k", "observed", (F.col("total") * dist.poisson_pmf(F.col("k"), F.col("lam"))).alias("poisson"),
        (F.col("total") * dist.binom_pmf(F.col("k"), n, F.col("lam") / n)).alias("binomial"),
    )
    return rnd(out, poisson=4, binomial=4)


@query("h14_normal_cdf")
def _(spark, d):
    from tallygrid.operators.joins import attach_global

    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    c = attach_global(c, c, mu=F.avg("c_acctbal"), sd=F.stddev_samp("c_acctbal"))
    return c.select("c_custkey", dist.normal_cdf(F.col("c_acctbal"), F.col("mu"), F.col("sd")).alias("share_below"))


_VALID = "(lat_a BETWEEN -90 AND 90 AND lon_a BETWEEN -180 AND 180 AND lat_b BETWEEN -90 AND 90 AND lon_b BETWEEN -180 AND 180)"
_COSINE = "acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(lat_a)) * sin(radians(lat_b)) + cos(radians(lat_a)) * cos(radians(lat_b)) * cos(radians(lon_a) - radians(lon_b))))) * 6371.01::DOUBLE"
_HAVERSINE = "2 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(lat_b) - radians(lat_a)) / 2), 2) + cos(radians(lat_a)) * cos(radians(lat_b)) * pow(sin((radians(lon_b) - radians(lon_a)) / 2), 2)))) * 6371.0088::DOUBLE"
_BEARING = "fmod(degrees(atan2(sin(radians(lon_b) - radians(lon_a)) * cos(radians(lat_b)), cos(radians(lat_a)) * sin(radians(lat_b)) - sin(radians(lat_a)) * cos(radians(lat_b)) * cos(radians(lon_b) - radians(lon_a)))) + 360, 360)"


def _coords():
    return [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]


@query("i1_distance_cosine", f"WITH {SQL_COORDS} SELECT c_custkey, round(CASE WHEN {_VALID} THEN {_COSINE} END, 4) AS km FROM coords")
def _(spark, d):
    return rnd(coordinates(spark, d).select("c_custkey", geo.distance_cosine(*_coords()).alias("km")), km=4)


@query("i2_distance_haversine", f"WITH {SQL_COORDS} SELECT c_custkey, round(CASE WHEN {_VALID} THEN {_HAVERSINE} END, 5) AS km FROM coords")
def _(spark, d):
    return rnd(coordinates(spark, d).select("c_custkey", geo.distance_haversine(*_coords()).alias("km")), km=5)


# The inverse solution by 200 steps of a recursive query on the valid pairs.
_VINCENTY = f"""WITH RECURSIVE {SQL_COORDS}, u AS (
  SELECT c_custkey, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat_a))) AS u1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat_b))) AS u2, radians(lon_b - lon_a - 360 * round((lon_b - lon_a) / 360)) AS l FROM coords WHERE {_VALID}),
step(c_custkey, i, lam, gap) AS (
  SELECT c_custkey, 0, l, 1.0::DOUBLE FROM u
  UNION ALL
  SELECT c_custkey, i + 1, nxt, abs(nxt - lam) FROM (
    SELECT c_custkey, i, lam, l + (1 - c) * f * sa * (sig + c * ss * (mid + c * cs * (2 * mid * mid - 1))) AS nxt FROM (
      SELECT *, f / 16 * c2a * (4 + f * (4 - 3 * c2a)) AS c, CASE WHEN c2a = 0 THEN 0.0::DOUBLE ELSE cs - 2 * sin(u1) * sin(u2) / c2a END AS mid FROM (
        SELECT *, 1 - sa * sa AS c2a FROM (
          SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0.0::DOUBLE ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (
            SELECT s.c_custkey, s.i, s.lam, u.l, u.u1, u.u2, 1 / 298.257223563::DOUBLE AS f,
              sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs
            FROM step s JOIN u ON s.c_custkey = u.c_custkey WHERE s.i < 200 AND s.gap >= 1e-12::DOUBLE))))) ),
final AS (SELECT c_custkey, arg_max(lam, i) AS lam, min(gap) AS gap FROM step GROUP BY 1),
p AS (SELECT f.c_custkey, u1, u2, gap, lam, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS b FROM final f JOIN u ON f.c_custkey = u.c_custkey),
q AS (SELECT *, 1 - pow(CASE WHEN ss = 0 THEN 0.0::DOUBLE ELSE cos(u1) * cos(u2) * sin(lam) / ss END, 2) AS c2a FROM p),
r AS (SELECT *, CASE WHEN c2a = 0 THEN 0.0::DOUBLE ELSE cs - 2 * sin(u1) * sin(u2) / c2a END AS mid, c2a * (pow(6378137.0::DOUBLE, 2) - b * b) / (b * b) AS w FROM q),
t AS (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS aa, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS bb FROM r)
SELECT coords.c_custkey, round(CASE WHEN gap < 1e-12::DOUBLE AND abs(lam) <= pi() * 1.0000001::DOUBLE THEN b * aa * (atan2(ss, cs) - bb * ss * (mid + bb / 4 * (cs * (2 * mid * mid - 1) - bb / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) / 1000 END, 4) AS km
FROM coords LEFT JOIN t ON coords.c_custkey = t.c_custkey"""


@query("i3_distance_geodesic", _VINCENTY)
def _(spark, d):
    return rnd(coordinates(spark, d).select("c_custkey", geo.distance_geodesic(*_coords()).alias("km")), km=4)


@query("i4_bearing", f"WITH {SQL_COORDS} SELECT c_custkey, round({_BEARING}, 7) AS course FROM coords")
def _(spark, d):
    return rnd(coordinates(spark, d).select("c_custkey", geo.bearing(*_coords()).alias("course")), course=7)


@query("i5_deltas", f"WITH {SQL_COORDS} SELECT c_custkey, lat_b - lat_a AS geo_delta_lat, lon_b - lon_a AS geo_delta_lon FROM coords")
def _(spark, d):
    out = geo.add_geo_features(coordinates(spark, d), "lat_a", "lon_a", "lat_b", "lon_b", features=("delta_lat", "delta_lon"))
    return out.select("c_custkey", "geo_delta_lat", "geo_delta_lon")


@query("i6_coords_valid", f"WITH {SQL_COORDS} SELECT c_custkey, {_VALID} AS valid FROM coords")
def _(spark, d):
    return coordinates(spark, d).select("c_custkey", geo.coords_valid(*_coords()).alias("valid"))


@query("i7_geo_features", f"WITH {SQL_COORDS} SELECT c_custkey, round(CASE WHEN {_VALID} THEN {_HAVERSINE} END, 5) AS geo_distance_km, round({_BEARING}, 7) AS geo_bearing_deg FROM coords")
def _(spark, d):
    out = geo.add_geo_features(coordinates(spark, d), "lat_a", "lon_a", "lat_b", "lon_b")
    return rnd(out.select("c_custkey", "geo_distance_km", "geo_bearing_deg"), geo_distance_km=5, geo_bearing_deg=7)
