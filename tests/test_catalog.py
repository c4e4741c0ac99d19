"""Every query with SQL agrees with DuckDB; a part of them also with eight cells."""

import math
from pathlib import Path

import pytest

from tallygrid.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

FORCED = [
    "b11_segments", "b19_reset_index", "d10_stat_summary", "d12_describe_extended", "d14_profile_numbers_by", "d18_quantiles",
    "d27_box_stats", "e6_flag_extremes", "j2_spearman", "l3_roc_auc", "l4_pr_auc", "l8_pr_points", "w2_trajectory",
    "w3_cumulative_lift", "w4_stratified_folds", "w5_stratified_split", "w6_average_rank", "w8_integrate_derivative",
]
# Slow model fits are exercised in test_models.py on small fixtures.
ROWS_ONLY = ["e7_sample_n", "h14_normal_cdf", "j19_bootstrap_ci", "j20_spline_fit", "j21_bootstrap_means", "k5_logit_coefficients"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _compare(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if isinstance(b, float) and a is not None and math.isfinite(b):
                assert a == pytest.approx(b, rel=1e-9, abs=1e-9), (name, g, w)
            else:
                assert a == b, (name, g, w)


# At this scale one nation has no order in one year, so the closed form for balanced panels does not apply.
BALANCED = {"j13_panel_fe", "j14_fixed_effects"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - BALANCED))
def test_matches_sql(spark, duck, name):
    _compare(spark, duck, name)


@pytest.mark.parametrize("name", FORCED)
def test_matches_sql_in_cells(spark, duck, name):
    spark.conf.set("tallygrid.rowsPerTask", "0")
    try:
        _compare(spark, duck, name)
    finally:
        spark.conf.unset("tallygrid.rowsPerTask")


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_text_operators(tmp_path):
    """The entry module of a copy that lacks the text operators imports and has all other queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tallygrid", tmp_path / "tallygrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
        assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr
