"""Every registered query on the small tables, against its SQL twin where it has one."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from gapscope.config import Thresholds
from gapscope.operators import clustering as cl

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, TWINS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if isinstance(v, pd.Timestamp) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in TWINS:
        assert cols and rows is not None
        return
    cur = con.execute(TWINS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert ordered(rows) == ordered(want)


def test_fits_are_not_cut_short(spark, monkeypatch):
    """Every fit of the registered queries has the operators' starts and rounds; the fits themselves are cut here."""
    asked = []
    real = cl.fit_kmeans

    def fit(df, k, *, tries=15, max_iter=500, seed=cl.SEED):
        asked.append((k, tries, max_iter))
        return real(df, k, tries=1, max_iter=1, seed=seed)

    monkeypatch.setattr(cl, "fit_kmeans", fit)
    for name in ("clu_kmeans", "clu_sweep", "vec_approximate_top_k"):
        QUERIES[name](spark, FOLDER)
    assert asked == [(8, 15, 500), *[(k, 5, 300) for k in Thresholds.k_values], (10, 15, 500)]


def test_enough_tickets_counts_all(spark):
    plan = QUERIES["clu_enough_tickets"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_flagship(spark):
    out = entry_points.entry(spark)
    assert out.count() > 0 and "coverage" in out.columns


def upper_plan(spark, name):
    """The optimised plan down to its first join, that join included."""
    lines = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return lines[: next(i for i, line in enumerate(lines) if "Join " in line) + 1]


@pytest.mark.parametrize("name", ["dash_tickets", "dash_tickets_of_clusters", "src_run_tickets"])
def test_texts_are_digested_before_they_are_moved(spark, name):
    assert not any("md5" in line.replace("_md5", "") for line in upper_plan(spark, name))


@pytest.mark.parametrize("name", ["art_evidence", "lbl_samples", "lbl_prompts"])
def test_picked_ids_are_sent_to_the_texts(spark, name):
    lines = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Join " in line and "strategy=broadcast" in line for line in lines)
