"""Registered queries against their SQL on the smallest tables (a spread; tools/compare.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from quiltlens.plans.registry import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
PICKED = ["template_inventory", "harvest_links", "resolve_hrefs", "nav_state", "merge_meta", "footer_defects", "heading_ranks", "layer_roles", "similar_documents", "tally", "merge_near_colors",
          "original_images", "hover_recipes", "sibling_overlap", "split_headings", "geometry_diff", "scorecard", "pending_predecessors", "session_state"]


def _norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES and set(QUERIES) == set(ORACLE)  # the optional queries have tests of their own where SQL cannot express them


@pytest.mark.parametrize("name", PICKED)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
