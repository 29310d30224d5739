"""Registered queries against their SQL on tables with large keys, long pages and references that end in digits."""

import duckdb
import pytest

import __spark_entry__ as entry


def differing(spark, folder, name, **tables):
    """Rows of Spark and of the SQL that the other lacks; ``tables`` are SQL texts over DuckDB."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got, want = sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))), sorted(map(str, cur.fetchall()))
    assert got
    return [x for x in got if x not in set(want)], [x for x in want if x not in set(got)], len(got) - len(want)


@pytest.mark.parametrize("name", ["heading_ranks", "layer_roles", "layer_texts"])
def test_positions_beyond_the_whole_numbers_of_a_double(spark, tmp_path, name):
    lines = "SELECT * REPLACE (l_partkey + 1180000 AS l_partkey) FROM '/root/testdata/sf0.001/lineitem.parquet'"
    assert differing(spark, tmp_path, name, lineitem=lines) == ([], [], 0)


def test_bands_past_the_ninety_ninth(spark, tmp_path):
    pages = "SELECT CAST(1 AS BIGINT) AS page_id, 'http://a.example/x' AS url, repeat('<p>7</p>', 1003) AS html"
    assert differing(spark, tmp_path, "section_bands", pages=pages) == ([], [], 0)


def test_references_keep_their_last_digits(spark, tmp_path):
    pages = "SELECT i AS page_id, 'http://a.example/' || i AS url, '<head></head><body>' || repeat('<a href=\"/x\">x</a>', CAST(i AS INTEGER)) || '<article>' || i || '</article></body>' AS html FROM range(60) t(i)"
    assert differing(spark, tmp_path, "check_asset_refs", pages=pages) == ([], [], 0)
