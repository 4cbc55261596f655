import pathlib

import pytest

from tandemframe.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(float(r[k]), 5) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    """Every registered query of the core, the whole result."""
    df = Q.queries()[name](spark, FOLDER)
    found = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = shown([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in found.fetchall()], columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == want


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
