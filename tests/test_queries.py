from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from seatwise.plans import relational

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def rows(spark, request):
    """Futures of the chosen queries' rows: planning takes most of the time here, so several run at once."""
    names = [i.callspec.params["name"] for i in request.session.items if i.path == request.path]

    def run(name):
        df = relational.QUERIES[name](spark, FOLDER)
        cols = sorted(df.columns)
        return cols, sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in names}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(relational.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(rows, db, name):
    cols, ours = rows[name].result()
    found = db.execute(relational.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert sorted(names) == cols
    assert ours == theirs
