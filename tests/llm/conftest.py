import duckdb
import pytest


@pytest.fixture
def oracle():
    """Rows of DuckDB SQL over the given tables (name -> Spark DataFrame), each as a dict."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return [dict(zip(names, row)) for row in got.fetchall()]

    return run


def ordered(rows):
    rows = [r if isinstance(r, dict) else r.asDict() for r in rows]
    return sorted(rows, key=lambda r: str(sorted(r.items())))


@pytest.fixture
def same():
    def check(df, expected):
        assert ordered(df.collect()) == ordered(expected)

    return check
