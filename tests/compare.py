"""Rows of a query against those of its SQL, in any order, columns by name."""

import math

DATA = "/root/testdata"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def assert_equal(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert got == want
