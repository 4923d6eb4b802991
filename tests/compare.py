"""Order-insensitive comparison of a Spark query with its DuckDB statement: integers, decimals and texts exactly, floats alone
to eight digits."""

import math
from decimal import Decimal


def _norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, Decimal):
        return str(v.normalize())
    return str(v)


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted([_norm(r[c]) for c in columns] for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([_norm(dict(zip(names, r, strict=True))[c]) for c in columns] for r in result.fetchall())
    assert got == want
