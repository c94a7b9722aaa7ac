"""Named queries against their SQL, on one folder of tables."""

import math
import re
import sys
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        at = f"{f}/*.parquet" if f.is_dir() else f
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def _plain(x):
    if isinstance(x, Decimal):
        return float(x) if x % 1 else int(x)
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """What differs: nothing, names, or the first rows on either side alone."""
    got, want = query(spark, sf_dir), con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    if a == b:
        return None if a else "no rows on either side"
    left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} and {len(b)} rows; only here {left[:4]}; only in SQL {right[:4]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import time

    import __spark_entry__
    from tagloom.session import session

    spark = session("oracles", cores=8, partitions=8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    folder = sys.argv[1]
    con = connection(folder)
    own = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        if re.search(sys.argv[2], name):
            began = time.time()
            try:
                said = differences(spark, con, own[name], sql, folder) or "same"
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"{name} {time.time() - began:.1f}s {said}", flush=True)
