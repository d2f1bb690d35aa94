"""Run registered queries next to their SQL checks: ``python tools/check.py sf_dir [names...]``."""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from crestline.plans.base import ORACLES, QUERIES  # noqa: E402
from crestline.plans import registry  # noqa: E402,F401
from crestline.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf: str, name: str) -> str:
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if name not in ORACLES:
        return f"rows {len(got)}" if got else "EMPTY"
    rel = con.sql(ORACLES[name])
    wanted_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(rel.columns) != columns:
        return f"COLUMNS {sorted(rel.columns)} != {columns}"
    if types != wanted_types:
        return f"TYPES {[(c, types[c], wanted_types[c]) for c in columns if types[c] != wanted_types[c]]}"
    at = {c: i for i, c in enumerate(rel.columns)}
    want = sorted((tuple(row[at[c]] for c in columns) for row in rel.fetchall()), key=repr)
    if got != want:
        only_got, only_want = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
        return (f"DIFF rows {len(got)} vs {len(want)}, {len(only_got)} only here {only_got[:2]}, "
                f"{len(only_want)} only in SQL {only_want[:2]} columns {columns}")
    return f"ok {len(got)}" if got else "EMPTY"


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            result = "ERROR " + str(error)[:600]
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:24s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
