"""Running a query and its SQL over one data directory and comparing them."""

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(d: str = DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(d):
        con.execute(f"CREATE VIEW {name[:-8]} AS FROM '{d}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(f"{float(x):.12g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
