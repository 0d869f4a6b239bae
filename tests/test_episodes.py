"""Forces of frames are rounded before frames meet windows: a pair of both must cost no more than its row."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def _tables(folder):
    at = datetime(2024, 1, 1)
    kinds = ["view", "click", "error", "signup"]
    events = {
        "event_id": range(240), "ts": [at + timedelta(seconds=5 * i) for i in range(240)], "user_id": [i % 17 for i in range(240)],
        "event_type": [kinds[i % 4] for i in range(240)], "value": [1e-7 + i / 3 if i % 4 != 3 else float(i % 8 - 3) for i in range(240)],
    }
    # Order dates fold by 30 days: two of these fold to the day of the events. Several orders share an extent, two an id.
    days = [datetime(1970, 1, 1) + timedelta(days=d) for d in (30 * 300, 30 * 304, 30 * 304 + 1)]
    orders = {"o_orderkey": [*range(60), 60, 60], "o_orderdate": [days[i % 3] for i in range(62)]}
    times = pa.timestamp("us")
    event_types = [pa.int64(), times, pa.int64(), pa.string(), pa.float64()]
    for name, cols, types in (("events", events, event_types), ("orders", orders, [pa.int64(), times])):
        pq.write_table(pa.table({c: pa.array(list(v), t) for (c, v), t in zip(cols.items(), types)}), folder / f"{name}.parquet")


def test_forces_are_rounded_once_per_frame(spark, tmp_path):
    _tables(tmp_path)
    out = entry.queries()["force_episodes"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    cols = ["window_id", "event_id", "prompt", "force_along"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()['force_episodes']})").fetchall()
    got = [tuple(r) for r in out.select(*cols).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)
    assert any(f != round(f, 2) for *_, f in got)
    # Rounding goes through decimal text; before, every pair of a frame and a window paid for it.
    assert "round(" not in out._jdf.queryExecution().optimizedPlan().toString()
