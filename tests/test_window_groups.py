"""Windows that crowd one time cell are met in groups, so tasks are dealt by the number of windows."""

import pandas as pd
from pyspark.sql import functions as F

from sensorframe.operators import intervals
from sensorframe.operators.ordered import Series


def test_full_cells_are_met_in_groups(spark, monkeypatch):
    monkeypatch.setattr(intervals, "LISTED_WINDOWS", 4)
    monkeypatch.setattr(intervals, "GROUPED_WINDOWS", 16, raising=False)
    rows = pd.DataFrame({"rig": [0, 1] * 60, "ts": [i // 2 * 5 for i in range(120)], "id": range(120)})
    windows = pd.DataFrame([(i % 2, i, 20 + i % 3, 90 + i % 5) for i in range(300)] + [(1, 300, 200, 400), (2, 301, 0, 9)], columns=["rig", "w", "start_ns", "end_ns"])
    df, ws = spark.createDataFrame(rows), spark.createDataFrame(windows)
    ws = ws.union(spark.createDataFrame([(None, 302, 0, 9)], ws.schema))
    out = intervals.window_members(df, ws, Series(["rig"], cell_ns=1000), ["w"], width_ns=64).select("id", "w", F.spark_partition_id().alias("task"))
    got = out.toPandas()
    both = rows.merge(windows, on="rig")
    want = both[(both.ts >= both.start_ns) & (both.ts <= both.end_ns)]
    assert sorted(zip(got.id, got.w)) == sorted(zip(want.id, want.w))
    # 150 windows of a rig lie in each of two cells: one task for a cell made them all before.
    assert got.groupby("task").size().max() < 0.25 * len(got)
