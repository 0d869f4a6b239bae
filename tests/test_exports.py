"""Exported rows: hand-eye poses and landmark annotations."""

import json

from pyspark.sql import functions as F

from sensorframe.plans import hands
from sensorframe.sources import sinks


def test_hand_eye_csv(spark, tmp_path):
    df = spark.createDataFrame([(2_500_000_000, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0), (500_000_000, 4.0, 5.0, 6.0, 0.0, 0.0, 0.0, 1.0)], "ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    sinks.write_hand_eye(df, str(tmp_path / "h"))
    rows = sorted(r.value for r in spark.read.text(str(tmp_path / "h")).collect())
    assert rows == ["0.5,4.0,5.0,6.0,0.0,0.0,0.0,1.0", "2.5,1.0,2.0,3.0,0.0,0.0,0.0,1.0"]


def test_annotation(spark):
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((i * 10.0).alias("u"), (i * 1.0).alias("v")))
    df = spark.range(1).select(points.alias("p"))
    box = hands.keypoint_box(F.col("p"), 150, 100)
    ones = F.array_repeat(F.lit(1.0), 21)
    out = df.select(
        hands.annotation_json(F.col("p"), box, ones, F.array_repeat(F.lit(0.0), 21), ones, F.col("p")).alias("j"), hands.reorder(F.col("p")).alias("r"),
    ).collect()[0]
    ann = json.loads(out.j)
    assert len(ann["keypoints"]) == 21 and ann["bbox"]["x0"] == 0 and ann["bbox"]["x1"] == 149 and ann["bbox"]["y1"] == 20
    assert [p.v for p in out.r[:3]] == [5.0, 20.0, 6.0]
