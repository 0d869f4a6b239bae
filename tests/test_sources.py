"""Readers, catalog, sinks, release plan and late rows on files written by the test."""

import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.plans import release
from sensorframe.sources import catalog, readers, sinks
from sensorframe.streaming import live


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_readers(spark, tmp_path):
    write(tmp_path / "w" / "data.csv", "timestamp,wrench.force.x,wrench.force.y,extra\n10,1.5,NaN,a\n20,bad,2.0,b\n")
    got = readers.read_csv(spark, str(tmp_path / "w"), readers.SCHEMAS["gripper", "wrench"]).orderBy("timestamp").collect()
    assert [(r.timestamp, r.wrench_force_x, r.wrench_force_y) for r in got] == [(10, 1.5, None), (20, None, 2.0)]
    (tmp_path / "p").mkdir()
    with gzip.open(tmp_path / "p" / "points.csv.gz", "wt") as f:
        f.write("px_world,py_world\n1,2\n")
    assert readers.read_csv(spark, str(tmp_path / "p")).collect()[0].px_world == "1"
    write(tmp_path / "odo.txt", " 1700000000000000001  1 2 3  0 0 0 1\nbroken line\n")
    odo = readers.read_odometry(spark, str(tmp_path / "odo.txt")).collect()
    assert len(odo) == 1 and odo[0].ts == 1700000000000000001 and odo[0].qw == 1.0
    write(tmp_path / "win" / "a.json", json.dumps({"window_0": {"start_ns": 1, "end_ns": 5, "duration_s": 4e-9}, "window_2": {"start_ns": 7, "end_ns": 9, "duration_s": 2e-9, "index": 3}}))
    write(tmp_path / "win" / "b.json", "not json")
    win = {r.name: (r.start_ns, r["index"]) for r in readers.read_windows(spark, str(tmp_path / "win")).collect()}
    assert win == {"window_0": (1, None), "window_2": (7, 3)}
    write(tmp_path / "cue" / "a.csv", "AXIS_NAME; CUE_START ;CUE_END;VERIFICATION\n1;10;20;ok\n;1;2;no\n")
    write(tmp_path / "cue" / "b.csv", "axis,cue_start,cue_end\nleft,x,7\n")
    cue = sorted((r.axis, r.cue_start, r.cue_end, r.verification) for r in readers.read_cues(spark, str(tmp_path / "cue")).collect())
    assert cue == [("1", 10, 20, "ok"), ("left", None, 7, "")]
    write(tmp_path / "pairs.txt", "('gripper', 'iphone_1')\n(10, 7)\n\n(20, 18)\n")
    pairs = readers.read_event_pairs(spark, str(tmp_path / "pairs.txt")).collect()
    assert [(r.sensor_1, r.sensor_2, r.ts_1, r.ts_2) for r in pairs] == [("gripper", "iphone_1", 10, 7), ("gripper", "iphone_1", 20, 18)]
    write(tmp_path / "meta.json", json.dumps({"frameTimestamps": [0.5, 1.0], "poses": [[0, 0, 0, 1, 1, 2, 3], [0, 0, 0, 1, 4, 5, 6]], "K": [400, 0, 0, 0, 410, 0, 320, 240, 1], "w": 640, "h": 480, "fps": 30}))
    poses, calib = readers.read_phone(spark, str(tmp_path / "meta.json"))
    assert [(r.ts, r.tx) for r in poses.orderBy("ts").collect()] == [(500_000_000, 1.0), (1_000_000_000, 4.0)]
    k = calib.collect()[0]
    assert (k.fx, k.fy, k.cx, k.cy, k.w) == (400.0, 410.0, 320.0, 240.0, 640)
    write(tmp_path / "pano.txt", "Ldr Image\n  position = [1.0, 2.0, 3.0];\n orientation = [0, 0, 0, 1];\nHdr Image\n position = [4, 5, 6];\n orientation = [1, 0, 0, 0];\n")
    pano = {r.section: (r.position, r.orientation) for r in readers.read_panorama_poses(spark, str(tmp_path / "pano.txt")).collect()}
    assert pano == {"LDR": ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0, 1.0]), "HDR": ([4.0, 5.0, 6.0], [1.0, 0.0, 0.0, 0.0])}
    write(tmp_path / "s" / "k" / "1" / "label.txt", "Drawer\n")
    write(tmp_path / "s" / "k" / "1" / "force.txt", "12.5\n")
    write(tmp_path / "s" / "k" / "2" / "label.txt", "Door\n")
    smp = readers.read_force_samples(spark, str(tmp_path / "s")).collect()
    assert [(r.scene, r.sample, r.label, r.force) for r in smp] == [("k", "1", "Drawer", 12.5)]
    write(tmp_path / "calib.yaml", "cam0:\n  T_cam_imu:\n  - [1.0, 0.0, 0.0, -0.5]\n  - [0.0, 1.0, 0.0, 2e-3]\n  - [0.0, 0.0, 1.0, 0.0]\n  - [0.0, 0.0, 0.0, 1.0]\n  intrinsics: [400.0, 401.0, 320.5, 240.5]\n  resolution: [640, 480]\n  timeshift_cam_imu: -0.0125\ncam1:\n  intrinsics: [1.0, 2.0, 3.0, 4.0]\n  resolution: [64, 48]\n")
    cal = {r.camera: r for r in readers.read_calibration(spark, str(tmp_path / "calib.yaml")).collect()}
    assert cal["cam0"].T[3] == -0.5 and cal["cam0"].T[7] == 2e-3 and len(cal["cam0"].T) == 16 and cal["cam0"].timeshift_s == -0.0125
    assert cal["cam1"].intrinsics == [1.0, 2.0, 3.0, 4.0] and cal["cam1"].w == 64


def test_catalog(spark, tmp_path):
    for rel in (
        "lab_1/gripper/aria_human/lab_1_1-8_take.vrs", "lab_1/gripper/aria_human/._lab_1_1-8_take.vrs", "lab_1/gripper/iphone_2/lab_1_1-8-9_take.mov",
        "lab_1/spot/gripper/lab_1_1_take.bag", "lab_1/hand/iphone_1/notes.txt", "lab_1/gripper/gripper/rgb/camera_rgb/100.png", "lab_1/gripper/gripper/rgb/camera_rgb/x.png",
        "lab_1/gripper/gripper/wrench/data.csv", "lab_1/gripper/aria_human/camera_depth/5.npy", "lab_1/gripper/interaction_splitting_info_1-3-5.json",
    ):
        write(tmp_path / rel, "x")
    files = catalog.with_levels(catalog.list_files(spark, str(tmp_path)), str(tmp_path))
    cat = catalog.catalog(files)
    rows = sorted((r.recorder, r.interaction_index) for r in cat.collect())
    assert rows == [("aria_human", "1-8"), ("iphone_2", "1-8-9")]
    assert catalog.query_catalog(cat, index="1-8").count() == 2 and catalog.query_catalog(cat, recorder="iphone").count() == 1
    assert catalog.container_files(files, cat).count() == 1
    assert sorted((r.dir.rsplit("/", 1)[-1], r.kind) for r in catalog.extracted_streams(files).collect()) == [("camera_depth", "frames"), ("camera_rgb", "frames"), ("wrench", "csv")]
    assert [r.kind for r in catalog.extracted_streams(files, sensor_streams=True).collect()] == ["csv"]
    assert catalog.extracted_streams(files, image_streams=True, sensor_streams=True).count() == 2
    assert [r.interaction_index for r in catalog.window_files(files, index="3").collect()] == ["1-3-5"]
    assert sorted(r.ts for r in catalog.frames(files).collect()) == [5, 100]


def test_release_plan(spark):
    meg = 1024 * 1024
    tree = {
        "readme.md": 10, "big.json": 17 * meg, ".hidden": 1, "gripper/notes.txt": 5, "gripper/raw.bin": 9,
        "gripper/stream/1.png": 3, "gripper/stream/2.png": 3,
        "gripper/deep/left/1.png": 1, "gripper/deep/right/sub/1.png": 1, "gripper/deep/right/info.json": 2, "gripper/deep/extra.bin": 4,
        "leica/12/scan/1.e57": 8, "hand/flat/meta.json": 1, "hand/flat/cam (old)/1.png": 2, "hand/flat/cam (new)/1.png": 2, "hand/flat/inner/deeper/1.png": 2,
        "wrist/__MACOSX/x.png": 1,
    }
    rows = [("lab", p, s, False, False) for p, s in tree.items()]
    dirs = {"/".join(p.split("/")[:i]) for p in tree for i in range(1, p.count("/") + 1)}
    rows += [("lab", d, 0, True, False) for d in dirs] + [("lab", "hand/link", 0, True, True), ("lab", "hand/link/a.png", 1, False, False)]
    files = spark.createDataFrame(rows, "location string, path string, size long, is_dir boolean, is_symlink boolean")
    got = {(r.source, r.destination, r.action_type) for r in release.plan(files).collect()}
    assert got == {
        ("readme.md", "readme.md", "root_metadata_copy"), ("gripper/notes.txt", "gripper/notes.txt", "module_metadata_copy"),
        ("gripper/stream", "gripper/stream.zip", "module_stream_archive"), ("gripper/deep/left", "gripper/deep/left.zip", "nested_stream_archive"),
        ("gripper/deep/right/sub", "gripper/deep/right/sub.zip", "nested_stream_archive"), ("gripper/deep/right/info.json", "gripper/deep/right/info.json", "nested_metadata_copy"),
        ("gripper/deep/extra.bin", "gripper/deep/extra.bin.zip", "nested_direct_file_archive"), ("leica/12/scan", "leica/12/scan.zip", "nested_stream_archive"),
        ("hand/flat/meta.json", "hand/flat/meta.json", "nested_metadata_copy"), ("hand/flat/cam (old)", "hand/flat/cam_old.zip", "nested_stream_archive"),
        ("hand/flat/cam (new)", "hand/flat/cam_new.zip", "nested_stream_archive"), ("hand/flat/inner", "hand/flat/inner.zip", "nested_stream_archive"),
    }


def test_stems_that_meet(spark):
    names = ["a (1)", "a (2)", "a_1", "a_1 (x)", "b (z)", "a 1", "c!", "c?", "(("]
    df = spark.createDataFrame([("m", n) for n in names], "parent string, name string")
    got = {r.name: r.output_stem for r in release.resolve_stems(df, ["parent"]).collect()}
    # Taken in turn by name: each wants its clean stem when nobody shares it, else its raw one, then a free number.
    import re

    def clean(n, strip):
        s = re.sub(r"\s+\([^)]*\)\s*$", "", n).strip() if strip else n
        s = (s or n).replace("(", " ").replace(")", " ")
        return re.sub("_+", "_", re.sub("[^A-Za-z0-9._-]+", "_", s)).strip("._") or "archive"

    soft = [clean(n, True) for n in names]
    used, want = set(), {}
    for n in sorted(names, key=str.casefold):
        stem = clean(n, True) if soft.count(clean(n, True)) == 1 else clean(n, False)
        out, i = stem, 2
        while out in used:
            out, i = f"{stem}_{i}", i + 1
        used.add(out)
        want[n] = out
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_stems_by_sets(spark, seed):
    """Families whose folders want the same stems and each other's numbers, in any order of names, as the folders take them in turn."""
    pick = random.Random(seed)
    pool = [f"x_{i}" for i in range(1, 25)] + ["x", "x", "x", "x_2_2", "x_2_3", "x_2_3_2", "x_02", "x_3_4", "y", "y_2", "z_1234567890123456789"]
    pool += ["x"] * (40 if seed == 2 else 0)
    rows = []
    for home in ("m", "n", None):
        for name in pick.sample(range(10000), 60):
            want = pick.choice(pool)
            rows.append((home, f"N{name}" if name % 2 else f"n{name}", want, want[0]))
    df = spark.createDataFrame(rows, "parent string, name string, _want string, _root string").withColumn("_fold", F.lower("name"))
    got = {(r.parent, r.name): r.output_stem for r in release._name_by_sets(df, ["parent"]).collect()}
    want = {}
    for home in ("m", "n", None):
        used = set()
        for name, stem in sorted(((n, w) for h, n, w, _ in rows if h == home), key=lambda r: (r[0].lower(), r[0])):
            out, i = stem, 2
            while out in used:
                out, i = f"{stem}_{i}", i + 1
            used.add(out)
            want[home, name] = out
    assert got == want


def test_open_slots_close_in(spark):
    """Slots that hang on those before them: decided round by round as one after the other."""
    pick = random.Random(4)
    rows, want = [], {}
    for g in range(6):
        skipped = 0
        for r in range(10):
            d = pick.randint(-1, 4) if g % 2 else r // 2 - r % 2
            rows.append((g, 2 + 2 * r, d, r))
            want[g, 2 + 2 * r] = skipped <= d
            skipped += skipped <= d
    df = spark.createDataFrame(rows, "g int, _i bigint, _d bigint, _r bigint")
    assert {(r.g, r._i): r._skip for r in release._decide(df, ["g"]).collect()} == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 2.0)], "k string, ts long, v double")
    path = str(tmp_path / "t")
    sinks.write_stream_table(df, path, ["k"])
    sinks.write_stream_table(df.limit(0), path, ["k"])
    assert spark.read.parquet(path).count() == 2
    sinks.write_stream_table(df.where("k = 'a'").withColumn("v", F.lit(9.0)), path, ["k"], overwrite=True)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9.0), ("b", 2.0)]
    art = spark.createDataFrame([("z.zip", "zip_archive", 2048, "z", ""), ("a.json", "metadata_file", 5, "a.json", "")], "relative_path string, artifact_type string, size_bytes long, source_relative_path string, note string")
    sinks.write_manifest(art, str(tmp_path / "m"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "m")).collect()
    assert {(r.relative_path, r.size_human) for r in rows} == {("z.zip", "2.0 KiB"), ("a.json", "5 B")}


def test_late_rows_go_aside(spark, tmp_path):
    src = tmp_path / "in"
    schema = "ts long"
    writer = None
    for i, times in enumerate(([10, 100], [95, 20, 150])):
        spark.createDataFrame(pd.DataFrame({"ts": times})).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        writer = live.split_late(stream, str(tmp_path / "main"), str(tmp_path / "late"), str(tmp_path / "marks"), 30)
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "main")).collect()) == [10, 95, 100, 150]
    assert [r.ts for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [20]
