"""Geometry columns over ``embeddings``: elements 1-3 a point, 4-7 a quaternion, 8-16 further vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.operators import interp, metrics
from sensorframe.operators.ordered import Series
from sensorframe.queries.registry import query, r6, table

# Elements as doubles: p point, q quaternion, v and w two more vectors.
_E = """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz,
 embedding[4]::DOUBLE AS q1, embedding[5]::DOUBLE AS q2, embedding[6]::DOUBLE AS q3, embedding[7]::DOUBLE AS q4,
 embedding[8]::DOUBLE AS vx, embedding[9]::DOUBLE AS vy, embedding[10]::DOUBLE AS vz, embedding[11]::DOUBLE AS wx, embedding[12]::DOUBLE AS wy, embedding[13]::DOUBLE AS wz FROM embeddings),
u AS (SELECT *, sqrt(q1*q1+q2*q2+q3*q3+q4*q4) AS qn FROM e), n AS (SELECT * EXCLUDE (q1,q2,q3,q4), q1/qn AS qx, q2/qn AS qy, q3/qn AS qz, q4/qn AS qw FROM u),
m AS (SELECT *, 1-2*(qy*qy+qz*qz) AS m0, 2*(qx*qy-qz*qw) AS m1, 2*(qx*qz+qy*qw) AS m2, 2*(qx*qy+qz*qw) AS m3, 1-2*(qx*qx+qz*qz) AS m4, 2*(qy*qz-qx*qw) AS m5,
 2*(qx*qz-qy*qw) AS m6, 2*(qy*qz+qx*qw) AS m7, 1-2*(qx*qx+qy*qy) AS m8 FROM n)"""
_T = (0.1, -0.2, 1.5)


def _vec(spark, sf):
    e = F.col("embedding")
    names = ["px", "py", "pz", "qx", "qy", "qz", "qw", "vx", "vy", "vz", "wx", "wy", "wz"]
    return table(spark, sf, "embeddings").select("vec_id", "label", *[e[i].cast("double").alias(n) for i, n in enumerate(names)])


def _cols(*names):
    return [F.col(n) for n in names]


def _axes():
    """Point, quaternion and two more vectors as columns."""
    return _cols("px", "py", "pz"), _cols("qx", "qy", "qz", "qw"), _cols("vx", "vy", "vz"), _cols("wx", "wy", "wz")


def _out(df, ids, cols):
    return df.select(*ids, *[r6(c).alias(n) for n, c in cols.items()])


@query("rigid_transform", f"""{_E} SELECT vec_id, round(m0*px+m1*py+m2*pz+{_T[0]}, 6)+0.0 AS x, round(m3*px+m4*py+m5*pz+({_T[1]}), 6)+0.0 AS y, round(m6*px+m7*py+m8*pz+{_T[2]}, 6)+0.0 AS z FROM m""")
def rigid_transform(spark, sf):
    P, Q, _, _ = _axes()
    p = g.transform(g.quat_to_matrix(Q), g.lits(_T), P)
    return _out(_vec(spark, sf), ["vec_id"], dict(zip("xyz", p)))


@query("inverse_transform", f"""{_E}, d AS (SELECT vec_id, px-{_T[0]} AS a, py-({_T[1]}) AS b, pz-{_T[2]} AS c, m0, m1, m2, m3, m4, m5, m6, m7, m8 FROM m)
SELECT vec_id, round(m0*a+m3*b+m6*c, 6)+0.0 AS x, round(m1*a+m4*b+m7*c, 6)+0.0 AS y, round(m2*a+m5*b+m8*c, 6)+0.0 AS z FROM d""")
def inverse_transform(spark, sf):
    P, Q, _, _ = _axes()
    r, t = g.invert(g.quat_to_matrix(Q), g.lits(_T))
    return _out(_vec(spark, sf), ["vec_id"], dict(zip("xyz", g.transform(r, t, P))))


@query("compose_transform", f"""{_E}, a AS (SELECT *, m0*px+m1*py+m2*pz+vx AS b1, m3*px+m4*py+m5*pz+vy AS b2, m6*px+m7*py+m8*pz+vz AS b3 FROM m)
SELECT vec_id, round(m0*b1+m1*b2+m2*b3+vx, 6)+0.0 AS x, round(m3*b1+m4*b2+m5*b3+vy, 6)+0.0 AS y, round(m6*b1+m7*b2+m8*b3+vz, 6)+0.0 AS z FROM a""")
def compose_transform(spark, sf):
    P, Q, V, _ = _axes()
    # The transform after itself, applied to the point.
    m = g.quat_to_matrix(Q)
    r, t = g.compose(m, V, m, V)
    return _out(_vec(spark, sf), ["vec_id"], dict(zip("xyz", g.transform(r, t, P))))


@query("rotation_forms", f"""{_E} SELECT vec_id, round(sign(CASE WHEN qw<>0 THEN qw ELSE 1 END)*qx, 5)+0.0 AS qx, round(sign(CASE WHEN qw<>0 THEN qw ELSE 1 END)*qy, 5)+0.0 AS qy,
 round(sign(CASE WHEN qw<>0 THEN qw ELSE 1 END)*qz, 5)+0.0 AS qz, round(abs(qw), 5)+0.0 AS qw, round(atan2(m7, m8), 5)+0.0 AS roll, round(asin(greatest(least(-m6, 1), -1)), 5)+0.0 AS pitch, round(atan2(m3, m0), 5)+0.0 AS yaw FROM m""")
def rotation_forms(spark, sf):
    _, Q, _, _ = _axes()
    # Quaternion to matrix to Euler to matrix and back to the quaternion with non-negative scalar part.
    euler = g.matrix_to_euler(g.quat_to_matrix(Q))
    rows = _vec(spark, sf).select("vec_id", *[c.alias(n) for c, n in zip(euler, ("roll", "pitch", "yaw"))])
    q = g.matrix_to_quat(g.euler_to_matrix(_cols("roll", "pitch", "yaw")))
    rows = rows.select("vec_id", "roll", "pitch", "yaw", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))])
    s = F.when(F.col("qw") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return rows.select(
        "vec_id", *[r6(F.col(n), 5).alias(n) for n in ("roll", "pitch", "yaw")], *[r6(s * F.col(n), 5).alias(n) for n in ("qx", "qy", "qz", "qw")]
    )


@query("quaternion_product", f"""{_E}, r AS (SELECT vec_id, qx, qy, qz, qw, sin(0.25) AS bz, cos(0.25) AS bw FROM n)
SELECT vec_id, round(qx*bw + qy*bz, 6)+0.0 AS x, round(qy*bw - qx*bz, 6)+0.0 AS y, round(qw*bz + qz*bw, 6)+0.0 AS z, round(qw*bw - qz*bz, 6)+0.0 AS w FROM r""")
def quaternion_product(spark, sf):
    _, Q, _, _ = _axes()
    import math

    q = g.quat_product(g.unit(Q), g.lits((0.0, 0.0, math.sin(0.25), math.cos(0.25))))
    return _out(_vec(spark, sf), ["vec_id"], dict(zip("xyzw", q)))


_K = (400.0, 410.0, 320.0, 240.0)


@query("pinhole_project", f"""{_E}, c AS (SELECT vec_id, 400.0*px/pz+320.0 AS u, 410.0*py/pz+240.0 AS v FROM e WHERE pz > 1e-6)
SELECT e.vec_id, CASE WHEN u >= 0 AND u < 640 AND v >= 0 AND v < 480 THEN round(u, 5)+0.0 END AS u, CASE WHEN u >= 0 AND u < 640 AND v >= 0 AND v < 480 THEN round(v, 5)+0.0 END AS v FROM e LEFT JOIN c USING (vec_id)""")
def pinhole_project(spark, sf):
    P, _, _, _ = _axes()
    u, v = g.project_safe(g.lits(_K), P, 640, 480)
    return _vec(spark, sf).select("vec_id", r6(u, 5).alias("u"), r6(v, 5).alias("v"))


@query("behind_camera", f"{_E} SELECT vec_id, round(m6*px+m7*py+m8*pz+0.1, 6)+0.0 AS z FROM m WHERE m6*px+m7*py+m8*pz+0.1 > 1e-6")
def behind_camera(spark, sf):
    P, Q, _, _ = _axes()
    z = g.transform(g.quat_to_matrix(Q), g.lits((0, 0, 0.1)), P)[2]
    return _vec(spark, sf).withColumn("z", z).where("z > 1e-6").select("vec_id", r6("z").alias("z"))


@query("image_bounds_filter", f"""{_E}, c AS (SELECT vec_id, label, pz > 1e-6 AND 400.0*px/pz+320.0 >= 0 AND 400.0*px/pz+320.0 < 640 AND 410.0*py/pz+240.0 >= 0 AND 410.0*py/pz+240.0 < 480 AS a,
 vz > 1e-6 AND 400.0*vx/vz+320.0 >= 0 AND 400.0*vx/vz+320.0 < 640 AND 410.0*vy/vz+240.0 >= 0 AND 410.0*vy/vz+240.0 < 480 AS b FROM e)
SELECT vec_id, label FROM c WHERE a AND b""")
def image_bounds_filter(spark, sf):
    P, _, V, _ = _axes()
    # Wrist and palm both inside the image.
    k = g.lits(_K)
    both = g.project_safe(k, P, 640, 480)[0].isNotNull() & g.project_safe(k, V, 640, 480)[0].isNotNull()
    return _vec(spark, sf).where(both).select("vec_id", "label")


@query("bilinear_depth", """WITH b AS (SELECT vec_id, embedding AS v, abs(embedding[1]::DOUBLE)*25 AS u, abs(embedding[2]::DOUBLE)*25 AS w FROM embeddings),
f AS (SELECT *, CAST(floor(u) AS INT) AS u0, CAST(floor(w) AS INT) AS v0, u-floor(u) AS du, w-floor(w) AS dv FROM b),
c AS (SELECT *, CASE WHEN u0+1 < 8 AND v0+1 < 8 THEN 1 ELSE 0 END AS ok, v[v0*8+u0+1]::DOUBLE AS a00, v[v0*8+u0+2]::DOUBLE AS a10, v[(v0+1)*8+u0+1]::DOUBLE AS a01, v[(v0+1)*8+u0+2]::DOUBLE AS a11 FROM f),
s AS (SELECT vec_id, ok, CASE WHEN a00 > 0 THEN (1-du)*(1-dv) ELSE 0 END AS w00, CASE WHEN a10 > 0 THEN du*(1-dv) ELSE 0 END AS w10, CASE WHEN a01 > 0 THEN (1-du)*dv ELSE 0 END AS w01, CASE WHEN a11 > 0 THEN du*dv ELSE 0 END AS w11,
 coalesce(a00,0) AS a00, coalesce(a10,0) AS a10, coalesce(a01,0) AS a01, coalesce(a11,0) AS a11 FROM c)
SELECT vec_id, CASE WHEN ok = 1 AND w00+w10+w01+w11 > 0 THEN round((w00*a00+w10*a10+w01*a01+w11*a11)/(w00+w10+w01+w11), 6)+0.0 END AS depth FROM s""")
def bilinear_depth(spark, sf):
    # The 64 elements read as an 8 by 8 depth image.
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", e.alias("d"), (F.abs(e[0].cast("double")) * 25).alias("u"), (F.abs(e[1].cast("double")) * 25).alias("v"))
    z = g.bilinear(F.col("d"), F.lit(8), F.lit(8), F.col("u"), F.col("v"))
    return rows.select("vec_id", r6(z).alias("depth"))


@query("velocity_transport", f"{_E} SELECT vec_id, round(vx + wy*pz - wz*py, 6)+0.0 AS x, round(vy + wz*px - wx*pz, 6)+0.0 AS y, round(vz + wx*py - wy*px, 6)+0.0 AS z FROM e")
def velocity_transport(spark, sf):
    P, _, V, OM = _axes()
    return _out(_vec(spark, sf), ["vec_id"], dict(zip("xyz", g.transport_velocity(V, OM, P))))


@query("project_on_motion", f"""{_E}, s AS (SELECT vec_id, sqrt(vx*vx+vy*vy+vz*vz) AS nv, px*vx+py*vy+pz*vz AS d, vx, vy, vz FROM e)
SELECT vec_id, round(CASE WHEN nv > 1e-12 THEN d/nv ELSE 0 END, 6)+0.0 AS size, round(CASE WHEN nv > 1e-12 THEN d/nv*vx/nv ELSE 0 END, 6)+0.0 AS x,
 round(CASE WHEN nv > 1e-12 THEN d/nv*vy/nv ELSE 0 END, 6)+0.0 AS y, round(CASE WHEN nv > 1e-12 THEN d/nv*vz/nv ELSE 0 END, 6)+0.0 AS z FROM s""")
def project_on_motion(spark, sf):
    P, _, V, _ = _axes()
    size, part = g.along(P, V)
    return _out(_vec(spark, sf), ["vec_id"], {"size": size, **dict(zip("xyz", part))})


@query("fingertips", f"{_E} SELECT vec_id, " + ", ".join(f"round(v{a} + 0.05*m{i}, 6)+0.0 AS a{a}, round(v{a} - 0.05*m{i}, 6)+0.0 AS b{a}" for a, i in zip("xyz", (0, 3, 6))) + " FROM m")
def fingertips(spark, sf):
    _, Q, V, _ = _axes()
    m = g.quat_to_matrix(Q)
    a, b = g.fingertips([m[0], m[3], m[6]], V, F.lit(0.05))
    return _out(_vec(spark, sf), ["vec_id"], {**{f"a{k}": c for k, c in zip("xyz", a)}, **{f"b{k}": c for k, c in zip("xyz", b)}})


@query("panorama_pixel", f"""{_E}, s AS (SELECT vec_id, atan2(px, pz) AS lon, asin(greatest(least(py/sqrt(px*px+py*py+pz*pz), 1), -1)) AS lat FROM e)
SELECT vec_id, round((lon/(2*pi())+0.5)*4096, 4)+0.0 AS u, round((0.5-lat/pi())*2048, 4)+0.0 AS v FROM s""")
def panorama_pixel(spark, sf):
    P, _, _, _ = _axes()
    u, v = g.equirect_pixel(P, 4096, 2048)
    return _vec(spark, sf).select("vec_id", r6(u, 4).alias("u"), r6(v, 4).alias("v"))


@query("depth_to_world", f"""{_E}, d AS (SELECT embeddings.vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS z FROM embeddings),
c AS (SELECT vec_id, i % 8 AS u, i // 8 AS v, (i % 8 - 3.5)*z/10 AS a, (i // 8 - 3.5)*z/10 AS b, z AS c FROM d WHERE z > 0 AND (i % 8) % 2 = 0 AND (i // 8) % 2 = 0)
SELECT c.vec_id, u, v, round(m0*a+m1*b+m2*c.c+px, 6)+0.0 AS x, round(m3*a+m4*b+m5*c.c+py, 6)+0.0 AS y, round(m6*a+m7*b+m8*c.c+pz, 6)+0.0 AS z FROM c JOIN m USING (vec_id)""")
def depth_to_world(spark, sf):
    P, Q, _, _ = _axes()
    from sensorframe.operators.pointcloud import depth_points

    rows = _vec(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("values"), F.lit(8).alias("w")), "vec_id")
    out = depth_points(rows, g.lits((10, 10, 3.5, 3.5)), g.quat_to_matrix(Q), P, stride=2)
    return out.select("vec_id", "u", "v", *[r6(c).alias(c) for c in "xyz"])


@query("depth_rescale", """WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS z FROM embeddings)
SELECT vec_id, i, CASE WHEN abs(z) > 0.05 THEN round(abs(z)/1.25, 6)+0.0 ELSE 0.0 END AS z, CAST(least(round_even(abs(z)*1000, 0), 65535) AS INT) AS mm FROM d""")
def depth_rescale(spark, sf):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf, "embeddings").withColumn("e", e)
    scaled = g.rescale_depth(F.col("e"), F.lit(1.25), F.transform("e", lambda x: x > 0.05))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip(scaled.alias("z"), F.col("e"))).alias("i", "p"))
    return rows.select("vec_id", "i", r6(F.col("p.z")).alias("z"), g.depth_to_millimetres(F.col("p.e")).alias("mm"))


_POSES = f"""{_E}, p AS (SELECT vec_id*1000 AS ts, px AS tx, py AS ty, pz AS tz, qx, qy, qz, qw FROM n WHERE vec_id % 2 = 0),
l AS (SELECT vec_id, vec_id*1000 + (vec_id % 7)*150 - 900 AS ts FROM embeddings),
b AS (SELECT l.*, p.ts AS t0, p.tx AS tx0, p.ty AS ty0, p.tz AS tz0, p.qx AS x0, p.qy AS y0, p.qz AS z0, p.qw AS w0 FROM l ASOF LEFT JOIN p ON l.ts >= p.ts),
f AS (SELECT b.*, p.ts AS t1, p.tx AS tx1, p.ty AS ty1, p.tz AS tz1, p.qx AS x1, p.qy AS y1, p.qz AS z1, p.qw AS w1 FROM b ASOF LEFT JOIN p ON b.ts <= p.ts)"""
_SLERP = """, a AS (SELECT *, CASE WHEN t1 = t0 THEN 0 ELSE (ts-t0)/(t1-t0) END AS k, x0*x1+y0*y1+z0*z1+w0*w1 AS d FROM c),
th AS (SELECT *, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sg, acos(least(abs(d), 1)) AS h FROM a),
w AS (SELECT *, CASE WHEN sin(h) < 1e-8 THEN 1-k ELSE sin((1-k)*h)/sin(h) END AS s0, CASE WHEN sin(h) < 1e-8 THEN k ELSE sin(k*h)/sin(h) END AS s1 FROM th),
q AS (SELECT *, s0*x0+s1*sg*x1 AS qx, s0*y0+s1*sg*y1 AS qy, s0*z0+s1*sg*z1 AS qz, s0*w0+s1*sg*w1 AS qw FROM w)
SELECT vec_id, round((1-k)*tx0+k*tx1, 6)+0.0 AS tx, round((1-k)*ty0+k*ty1, 6)+0.0 AS ty, round((1-k)*tz0+k*tz1, 6)+0.0 AS tz,
 """ + ", ".join(f"round(q{a}/sqrt(qx*qx+qy*qy+qz*qz+qw*qw), 5)+0.0 AS q{a}" for a in "xyzw") + " FROM q"
_TRACK = Series(["rig"], cell_ns=100_000)


def _pose_tables(spark, sf):
    rows = _vec(spark, sf).withColumn("rig", F.lit(0))
    poses = rows.where("vec_id % 2 = 0").select("rig", (F.col("vec_id") * 1000).alias("ts"), F.col("px").alias("tx"), F.col("py").alias("ty"), F.col("pz").alias("tz"), "qx", "qy", "qz", "qw")
    left = rows.select("rig", "vec_id", (F.col("vec_id") * 1000 + (F.col("vec_id") % 7) * 150 - 900).alias("ts"))
    return left, poses


def _pose_out(df):
    return df.select("vec_id", *[r6(c).alias(c) for c in ("tx", "ty", "tz")], *[r6(c, 5).alias(c) for c in ("qx", "qy", "qz", "qw")])


@query("slerp_pose", _POSES + ", c AS (SELECT vec_id, ts, coalesce(t0,t1) AS t0, coalesce(t1,t0) AS t1, " + ", ".join(f"coalesce({a}0,{a}1) AS {a}0, coalesce({a}1,{a}0) AS {a}1" for a in ("tx", "ty", "tz", "x", "y", "z", "w")) + " FROM f)" + _SLERP)
def slerp_pose(spark, sf):
    left, poses = _pose_tables(spark, sf)
    return _pose_out(interp.interpolate_pose(left, poses, _TRACK))


@query("pose_at_time", _POSES + ", c AS (SELECT * FROM f)" + _SLERP)
def pose_at_time(spark, sf):
    left, poses = _pose_tables(spark, sf)
    return _pose_out(interp.interpolate_pose(left, poses, _TRACK, clamp=False))


_MT = ", ".join(f"m{i}" for i in range(9))


@query("mean_transform", f"""{_E}, d AS (SELECT a.label, a.vec_id, avg(sqrt({'+'.join(f'(a.m{i}-b.m{i})*(a.m{i}-b.m{i})' for i in range(9))})) AS d FROM m a JOIN m b ON a.label = b.label GROUP BY 1, 2),
k AS (SELECT m.*, d.d, sqrt(px*px+py*py+pz*pz) AS l FROM m JOIN d USING (label, vec_id)), q AS (SELECT label, quantile_cont(d, 0.5) AS md, quantile_cont(l, 0.5) AS ml FROM k GROUP BY label)
SELECT k.label, count(*) AS n_kept, {", ".join(f"round(avg({c}), 6)+0.0 AS {c}" for c in [f"m{i}" for i in range(9)] + ["px", "py", "pz"])}
FROM k JOIN q USING (label) WHERE d BETWEEN 0.75*md AND 1.25*md AND l BETWEEN 0.75*ml AND 1.25*ml GROUP BY k.label""")
def mean_transform(spark, sf):
    _, Q, _, _ = _axes()
    rot = [f"m{i}" for i in range(9)]
    rows = _vec(spark, sf).select("vec_id", "label", "px", "py", "pz", *[c.alias(n) for c, n in zip(g.quat_to_matrix(Q), rot)])
    out = metrics.mean_transform(rows, ["label"], "vec_id", rot, ["px", "py", "pz"], block=16)
    return out.select("label", "n_kept", *[r6(c).alias(c) for c in [*rot, "px", "py", "pz"]])


@query("landmarks_to_world", f"""{_E}, d AS (SELECT vec_id, unnest(range(21)) AS k, unnest(embedding[1:21])::DOUBLE AS a, unnest(embedding[22:42])::DOUBLE AS b, unnest(embedding[43:63])::DOUBLE AS c FROM embeddings)
SELECT d.vec_id, k, CASE WHEN abs(px) > 0.05 AND sqrt(a*a+b*b+c*c) > 1e-6 THEN round(m0*a+m1*b+m2*c+vx, 6)+0.0 END AS x,
 CASE WHEN abs(px) > 0.05 AND sqrt(a*a+b*b+c*c) > 1e-6 THEN round(m3*a+m4*b+m5*c+vy, 6)+0.0 END AS y, CASE WHEN abs(px) > 0.05 AND sqrt(a*a+b*b+c*c) > 1e-6 THEN round(m6*a+m7*b+m8*c+vz, 6)+0.0 END AS z
FROM d JOIN m USING (vec_id)""")
def landmarks_to_world(spark, sf):
    _, Q, V, _ = _axes()
    from sensorframe.plans.hands import landmarks_to_world as lift

    marks = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(
        *[F.element_at("embedding", (i + 21 * k + 1).cast("int")).cast("double").alias(a) for k, a in enumerate("xyz")]
    ))
    rows = _vec(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", marks.alias("marks")), "vec_id")
    pose = dict(zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), [*V, *Q]))
    out = rows.select("vec_id", F.posexplode(lift(F.col("marks"), F.abs("px"), pose, min_confidence=0.05)).alias("k", "p"))
    return out.select("vec_id", "k", *[r6(F.col(f"p.{a}")).alias(a) for a in "xyz"])


@query("keypoint_box", """WITH d AS (SELECT vec_id, unnest(embedding[1:21])::DOUBLE*1000+300 AS u, unnest(embedding[22:42])::DOUBLE*1000+200 AS v FROM embeddings),
b AS (SELECT vec_id, CAST(greatest(0, least(639, trunc(min(u)))) AS INT) AS x0, CAST(greatest(0, least(479, trunc(min(v)))) AS INT) AS y0, CAST(greatest(0, least(639, trunc(max(u)))) AS INT) AS x1, CAST(greatest(0, least(479, trunc(max(v)))) AS INT) AS y1 FROM d GROUP BY vec_id)
SELECT *, (x0+x1)/2.0::DOUBLE AS cx, (y0+y1)/2.0::DOUBLE AS cy, greatest(x1-x0, y1-y0)::DOUBLE AS side FROM b""")
def keypoint_box(spark, sf):
    from sensorframe.plans.hands import keypoint_box as box

    kps = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(
        (F.element_at("embedding", i + 1).cast("double") * 1000 + 300).alias("u"), (F.element_at("embedding", i + 22).cast("double") * 1000 + 200).alias("v")
    ))
    rows = table(spark, sf, "embeddings").select("vec_id", kps.alias("k"))
    return rows.select("vec_id", box(F.col("k"), 640, 480).alias("b")).select("vec_id", "b.*")


@query("distance_split", f"""{_E} SELECT vec_id, round(sqrt(px*px+py*py+pz*pz), 6)+0.0 AS dist, CASE WHEN sqrt(px*px+py*py+pz*pz) < 0.2 THEN 'close' WHEN sqrt(px*px+py*py+pz*pz) >= 0.2 THEN 'far' END AS part FROM e""")
def distance_split(spark, sf):
    P, _, _, _ = _axes()
    from sensorframe.plans.hands import distance_class

    rows = _vec(spark, sf).withColumn("d", g.norm(P))
    return rows.select("vec_id", r6("d").alias("dist"), distance_class(F.col("d"), 0.2).alias("part"))


@query("occlusion_filter", f"""{_E} SELECT vec_id FROM e WHERE NOT coalesce((CASE WHEN vx > 0 THEN vx END) + 0.1 < vy, false)""")
def occlusion_filter(spark, sf):
    from sensorframe.plans.hands import occluded

    rows = _vec(spark, sf)
    return rows.where(~occluded(F.when(F.col("vx") > 0, F.col("vx")), F.col("vy"))).select("vec_id")
