"""Point-cloud tables over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.operators import pointcloud
from sensorframe.queries.registry import query, r6, table

_PTS = "WITH p AS (SELECT l_returnflag AS cloud, l_orderkey, l_linenumber, l_quantity AS x, l_discount*100 AS y, l_extendedprice/1000 AS z FROM lineitem)"


def _points(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("cloud"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z")
    )


@query("voxel_downsample", f"""{_PTS}, b AS (SELECT cloud, min(x) AS a, min(y) AS b, min(z) AS c FROM p GROUP BY cloud)
SELECT p.cloud, CAST(floor((x-a+2.5)/5) AS BIGINT) AS vx, CAST(floor((y-b+2.5)/5) AS BIGINT) AS vy, CAST(floor((z-c+2.5)/5) AS BIGINT) AS vz, count(*) AS n, round(avg(x)*1.0001, 3)+0.0 AS x, round(avg(y)*1.0001, 3)+0.0 AS y, round(avg(z)*1.0001, 3)+0.0 AS z
FROM p JOIN b USING (cloud) GROUP BY 1, 2, 3, 4""")
def voxel_downsample(spark, sf):
    out = pointcloud.voxel_downsample(_points(spark, sf), ["cloud"], 5.0)
    return out.select("cloud", "vx", "vy", "vz", "n", *[r6(F.col(c) * 1.0001, 3).alias(c) for c in "xyz"])


@query("voxel_dedup", f"""{_PTS}, v AS (SELECT *, l_orderkey*10+l_linenumber AS id, row_number() OVER (PARTITION BY cloud, round_even(x/5, 0), round_even(y/5, 0), round_even(z/5, 0) ORDER BY l_orderkey*10+l_linenumber, z, x, y) AS r FROM p)
SELECT cloud, id, round(z, 5)+0.0 AS z FROM v WHERE r = 1""")
def voxel_dedup(spark, sf):
    key = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "z", "x", "y")
    rows = _points(spark, sf).withColumn("o", key)
    out = pointcloud.voxel_dedup(rows, ["cloud"], 5.0, "o")
    return out.select("cloud", F.col("o.id").alias("id"), r6("z", 5).alias("z"))


@query("cloud_difference", """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id FROM e a WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.label >= 5 AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.05)""")
def cloud_difference(spark, sf):
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("scene"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    out = pointcloud.cloud_difference(rows.where("label < 5"), rows.where("label >= 5"), ["scene"], 0.05)
    return out.select("vec_id")


@query("cloud_normals")
def cloud_normals(spark, sf):
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("scene"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    out = pointcloud.normals(rows, ["scene"], "vec_id", 0.05)
    return out.select("vec_id", *[r6(F.abs(c), 4).alias(c) for c in ("nx", "ny", "nz")])


@query("instance_summary", """WITH p AS (SELECT l_suppkey AS instance, l_linenumber AS tile, l_quantity AS x, l_discount AS y, l_extendedprice AS z FROM lineitem)
SELECT instance, count(*) AS n_points, count(DISTINCT tile) AS n_tiles, array_to_string(list_sort(list(DISTINCT tile)), ',') AS tiles, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z, round(avg(x), 5)+0.0 AS center_x FROM p GROUP BY instance""")
def instance_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("instance"), F.col("l_linenumber").alias("tile"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))
    out = pointcloud.instance_summary(rows, ["instance"], "tile")
    return out.select("instance", "n_points", "n_tiles", F.concat_ws(",", F.col("tiles").cast("array<string>")).alias("tiles"), "min_x", "max_x", "min_z", "max_z", r6("center_x", 5).alias("center_x"))


@query("lift_instances", """WITH t AS (SELECT l_suppkey AS tile, l_orderkey % 50 AS r, l_linenumber AS c, min(l_quantity) AS x, min(l_extendedprice)/1000 AS y, min(l_tax)*100 AS z FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT l_suppkey AS tile, l_orderkey % 50 AS r, l_linenumber AS c, l_partkey % 20 AS instance FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT instance, tile, x, y, z, tile*1000 + r*10 + c AS o FROM m JOIN t USING (tile, r, c) WHERE x <> 0 OR y <> 0 OR z <> 0),
v AS (SELECT *, row_number() OVER (PARTITION BY instance, round_even(x/10, 0), round_even(y/10, 0), round_even(z/10, 0) ORDER BY o) AS k FROM j)
SELECT instance, count(*) AS n_points, count(DISTINCT tile) AS n_tiles, round(min(y), 5)+0.0 AS min_y, round(max(y), 5)+0.0 AS max_y FROM v WHERE k = 1 GROUP BY instance""")
def lift_instances(spark, sf):
    li = table(spark, sf, "lineitem")
    pix = [F.col("l_suppkey").alias("tile"), (F.col("l_orderkey") % 50).alias("row"), F.col("l_linenumber").alias("col")]
    tiles = li.groupBy(*pix).agg(F.min("l_quantity").alias("x"), (F.min("l_extendedprice") / 1000).alias("y"), (F.min("l_tax") * 100).alias("z"))
    masks = li.where("l_returnflag = 'R'").select(*pix, (F.col("l_partkey") % 20).alias("instance")).distinct()
    order = F.col("tile") * 1000 + F.col("row") * 10 + F.col("col")
    out = pointcloud.lift_instances(masks.withColumn("o", order), tiles, ["tile"], ["instance"], "tile", 10.0, "o")
    return out.select("instance", "n_points", "n_tiles", r6("min_y", 5).alias("min_y"), r6("max_y", 5).alias("max_y"))


@query("colour_points", """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
p AS (SELECT vec_id, label, CAST(round_even(40*x/z+32, 0) AS INT) AS u, CAST(round_even(40*y/z+24, 0) AS INT) AS v FROM e WHERE z > 0 AND abs(x/z) < 1e6 AND abs(y/z) < 1e6),
c AS (SELECT label, l.i AS u, l.j AS v, (label*7+l.i) % 256 AS r, (label*3+l.j) % 256 AS g, (l.i+l.j) % 256 AS b FROM (SELECT DISTINCT label FROM embeddings), (SELECT i, j FROM range(64) a(i), range(48) b(j)) l)
SELECT vec_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM p JOIN c USING (label, u, v)""")
def colour_points(spark, sf):
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", "label", *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    uv = rows.select("label").distinct().withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(47))))
    image = uv.select("label", "u", "v", ((F.col("label") * 7 + F.col("u")) % 256).cast("bigint").alias("r"), ((F.col("label") * 3 + F.col("v")) % 256).cast("bigint").alias("g"), ((F.col("u") + F.col("v")) % 256).cast("bigint").alias("b"))
    out = pointcloud.colour_points(rows, image, ["label"], g.lits((40, 40, 32, 24)), 64, 48)
    return out.select("vec_id", "r", "g", "b")


@query("point_quality", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax/10 <= 0.005 AND l_discount/5 <= 0.01")
def point_quality(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"), (F.col("l_tax") / 10).alias("inv_dist_std"), (F.col("l_discount") / 5).alias("dist_std")
    )
    return pointcloud.quality_filter(li).select("l_orderkey", "l_linenumber")
