"""Queries of distances, neighbours, bridges, polygons and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import spatial
from panelforge.plans.common_sql import ENTITIES, PANEL
from panelforge.plans.panel_queries import dense
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities

_KM = "round(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))), 6)"
EDGES = f"""{ENTITIES}, near AS (SELECT a.geo AS src, b.geo AS dst, {_KM} AS km FROM ent a JOIN ent b ON a.geo <> b.geo),
 edges AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY km, dst) <= 3)"""


def edges(spark, folder):
    return spatial.neighbours(entities(spark, folder), 3)


@query("GEO01_JON19_neighbours", f"WITH {EDGES} SELECT src, dst, round(km, 4) AS km, CAST(rank AS INT) AS rank FROM edges")
def neighbours(spark, folder):
    return edges(spark, folder).select("src", "dst", F.round("km", 4).alias("km"), "rank")


@query("JON18_AGG14_neighbour_mean", f"WITH {PANEL}, {EDGES}, n AS (SELECT src AS geo, p, sum(y / (1 + km)) / sum(1 / (1 + km)) AS near FROM edges JOIN panel ON panel.geo = dst GROUP BY src, p) SELECT panel.geo, panel.p, round(coalesce(near, 0.0), 5) AS near FROM panel LEFT JOIN n ON panel.geo = n.geo AND panel.p = n.p")
def neighbour_mean(spark, folder):
    return spatial.neighbour_mean(dense(spark, folder), edges(spark, folder), "y").select("geo", "p", F.round("near", 5).alias("near"))


@query("AGG12_JON17_idw", f"WITH {PANEL}, {EDGES} SELECT src, p, round(sum(y / pow(km + 5, 2)) / sum(1 / pow(km + 5, 2)), 5) AS idw, count(DISTINCT dst) AS stations FROM edges JOIN panel ON panel.geo = dst GROUP BY src, p")
def idw(spark, folder):
    return spatial.interpolated(edges(spark, folder), dense(spark, folder).select("geo", "p", F.col("y").alias("v"))).select("src", "p", F.round("idw", 5).alias("idw"), "stations")


@query("JON16_AGG13_zonal", f"WITH {PANEL}, b AS (SELECT geo AS cell, geo % 7 AS zone, 1.0 / count(*) OVER (PARTITION BY geo % 7) AS weight FROM (SELECT DISTINCT geo FROM obs)) SELECT zone, p, round(sum(y * weight), 6) AS value, count(DISTINCT cell) AS cells, round(sum(weight), 6) AS covered FROM b JOIN panel ON panel.geo = cell GROUP BY zone, p")
def zonal(spark, folder):
    panel = dense(spark, folder)
    cells = panel.select(F.col("geo").alias("cell")).distinct().withColumn("zone", F.col("cell") % 7)
    sizes = cells.groupBy("zone").agg((1 / F.count(F.lit(1))).alias("weight"))
    bridge = cells.join(sizes, "zone")
    return tidy(spatial.zonal(bridge, panel.select(F.col("geo").alias("cell"), "p", F.col("y").alias("v"))), "zone", "p", "value", "cells", "covered")


def squares(spark):
    """Squares of 3 by 2 degrees as closed rings."""
    xs, ys = F.sequence(F.lit(-45), F.lit(-36), F.lit(3)), F.sequence(F.lit(-12), F.lit(-4), F.lit(2))
    base = spark.range(1).select(F.explode(xs).alias("x")).select("x", F.explode(ys).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(3, 0), corner(3, 2), corner(0, 2), corner(0, 0))
    d = lambda c: c.cast("double")
    return base.select(((F.col("x") + 45) * 100 + F.col("y") + 12).alias("poly"), ring.alias("ring"), d(F.col("x")).alias("x0"), d(F.col("x") + 3).alias("x1"), d(F.col("y")).alias("y0"), d(F.col("y") + 2).alias("y1"))


@query("JON14_GEO08_located", f"WITH {ENTITIES}, q AS (SELECT CAST((x + 45) * 100 + y + 12 AS INT) AS poly, x, y FROM generate_series(-45, -36, 3) a(x), generate_series(-12, -4, 2) b(y)) SELECT geo, min(poly) AS poly FROM ent LEFT JOIN q ON lon >= x AND lon < x + 3 AND lat >= y AND lat < y + 2 GROUP BY geo")
def located(spark, folder):
    return spatial.located(entities(spark, folder), squares(spark)).select("geo", "poly")


@query("GEO05_shape", "SELECT CAST((x + 45) * 100 + y + 12 AS INT) AS poly, 6.0::DOUBLE AS area, 10.0::DOUBLE AS perimeter, round(4 * 3.141592653589793 * 6 / 100, 6) AS compactness FROM generate_series(-45, -36, 3) a(x), generate_series(-12, -4, 2) b(y)")
def shape(spark, folder):
    return tidy(squares(spark), "poly", **spatial.shape(F.col("ring")))


@query("GEO09_JON12_kernel", f"WITH {PANEL}, {EDGES}, f AS (SELECT geo AS dst, CAST(p + age AS INT) AS p, sum(y * exp(-(age - 1) / 2.0::DOUBLE)) AS s FROM panel, generate_series(1, 6) g(age) WHERE y > 0 GROUP BY 1, 2) SELECT src AS geo, p, round(sum(s * exp(-km / 50.0::DOUBLE)), 5) AS score FROM f JOIN edges ON f.dst = edges.dst GROUP BY src, p")
def kernel(spark, folder):
    return spatial.kernel_scores(dense(spark, folder), edges(spark, folder), 6, 2.0, 50.0).select("geo", "p", F.round("score", 5).alias("score"))


@query("GEO07_bounds", f"WITH {ENTITIES} SELECT uf, round(min(lat) - 0.25, 6) AS south, round(max(lat) + 0.25, 6) AS north, round(min(lon) - 0.25, 6) AS west, round(max(lon) + 0.25, 6) AS east, count(*) AS n FROM ent GROUP BY uf")
def bounds(spark, folder):
    g = entities(spark, folder).groupBy("uf").agg((F.min("lat") - 0.25).alias("south"), (F.max("lat") + 0.25).alias("north"), (F.min("lon") - 0.25).alias("west"), (F.max("lon") + 0.25).alias("east"), F.count(F.lit(1)).alias("n"))
    return tidy(g, "uf", "south", "north", "west", "east", "n")


@query("GEO12_edge_sets", f"WITH {EDGES} SELECT src, count(*) AS n, CAST(sum(CASE WHEN rank <= 1 OR km < 30 THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(min(km), 4) AS nearest FROM edges GROUP BY src")
def edge_sets(spark, folder):
    return edges(spark, folder).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("rank") <= 1) | (F.col("km") < 30)).cast("long")).alias("kept"), F.round(F.min("km"), 4).alias("nearest"))
