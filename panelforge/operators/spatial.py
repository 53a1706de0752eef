"""Spatial operators: distances, nearest neighbours, bridges, point in polygon and kernels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import EARTH_KM, haversine_km, share
from panelforge.sources.tables import stored


#: Places of a cell at the start of a search, and the smallest cell in degrees.
CROWD, SMALLEST = 64, 1e-6


def _cells(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumns({"r": F.floor(F.col("lat") / cell), "c": F.floor(F.col("lon") / cell)})


def nearest(places: DataFrame, k: int, within: Sequence[str] = (), sphere: bool = True, order: Callable[[Column], Column] = lambda distance: distance) -> DataFrame:
    """within, src, dst, distance and rank of the k nearest other places of each place (geo, lat, lon), however far they are.

    distance is in km on the sphere (rounded to 6 places), or plain in degrees. Places go by
    order(distance), which must not fall as distance grows; ties go to the smaller geo. So where
    order rounds two distances to one value, they tie. A place looks at its cell and the eight around it, and is done when its k-th
    distance is below what any place outside of them can have; the others go on with cells of
    four times the width, until these hold everything. The first width is one at which no cell is
    crowded. Of places at one point only the k + 1 smallest can be near to anyone, so the
    others are no candidates. A lone place may have to look at all places of a crowded cell.
    Places without coordinates are left out. Longitudes are from -180 to 180.
    """
    keys = list(within)
    base = stored(places.where("lat IS NOT NULL AND lon IS NOT NULL").select(*keys, F.col("geo").alias("src"), "lat", "lon"), "places")
    first = F.row_number().over(Window.partitionBy(*keys, "lat", "lon").orderBy("src"))
    able = stored(base.withColumn("i", first).where(F.col("i") <= k + 1).drop("i"), "able")
    ends = base.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    extent = 360.0 if sphere else max(ends[1] - ends[0], ends[3] - ends[2], SMALLEST) if ends[0] is not None else 1.0
    cell = extent
    while cell / 2 >= SMALLEST and (_cells(able, cell).groupBy(*keys, "r", "c").count().agg(F.max("count")).first()[0] or 0) > CROWD:
        cell /= 2
    left, done = base, None
    while True:
        whole = cell >= extent
        columns = round(360 / cell) if sphere else None  # cells divide the circle, so the last column touches the first
        near = [F.struct((F.col("r") + i).alias("r"), (F.pmod(F.col("c") + j, F.lit(columns)) if sphere else F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        asked = _cells(left, cell).select(*keys, "src", F.col("lat").alias("la"), F.col("lon").alias("lo"), F.explode(F.array_distinct(F.array(*near))).alias("x")).select(*keys, "src", "la", "lo", "x.*")
        there = _cells(able.withColumnRenamed("src", "dst"), cell)
        if sphere:
            there = there.withColumn("c", F.pmod("c", F.lit(columns)))
            distance = F.round(haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 6)
            # from a place to the circles of latitude and longitude that bound what it has seen
            across = F.asin(F.cos(F.radians("la")) * F.sin(F.radians(F.lit(min(cell, 90.0)))))
            outside = EARTH_KM * F.least(F.radians(F.lit(cell)), across) - 1e-5
        else:
            distance = F.sqrt(F.pow(F.col("la") - F.col("lat"), 2) + F.pow(F.col("lo") - F.col("lon"), 2))
            outside = F.lit(cell * (1 - 1e-9))
        met = asked.join(there, [*keys, "r", "c"]).where("src <> dst").select(*keys, "src", "dst", distance.alias("distance"), outside.alias("outside"))
        by = Window.partitionBy(*keys, "src")
        top = met.withColumn("rank", F.row_number().over(by.orderBy(order(F.col("distance")), "dst"))).where(F.col("rank") <= k)
        settled = F.lit(True) if whole else (F.count(F.lit(1)).over(by) == k) & (F.max(order(F.col("distance"))).over(by) < order(F.col("outside")))
        now = stored(top.withColumn("settled", settled).where("settled").select(*keys, "src", "dst", "distance", "rank"), "nearest")
        done = now if done is None else done.unionByName(now)
        if whole:
            return done
        left = stored(left.join(now.select(*keys, "src").distinct(), [*keys, "src"], "left_anti"), "left")
        if left.isEmpty():
            return done
        cell = min(4 * cell, extent)


def neighbours(places: DataFrame, k: int) -> DataFrame:
    """src, dst, km and rank of the k nearest places."""
    return nearest(places, k).select("src", "dst", F.col("distance").alias("km"), "rank")


def neighbour_mean(panel: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Weighted mean of the neighbours' value, weights 1 / (1 + km); 0 without any."""
    w = 1 / (1 + F.col("km"))
    looked = edges.join(panel.select(F.col("geo").alias("dst"), "p", F.col(value).alias("v")), "dst").where("v IS NOT NULL")
    means = looked.groupBy(F.col("src").alias("geo"), "p").agg(share(F.sum(F.col("v") * w), F.sum(w)).alias("near"))
    return panel.join(means, ["geo", "p"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))


def interpolated(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Inverse squared distance means, weights 1 / (km + 5)^2, by place and month."""
    w = 1 / F.pow(F.col("km") + 5, 2)
    joined = edges.join(values.select(F.col("geo").alias("dst"), "p", "v"), "dst")
    return joined.groupBy("src", "p").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("idw"), F.countDistinct("dst").alias("stations"))


#: Stations of a month that go together.
STATIONS = 512


def station_means(places: DataFrame, stations: DataFrame) -> DataFrame:
    """Means of all stations that have a value in the month, whatever their distance, weights 1 / (km + 5)^2.

    places: geo, p, lat, lon. stations: station, p, lat, lon, v. A month's stations go in arrays
    of about STATIONS, so a place is multiplied by the arrays and not by the stations, and no
    array grows with the network. Months without a station have no rows.
    """
    known = stations.where("v IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    most = known.groupBy("p").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("station"), F.lit(1 + most // STATIONS))
    month = known.groupBy("p", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("station", F.col("lat").alias("la"), F.col("lon").alias("lo"), "v"))).alias("s"))
    km = lambda x: F.round(haversine_km(F.col("lat"), F.col("lon"), x.la, x.lo), 6)
    weighed = F.transform("s", lambda x: F.struct((1 / F.pow(km(x) + 5, 2)).alias("w"), x.v.alias("v")))
    total = lambda value: F.aggregate("weighed", F.lit(0.0), lambda a, x: a + value(x))
    joined = places.join(month, "p").withColumn("weighed", weighed)
    sums = joined.select("geo", "p", total(lambda x: x.v * x.w).alias("a"), total(lambda x: x.w).alias("b"), F.size("weighed").alias("n"))
    return sums.groupBy("geo", "p").agg((F.sum("a") / F.sum("b")).alias("idw"), F.sum("n").cast("int").alias("stations"))


def zonal(bridge: DataFrame, cells: DataFrame) -> DataFrame:
    """Area-weighted sums of cell values by zone and month, and how much of the zone they cover."""
    joined = bridge.join(cells, "cell")
    return joined.groupBy("zone", "p").agg(F.sum(F.col("v") * F.col("weight")).alias("value"), F.countDistinct("cell").alias("cells"), F.sum("weight").alias("covered"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a polygon by crossing numbers. ring: array of struct(x, y), closed."""
    crossing = lambda a, b: ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * F.try_divide(y - a.y, b.y - a.y) + a.x)
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), crossing)
    return F.size(F.filter(pairs, lambda c: c)) % 2 == 1


def located(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """The first polygon, by id, that holds each point, or NULL. Cells of whole degrees bring the two together."""
    cells = polygons.withColumn("cx", F.explode(F.sequence(F.floor("x0"), F.floor("x1")))).withColumn("cy", F.explode(F.sequence(F.floor("y0"), F.floor("y1"))))
    placed = points.withColumns({"cx": F.floor("lon"), "cy": F.floor("lat")})
    hits = placed.join(cells, ["cx", "cy"]).where(inside(F.col("lon"), F.col("lat"), F.col("ring")))
    first = hits.groupBy("geo").agg(F.min("poly").alias("poly"))
    return points.join(first, "geo", "left")


def shape(ring: Column) -> dict[str, Column]:
    """Area, perimeter and compactness of a closed ring."""
    a, b = F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1)
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    area = F.abs(total(F.zip_with(a, b, lambda p, q: p.x * q.y - q.x * p.y))) / 2
    around = total(F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p.x - q.x, 2) + F.pow(p.y - q.y, 2))))
    return {"area": area, "perimeter": around, "compactness": F.least(F.try_divide(4 * 3.141592653589793 * area, around * around), F.lit(1.0))}


def kernel_scores(panel: DataFrame, edges: DataFrame, months: int, tau: float, distance: float) -> DataFrame:
    """Past events near a place, fading with age and distance: sum of y exp(-(age - 1) / tau) exp(-km / distance).

    Each month's value is sent forward to the months it reaches, then along the edges.
    """
    ages = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("age")
    faded = panel.where("y > 0").select(F.col("geo").alias("dst"), "p", "y", ages).select("dst", (F.col("p") + F.col("age")).alias("p"), (F.col("y") * F.exp(-(F.col("age") - 1) / tau)).alias("s"))
    faded = faded.groupBy("dst", "p").agg(F.sum("s").alias("s"))
    return faded.join(edges, "dst").groupBy(F.col("src").alias("geo"), "p").agg(F.sum(F.col("s") * F.exp(-F.col("km") / distance)).alias("score"))


def centroid(ring: Column) -> dict[str, Column]:
    """Centre of mass of a closed ring."""
    a, b = F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1)
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    cross = lambda p, q: p.x * q.y - q.x * p.y
    area = total(cross) / 2
    return {"cx": F.try_divide(total(lambda p, q: (p.x + q.x) * cross(p, q)), 6 * area), "cy": F.try_divide(total(lambda p, q: (p.y + q.y) * cross(p, q)), 6 * area)}


def overlay(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """poly, cell and the share of the box (x0, x1, y0, y1) that lies in the cell, by whole degrees."""
    degrees = lambda df: df.withColumn("dx", F.explode(F.sequence(F.floor("x0"), F.floor("x1")))).withColumn("dy", F.explode(F.sequence(F.floor("y0"), F.floor("y1"))))
    left = degrees(boxes.select("poly", "x0", "x1", "y0", "y1"))
    right = degrees(cells.select("cell", "x0", "x1", "y0", "y1")).select("cell", "dx", "dy", *[F.col(c).alias(f"c{c}") for c in ("x0", "x1", "y0", "y1")])
    met = left.join(right, ["dx", "dy"]).drop("dx", "dy").distinct()
    wide, high = F.least("x1", "cx1") - F.greatest("x0", "cx0"), F.least("y1", "cy1") - F.greatest("y0", "cy0")
    out = met.where((wide > 0) & (high > 0)).withColumn("weight", wide * high / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))))
    return out.select("poly", "cell", "weight")


def box_distance(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Distance of two boxes (x0, x1, y0, y1); 0 where they touch."""
    dx = F.greatest(a[0] - b[1], b[0] - a[1], F.lit(0.0))
    dy = F.greatest(a[2] - b[3], b[2] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)
