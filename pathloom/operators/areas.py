"""Places within circles by a grid index.

A circle is covered by the cells of a grid of CELL degrees that it may touch; a place lies in one cell. Cells meet by equality,
and the exact distance decides. Longitudes wrap, and a circle over a pole covers all cells of its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo

CELL = 1.0
AROUND = round(360 / CELL)
#: Degrees by which a circle's cells are widened, against rounding.
MARGIN = 1e-6


def covering(areas: DataFrame) -> DataFrame:
    """areas (latitude, longitude, radius_km, …) with columns x and y, a row for each cell that a circle may touch."""
    angle = F.least(F.col("radius_km") / geo.RADIUS_KM, F.lit(math.pi))
    tall = F.degrees(angle) + MARGIN
    lat, lon = F.col("latitude"), geo.wrapped(F.col("longitude"))
    south, north = F.greatest(lat - tall, F.lit(-90.0)), F.least(lat + tall, F.lit(90.0))
    # Where the circle holds a pole, its longitudes are all.
    polar = (lat - tall <= -90) | (lat + tall >= 90)
    wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(angle) / F.cos(F.radians(lat)), F.lit(1.0)))) + MARGIN)
    cell = lambda c: F.floor(c / CELL)
    columns = F.when(wide >= 180 - CELL, F.sequence(F.lit(0).cast("long"), F.lit(AROUND - 1).cast("long"))).otherwise(F.sequence(cell(lon - wide), cell(lon + wide)))
    rows = areas.where("radius_km >= 0").select("*", F.explode(F.sequence(cell(south), cell(north))).alias("y"), columns.alias("__xs"))
    return rows.select("*", F.explode(F.transform("__xs", lambda x: F.pmod(x, F.lit(AROUND)))).alias("x")).drop("__xs")


def area_matches(places: DataFrame, areas: DataFrame, area_cities: DataFrame) -> DataFrame:
    """places (name, cc, latitude, longitude) that lie in an area, distinct, with the first area's ord and name as `area`: one of the
    place's country that lists its name, or whose circle holds it. Null coordinates lie in no circle, null names are on no list.
    """
    place = ["name", "cc", "latitude", "longitude"]
    rows = places.select(*place).distinct()
    listed = areas.select("ord", "area", "cc").join(area_cities, "area").select("ord", "area", F.col("cc").alias("__cc"), F.col("name").alias("__name"))
    by_name = rows.join(listed, (F.col("cc") == F.col("__cc")) & (F.col("name") == F.col("__name")))
    circles = covering(areas).select("ord", "area", F.col("cc").alias("__cc"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), "radius_km", "x", "y")
    lat, lon = F.col("latitude"), F.col("longitude")
    placed = rows.where(lat.isNotNull() & lon.isNotNull()).withColumn("__y", F.floor(lat / CELL)).withColumn("__x", F.pmod(F.floor(geo.wrapped(lon) / CELL), F.lit(AROUND)))
    by_cell = placed.join(circles, (F.col("__x") == F.col("x")) & (F.col("__y") == F.col("y")) & (F.col("cc") == F.col("__cc")))
    by_cell = by_cell.where(geo.haversine(lat, lon, F.col("__lat"), F.col("__lon")) <= F.col("radius_km"))
    met = by_name.select(*place, "ord", "area").unionByName(by_cell.select(*place, "ord", "area"))
    return met.groupBy(*place).agg(F.min(F.struct("ord", "area")).alias("m")).select(*place, "m.ord", "m.area")
