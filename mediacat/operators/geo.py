"""Reverse geocoding and map clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.scalars import haversine_km, is_located, mercator_pixel
from mediacat.operators.tables import checkpointed

MAX_KM = 100.0
_KM_PER_DEGREE = 111.195
#: Rows of the gazetteer's cells up to which they are broadcast.
BROADCAST_CELLS = 500_000


def nearest_places(points: DataFrame, gazetteer: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """``(latitude, longitude, row_no, km)`` for each distinct coordinate with a place within
    ``max_km``: the nearest, of equally near ones the first in the gazetteer.

    Places are copied to all one-degree cells that they may serve (more of them towards the
    poles, wrapped at the date line), so points meet them by an equality of cells.
    """
    reach = int(max_km // _KM_PER_DEGREE) + 1
    far = F.least(F.lit(90.0), F.abs("latitude") + reach + 1)
    across = F.when(far >= 88, 180).otherwise(F.ceil(F.lit(max_km / _KM_PER_DEGREE) / F.cos(F.radians(far))).cast("int") + 1)
    across = F.least(across, F.lit(180))
    lat_cell, lon_cell = F.floor("latitude"), F.floor(F.col("longitude") + 180)
    cells = gazetteer.select("row_no", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"), lat_cell.alias("la"), lon_cell.alias("lo"), across.alias("across"))
    cells = cells.withColumn("la", F.explode(F.sequence(F.col("la") - reach, F.col("la") + reach))).withColumn("lo", F.explode(F.sequence(F.col("lo") - F.col("across"), F.col("lo") + F.col("across"))))
    cells = checkpointed(cells.select("row_no", "plat", "plon", "la", F.pmod("lo", F.lit(360)).alias("lo")).distinct())
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    distinct = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").where(is_located(F.lit(True))).select("latitude", "longitude").distinct()
    at = distinct.withColumn("la", lat_cell).withColumn("lo", F.pmod(lon_cell, F.lit(360)))
    near = at.join(F.broadcast(cells) if small else cells, ["la", "lo"]).withColumn("km", haversine_km("latitude", "longitude", "plat", "plon")).where(F.col("km") <= max_km)
    best = near.groupBy("latitude", "longitude").agg(F.min(F.struct("km", "row_no")).alias("best"))
    return best.select("latitude", "longitude", "best.row_no", "best.km")


def place_names(media: DataFrame, gazetteer: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """``(media_id, name)``: distinct non-empty city, region and country of each located item."""
    located = media.where(is_located()).select("id", "latitude", "longitude")
    found = nearest_places(located, gazetteer, max_km).join(gazetteer.select("row_no", F.col("name").alias("city"), "admin1", "country"), "row_no")
    names = F.array_distinct(F.filter(F.array("city", "admin1", "country"), lambda x: x != ""))
    return located.join(found, ["latitude", "longitude"]).select(F.col("id").alias("media_id"), F.explode(names).alias("name"))


def map_grid(media: DataFrame, zoom: int, cell_px: int = 50) -> DataFrame:
    """Located items counted by pixel cell: the map's clusters at any number of items."""
    x, y = mercator_pixel("latitude", "longitude", zoom)
    cells = media.where(is_located()).select(F.floor(x / cell_px).alias("cx"), F.floor(y / cell_px).alias("cy"), "latitude", "longitude", "id")
    return cells.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.max("id").alias("cover_id"))


def map_clusters(media: DataFrame, zoom: int, radius_px: float = 50.0, tile_px: int = 512) -> DataFrame:
    """``(tile_x, tile_y, cluster_id, n, x, y)``: clusters as the map draws them, tile by tile.

    In the order of date and id, both descending, an item joins the nearest cluster of its
    tile whose running centre is less than ``radius_px`` away, or starts one, which goes by its
    id. A cluster never crosses the edge of a tile, so tiles are tasks of their own. Items of
    one pixel are reduced before the shuffle to their mean and their first item, with which
    they enter, so a tile has at most ``tile_px`` squared points however many items it has.
    """
    x, y = mercator_pixel("latitude", "longitude", zoom)
    items = media.where(is_located()).select("id", "date_taken", x.alias("x"), y.alias("y"))
    first = F.max(F.struct("date_taken", "id"))
    points = items.groupBy(F.floor("x").alias("px"), F.floor("y").alias("py")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), first.alias("first"))
    points = points.select(F.floor(F.col("px") / tile_px).alias("tile_x"), F.floor(F.col("py") / tile_px).alias("tile_y"), "x", "y", "n", "first.date_taken", "first.id")

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        grid: dict[tuple[int, int], list[int]] = {}
        cx, cy, n, ids = [], [], [], []
        cell = lambda x, y: (int(x // radius_px), int(y // radius_px))
        for r in g.sort_values(["date_taken", "id"], ascending=False).itertuples():
            (i, j), best, near = cell(r.x, r.y), radius_px, None
            for k in (k for di in (-1, 0, 1) for dj in (-1, 0, 1) for k in grid.get((i + di, j + dj), ())):
                d = ((cx[k] - r.x) ** 2 + (cy[k] - r.y) ** 2) ** 0.5
                if d < best:
                    best, near = d, k
            if near is None:
                grid.setdefault((i, j), []).append(len(n))
                cx.append(r.x), cy.append(r.y), n.append(r.n), ids.append(r.id)
                continue
            old = cell(cx[near], cy[near])
            cx[near] += (r.x - cx[near]) * r.n / (n[near] + r.n)
            cy[near] += (r.y - cy[near]) * r.n / (n[near] + r.n)
            n[near] += r.n
            new = cell(cx[near], cy[near])
            if new != old:
                grid[old].remove(near)
                grid.setdefault(new, []).append(near)
        return pd.DataFrame({"tile_x": g["tile_x"].iloc[0], "tile_y": g["tile_y"].iloc[0], "cluster_id": ids, "n": n, "x": cx, "y": cy})

    return points.groupBy("tile_x", "tile_y").applyInPandas(cluster, "tile_x long, tile_y long, cluster_id long, n long, x double, y double")


def place_report(media: DataFrame, gazetteer: DataFrame, max_km: float = MAX_KM, top: int = 10) -> DataFrame:
    """``(kind, name, photos)``: located photos, those with a place, and the ``top`` cities and
    countries by photos, ties by name. Coordinates are looked up once, to 6 digits."""
    photos = media.where((F.col("media_type") == "photo") & is_located()).select("id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))
    found = nearest_places(photos, gazetteer, max_km).join(gazetteer.select("row_no", F.col("name").alias("city"), "country"), "row_no")
    of = checkpointed(photos.join(found, ["latitude", "longitude"], "left").select("row_no", "city", "country"))
    parts = [of.agg(F.count("*").alias("photos")).select(F.lit("located").alias("kind"), F.lit("").alias("name"), "photos"), of.where("row_no IS NOT NULL").agg(F.count("*").alias("photos")).select(F.lit("matched"), F.lit(""), "photos")]
    for kind in ("city", "country"):
        counts = of.where(F.col(kind) != "").groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("photos"))
        parts.append(counts.orderBy(F.desc("photos"), "name").limit(top).select(F.lit(kind), "name", "photos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
