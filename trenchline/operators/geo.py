"""Map-ready point layers and density grids.

The reference hands point lists to a browser map; here the layers are a
filtered projection (one row per valid permit location), the density grid is a
grouped count per cell and day, and the heat layer is what the browser would
draw: points binned in map pixels of a zoom level and spread over the cells
around them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trenchline.functions.dates import day_range_filter, local_day

# fixed value: valid coordinate box (lat_min, lat_max, lon_min, lon_max), inclusive
VALID_BOX = (41.5, 42.5, -88.0, -87.0)
GRID_CELL_DEG = 0.01

# --- fixed values: the heat layer (pixels of the map, opacities) ---
HEAT_RADIUS = 15
HEAT_BLUR = 20
HEAT_MAX_ZOOM = 13
HEAT_MIN_OPACITY = 0.4
# -------------------------------------------------------------------
TILE_PIXELS = 256
HEAT_CELL_PIXELS = 7
#: weights are whole thousandths, so sums do not depend on the order of rows
WEIGHT_UNIT = 1000


def valid_location(box=VALID_BOX):
    lat, lon = F.col("latitude"), F.col("longitude")
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3]) & (lat != 0) & (lon != 0)


def map_points(permits: DataFrame, start=None, end=None, box=VALID_BOX) -> DataFrame:
    """G1: ``day, layer, dig_ticket_number, latitude, longitude`` for permits
    with a day and a location inside the box; layer is 'emergency' or 'regular'.
    The day filter and the box reach the Parquet scan as pushed predicates."""
    from trenchline.operators.quality import NUMERIC, TIMESTAMPS, require_columns

    require_columns(permits, {"latitude": NUMERIC, "longitude": NUMERIC, "dig_date": TIMESTAMPS, "is_emergency": ("boolean",)})
    cond = day_range_filter("dig_date", start, end)
    p = permits.where(F.col("dig_date").isNotNull())  # permits without a dig date belong to no day
    p = p if cond is None else p.where(cond)
    return p.where(valid_location(box)).select(
        local_day("dig_date").alias("day"),
        F.when(F.col("is_emergency"), F.lit("emergency")).otherwise(F.lit("regular")).alias("layer"),
        "dig_ticket_number",
        "latitude",
        "longitude",
    )


def density_grid(points: DataFrame, cell_deg: float = GRID_CELL_DEG) -> DataFrame:
    """Points per grid cell ``day, layer, lat_cell, lon_cell, points``;
    cell index = floor(coordinate / cell size)."""
    size = F.lit(float(cell_deg))
    return points.groupBy(
        "day",
        "layer",
        F.floor(F.col("latitude") / size).alias("lat_cell"),
        F.floor(F.col("longitude") / size).alias("lon_cell"),
    ).agg(F.count(F.lit(1)).alias("points"))


def heat_stencil(radius: int = HEAT_RADIUS, blur: int = HEAT_BLUR, cell: int = HEAT_CELL_PIXELS) -> list[tuple[int, int, int]]:
    """(dx, dy, weight) of the cells that a point shows in: full weight up to
    ``radius`` pixels from its cell, falling to nothing over ``blur`` more."""
    reach = (radius + blur) // cell
    out = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            distance = cell * (dx * dx + dy * dy) ** 0.5
            weight = round(WEIGHT_UNIT * min(1.0, max(0.0, (radius + blur - distance) / blur)))
            if weight:
                out.append((dx, dy, weight))
    return out


def map_pixel(zoom: Column) -> tuple[Column, Column]:
    """x and y in the pixels of the web map at ``zoom`` (spherical Mercator)."""
    size = F.lit(float(TILE_PIXELS)) * F.pow(F.lit(2.0), zoom)
    sine = F.sin(F.col("latitude") * F.lit(math.pi) / F.lit(180.0))
    x = (F.col("longitude") + F.lit(180.0)) / F.lit(360.0) * size
    y = (F.lit(0.5) - F.ln((F.lit(1.0) + sine) / (F.lit(1.0) - sine)) / F.lit(4.0 * math.pi)) * size
    return x, y


def heat_layer(
    points: DataFrame,
    zooms: tuple[int, ...] = (HEAT_MAX_ZOOM,),
    by: tuple[str, ...] = ("layer",),
    radius: int = HEAT_RADIUS,
    blur: int = HEAT_BLUR,
    max_zoom: int = HEAT_MAX_ZOOM,
    min_opacity: float = HEAT_MIN_OPACITY,
) -> DataFrame:
    """The heat layer of each zoom level -> ``zoom, <by>, x_cell, y_cell,
    weight, intensity, opacity``.

    A point weighs less below ``max_zoom`` (half for each level), and no cell
    that is drawn is fainter than ``min_opacity``.  Points are counted per
    cell first (partial aggregation, so a crowded cell is one row), and each
    *cell* is spread by a stencil whose size depends on radius and blur only."""
    x, y = map_pixel(F.col("zoom"))
    cell = F.lit(float(HEAT_CELL_PIXELS))
    levels = points.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    counts = levels.groupBy("zoom", *by, F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy")).agg(F.count(F.lit(1)).alias("points"))
    stencil = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).cast("bigint").alias("w")) for a, b, w in heat_stencil(radius, blur)])
    spread = counts.select("zoom", *by, "cx", "cy", "points", F.explode(stencil).alias("s"))
    cells = spread.groupBy("zoom", *by, (F.col("cx") + F.col("s.dx")).alias("x_cell"), (F.col("cy") + F.col("s.dy")).alias("y_cell")).agg(
        F.sum(F.col("points") * F.col("s.w")).alias("weight")
    )
    faint = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.lit(max_zoom) - F.col("zoom")))
    intensity = F.col("weight") / F.lit(float(WEIGHT_UNIT)) / faint
    out = cells.withColumn("intensity", intensity)
    return out.withColumn("opacity", F.greatest(F.lit(min_opacity), F.least(F.lit(1.0), F.col("intensity"))))
