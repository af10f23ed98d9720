"""Hex grid, distances, bearings and polygons as native Column expressions.

Cells are pointy-top hexagons over a local equirectangular plane. A cell id packs
the axial coordinates (q, r) into one long, so a neighbour is ``cell + constant``:
ring joins stay integer equi-joins with no string building.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
_BITS = 21
_SHIFT = 2_097_152  # q stride; r lives below it
_BAND = 1 << (2 * _BITS)  # above q and r: the latitude at which a local cell is true to scale; 0 is the grid's own
_BAND_DEG = 0.25
_BIAS = 1_048_576  # keeps q and r non-negative
_ROOT3 = math.sqrt(3.0)


class Grid(NamedTuple):
    """Hexagon edge in km and the latitude at which a degree of longitude is measured."""

    edge_km: float = 0.46
    ref_lat: float = 28.6

    @property
    def km_per_lon(self) -> float:
        return KM_PER_DEGREE * math.cos(math.radians(self.ref_lat))

    def rings_for(self, radius_km: float) -> int:
        """Rings to visit so that no point pair within ``radius_km`` is missed.

        Two points r apart sit in hexes whose centres are at most r + 2R apart and
        ring k is at least 1.5kR away; 1 % covers the projection error.
        """
        return int((1.01 * radius_km + 2 * self.edge_km) / (1.5 * self.edge_km))


class Offset(NamedTuple):
    delta: int
    ring: int
    dist_km: float
    bearing: float


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(x: Column, digits: int) -> Column:
    """Half-even rounding on the double itself, without a BigDecimal per row."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Not least(): it skips nulls and would turn a missing coordinate into half the globe.
    return F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a))) * (2 * EARTH_RADIUS_KM)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, clockwise from north, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def alignment_from_bearing(bearing: Column, wind_from_deg: Column) -> Column:
    wind_to = F.pmod(wind_from_deg + 180.0, F.lit(360.0))
    return F.greatest(F.lit(0.0), F.cos(F.radians(wind_to - bearing)))


def wind_alignment(
    src_lat: Column, src_lon: Column, dst_lat: Column, dst_lon: Column, wind_from_deg: Column
) -> Column:
    """1 when the destination is exactly downwind of the source, 0 at 90 degrees or more."""
    return alignment_from_bearing(bearing_deg(src_lat, src_lon, dst_lat, dst_lon), wind_from_deg)


def circular_mean_deg(bearing: Column) -> Column:
    """Aggregate: mean direction on the circle, in [0, 360); null where bearings cancel out and only rounding noise is left.

    Sums are exact, so the order of rows does not reach the last bit: bearings at even steps have their mean halfway between
    two whole degrees.
    """
    rad = F.radians(bearing)
    n = F.count(bearing)
    east, north = (F.sum(part.cast("decimal(28,20)")).cast("double") / n for part in (F.sin(rad), F.cos(rad)))
    return F.when(east * east + north * north > 1e-18, F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0)))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mean_lat: Column) -> Column:
    dy = (lat2 - lat1) * KM_PER_DEGREE
    dx = (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians(mean_lat))
    return F.sqrt(dx * dx + dy * dy)


def equirect_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mean_lat: Column) -> Column:
    dy = lat2 - lat1
    dx = (lon2 - lon1) * F.cos(F.radians(mean_lat))
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))


# ---------------------------------------------------------------- hex cells


def pack(q: Column, r: Column) -> Column:
    return (q.cast("long") + _BIAS) * F.lit(_SHIFT) + (r.cast("long") + _BIAS)


def cell_q(cell: Column) -> Column:
    return F.shiftright(cell, _BITS).bitwiseAND(F.lit(_SHIFT - 1)) - _BIAS


def cell_r(cell: Column) -> Column:
    return F.pmod(cell, F.lit(_SHIFT)) - _BIAS


def latlng_to_cell(lat: Column, lon: Column, grid: Grid = Grid()) -> Column:
    """Id of the nearest hex centre to the projected point.

    A point lies between lines in three directions; the floors of its position along them
    give the hex without comparing rounding errors, so the expression stays small when
    the planner inlines it.
    """
    unit = grid.edge_km * _ROOT3
    return _hex_at(lon * (grid.km_per_lon / unit), lat * (KM_PER_DEGREE * _ROOT3 / unit))


def _hex_at(x: Column, y: Column) -> Column:
    diagonal = F.floor(y + x + 1.0)
    across = F.floor((F.floor(x * 2.0 + 1.0) + diagonal) / 3)
    r = F.floor((diagonal + F.floor(y - x + 1.0)) / 3)
    # across = q + r, so this is pack(across - r, r) with r used once.
    return (across + _BIAS) * F.lit(_SHIFT) + _BIAS - r * F.lit(_SHIFT - 1)


# Local cells: the same hexes over a plane that is true to scale at the cell's own latitude band, which the id
# carries. A neighbour is still ``cell + constant``, and ring radii hold their kilometres from the equator to the pole.


def local_band(lat: Column) -> Column:
    """Band of a reference latitude, usually the middle of a city."""
    return F.floor((lat + 90.0) / _BAND_DEG + 0.5).cast("long") + 1


def _band_km_per_lon(band: Column) -> Column:
    return F.greatest(F.cos(F.radians((band - 1) * _BAND_DEG - 90.0)), F.lit(1e-6)) * KM_PER_DEGREE


def local_cell(lat: Column, lon: Column, band: Column, grid: Grid = Grid()) -> Column:
    """Id of the local hex of a point; all points to be compared take the band of their city."""
    unit = grid.edge_km * _ROOT3
    return _hex_at(lon * (_band_km_per_lon(band) / unit), lat * (KM_PER_DEGREE * _ROOT3 / unit)) + band * F.lit(_BAND)


def local_lon(cell: Column, grid: Grid = Grid()) -> Column:
    """Longitude of a local cell's centre; its latitude is ``cell_lat``."""
    x = (cell_q(cell) * _ROOT3 + cell_r(cell) * (_ROOT3 / 2)) * grid.edge_km
    return x / _band_km_per_lon(F.shiftright(cell, 2 * _BITS))


def cell_lat(cell: Column, grid: Grid = Grid()) -> Column:
    return cell_r(cell) * (1.5 * grid.edge_km) / KM_PER_DEGREE


def cell_lon(cell: Column, grid: Grid = Grid()) -> Column:
    x = (cell_q(cell) * _ROOT3 + cell_r(cell) * (_ROOT3 / 2)) * grid.edge_km
    return x / grid.km_per_lon


def hex_distance(a: Column, b: Column) -> Column:
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def cell_distance_km(a: Column, b: Column, grid: Grid = Grid()) -> Column:
    return haversine_km(cell_lat(a, grid), cell_lon(a, grid), cell_lat(b, grid), cell_lon(b, grid))


def offsets(lo: int, hi: int, grid: Grid = Grid()) -> list[Offset]:
    """Every hex displacement from ring ``lo`` to ring ``hi`` with its planar length and bearing."""
    out = []
    for dq in range(-hi, hi + 1):
        for dr in range(-hi, hi + 1):
            ring = (abs(dq) + abs(dr) + abs(dq + dr)) // 2
            if lo <= ring <= hi:
                dx = grid.edge_km * (_ROOT3 * dq + _ROOT3 / 2 * dr)
                dy = grid.edge_km * 1.5 * dr
                bearing = math.degrees(math.atan2(dx, dy)) % 360.0 if ring else 0.0
                out.append(Offset(dq * _SHIFT + dr, ring, math.hypot(dx, dy), bearing))
    return out


def offset_array(shape: list[Offset]) -> Column:
    """Constant array of (delta, ring, ring_km, ring_bearing); one expression that folds to a literal."""
    rows = [
        {"delta": o.delta, "ring": o.ring, "ring_km": o.dist_km, "ring_bearing": o.bearing} for o in shape
    ]
    return F.from_json(
        F.lit(json.dumps(rows)), "array<struct<delta:bigint,ring:int,ring_km:double,ring_bearing:double>>"
    )


def disk(cell: Column, k: int, lo: int = 0) -> Column:
    """Array of the cells in rings ``lo``..``k`` around a cell (ring 0 is the cell itself)."""
    deltas = F.expr(f"array({', '.join(f'{o.delta}L' for o in offsets(lo, k))})")
    return F.transform(deltas, lambda d: cell + d)


def neighbours(cell: Column, k: int = 1) -> Column:
    """The k-disk without its centre."""
    return disk(cell, k, lo=1)


# ----------------------------------------------------------------- polygons


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray cast of a point against one ring of [lon, lat] pairs."""
    n = F.size(ring)
    previous = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))

    def crosses(a: Column, b: Column) -> Column:
        ay, by = a[1], b[1]
        at = a[0] + (lat - ay) * (b[0] - a[0]) / F.nullif(by - ay, F.lit(0.0))
        return F.when((ay > lat) != (by > lat), (lon < at).cast("int")).otherwise(0)

    hits = F.aggregate(F.zip_with(ring, previous, crosses), F.lit(0), lambda acc, c: acc + c)
    return hits % 2 == 1


def point_in_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """Inside the outer ring and in none of the holes."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return point_in_ring(lon, lat, F.get(polygon, F.lit(0))) & ~F.exists(
        holes, lambda h: point_in_ring(lon, lat, h)
    )


def point_in_any(lon: Column, lat: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda p: point_in_polygon(lon, lat, p))


def polygons_bbox(polygons: Column) -> Column:
    """struct(x0, y0, x1, y1) over the outer rings."""
    outer = F.flatten(F.transform(polygons, lambda p: F.get(p, F.lit(0))))
    xs, ys = F.transform(outer, lambda p: p[0]), F.transform(outer, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )
