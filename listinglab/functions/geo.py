"""Distances on the sphere, grid cells, and the range join they make possible."""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored

EARTH_KM, EARTH_M = 6371.0, 6371008.8
_NO_BAND = -(1 << 40)  # of rows that look along the whole axis
EQUATOR_M, FLATTENING = 6378137.0, 1 / 298.257223563
Point = tuple[Column, Column]
Metres = Callable[[Point, Point], Column]


def _angle(a: Point, b: Point) -> Column:
    (y1, x1), (y2, x2) = a, b
    s = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * F.asin(F.when(s > 1, 1.0).otherwise(F.sqrt(s)))  # null stays null


def haversine_km(a: Point, b: Point) -> Column:
    """G1: great-circle kilometres between (lat, lon) pairs."""
    return _angle(a, b) * EARTH_KM


def distance_m(a: Point, b: Point) -> Column:
    """Metres on the sphere of mean radius; a spheroid differs by 0.6 % at most."""
    return _angle(a, b) * EARTH_M


def spheroid_m(a: Point, b: Point) -> Column:
    """Metres on the WGS 84 spheroid, by Andoyer's and Lambert's first-order correction of
    the angle between reduced latitudes: within a metre of the geodesic over 10 km."""
    reduced = lambda y: F.atan((1 - FLATTENING) * F.tan(F.radians(y)))
    (y1, x1), (y2, x2) = a, b
    u, v = reduced(y1), reduced(y2)
    angle = _angle((F.degrees(u), x1), (F.degrees(v), x2))
    mean, half, sine = (u + v) / 2, (v - u) / 2, F.sin(angle)
    along = (angle - sine) * F.pow(F.sin(mean) * F.cos(half) / F.cos(angle / 2), 2)
    across = (angle + sine) * F.pow(F.cos(mean) * F.sin(half) / F.sin(angle / 2), 2)
    return F.when(angle == 0, 0.0).otherwise(EQUATOR_M * (angle - FLATTENING / 2 * (along + across)))


def within_m(a: Point, b: Point, radius: float, metres: Metres = distance_m) -> Column:
    """At most `radius` metres apart; null points are not."""
    return F.coalesce(metres(a, b) <= radius, F.lit(False))


def walk_min(metres: Column | str) -> Column:
    """Minutes at 80 metres a minute, rounded up."""
    m = F.col(metres) if isinstance(metres, str) else metres
    return F.when(m.isNotNull() & ~F.isnan(m), F.ceil(m / 80).cast("int"))


def has_point(lat: Column | str, lon: Column | str) -> Column:
    """G5"""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return as_col(lat).isNotNull() & as_col(lon).isNotNull()


def cell(lat: Column | str, lon: Column | str, dlat: float = 0.02, dlon: float = 0.03) -> Column:
    """The name of a grid cell; null for missing or impossible coordinates."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    fine = y.between(-90, 90) & x.between(-180, 180)
    return F.when(fine, F.concat_ws("_", F.floor(y / dlat).cast("string"), F.floor(x / dlon).cast("string")))


def _measures(side_m: float) -> tuple[float, float]:
    """Of a grid whose cells are at least `side_m` wide: its bands' height in degrees, and half
    the width that its cells need, as a chord."""
    return math.degrees(side_m / EARTH_M) * 1.01, math.sin(min(side_m / EARTH_M / 2, math.pi / 2)) * 1.0001


def _around(band: Column, dlat: Column | float, half: Column | float) -> Column:
    """How many cells a band of latitude has. In the bands next to each other, a point's cell and
    those beside it hold all within the grid's width: near a pole one cell goes all around."""
    top = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * dlat, F.lit(90.0))
    reach = (F.lit(half) if isinstance(half, float) else half) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
    return F.when(reach >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / F.degrees(2 * F.asin(F.least(reach, F.lit(1.0))))).cast("long"))).cast("long")


def _cell_of(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)


def in_cells(df: DataFrame, radius_m: float, width: float = 4.0, near: bool = False) -> DataFrame:
    """`df` (lat, lon) with the cell _y, _x of each row in a grid of bands and cells at least
    `width` radii wide; with `near`, a row for each cell that may hold points within the radius:
    the cells in which the corners of the box around it lie, 2.25 of them on average. A cell is
    wider than such a box, near a pole it goes all around."""
    dlat, half = _measures(radius_m * width)
    up, reach = _measures(radius_m)
    band = lambda y: F.floor(y / dlat).cast("long")
    lat, lon, y, n = F.col("lat"), F.col("lon"), F.col("_y"), F.col("_n")
    df = df.withColumn("_y", F.explode(F.array_distinct(F.array(band(lat - up), band(lat + up)))) if near else band(lat)).withColumn("_n", _around(y, dlat, half))
    if not near:
        return df.withColumn("_x", _cell_of(lon, n)).drop("_n")
    top = F.least(F.greatest(F.abs(y - 1), F.abs(y + 2)) * dlat, F.lit(90.0))  # as in _around
    df = df.withColumn("_d", F.degrees(2 * F.asin(F.least(F.lit(reach) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)), F.lit(1.0)))))
    return df.withColumn("_x", F.explode(F.array_distinct(F.array(_cell_of(lon - F.col("_d"), n), _cell_of(lon + F.col("_d"), n))))).drop("_n", "_d")


def range_join(left: DataFrame, right: DataFrame, radius_m: float, keys: list[str], how: str = "inner", extra: Column | None = None, metres: Metres = distance_m) -> DataFrame:
    """Rows of `left` (l_lat, l_lon) with rows of `right` (r_lat, r_lon) at most `radius_m`
    apart and equal in `keys` (as l_KEY and r_KEY), with dist_m.

    A grid turns it into an equi-join. Its bands of latitude are at least the radius wide, and
    each band's cells as wide in longitude as the radius can reach there: near a pole one cell
    goes all around. A row of `left` looks into its cell and those around it in its band and the
    two next, across the antimeridian too, so each pair meets once. Null points and keys meet
    nothing. A dense cell is split by the adaptive skew join, as both sides are plain shuffles.
    metres: `distance_m`, or `spheroid_m`, which differs by 0.6 % at most: cells are widened."""
    dlat, half = _measures(radius_m * (1.0 if metres is distance_m else 1.006))
    around, cell_of = lambda band: _around(band, dlat, half), _cell_of
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = left.where(has_point("l_lat", "l_lon")).withColumn("_y", F.explode(F.transform(steps, lambda i: F.floor(F.col("l_lat") / dlat) + i))).withColumn("_n", around(F.col("_y")))
    near = near.withColumn("_x", F.explode(F.array_distinct(F.transform(steps, lambda i: F.pmod(cell_of(F.col("l_lon"), F.col("_n")) + i, F.col("_n")))))).drop("_n")
    far = right.where(has_point("r_lat", "r_lon")).withColumn("_v", F.floor(F.col("r_lat") / dlat)).withColumn("_u", cell_of(F.col("r_lon"), around(F.col("_v"))))
    same = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    on = reduce(lambda a, b: a & b, same, (F.col("_y") == F.col("_v")) & (F.col("_x") == F.col("_u")))
    d = metres((F.col("l_lat"), F.col("l_lon")), (F.col("r_lat"), F.col("r_lon")))
    within = within_m((F.col("l_lat"), F.col("l_lon")), (F.col("r_lat"), F.col("r_lon")), radius_m, metres)
    met = near.join(far, on & within & (extra if extra is not None else F.lit(True)), how)
    return met.withColumn("dist_m", d).drop("_y", "_x", "_v", "_u")


class Nearest:
    """The k rows of `right` (r_id, r_lat, r_lon, r_KEY) of least score for each row of `left`
    (l_id, l_lat, l_lon, l_KEY) among those with equal keys, ties by r_id.

    score: a column over l_ and r_ columns, at least their distance in `unit_m` metres; null
    scores don't count. axis: a number on both sides (l_axis, r_axis) of which the score holds
    the squared difference too, up to the square of `axis_most`. sides: cell widths in metres,
    ascending; `radius_m`: how far to look (the whole key, if None), at most the last side. A row
    without a number on the axis has the distance only as its score, or on the right the most
    that the axis can add. Ids of `left` tell its rows apart; rows without a point or key find nothing.

    Rings of cells around a row widen until they must hold its k best. Cells of all widths are
    counted first; the least cell of a row that holds k rows gives a bound, its kth score there.
    No better row lies farther away than that, so the row then looks only into cells of at
    least the bound's width that the bound reaches, and keeps what is within the bound. So what a row meets
    grows with k and with how unevenly cells next to each other are filled, not with the number
    of rows in its key. Of rows of `right` alike in place, axis and keys, only the k least ids
    are looked at: no others can be found. Where no key has more than `few` rows, a row simply
    meets all of its key: that is bounded too, and costs less than looking for cells."""

    def __init__(self, left: DataFrame, right: DataFrame, k: int, keys: list[str], score: Column, sides: list[float], unit_m: float = 1.0, radius_m: float | None = None, axis_most: float | None = None, few: int = 500) -> None:
        self.k, self.keys, self.score, self.sides, self.unit = k, keys, score, sides, unit_m
        self.radius, self.axis_most, self.few = radius_m, axis_most, few
        self.levels = F.array(*[self._level(n) for n in range(len(sides) + (radius_m is None))])
        axis = lambda df, tag: df if axis_most else df.withColumn(f"{tag}_axis", F.lit(None).cast("double"))
        self.left = axis(left.where(has_point("l_lat", "l_lon")), "l")
        self._all = axis(right.where(has_point("r_lat", "r_lon")), "r")
        alike = Window.partitionBy(*[f"r_{c}" for c in keys], "r_lat", "r_lon", "r_axis").orderBy("r_id")
        self.right = self._all.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n")
        self.steps: list[DataFrame] = []  # tables stored on the way
        self.lacking = bool(axis_most)  # whether rows of `left` may lack the number on the axis

    def _level(self, n: int) -> Column:
        """A cell width with what belongs to it: height, half chord, and the width of the bands
        on the axis (0: none, as the score reaches over the whole axis); the last may be one
        cell for all."""
        whole = n == len(self.sides)
        width = 0.0 if whole or (self.radius is not None and n == len(self.sides) - 1) else math.sqrt(self.sides[n] / self.unit)  # the last holds all that count
        dlat, half = (360.0, 1.0) if whole else _measures(self.sides[n])
        return F.struct(F.lit(n).alias("n"), F.lit(dlat).alias("dlat"), F.lit(half).alias("half"), F.lit(width if self.axis_most and width < self.axis_most else 0.0).alias("width"), F.lit(whole).alias("whole"))

    def _keyed(self, df: DataFrame, tag: str) -> DataFrame:
        """Cells as one number, of keys and place: `_cell` instead of _y, _x and _b."""
        return df.withColumn("_cell", F.xxhash64(*[f"{tag}_{c}" for c in self.keys], "_level", "_y", "_x", "_b")).drop("_y", "_x", "_b")

    def _met(self, looks: DataFrame, cells: DataFrame) -> DataFrame:
        """Rows of `left` with those of `right` in the cells that they look into. Keys are compared
        beside the cells' numbers, and not joined on: one number is sorted and shuffled by."""
        same = reduce(lambda a, b: a & b, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in self.keys])
        return looks.join(cells.drop("_level"), "_cell").where(F.coalesce(same, F.lit(False)))

    def _placed(self, df: DataFrame, tag: str) -> DataFrame:
        """Rows that have a level `_v` with their cell in it: _level, _y, _x and _b."""
        v, whole = F.col("_v"), F.col("_v.whole")
        df = df.withColumn("_level", v.n).withColumn("_y", F.when(whole, 0).otherwise(F.floor(F.col(f"{tag}_lat") / v.dlat)).cast("long"))
        df = df.withColumn("_x", F.when(whole, 0).otherwise(_cell_of(F.col(f"{tag}_lon"), _around(F.col("_y"), v.dlat, v.half))).cast("long"))
        axis = F.col(f"{tag}_axis")
        return df.withColumn("_b", F.when(v.width == 0, 0).when(axis.isNotNull(), F.floor(axis / v.width)).otherwise(F.lit(_NO_BAND)).cast("long")).drop("_v")

    def cells(self, levels: list[int] | None = None) -> DataFrame:
        """`right` in its cells of all widths, or of those of `levels`; with a number on the axis,
        also where rows of `left` without one look, if there are any."""
        held = self.levels if levels is None else F.array(*[self._level(n) for n in levels])
        out = self._placed(self.right.withColumn("_v", F.explode(held)), "r")
        if self.lacking:
            out = out.withColumn("_b", F.explode(F.when(F.col("r_axis").isNotNull() & F.element_at(self.levels, F.col("_level") + 1)["width"].cast("boolean"), F.array("_b", F.lit(_NO_BAND))).otherwise(F.array("_b"))))
        return self._keyed(out, "r")

    def bounds(self) -> DataFrame:
        """(l_id, bound): the kth score in the least cell around a row that holds k rows."""
        full = self.cells().groupBy("_cell").count().where(F.col("count") >= self.k)
        own = self._keyed(self._placed(self.left.withColumn("_v", F.explode(self.levels)), "l"), "l")
        least = stored(own.select("l_id", "_cell", "_level").join(full.drop("count"), "_cell").groupBy("l_id").agg(F.min("_level").alias("_w")), "least")
        self.steps.append(least)
        looks = self._keyed(self._placed(self.left.join(least, "l_id").withColumn("_v", F.element_at(self.levels, F.col("_w") + 1)).drop("_w"), "l"), "l")
        used = sorted(r[0] for r in least.select("_w").distinct().collect())  # a number for each width at most
        if not used:
            return least.select("l_id", F.lit(None).cast("double").alias("bound"))
        met = self._met(looks, self.cells(used)).select("l_id", self.score.alias("score"), "r_id").where("score is not null")
        nth = F.row_number().over(Window.partitionBy("l_id").orderBy("score", "r_id"))
        return met.withColumn("_n", nth).where(F.col("_n") == self.k).select("l_id", F.col("score").alias("bound"))

    def candidates(self) -> DataFrame:
        """Rows of `left` with those of `right` that may be among its k best, with their score."""
        last = len(self.sides) - (self.radius is not None)
        wide = F.array_position(F.transform(F.array(*[F.lit(x) for x in self.sides]), lambda x: x >= F.col("bound") * self.unit), True) - 1
        level = F.when(F.col("bound").isNull() | (wide < 0), last).otherwise(wide).cast("int")
        bounded = stored(self.left.join(self.bounds(), "l_id", "left").withColumn("_w", level), "bounded")
        self.steps.append(bounded)
        used = sorted(r[0] for r in bounded.select("_w").distinct().collect())  # a number for each width at most
        looks = self._placed(bounded.withColumn("_v", F.element_at(self.levels, F.col("_w") + 1)).drop("_w"), "l")
        v, ends = F.col("_v"), (lambda c, reach, of: F.array_distinct(F.array(*[of(x) for x in (c - reach, c, c + reach)])))
        looks = looks.withColumn("_v", F.element_at(self.levels, F.col("_level") + 1))
        sides = F.element_at(F.array(*[F.lit(x) for x in self.sides], F.lit(math.pi * EARTH_M)), F.col("_level") + 1)
        looks = looks.withColumn("_m", F.least(F.coalesce(F.col("bound") * self.unit, sides), sides))
        # how far the box around a row reaches: in latitude, in longitude (at most as far from the equator as that) and on the axis
        top = F.least(F.abs("l_lat") + F.col("_up"), F.lit(90.0))
        chord = F.sin(F.least(F.col("_m") / EARTH_M / 2, F.lit(math.pi / 2))) * 1.0001
        looks = looks.withColumn("_up", F.when(v.whole, 360.0).otherwise(F.degrees(F.col("_m") / EARTH_M) * 1.01)).withColumn("_chord", chord)
        looks = looks.withColumn("_aside", F.when(v.whole, 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.col("_chord") / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)), F.lit(1.0))))))
        along = F.sqrt("bound") * (1 + 1e-9) + 1e-9
        looks = looks.withColumn("_along", F.when(along < (self.axis_most or 0.0), along))
        looks = looks.withColumn("_y", F.explode(F.when(v.whole, F.array("_y")).otherwise(ends(F.col("l_lat"), F.col("_up"), lambda y: F.floor(y / v.dlat).cast("long")))))
        looks = looks.withColumn("_n", _around(F.col("_y"), v.dlat, v.half))
        edge = F.least(F.greatest(F.abs(F.col("_y") - 1), F.abs(F.col("_y") + 2)) * v.dlat, F.lit(90.0))  # as in _around
        looks = looks.withColumn("_d", F.degrees(2 * F.asin(F.least(F.col("_chord") / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)), F.lit(1.0)))))
        looks = looks.withColumn("_x", F.explode(F.when(v.whole, F.array(F.lit(0).cast("long"))).otherwise(ends(F.col("l_lon"), F.col("_d"), lambda x: _cell_of(x, F.col("_n"))))))
        banded = (v.width > 0) & F.col("l_axis").isNotNull()
        steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
        bands = F.when(F.col("_along").isNull(), F.transform(steps, lambda i: F.col("_b") + i)).otherwise(ends(F.col("l_axis"), F.col("_along"), lambda x: F.floor(x / v.width).cast("long")))
        looks = looks.withColumn("_b", F.explode(F.when(banded, bands).otherwise(F.array("_b")))).drop("_v", "_n", "_d", "_m", "_chord")
        met = self._met(self._keyed(looks, "l"), self.cells(used or [last]))
        apart = F.abs(F.col("l_lon") - F.col("r_lon"))
        boxed = (F.abs(F.col("l_lat") - F.col("r_lat")) <= F.col("_up")) & (F.least(apart, F.abs(360 - apart)) <= F.col("_aside")) & F.coalesce(F.abs(F.col("l_axis") - F.col("r_axis")) <= F.col("_along"), F.lit(True))
        met = met.where(boxed).drop("_up", "_aside", "_along")  # before the score, which takes longer
        return met.withColumn("score", self.score).where("score <= bound or (bound is null and score is not null)").drop("_level", "_cell", "bound")

    def best(self) -> DataFrame:
        """The k best of each row, with `score` and `rank`, stored."""
        rank = F.row_number().over(Window.partitionBy("l_id").orderBy("score", "r_id"))
        most = self._all.groupBy(*[f"r_{c}" for c in self.keys]).count().agg(F.max("count")).first()[0] or 0
        if most <= self.few:
            same = self._all.withColumnsRenamed({f"r_{c}": f"l_{c}" for c in self.keys})
            met = self.left.join(same, [f"l_{c}" for c in self.keys]).withColumn("score", self.score).where("score is not null")
            return stored(met.withColumn("rank", rank).where(F.col("rank") <= self.k), "nearest")
        self.left, self.right = stored(self.left, "near-left"), stored(self.right, "near-right")  # read several times
        self.lacking = self.lacking and bool(self.left.where("l_axis is null").take(1))
        out = stored(self.candidates().withColumn("rank", rank).where(F.col("rank") <= self.k), "nearest")
        dropped(self.left, self.right, *self.steps)
        return out


def widening(least_m: float, most_m: float, factor: float = 4.0) -> list[float]:
    """Cell widths from `least_m`, each `factor` times the one before, up to `most_m`."""
    out = [least_m]
    while out[-1] < most_m:
        out.append(min(out[-1] * factor, most_m))
    return out


def prefixed(df: DataFrame, tag: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{tag}_{c}") for c in df.columns])
