"""Rows stored by where they lie on the map, so that a viewport reads few folders.

Rows with coordinates are range-partitioned along a Z-order curve over (lat, lng) and stored, a folder a partition; beside them a table
of boxes: each folder's rows and the least and greatest coordinates in it. A viewport reads the folders whose
boxes it meets. Rows at one point are dealt on by a tie-breaker: a place that holds a third of all rows takes many folders.

* Rows without both coordinates (null, NaN) lie nowhere and are not stored. Coordinates beyond the poles or the date
  line count to the outermost cells; their boxes are as they are, so they are found all the same.
* A viewport's edges belong to it. One whose west is greater than its east crosses the date line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TILE = "_tile"
BITS = 16  # of each coordinate in the curve: cells of 300 by 600 metres at the equator
Box = tuple[float, float, float, float]  # south, west, north, east


def _cell(x: Column, least: float, most: float) -> Column:
    top = (1 << BITS) - 1
    return F.least(F.greatest(F.floor((x - least) / (most - least) * (1 << BITS)), F.lit(0)), F.lit(top)).cast("long")


def z_order(lat: Column, lng: Column) -> Column:
    """The bits of both coordinates' cells in turn."""
    y, x = _cell(lat, -90, 90), _cell(lng, -180, 180)
    bit = lambda c, k, to: F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), to)
    return reduce(Column.bitwiseOR, [bit(c, k, 2 * k + i) for k in range(BITS) for i, c in enumerate((x, y))])


def _within(west: float, east: float, least: Column, most: Column) -> Column:
    """Whether [least, most] meets the viewport's longitudes."""
    if west <= east:
        return (least <= east) & (most >= west)
    return (most >= west) | (least <= east)


@dataclass
class MapIndex:
    rows: DataFrame   # the rows, with TILE
    boxes: DataFrame  # TILE, n, south, west, north, east
    lat: str
    lng: str

    def met(self, box: Box) -> DataFrame:
        """The folders that a viewport reads."""
        s, w, n, e = box
        return self.boxes.filter((F.col("south") <= n) & (F.col("north") >= s) & _within(w, e, F.col("west"), F.col("east")))

    def inside(self, box: Box) -> DataFrame:
        """The rows inside the viewport."""
        s, w, n, e = box
        # a row a folder: some megabytes for 100,000 of them
        rows = self.rows.join(F.broadcast(self.met(box).select(TILE)), TILE).drop(TILE)
        return rows.filter(F.col(self.lat).between(s, n) & _within(w, e, F.col(self.lng), F.col(self.lng)))


def build(df: DataFrame, tie: Column, partitions: int, lat: str = "lat", lng: str = "lng") -> MapIndex:
    """The index of ``df``. ``tie`` (a key) deals rows at one point over partitions."""
    known = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lng).cast("double")))
    placed = known.repartitionByRange(partitions, z_order(F.col(lat), F.col(lng)), F.xxhash64(tie))
    rows = materialize(placed.withColumn(TILE, F.spark_partition_id()), "tiles", partition_by=TILE)
    boxes = rows.groupBy(TILE).agg(F.count(F.lit(1)).alias("n"), F.min(lat).alias("south"), F.min(lng).alias("west"),
                                   F.max(lat).alias("north"), F.max(lng).alias("east"))
    return MapIndex(rows, materialize(boxes, "boxes"), lat, lng)
