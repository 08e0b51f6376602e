"""Points in intervals by equality: an interval is cut into aligned cells, a point lies in one cell of each width.

Widths are powers of RADIX. An interval takes at most 14 cells of a width and
none of a width above its own, however long it is, and a point 11 keys, so a
long file or function needs no comparison of its points with its intervals,
and its rows spread over many keys. Keys with few intervals, as most functions
are, meet them all at once instead: no row is copied. Places run from 0 to
2^31 - 1; null places and intervals that end before they begin meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

RADIX, LEVELS = 8, 11
#: Rows of one key, intervals or statements, up to which all of them are compared with each other.
FEW = 64


def cells(first: Column, last: Column) -> Column:
    """Structs (level, cell) that make up [first, last] without overlap."""
    end = last.cast("long") + 1
    up = lambda k: F.ceil(first.cast("long") / F.lit(RADIX**k)).cast("long")
    down = lambda k: F.floor(end / F.lit(RADIX**k)).cast("long")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    out = []
    for k in range(LEVELS):
        a, b, c, d = up(k), down(k), up(k + 1), down(k + 1)
        # what the next width covers is left to it
        own = F.when(c < d, F.concat(run(a, c * RADIX), run(d * RADIX, b))).otherwise(run(a, b))
        out.append(F.transform(own, _at(k)))
    return F.concat(*out)


def _at(level: int):
    return lambda x: F.struct(F.lit(level).alias("level"), x.alias("cell"))


def keys(place: Column) -> Column:
    """Structs (level, cell) of the cells that hold a place."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(place.cast("long") / F.lit(RADIX**k)).cast("long").alias("cell")) for k in range(LEVELS)])


def crowded(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """The keys of more than FEW rows, as a table; None if there are none."""
    many = cut(rows.groupBy(*by).count().filter(F.col("count") > FEW).select(*by))
    return None if many.isEmpty() else many


def inside(points: DataFrame, spans: DataFrame, by: list[str], place: str = "pos", first: str = "first", last: str = "last") -> DataFrame:
    """Every pair of a point and a span around it, of equal by: all columns of both. Columns of either side other than by must differ in name."""
    p, s = points.filter(F.col(place).isNotNull()), spans.filter(F.col(first) <= F.col(last))
    many = crowded(s, by)
    few = s if many is None else s.join(many, by, "left_anti")
    met = p.join(few, by).filter(F.col(place).between(F.col(first), F.col(last)))
    return met if many is None else met.unionByName(_by_cells(p.join(many, by, "left_semi"), s.join(many, by, "left_semi"), by, place, first, last))


def _by_cells(p: DataFrame, s: DataFrame, by: list[str], place: str, first: str, last: str) -> DataFrame:
    p = p.withColumn("__at", F.explode(keys(F.col(place))))
    s = s.withColumn("__at", F.explode(cells(F.col(first), F.col(last))))
    return p.join(s, [*by, "__at"]).drop("__at")
