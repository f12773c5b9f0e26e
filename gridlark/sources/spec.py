"""Where a DataFrame keeps its ids and its geometry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.geometry import BASE_TOLERANCE, Box
from gridlark.plans.storage import cut

CONTIGUOUS, STABLE, KEYED = "contiguous", "stable", "keyed"


@dataclass(frozen=True)
class GeometrySpec:
    """kind is `point` or `box`. lo and hi are SQL expressions of coordinates; points have no hi.

    ids says what a delete does: keyed ids are columns like any other, contiguous
    ids are row numbers that close up, stable ids never change.
    """

    kind: str
    lo: Sequence[str]
    hi: Sequence[str] = ()
    key: Sequence[str] = ("id",)
    tolerance: float = BASE_TOLERANCE
    ids: str = KEYED
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("point", "box"):
            raise ValueError("kind is point or box")
        if self.kind == "box" and len(self.lo) != len(self.hi):
            raise ValueError("a box has as many upper as lower coordinates")
        if not 1 <= len(self.lo) <= 63:
            raise ValueError("1 to 63 dimensions")

    @property
    def dims(self) -> int:
        return len(self.lo)

    def _columns(self, names: Sequence[str], side: str) -> list[Column]:
        prefix = f"{side}." if side else ""
        return [(F.col(prefix + n) if n.isidentifier() else F.expr(n)).cast("double") for n in names]

    def point(self, side: str = "") -> list[Column]:
        return self._columns(self.lo, side)

    def box(self, side: str = "") -> Box:
        """The box of a row; a point is a flat one."""
        lo = self._columns(self.lo, side)
        return Box(lo, self._columns(self.hi, side) if self.kind == "box" else lo)

    def checked(self, df: DataFrame) -> DataFrame:
        """df, if it has all columns."""
        df.select(*self.key, *self.point(), *self.box().hi).schema  # noqa: B018  analysis fails where one is missing
        return df


def points(dims: int, key: str = "id", **more) -> GeometrySpec:
    """Columns p0, p1, ..."""
    return GeometrySpec("point", [f"p{d}" for d in range(dims)], key=(key,), **more)


def boxes(dims: int, key: str = "id", **more) -> GeometrySpec:
    """Columns min0, max0, min1, ..."""
    return GeometrySpec("box", [f"min{d}" for d in range(dims)], [f"max{d}" for d in range(dims)], key=(key,), **more)


def xyz(dims: int = 3, key: str = "id") -> GeometrySpec:
    """Columns x, y, z, w."""
    return GeometrySpec("point", list("xyzw"[:dims]), key=(key,))


def struct_points(name: str, dims: int = 3, key: str = "id") -> GeometrySpec:
    """A struct with fields x, y, z, w."""
    return GeometrySpec("point", [f"{name}.{c}" for c in "xyzw"[:dims]], key=(key,))


def array_points(name: str, dims: int, key: str = "id") -> GeometrySpec:
    """The first components of an array."""
    return GeometrySpec("point", [f"{name}[{d}]" for d in range(dims)], key=(key,))


def struct_boxes(name: str, dims: int = 3, key: str = "id") -> GeometrySpec:
    """A struct with structs or arrays min and max: STRUCT<min: ARRAY, max: ARRAY>."""
    return GeometrySpec("box", [f"{name}.min[{d}]" for d in range(dims)], [f"{name}.max[{d}]" for d in range(dims)], key=(key,))


def with_row_ids(df: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """Contiguous ids 0, 1, ... in the order of these columns, without one task for all rows.

    Range partitioning draws its borders anew each time it runs; so rows are
    written with their partition's number and their place in it before they are counted.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    # One number for each partition.
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, first = [], 0
    for p in sorted(counts):
        starts.append((p, first))
        first += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return parts.join(F.broadcast(offsets), "_part").withColumn(key, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
