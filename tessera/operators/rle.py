"""Run-length frames: one row per run, (start_vid, length, value columns); filters, projections, aggregates and joins
work on runs, and ``decode`` is the only step that repeats values.

Positions (vids) are dense from 0 in a total order given by the caller. They are made without a one-partition sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import numbered

#: Rows of one window partition while runs are found, and positions of one bin while ranges are intersected.
BLOCK = 65_536
#: Positions that one generated row expands to at most while decoding.
CHUNK = 8_192


def with_vid(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``vid``. ``order_by`` must be a total order, else equal rows get their positions in any order."""
    return numbered(df, [F.col(c).asc_nulls_first() for c in order_by], "vid")


def encode(df: DataFrame, values: Sequence[str], order_by: Sequence[str] | None = None, vid: str = "vid") -> "RLEFrame":
    """Runs of equal ``values`` in the order of ``order_by`` (or of an existing dense ``vid`` column); nulls equal nulls.

    Runs are found inside blocks of positions, then runs that go on over block edges are joined by way of a table of
    one row per block, so no value and no long run lands in one task.
    """
    if order_by is not None:
        df = with_vid(df.select(*dict.fromkeys([*values, *order_by])), order_by)
        vid = "vid"
    rows = df.select(F.col(vid).alias("__v"), F.struct(*[F.col(c) for c in values]).alias("__val"), F.floor(F.col(vid) / BLOCK).alias("__b"))
    inside = Window.partitionBy("__b").orderBy("__v")
    new = F.when(F.lag("__v").over(inside).isNull() | ~F.col("__val").eqNullSafe(F.lag("__val").over(inside)), F.col("__v"))
    runs = (
        rows.withColumn("__s", F.last(new, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__b", "__s")
        .agg(F.first("__val").alias("__val"), F.count(F.lit(1)).alias("__n"))
    )
    edges = runs.groupBy("__b").agg(
        F.min_by("__val", "__s").alias("__first"), F.max_by("__val", "__s").alias("__last"), F.min("__s").alias("__s0"), F.max("__s").alias("__s1")
    )
    along = Window.orderBy("__b")  # one row per block of positions
    edges = edges.withColumn("__on", F.coalesce(F.col("__first").eqNullSafe(F.lag("__last").over(along)) & F.lag("__b").over(along).isNotNull(), F.lit(False)))
    opens = F.when(~F.col("__on") | (F.col("__s0") < F.col("__s1")), F.col("__s1"))  # its last run starts here
    edges = edges.withColumn("__from", F.last(opens, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    moved = edges.where("__on").select("__b", F.col("__s0").alias("__s"), "__from")
    joined = runs.join(moved, ["__b", "__s"], "left").withColumn("start_vid", F.coalesce("__from", "__s"))
    out = joined.groupBy("start_vid").agg(F.sum("__n").alias("length"), F.first("__val").alias("__val"))
    return RLEFrame(out.select("start_vid", "length", *[F.col("__val")[c].alias(c) for c in values]), tuple(values))


def _starts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / CHUNK).cast("long")))


@dataclass(frozen=True)
class RLEFrame:
    """Runs and the names of their value columns. ``start_vid`` has a meaning up to a join or aggregate."""

    runs: DataFrame
    values: tuple[str, ...]

    def where(self, condition: Column | str) -> "RLEFrame":
        """Tests each run once."""
        return RLEFrame(self.runs.where(condition), self.values)

    def select(self, **columns: Column | str) -> "RLEFrame":
        """Evaluates each expression once a run; neighbouring equal runs are left apart."""
        made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
        return RLEFrame(self.runs.select("start_vid", "length", *made), tuple(columns))

    def agg(self, group: Sequence[str], **aggregates: tuple[str, str]) -> DataFrame:
        """name=(function, column or expression): sum, count, avg weigh a run by its length; min and max need not. count of '*' counts rows."""
        made = []
        for name, (kind, what) in aggregates.items():
            x, n = (None if what == "*" else F.expr(what)), F.col("length")
            weight = F.when(x.isNotNull(), n) if x is not None else n
            made.append(
                {
                    "sum": lambda: F.sum(x * n),
                    "count": lambda: F.coalesce(F.sum(weight), F.lit(0)).cast("long"),
                    "avg": lambda: F.try_divide(F.sum(x * n).cast("double"), F.sum(weight)),
                    "min": lambda: F.min(x),
                    "max": lambda: F.max(x),
                }[kind]().alias(name)
            )
        return self.runs.groupBy(*group).agg(*made) if group else self.runs.agg(*made)

    def join(self, other: "RLEFrame", on: Sequence[tuple[str, str]]) -> "RLEFrame":
        """Equi-join of runs: m and n equal rows make m * n, and positions lose their meaning."""
        a, b = self.runs.drop("start_vid").alias("a"), other.runs.drop("start_vid").alias("b")
        condition = None
        for x, y in on:
            term = F.col(f"a.{x}") == F.col(f"b.{y}")
            condition = term if condition is None else condition & term
        columns = [F.col(f"a.{c}").alias(c) for c in self.values] + [F.col(f"b.{c}").alias(c) for c in other.values if c not in self.values]
        out = a.join(b, condition).select(F.lit(None).cast("long").alias("start_vid"), (F.col("a.length") * F.col("b.length")).alias("length"), *columns)
        return RLEFrame(out, tuple(dict.fromkeys([*self.values, *other.values])))

    def reconstruct(self, other: "RLEFrame") -> "RLEFrame":
        """Realigns columns of one table: the overlap of each pair of ranges, with both sides' values.

        Ranges are dealt to blocks of positions. In a block, in the order of their starts, each range meets the last
        one of the other side that began before it: a sort, and no join. An overlap counts in the block where it begins.
        """
        end = F.col("start_vid") + F.col("length")

        def spread(r: DataFrame, left: bool, names: tuple[str, ...]) -> DataFrame:
            own = F.struct(F.col("start_vid").alias("s"), end.alias("e"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
            sides = [own.alias("l"), F.lit(None).alias("r")] if left else [F.lit(None).alias("l"), own.alias("r")]
            blocks = F.explode(F.sequence(F.floor(F.col("start_vid") / BLOCK), F.floor((end - 1) / BLOCK)))
            return r.select(blocks.alias("__b"), F.col("start_vid").alias("__s"), *sides)

        extra = tuple(c for c in other.values if c not in self.values)
        kind = lambda frame, names: spread(frame.runs, False, names).schema["r"].dataType
        a = spread(self.runs, True, self.values).withColumn("r", F.col("r").cast(kind(other, extra)))
        b = spread(other.runs, False, extra)
        b = b.withColumn("l", F.col("l").cast(a.schema["l"].dataType))
        inside = Window.partitionBy("__b").orderBy("__s")
        upto = inside.rangeBetween(Window.unboundedPreceding, 0)
        met = a.unionByName(b).select(
            "__b", F.last("l", ignorenulls=True).over(upto).alias("l"), F.last("r", ignorenulls=True).over(upto).alias("r"), F.lag("__s").over(inside).eqNullSafe(F.col("__s")).alias("__again")
        )
        start, stop = F.greatest("l.s", "r.s"), F.least("l.e", "r.e")
        met = met.where(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("__again") & (start < stop) & (F.floor(start / BLOCK) == F.col("__b")))
        columns = [F.col(f"{s}.v{i}").alias(c) for s, names in (("l", self.values), ("r", extra)) for i, c in enumerate(names)]
        # ranges that began in an earlier block and meet in this one are seen at the later start, which is in this block
        out = met.select(start.alias("start_vid"), (stop - start).alias("length"), *columns)
        return RLEFrame(out, (*self.values, *extra))

    def decode(self, positions: bool = True) -> DataFrame:
        """One row per position; long runs go through chunks, so no generated array is long."""
        chunks = self.runs.withColumn("__c", _starts())
        length = F.least(F.lit(CHUNK).cast("long"), F.col("length") - F.col("__c") * CHUNK)
        rows = chunks.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), length - 1)))
        vid = (F.col("start_vid") + F.col("__c") * CHUNK + F.col("__o")).alias("vid")
        return rows.select(*([vid] if positions else []), *self.values)
