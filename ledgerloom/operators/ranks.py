"""Ranks and running sums over any number of rows, without a task that sees a whole group.

Values are dealt into parts by borders that one aggregation of quantile sketches finds for every group.  Sums run inside the
parts; what stands before a part is the sum of the parts before it, one row a part and group.  Equal values share a part, so
the borders only decide how rows are dealt, never a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the number of parts of a group, and the sketch's accuracy for each of them.
PART_BITS, ACCURACY = 6, 20


def _part(value: Column, borders: Column) -> Column:
    """How many of the sorted borders are below the value, by binary search; null and empty borders are part 0."""

    def step(at: Column, width: Column) -> Column:
        border = F.get(borders, at + width - 1)
        return F.when(border.isNotNull() & (border < value), at + width).otherwise(at)

    widths = F.array(*[F.lit(1 << k) for k in reversed(range(PART_BITS))])
    return F.coalesce(F.aggregate(widths, F.lit(0), step), F.lit(0))


def running(rows: DataFrame, value: str, sums: dict[str, str], *by: str, descending: bool = False) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``sums``, the sum of ``column`` up to and with the row's value in ``name``.

    ``all_<name>`` has the sum of the whole group.  Rows of equal value (nulls too) get the same sums.
    """
    keys = [*by, "__group"] if not by else list(by)
    marked = rows if by else rows.withColumn("__group", F.lit(0))
    points = (1 << PART_BITS) - 1
    shares = [k / (points + 1) for k in range(1, points + 1)]
    borders = marked.groupBy(*keys).agg(F.array_sort(F.percentile_approx(F.col(value).cast("double"), shares, ACCURACY * points)).alias("__borders"))
    dealt = _met(marked, borders, keys).withColumn("__part", _part(F.col(value).cast("double"), F.col("__borders"))).drop("__borders")
    totals = dealt.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    parts = Window.partitionBy(*keys).orderBy(F.col("__part").desc() if descending else F.col("__part").asc())
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums], *[F.sum(f"__{n}").over(Window.partitionBy(*keys)).alias(f"all_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__part").orderBy(F.col(value).desc() if descending else F.col(value).asc())
    out = _met(dealt, moved, [*keys, "__part"]).withColumns({name: F.sum(c).over(inside) + F.col(f"__{name}") for name, c in sums.items()})
    return out.drop("__part", "__group", *[f"__{n}" for n in sums])


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join whose keys may be null."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    others = [c for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[F.col(f"r.{c}") for c in others])


def average_percentiles(rows: DataFrame, values: list[str], keys: list[str], *by: str) -> DataFrame:
    """``keys`` (unique) and, for each value, ``pct_<value>``: its average rank among the group's non-null values over their number.

    All values are ranked at once in a long form; distinct values are counted first.  Null values have no rank.
    """
    names = list(dict.fromkeys([*keys, *by]))
    long = rows.select(*names, F.explode(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*names, "x.*").filter("value IS NOT NULL")
    counts = long.groupBy(*by, "what", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, "value", {"upto": "n"}, *by, "what")
    percentile = ranked.select(*by, "what", "value", ((F.col("upto") - (F.col("n") - 1) / F.lit(2.0)) / F.col("all_upto")).alias("pct"))
    found = _met(long, percentile, [*by, "what", "value"])
    return found.groupBy(*names).agg(*[F.max(F.when(F.col("what") == v, F.col("pct"))).alias(f"pct_{v}") for v in values])


def with_neighbour(rows: DataFrame, position: str, columns: list[str], step: int, rows_per_block: int = 1_000_000, least_blocks: int = 16) -> DataFrame:
    """``rows`` with ``near_<column>``: the values of the next (``step`` 1) or last (-1) row by a unique integer position.

    Blocks of positions grow in number with the rows; each gets the one row that stands at its border as a copy.
    """
    bounds = rows.agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    low, high = bounds["lo"] or 0, bounds["hi"] or 0
    width = max(1, -(-(high - low + 1) // max(least_blocks, -(-bounds["n"] // rows_per_block))))
    blocked = rows.withColumns({"__block": F.floor((F.col(position) - F.lit(low)) / width).cast("long"), "__copy": F.lit(False)})
    edge = F.min_by if step > 0 else F.max_by
    ends = blocked.groupBy("__block").agg(edge(F.struct(*blocked.columns), position).alias("e"))
    # The neighbouring block may be empty: its border row comes from the nearest one that is not.  One row a block.
    order = Window.partitionBy(F.col("__all")).orderBy("__block")
    other = (F.lag if step > 0 else F.lead)("__block").over(order)
    copies = ends.withColumn("__all", F.lit(0)).withColumn("__to", other).filter("__to IS NOT NULL").select(*[F.col(f"e.`{c}`").alias(c) for c in rows.columns], F.col("__to").alias("__block"), F.lit(True).alias("__copy"))
    inside = Window.partitionBy("__block").orderBy(position)
    near = F.lead if step > 0 else F.lag
    both = blocked.unionByName(copies).withColumns({f"near_{c}": near(c).over(inside) for c in columns})
    return both.filter("NOT __copy").drop("__block", "__copy")
