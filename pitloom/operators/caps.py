"""Weights under caps, exact, by sorted prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def proportional(book: DataFrame, keys: list[str], weight: str, cap: Column, budget: Column | float, name: str) -> DataFrame:
    """book with `name`, least(cap, factor * weight), where each group's factor makes the sum the budget.

    This is what handing the excess of capped rows to free ones, by weight,
    comes to in the end, whatever number of rounds that takes.  Rows are put
    in order of cap / weight; those before the first that a common factor
    leaves under its cap are capped.  Where all caps together don't reach the
    budget, every row with a weight is at its cap.  Null, NaN, zero and
    negative weights get 0, as does a null cap; a negative cap is 0.  Rows of
    null keys are a group.  One window over each group: a group is a book, as
    large as the universe.
    """
    w, c = F.col("_w"), F.col("_c")
    known = (F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double"))
    rows = book.withColumns({"_w": F.when(known, F.col(weight).cast("double")).otherwise(0.0), "_c": F.when(known, F.greatest(F.coalesce(cap.cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)})
    rows = rows.withColumn("_r", F.when(w > 0, c / w).otherwise(F.lit(float("inf"))))
    order = Window.partitionBy(*keys).orderBy("_r")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = budget if isinstance(budget, Column) else F.lit(float(budget))
    factor = F.try_divide(total - F.coalesce(F.sum(c).over(before), F.lit(0.0)), F.sum(w).over(rest))
    rows = rows.withColumn("_f", factor).withColumn("_f", F.max(F.when(F.col("_f") <= F.col("_r"), F.col("_f"))).over(Window.partitionBy(*keys)))
    return rows.withColumn(name, F.when(F.col("_f").isNull(), c).otherwise(F.least(c, F.greatest(F.col("_f"), F.lit(0.0)) * w))).drop("_w", "_c", "_r", "_f")


def two_level(book: DataFrame, keys: list[str], sector: str, weight: str, name_cap: float, sector_cap: float, budget: float, name: str) -> DataFrame:
    """book with `name`: weights by a common factor, no row above name_cap, no sector of a group above sector_cap, in sum the budget if the caps allow it.

    A sector on its own, brought to its cap, gives each of its rows a ceiling;
    the group is then brought to the budget under these ceilings.
    """
    ceilings = proportional(book, [*keys, sector], weight, F.lit(name_cap), sector_cap, "_ceiling")
    return proportional(ceilings, keys, weight, F.col("_ceiling"), budget, name).drop("_ceiling")
