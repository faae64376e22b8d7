"""Numbers that depend on all rows before one, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt into; each is summed as a whole and within itself.
RANGES = 64


def running_totals(df: DataFrame, order: str, value: str, name: str, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with the sum of `value` over all rows whose `order`, a number, comes before the row's; `order` must tell rows apart.

    Quantiles deal rows into ranges, whose sums are added up over a table of one row a range; a
    window then only adds what comes before a row in its own range.
    """
    bounds = df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01) if df.take(1) else []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: F.col(order) >= b)) if bounds else F.lit(0)
    ranged = df.withColumn("__range", at)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    a, b = sums.alias("a"), sums.alias("b")
    earlier = F.col("b.__range") > F.col("a.__range") if descending else F.col("b.__range") < F.col("a.__range")
    before = a.join(b, earlier, "left").groupBy(F.col("a.__range").alias("__range")).agg(F.coalesce(F.sum("b.__sum"), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")
