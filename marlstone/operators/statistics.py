"""Order statistics of distributed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of monotonically_increasing_id() that number a partition's rows.
_LOCAL = 33


def nearest_ranks(rows: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(*by, name, value): for each group and each named fraction f the value at the place round(f * (n - 1)), halves to
    even, of the group's n values in order. Null values don't count; a group without values has no row.

    Rows are sorted by ranges, over as many partitions as a shuffle has, equal values being dealt by a random number. A
    place is found from the partitions' counts, so no task holds more than a range and nothing is collected.
    """
    by = by or []
    spark, order = rows.sparkSession, [*by, value, "_salt"]
    ranged = rows.where(F.col(value).isNotNull()).select(*by, value, F.rand(7).alias("_salt")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = written(ranged.sortWithinPartitions(*order).select(*by, F.col(value).alias("value"), F.monotonically_increasing_id().alias("_id")))
    counts = placed.groupBy(*by, F.shiftright("_id", _LOCAL).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    whole = W.partitionBy(*by)
    counts = counts.withColumns({"_until": F.sum("_n").over(whole.orderBy("_part")), "_all": F.sum("_n").over(whole)})
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(f).alias("f")) for k, f in fractions.items()))).alias("_w")
    wanted = counts.select("*", named).withColumn("_place", F.bround(F.col("_w.f") * (F.col("_all") - 1)).cast("long") - (F.col("_until") - F.col("_n")))
    wanted = wanted.where((F.col("_place") >= 0) & (F.col("_place") < F.col("_n"))).select(F.col("_w.name").alias("name"), (F.col("_first") + F.col("_place")).alias("_at"))
    return placed.join(wanted, F.col("_id") == F.col("_at")).select(*by, "name", "value")
