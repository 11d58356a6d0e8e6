"""Bounded samples of labelled rows, by a hash of the key, so that the same rows are drawn each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1_000_000


def sample_by_class(rows: DataFrame, key: str, label: str, per_class: int, most_rows: int = 20_000) -> DataFrame:
    """On average per_class rows of each class at most (all of smaller classes), fewer where the classes are so many that
    most_rows would be passed; but every class keeps one on average.

    A row is drawn if the hash of its key is below its class's share, so a class's sample is spread over the table.
    Only the class counts come to the driver. Rows with a null label are never drawn.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    if not counts:
        return rows.limit(0)
    wanted = min(per_class, max(1, most_rows // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], max(1, int(_PARTS * min(1.0, wanted / r[1]))))))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(_PARTS)) < F.try_element_at(share, F.col(label))
    return rows.where(F.col(label).isNotNull() & drawn)
