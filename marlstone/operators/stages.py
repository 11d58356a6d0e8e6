"""Stages that a row goes through until one fails, and parts of documents by pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """df with the columns that stages set, and failed_at. A stage is a name, a condition under which a row passes, and the
    columns it sets. Of a row that fails a stage (false or null) this stage and all later ones set nothing: they are null.
    """
    out = df.withColumn("failed_at", F.lit(None).cast("string"))
    for name, passes, columns in stages:
        out = out.withColumn("failed_at", F.coalesce("failed_at", F.when(~F.coalesce(passes, F.lit(False)), name)))
        out = out.withColumns({c: F.when(F.col("failed_at").isNull(), x) for c, x in columns.items()})
    return out


def page_range(start: Column, end: Column, page_chars: int) -> Column:
    """The pages a span of characters lies on, as a map of page_start and page_end; pages of page_chars, from 1."""
    page = lambda at: (F.floor(at / page_chars) + 1).cast("int")
    return F.create_map(F.lit("page_start"), page(start), F.lit("page_end"), page(F.greatest(end - 1, start)))
