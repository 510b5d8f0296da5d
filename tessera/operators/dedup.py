"""De-duplication (D1, D2) as aggregations.

A window ``row_number() over (partition by subset)`` sends every row of a
group to one task: a key holding a third of the table becomes one task.
Both operators are written as ``groupBy(subset).agg(...)`` instead, whose
partial (map-side) aggregation collapses a hot key to one row per input
partition before the shuffle.  NULL keys group together (pandas semantics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
                    order_by: list[str] | None = None) -> DataFrame:
    """D1 / D2.

    keep="first": one row per ``subset`` group, the first by ``order_by``
    (required unless the subset is every column).  keep=False: drop every
    row of a group that occurs more than once.
    """
    cols = df.columns
    keys = list(subset or cols)
    rest = [c for c in cols if c not in keys]
    if keep is False:
        if not rest:
            kept = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1")
            return kept.select(*cols)
        kept = (df.groupBy(*keys)
                .agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
                .where("_n = 1"))
        return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols])
    if keep != "first":
        raise ValueError("keep must be 'first' or False")
    if not rest:
        return df.dropDuplicates(keys)
    if not order_by:
        raise ValueError("order_by is required to define the first row of a group")
    ob = [o for o in order_by]
    first = F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(ob)],
                           *[F.col(c) for c in rest])).alias("_r")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols])
