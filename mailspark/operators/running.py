"""Ordered per-key operators that stay balanced when one key is huge.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task;
with a key holding a third of all rows that task is the whole job.  These
helpers run the same computations over range partitions instead:

* :func:`running_sums` - running SUM/COUNT per key.  Rows are range-partitioned
  on (key, order), so a hot key is cut into many buckets (the range partition
  number); each bucket runs its own small window, and the totals of earlier
  buckets of the same key (one row per (key, bucket)) are added back.
* :func:`with_previous` - ``lag`` per key inside each range; the first row of a key in
  a range takes the key's last row of an earlier range (one row per (key, range)).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import _MID, _PART, ranged


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    num_partitions: int | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add one running-total column per entry of ``sums`` (name -> expression),
    summed over each key's rows up to and including the current one.

    ``carried`` (the keys and a column of each name, one row a key) holds what earlier rows, which are
    not in ``df``, come to; it joins the totals of a key's ranges, so no row of ``df`` is joined with it.
    """
    vals = {f"_run_v{i}": expr for i, expr in enumerate(sums.values())}
    # The ranges are written once, so every use sees the same cut.
    cut = ranged(df.select("*", *[e.alias(v) for v, e in vals.items()]), [*keys, *order], num_partitions)
    inside = Window.partitionBy(_PART, *keys).orderBy(_MID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select("*", *[F.sum(v).over(inside).alias(f"{v}_loc") for v in vals])
    totals = cut.groupBy(_PART, *keys).agg(*[F.sum(v).alias(f"{v}_tot") for v in vals])
    if carried is not None:
        before = [F.col(n).alias(f"{v}_tot") for v, n in zip(vals, sums)]
        totals = totals.unionByName(carried.select(F.lit(-1).alias(_PART), *keys, *before))
    # One row per (key, range): the sum over the key's earlier ranges, null if they have no value.
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    prior = totals.select(
        F.col(_PART).alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.sum(f"{v}_tot").over(earlier).alias(f"{v}_pre") for v in vals],
    )
    joined = local.join(prior, _same_range(local, prior, keys))
    out_cols = [
        F.when(F.col(f"{v}_loc").isNull(), F.col(f"{v}_pre")).otherwise(F.coalesce(f"{v}_pre", F.lit(0)) + F.col(f"{v}_loc")).alias(name)
        for v, name in zip(vals, sums.keys())
    ]
    return joined.select(*[local[c] for c in df.columns], *out_cols)


def _same_range(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [rows[_PART] == blocks["_p"], *[rows[k].eqNullSafe(blocks[f"_k_{k}"]) for k in keys]]


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    cols: Mapping[str, str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``prev_name`` = value of ``col`` on the previous row of the same key
    (NULL on a key's first row), for each ``prev_name -> col`` of ``cols``."""
    cut = ranged(df, [*keys, *order], num_partitions)
    inside = Window.partitionBy(_PART, *keys).orderBy(_MID)
    values = F.struct(*[F.col(c).alias(p) for p, c in cols.items()])
    local = cut.select("*", F.lag(values).over(inside).alias("_before"), F.row_number().over(inside).alias("_nth"))
    last = cut.groupBy(_PART, *keys).agg(F.max_by(values, F.col(_MID)).alias("_last"))
    carried = last.select(
        F.col(_PART).alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.lag("_last").over(Window.partitionBy(*keys).orderBy(_PART)).alias("_carried"),
    )
    joined = local.join(carried, _same_range(local, carried, keys))
    before = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return joined.select(*[local[c] for c in df.columns], *[before[p].alias(p) for p in cols])
