"""Distributed 1-based numbering (W1, W2, W3) without a one-partition window.

``add_sequence`` numbers rows by a sort key in two phases:

1. range-partition on the key (Spark samples the key to pick bounds, so every
   partition holds a contiguous, balanced key range; a hot key value is split
   across partitions like any other) and sort inside each partition; each row's
   local index comes from ``monotonically_increasing_id`` (consecutive per task);
2. count rows per range partition - one row per partition - turn the counts
   into offsets and broadcast them back.

The range bounds come from sampling whose seed depends on the RDD, so two
executions of the same exchange may cut the data differently.  The tagged rows
are therefore written once as a Parquet table under the cluster's
``spark.checkpoint.dir`` and read back; counts (reading one column) and rows
both come from it, so they always agree, the lineage is cut, and a lost
executor never changes the numbering.

The table of offsets has one row per range partition, a number that the session
(``spark.sql.shuffle.partitions``) or the caller sets; it never grows with the data.
There is one algorithm for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import remember_scratch, scratch_path

# Bound on the offsets table that is broadcast (rows = range partitions).
MAX_SEQUENCE_PARTITIONS = 1_000_000

_PART = "_seq_part"
_MID = "_seq_mid"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts lineage, survives executor loss, and later reads prune columns."""
    path = scratch_path(df.sparkSession, name)
    remember_scratch(df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def ranged(df: DataFrame, order_by: Sequence[Column | str], num_partitions: int | None = None) -> DataFrame:
    """``df`` in contiguous, sorted key ranges, written once, with the range's number
    (``_PART``) and the row's place (``_MID``, consecutive inside a range).

    Without ``num_partitions`` the number of ranges is ``spark.sql.shuffle.partitions``,
    which adaptive execution lowers for small data.
    """
    if num_partitions is not None and not 0 < num_partitions <= MAX_SEQUENCE_PARTITIONS:
        raise ValueError(f"num_partitions must be in 1..{MAX_SEQUENCE_PARTITIONS}, got {num_partitions}")
    cut = df.repartitionByRange(num_partitions, *order_by) if num_partitions else df.repartitionByRange(*order_by)
    tagged = cut.sortWithinPartitions(*order_by).select(
        "*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_MID)
    )
    return materialize(tagged, "sequence")


def add_sequence(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "seq",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``name`` = 1-based position of each row in ``order_by`` order.

    Ties in ``order_by`` get distinct, arbitrary numbers; pass a unique key for
    a deterministic result.
    """
    cols = list(df.columns)
    tagged = ranged(df, order_by, num_partitions)
    counts = tagged.groupBy(_PART).agg(F.count(F.lit(1)).alias("_seq_n"))
    # One row per range partition: a small, bounded window.
    offsets = counts.select(
        _PART,
        (F.sum("_seq_n").over(Window.orderBy(_PART)) - F.col("_seq_n")).alias("_seq_off"),
    )
    local = F.col(_MID) - F.shiftleft(F.col(_PART).cast("long"), 33)
    return tagged.join(F.broadcast(offsets), _PART).select(
        *cols, (F.col("_seq_off") + local + F.lit(1)).cast("long").alias(name)
    )


def add_sequence_by_key(
    df: DataFrame, key_cols: Sequence[str], name: str = "seq", num_partitions: int | None = None
) -> DataFrame:
    """``add_sequence`` for a *unique* key: only the narrow key table is
    range-partitioned and materialised; the rows get their number by one
    equi-join on the key (a uniform hash shuffle - a unique key cannot skew),
    so the full rows are never written out."""
    keys = list(key_cols)
    numbered = add_sequence(df.select(*keys), keys, name, num_partitions)
    return df.join(numbered, keys)


def add_group_position(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[Column | str],
    name: str = "position",
    num_partitions: int | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """1-based position inside each group, in ``order_by`` order.

    Rows are cut into ranges of (group, order), so a group that holds a large share
    of all rows lies in many ranges.  One row per (range, group) carries how many rows
    of the group lie in earlier ranges; a row's position is that number plus its place
    in its range.  Nothing is joined or windowed on the group alone but these rows,
    of which a group has one per range.  ``per_group`` (the group columns, not null, and
    others) adds its other columns on the way; rows of groups it lacks are left out.
    """
    tagged = ranged(df, [*group_by, *order_by], num_partitions)
    blocks = tagged.groupBy(_PART, *group_by).agg(F.min(_MID).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group_by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_grp_k{i}" for i in range(len(group_by))]
    blocks = blocks.select(
        F.col(_PART).alias("_grp_part"),
        *[F.col(g).alias(k) for g, k in zip(group_by, keys)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo") + 1).alias("_shift"),
    )
    extra: list[str] = []
    if per_group is not None:
        extra = [c for c in per_group.columns if c not in group_by]
        blocks = blocks.join(per_group.toDF(*[keys[list(group_by).index(c)] if c in group_by else c for c in per_group.columns]), keys)
    cond = [tagged[_PART] == blocks["_grp_part"], *[tagged[g].eqNullSafe(blocks[k]) for g, k in zip(group_by, keys)]]
    return tagged.join(blocks, cond).select(*[tagged[c] for c in df.columns], *[blocks[c] for c in extra], (F.col(_MID) + F.col("_shift")).alias(name))
