"""Running sums and places within groups of any size: a group that holds most of the rows is dealt over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def _names(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """df with the running sum, row included, of each column of sums within the group of keys (nulls are a group) along order;
    totals names, for some of them, a column for the sum of the whole group. order should tell all rows of a group apart: rows alike in it
    are taken in any order.

    One range exchange over keys and order puts a group's rows side by side, over as many ranges as they fill. Each range sums
    its share of a group by itself. A range begins inside at most one group, so what earlier ranges hold of cut groups is at
    most two rows a range; only these are broadcast. The ranges are written once, as they are drawn anew each time they are
    computed.
    """
    totals = totals or {}
    v = {f"__v{i}": c for i, c in enumerate(sums.values())}
    x = df.withColumns(v).repartitionByRange(*[F.col(k) for k in keys], *_names(order)).withColumn("__range", F.spark_partition_id())
    x = written(x, "running")
    shares = x.groupBy("__range", *keys).agg(*[F.sum(c).alias(c) for c in v])
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cut = shares.withColumn("__parts", F.count("*").over(group)).select(
        F.col("__range").alias("__of"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__parts",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in v], *[F.sum(c).over(group).alias(f"{c}_all") for c in v],
    ).where("__parts > 1")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__range") == F.col("__of"))
    share = Window.partitionBy("__range", *keys)
    so_far = share.orderBy(*_names(order)).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"{c}_run": F.sum(c).over(so_far) for c in v} | {f"{c}_share": F.sum(c).over(share) for c, out in zip(v, sums, strict=True) if out in totals})
    x = x.join(F.broadcast(cut), same, "left")
    out = {out: F.col(f"{c}_run") + F.coalesce(f"{c}_before", F.lit(0)) for c, out in zip(v, sums, strict=True)}
    out |= {totals[out]: F.coalesce(f"{c}_all", f"{c}_share") for c, out in zip(v, sums, strict=True) if out in totals}
    return x.select(*df.columns, *[c.alias(name) for name, c in out.items()])


def numbered_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str, total: str | None = None) -> DataFrame:
    """name: the row's place in its group, from 1; total: the rows of the group."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, {name: total} if total else None)
