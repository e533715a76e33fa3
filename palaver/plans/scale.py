"""Plan-level helpers that keep operators whole and evenly spread.

* ``checked_broadcast``  broadcast hint only behind a row-count check
* ``split_hot``          cut groups that hold a large share of all rows into slices
* ``row_numbers`` / ``running_sum`` / ``previous``  window results over sliced groups
* ``order_stats``        exact order statistics without a per-group sort
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.session import cut_lineage

BROADCAST_ROWS = 200_000
HOT_SHARE = 10_000  # a group is hot above 1/HOT_SHARE of all rows: fewer than HOT_SHARE are
HOT_ROWS = 1_000_000  # and never below this many rows
CUTS = 4096  # quantiles taken of a hot group; thinned to what its size needs
FAN = 64  # cuts are searched in two levels of at most FAN steps


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the side is proven small, else leave a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core on inputs too small to fill them.

    A table of a few row groups is read by a few tasks; when the plan's size
    estimate is below one full input split per core, the rows are dealt out
    again.  Larger inputs are left alone: their scan has tasks enough.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if plan_bytes(df) >= split * cores or "Repartition" in df._jdf.queryExecution().optimizedPlan().toString():
        return df
    return df.repartition(cores)


def python_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to the configured number of shuffle partitions by key.

    Python work per byte is far above what the coalescing of small shuffle
    partitions assumes, so the number is fixed here.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


SMALL_PLAN = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; nothing runs for it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # joins of joins: a number too long to convert
        return 1 << 62


def small_plan(df: DataFrame) -> bool:
    """True when the optimizer's size estimate is below SMALL_PLAN bytes."""
    return plan_bytes(df) < SMALL_PLAN


def lookup(
    big: DataFrame, table: DataFrame, key: str, *, how: str = "left", min_rows: int | None = None
) -> DataFrame:
    """Join ``big`` with a table that has one row per ``key``, safe for hot keys.

    Keys that hold more than 1/HOT_SHARE of ``big`` (fewer than HOT_SHARE of
    them, by pigeonhole) meet their table rows by broadcast, in the tasks where
    they lie; all other keys take an ordinary shuffle join.
    """
    if min_rows is None and small_plan(big):
        return big.join(table, key, how)
    found = hot_groups(big.where(F.col(key).isNotNull()), [key], min_rows or HOT_ROWS).collect()
    if not found:
        return big.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin([r[key] for r in found]), F.lit(False))
    hot = big.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how)
    return big.where(~is_hot).join(table.where(~is_hot), key, how).unionByName(hot)


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregated value as a scalar subquery (no cross join)."""
    return df.agg(expr.alias("_v")).scalar()


def equi(left: str, right: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def hot_groups(df: DataFrame, by: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """(by, _parts): groups above ``min_rows`` and above 1/HOT_SHARE of all rows.

    By pigeonhole there are fewer than HOT_SHARE of them, which is the proof
    needed to broadcast the result.  ``_parts`` is the number of ordinary
    groups each one is worth; their sum is below 2 * HOT_SHARE.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    unit = F.greatest(F.lit(float(min_rows)), scalar(sizes, F.sum("_n")) / HOT_SHARE)
    return sizes.where(F.col("_n") > unit).withColumn("_parts", F.ceil(F.col("_n") / unit)).drop("_n")


def split_hot(df: DataFrame, by: Sequence[str], order: Column, *, min_rows: int | None = None) -> DataFrame:
    """Add ``_slice``: 0 for ordinary groups, numbered in order for hot ones.

    Slice bounds are approximate quantiles (a bounded sketch, combined map
    side), as many as the size of the group calls for.  Rows with equal order
    values always share a slice, so (slice, order value) orders a group.
    """
    keyed = df.withColumn("_ord", order)
    whole = keyed.withColumn("_slice", F.lit(0)).withColumn("_hot", F.lit(False))
    if min_rows is None and small_plan(df):
        return whole
    # one pass that counts per group; its result has fewer than HOT_SHARE rows,
    # so it may come to the driver, and mostly it is empty: then the input is
    # referenced once and steps can follow each other without plans doubling
    found = hot_groups(df, by, min_rows or HOT_ROWS)
    rows = found.collect()
    if not rows:
        return whole
    hot = df.sparkSession.createDataFrame(rows, found.schema)
    quantiles = (
        keyed.alias("l")
        .join(F.broadcast(hot).alias("r"), equi("l", "r", by), "left_semi")
        .groupBy(*by)
        .agg(F.percentile_approx("_ord", [i / CUTS for i in range(1, CUTS)], F.lit(4 * CUTS)).alias("_q"))
    )
    sized = quantiles.alias("l").join(F.broadcast(hot).alias("r"), equi("l", "r", by)).select("l.*", "r._parts")
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) / F.col("_parts"))).cast("int")
    thin = sized.withColumn("_step", step).withColumn(
        "_cuts", F.array_distinct(F.filter("_q", lambda c, i: (i + 1) % F.col("_step") == 0))
    )
    branches = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / FAN).cast("int")),
        lambda j: F.slice("_cuts", j * FAN + 1, FAN),
    )
    tree = cut_lineage(
        thin.where(F.size("_cuts") > 0).select(*[F.col(c).alias(f"_k_{c}") for c in by], branches.alias("_tree"))
    )
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    top = F.size(F.filter("_tree", lambda r: F.element_at(r, -1) < F.col("_ord")))
    leaf = F.size(F.filter(F.get(F.col("_tree"), F.col("_top")), lambda c: c < F.col("_ord")))
    return (
        keyed.join(F.broadcast(tree), cond, "left")
        .withColumn("_hot", F.col("_tree").isNotNull())
        .withColumn("_top", F.when(F.col("_hot"), top))
        .withColumn(
            "_slice", F.when(F.col("_hot"), F.col("_top") * FAN + F.coalesce(leaf, F.lit(0))).otherwise(F.lit(0))
        )
        .drop("_tree", "_top", *[f"_k_{c}" for c in by])
    )


def _sorted_window(by: Sequence[str], order: Sequence[Column]):
    return W.partitionBy(*by, "_slice").orderBy(*order)


def _hot_slices(sliced: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Per-slice aggregates of the hot groups: at most 3 * HOT_SHARE rows."""
    return (
        sliced.where("_hot").groupBy(*by, "_slice").agg(*[c.alias(n) for n, c in aggs.items()])
    )


def _with_slices(sliced: DataFrame, table: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    keys = [*by, "_slice"]
    side = F.broadcast(table.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *cols))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return sliced.join(side, cond, "left").drop(*[f"_j_{k}" for k in keys])


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    min_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group, in ``order`` (ascending)."""
    sliced = split_hot(df, by, F.col(order[0]), min_rows=min_rows).withColumn("_val", value)
    totals = _hot_slices(sliced, by, _sum=F.sum("_val"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.sum("_sum").over(before))
    w = _sorted_window(by, [F.col(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return (
        _with_slices(sliced, offsets, by, ["_off"])
        .withColumn(name, F.sum("_val").over(w) + F.coalesce("_off", F.lit(0)))
        .drop("_slice", "_hot", "_ord", "_val", "_off")
    )


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, *, min_rows: int | None = None
) -> DataFrame:
    """1-based position per group; hot groups are numbered slice by slice."""
    return running_sum(df, by, order, F.lit(1).cast("bigint"), name, min_rows=min_rows)


def previous(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str],
    *,
    min_rows: int | None = None,
) -> DataFrame:
    """Add the previous row's values (``{source column: new name}``) per group."""
    sliced = split_hot(df, by, F.col(order[0]), min_rows=min_rows).withColumn(
        "_row", F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    )
    lasts = _hot_slices(sliced, by, _last=F.max_by("_row", F.struct(*order)))
    carried = lasts.withColumn("_carry", F.lag("_last").over(W.partitionBy(*by).orderBy("_slice")))
    w = _sorted_window(by, [F.col(c) for c in order])
    out = _with_slices(sliced, carried, by, ["_carry"]).withColumn(
        "_prev", F.coalesce(F.lag("_row").over(w), F.col("_carry"))
    )
    for n in cols.values():
        out = out.withColumn(n, F.col(f"_prev.{n}"))
    return out.drop("_slice", "_hot", "_ord", "_row", "_carry", "_prev")


Position = Callable[[Column], Column]


def position_cont(p: float) -> Position:
    """Linear interpolation, the SQL ``percentile_cont`` rule."""
    return lambda n: F.lit(float(p)) * (n - 1)


def position_exclusive(p: float) -> Position:
    """Quartiles at (n + 1) p, clipped to the data."""
    return lambda n: F.lit(float(p)) * (n + 1) - 1


def position_floor(p: float) -> Position:
    """Element ``int(n p)`` of the sorted values."""
    return lambda n: F.floor(F.lit(float(p)) * n)


def position_round(p: float) -> Position:
    """Element ``round(p (n - 1))``, halves to even."""
    return lambda n: F.bround(F.lit(float(p)) * (n - 1), 0)


def order_stats(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    positions: Mapping[str, Position],
    *,
    min_rows: int | None = None,
    **aggs: Column,
) -> DataFrame:
    """Exact order statistics per group.

    Values are counted first (map-side combined), so duplicates never travel;
    the running counts of groups with very many distinct values are computed
    slice by slice.  ``aggs`` may use ``value`` and its weight ``_cnt``.
    """
    keys = list(by) or ["_g"]
    src = df if by else df.withColumn("_g", F.lit(0))
    counts = (
        src.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    sliced = split_hot(counts, keys, F.col(value), min_rows=min_rows)
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_cnt").alias("_sum"))
    whole = W.partitionBy(*keys)
    totals = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(
            F.sum("_sum").over(whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    cond = F.lit(True)
    for k in [*keys, "_slice"]:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    w = _sorted_window(keys, [F.col(value)]).rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        sliced.alias("a")
        .join(totals.alias("b"), cond)
        .select("a.*", F.col("b._off").alias("_off"), F.col("b._total").alias("_total"))
        .withColumn("_cum", F.sum("_cnt").over(w) + F.col("_off"))
    )
    out = [F.first("_total").alias("n")]
    for name, position in positions.items():
        h = F.greatest(
            F.lit(0.0), F.least(position(F.col("_total")).cast("double"), F.col("_total") - 1.0)
        )
        low = F.min(F.when(F.col("_cum") > F.floor(h), F.col(value)))
        high = F.min(F.when(F.col("_cum") > F.ceil(h), F.col(value)))
        frac = F.first(h - F.floor(h))
        out.append((low + (high - low) * frac).alias(name))
    out += [c.alias(n) for n, c in aggs.items()]
    return ranked.groupBy(*keys).agg(*out).drop("_g")
