"""Ordered per-key computations that survive one key holding a large part of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Here the ordering column is cut at global quantiles into
slices, so that a (key, slice) pair can never hold more than about 1/slices of the table.  Row numbers, running sums and lags
are computed inside each pair, a tiny per-pair summary carries the totals over to later slices, and an equi join on
(key, slice) puts both together.  The same algorithm runs at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Cuts(NamedTuple):
    """Ascending cut points as one array column, and how many there are at most."""

    points: Column
    count: int


def quantiles(column: str | Column, slices: int) -> Column:
    """Aggregate: the ``slices - 1`` cut points that part the values into slices of about equal size."""
    value = F.col(column) if isinstance(column, str) else column
    return F.percentile_approx(value.cast("double"), [i / slices for i in range(1, slices)], 10 * slices)


def slice_count(df: DataFrame) -> int:
    """Number of slices unless given: that of the shuffle partitions, whatever the size of the table."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_slices(df: DataFrame, column: str, slices: int | None = None) -> Cuts:
    """Cut points of ``column``, computed inside the query: no job runs while the query is built."""
    slices = slices or slice_count(df)
    return Cuts(df.agg(quantiles(column, slices)).scalar(), slices - 1)


def with_slice(df: DataFrame, column: str, cuts: Cuts | Sequence[float], name: str = "_slice") -> DataFrame:
    """Number of cut points below or at the value; equal values share a slice, NULL counts as lowest.

    A binary search: one projection per bit of the number of cut points, each of which looks at one of them. The array is a constant
    of the generated code and is dropped in the same stage, so it is neither scanned nor copied into rows.
    """
    if not isinstance(cuts, Cuts):
        cuts = Cuts(F.array(*[F.lit(float(c)) for c in sorted(cuts)]).cast("array<double>"), len(cuts))
    found = df.select("*", cuts.points.alias("_cuts"), F.col(column).cast("double").alias("_at"), F.lit(0).alias(name))
    for bit in reversed(range(cuts.count.bit_length())):
        step = F.lit(1 << bit)
        # beyond the last cut point there is NULL, and no step is taken
        further = F.when(F.try_element_at("_cuts", F.col(name) + step) <= F.col("_at"), step).otherwise(F.lit(0))
        found = found.withColumn(name, F.col(name) + further)
    return found.drop("_cuts", "_at")


def keyed_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    cuts: Cuts | Sequence[float] | None = None,
    slice_on: str | None = None,
    row_number: str | None = None,
    lag: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add a row number, lags, running sums (current row included) and whole-key sums to every row.

    ``slice_on`` must be the leading ordering column; rows with equal values of it stay in one slice. Without ``cuts`` one task orders
    a whole key, which is only for keys of bounded size.
    """
    lag, running, totals = dict(lag or {}), dict(running or {}), dict(totals or {})
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if cuts is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys)
        cols = {n: F.lag(c).over(w) for n, c in lag.items()}
        cols |= {n: F.sum(c).over(upto) for n, c in running.items()}
        cols |= {n: F.sum(c).over(whole) for n, c in totals.items()}
        if row_number:
            cols[row_number] = F.row_number().over(w)
        return df.withColumns(cols)

    part = [*keys, "_slice"]
    sliced = with_slice(df, slice_on, cuts)
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"_rn": F.row_number().over(w)}
    cols |= {f"_lag_{n}": F.lag(c).over(w) for n, c in lag.items()}
    cols |= {f"_run_{n}": F.sum(c).over(upto) for n, c in running.items()}
    local = sliced.withColumns(cols)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.max_by(F.struct(F.col(c)), F.struct(*[o for o in order])).alias(f"_last_{n}") for n, c in lag.items()]
    aggs += [F.sum(c).alias(f"_sum_{n}") for n, c in running.items()]
    aggs += [F.sum(c).alias(f"_part_{n}") for n, c in totals.items()]
    # one row per key and slice: as many rows per key as there are slices
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = {"_off": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    carried |= {f"_prev_{n}": F.last(f"_last_{n}").over(before) for n in lag}
    carried |= {f"_base_{n}": F.sum(f"_sum_{n}").over(before) for n in running}
    carried |= {n: F.sum(f"_part_{n}").over(whole) for n in totals}
    summary = sliced.groupBy(*part).agg(*aggs).withColumns(carried).select(
        *[F.col(k).alias(f"_k_{k}") for k in part], *carried)

    on = [local[k].eqNullSafe(summary[f"_k_{k}"]) for k in part]
    joined = local.join(summary, on, "left")
    out = [F.col(c) for c in df.columns]
    lag_src = {n: F.when(F.col("_rn") == 1, F.col(f"_prev_{n}.{c}")).otherwise(F.col(f"_lag_{n}")) for n, c in lag.items()}
    out += [v.alias(n) for n, v in lag_src.items()]
    out += [(F.coalesce(F.col(f"_base_{n}"), F.lit(0)) + F.col(f"_run_{n}")).alias(n) for n in running]
    out += [F.col(n) for n in totals]
    if row_number:
        out.append((F.col("_rn") + F.col("_off")).cast("int").alias(row_number))
    return joined.select(*out)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join many rows per key with one row per key so that a hot key is spread over ``salts`` tasks.

    ``right`` must be unique on ``keys``; its rows are copied once per salt. Because the result is partitioned by key and salt, a
    following ``groupBy(keys)`` combines inside the tasks first and only merges partial results per key.
    """
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
