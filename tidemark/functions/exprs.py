"""Reusable column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUSINESS_TZ = "Asia/Taipei"
DAY_US = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_rows() -> Column:
    return F.count(F.lit(1))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct_change(now: str | Column, base: str | Column, digits: int = 1) -> Column:
    return F.round(100 * (ratio(now, base) - 1), digits)


def money(c: str | Column) -> Column:
    """Exact two-decimal amount, so that sums do not depend on row order."""
    return col(c).cast("decimal(18,2)")


def local_date(micros: str | Column, tz: str = BUSINESS_TZ) -> Column:
    """Business date of UTC microseconds, whatever the session time zone is."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_ntz(micros)))


def utc_ntz(micros: str | Column) -> Column:
    """UTC wall clock (timestamp without zone) of microseconds."""
    seconds = (col(micros) / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def micros_of(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts))


def day_start(day: str | Column, tz: str = BUSINESS_TZ) -> Column:
    """UTC microseconds at which a date begins in a time zone, also where clocks are changed that day."""
    return micros_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), col(day).cast("date").cast("timestamp_ntz")))


def within_local_days(micros: str | Column, first: Column, last: Column, tz: str = BUSINESS_TZ, partition: str | Column | None = None) -> Column:
    """Whether UTC microseconds fall on a local date from ``first`` to ``last``.

    ``local_date(micros)`` wraps the column, so a scan could prune nothing. The same condition as bounds on the raw microseconds reaches the
    files' statistics, and on ``partition``, a date column within a day of the local date, the folders. Constant dates give constant bounds.
    """
    inside = (col(micros) >= day_start(first, tz)) & (col(micros) < day_start(F.date_add(last, 1), tz))
    if partition is not None:
        inside = inside & (col(partition) >= F.date_sub(first, 1)) & (col(partition) <= F.date_add(last, 1))
    return inside


def monday(d: str | Column) -> Column:
    return F.trunc(col(d), "week").cast("date")


def sunday(d: str | Column) -> Column:
    return F.date_sub(col(d), F.dayofweek(col(d)) - 1)


def sunday_weeks_between(later: str | Column, earlier: str | Column) -> Column:
    """Number of Sunday boundaries crossed, not the number of full 7-day spans."""
    return (F.datediff(sunday(later), sunday(earlier)) / 7).cast("int")


def geo_mean(c: str | Column) -> Column:
    return F.exp(F.avg(F.log(col(c))))


def count_where(p: Column) -> Column:
    return F.count_if(p)


def sum_where(p: Column, c: str | Column) -> Column:
    return F.sum(F.when(p, col(c)))


def null_if_any(value: Column, *guards: str | Column) -> Column:
    """Formatted text that is NULL as soon as one of its inputs is NULL."""
    bad = F.lit(False)
    for g in guards:
        bad = bad | col(g).isNull()
    return F.when(~bad, value)


def newest(fields: list[str], *order: str | Column) -> Column:
    """The given fields of the row with the largest ordering tuple: one map-side combined aggregate, no sort."""
    return F.max_by(F.struct(*fields), F.struct(*[col(o) for o in order]))


def oldest(fields: list[str], *order: str | Column) -> Column:
    return F.min_by(F.struct(*fields), F.struct(*[col(o) for o in order]))


def expand_once(df: DataFrame, struct: Column) -> DataFrame:
    """Add the fields of a struct as columns, computing it one time per row.

    A plain ``select("s.*")`` lets Catalyst copy the struct's expression into every field; the output of a generator is never copied.
    """
    return df.select("*", F.inline(F.array(struct)))
