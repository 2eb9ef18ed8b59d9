"""Column helpers. NULL is the only missing value; divisions by zero give NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    """A symbol's daily bars in order."""
    return Window.partitionBy("symbol").orderBy("date")


def session() -> WindowSpec:
    """A session's bars in order."""
    return Window.partitionBy("symbol", "session_date").orderBy("ts")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def floor0(x: Column) -> Column:
    """max(x, 0); NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def yes(cond: Column) -> Column:
    """A condition as a boolean that is never NULL."""
    return F.coalesce(cond, F.lit(False))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def strict_max(a: Column, b: Column) -> Column:
    """The larger; NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def weighted(*parts: tuple[float, Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.lit(float(w)) * p for w, p in parts))


def lag(c: str | Column, n: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(over or series())


def last_n(n: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or series()).rowsBetween(-(n - 1), 0)


def prior_n(n: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or series()).rowsBetween(-n, -1)


def rolling(agg, c: str | Column, frame: WindowSpec, least: int) -> Column:
    """agg over a frame, NULL unless the frame has `least` values."""
    return F.when(F.count(col(c)).over(frame) >= least, agg(col(c)).over(frame))


def pct_rank(value: str, by: str) -> Column:
    """Percent rank by the average method among the non-null values of each group; NULL stays NULL."""
    known = F.col(value).isNotNull()
    group = Window.partitionBy(by, known)
    ties = Window.partitionBy(by, known, value)
    rank = F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(known, rank / F.count(value).over(group))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if a key repeats (one partially aggregated job)."""
    again = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if again:
        raise ValueError(f"keys repeat: {again}")
    return df
