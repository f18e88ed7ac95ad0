"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def finite(c: Column) -> Column:
    """Whether a double is neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    return F.when(finite(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def trailing(c: Column, w: WindowSpec, rows: int, how) -> Column:
    """how over the last `rows` rows, this one included; null unless all of them have a value."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) == rows, how(c).over(frame))


def causal_moments(df: DataFrame, cols: list[str], rows: int, keys: tuple[str, ...] = ("code",), order: str = "date") -> DataFrame:
    """mean_<c> and std_<c> over the `rows` rows before each row; null unless all of them have a value.

    Running sums of the values less their group's mean are differenced, so the cost per row doesn't grow with `rows`;
    all frames share one partitioning and one sort.
    """
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *(F.avg(c).over(whole).alias(f"_m_{c}") for c in cols), *(F.var_pop(c).over(whole).alias(f"_g_{c}") for c in cols))
    out = out.select("*", *(F.coalesce(F.col(c) - F.col(f"_m_{c}"), F.lit(0.0)).alias(f"_c_{c}") for c in cols))
    out = out.select(
        "*",
        *(F.sum(f"_c_{c}").over(upto).alias(f"_s_{c}") for c in cols),
        *(F.sum(F.col(f"_c_{c}") * F.col(f"_c_{c}")).over(upto).alias(f"_q_{c}") for c in cols),
        *(F.count(c).over(upto).alias(f"_n_{c}") for c in cols),
    )
    past = lambda name: F.lag(name, 1).over(w) - F.coalesce(F.lag(name, rows + 1).over(w), F.lit(0))
    out = out.select("*", *(past(f"_{k}_{c}").alias(f"_{k}w_{c}") for c in cols for k in "sqn"))
    done = []
    for c in cols:
        var = (F.col(f"_qw_{c}") - F.col(f"_sw_{c}") * F.col(f"_sw_{c}") / rows) / (rows - 1)
        full = F.col(f"_nw_{c}") == rows
        done.append(F.when(full, F.col(f"_sw_{c}") / rows + F.col(f"_m_{c}")).alias(f"mean_{c}"))
        done.append(F.when(full, F.when(var > 1e-13 * F.col(f"_g_{c}"), F.sqrt(var)).otherwise(F.lit(0.0))).alias(f"std_{c}"))
    return out.select(*df.columns, *done)


def counted(c: str) -> Column:
    """A value as ranks see it, to nine digits, so that ties don't hang on the last bit."""
    return F.round(c, 9)


def spread(sd: Column, largest: Column) -> Column:
    """A deviation, zero where it is no more than the last bits of values of that size: equal values seldom agree in all of them."""
    return F.when(sd > 1e-12 * (1 + largest), sd).otherwise(F.when(sd.isNotNull(), 0.0))


def deviation(c: Column) -> Column:
    """Sample deviation of a group; of values that are equal but for their last bits it is zero."""
    return spread(F.stddev_samp(c), F.max(F.abs(c)))


def equal_frequency_bin(c: str, k: int, keys: tuple[str, ...] = ("code",)) -> Column:
    """Bin 0..k-1 of a value among its group's whole history, by integer ranks; null stays null. Values count to nine digits."""
    w = Window.partitionBy(*keys)
    below = F.rank().over(w.orderBy(counted(c).asc_nulls_last())) - 1
    n = F.count(c).over(w)
    steps = [F.when((n - 1) * j < k * below, 1).otherwise(0) for j in range(1, k)]
    return F.when(F.col(c).isNotNull(), sum(steps[1:], steps[0])).cast("long")


def encode(parts: list[Column], base: int) -> Column:
    """Mixed-radix id, null if any part is null."""
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out + p * F.lit(base**i)
    return out.cast("long")


def decode(state: Column, base: int, i: int) -> Column:
    return (F.floor(state / F.lit(base**i)) % base).cast("long")


