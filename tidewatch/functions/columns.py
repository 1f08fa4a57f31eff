"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step_loss(value: str | Column, thresholds: Iterable[tuple[float, float]]) -> Column:
    """The loss of the highest threshold that value reaches, 0 below all and for null."""
    out: Column | None = None
    for limit, loss in sorted(thresholds, reverse=True):
        hit = col(value) >= F.lit(limit)
        out = F.when(hit, F.lit(float(loss))) if out is None else out.when(hit, F.lit(float(loss)))
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    """value within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def season(year: Column, month: Column) -> tuple[Column, Column]:
    """(dry or wet, the year it counts to): November to April is dry; November and December count to the next year."""
    dry = (month >= 11) | (month <= 4)
    return F.when(dry, "dry").otherwise("wet"), (year + (month >= 11).cast("int")).cast("int")


def facility_type(name: Column) -> Column:
    return F.when(F.upper(name).rlike("PHCC|HOSPITAL"), "PHCC").otherwise("PHCU")


def buffer_pixels(kind: Column) -> Column:
    return F.when(kind == "PHCC", 60).otherwise(40)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def lookup(key: Column, pairs: dict, default) -> Column:
    """The value of a small fixed table, or the default."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def quantile(c: str | Column, q: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(col(c), F.lit(q))


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def column_report(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """column_name, present, n_rows, n_filled (not null) of each name, in one pass; an absent column is filled nowhere."""
    names = list(names)
    filled = [F.struct(F.lit(n).alias("column_name"), F.lit(n in df.columns).alias("present"), F.count("*").alias("n_rows"), (F.count(F.col(f"`{n}`")) if n in df.columns else F.lit(0).cast("long")).alias("n_filled")) for n in names]
    return df.agg(F.array(*filled).alias("c")).select(F.inline("c"))
