"""Order statistics of whole tables: prefix sums and exact quantiles by ranges of values.

Values are dealt to ranges that hold about equally many rows, cut at approximate quantiles of the rows themselves, so an
outlier moves no other value. Ranges are numbered and summed first, then rows are ordered inside their own range; no task
sees all values of a group, and of a quantile only the ranges that hold its two neighbours are ever ordered. Cuts decide
who does the work, not what comes out: results are exact. Nulls and NaN are missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import stored

#: Ranges of values: PARTS at least, four a shuffle partition, MOST_PARTS at most.
PARTS, MOST_PARTS = 256, 8192


def known(value: str | Column) -> Column:
    v = col(value)
    return v.isNotNull() & ~F.isnan(v.cast("double"))


def ranged(values: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """values with __part, the number of the range that the value is in; ranges rise with the values."""
    parts = parts or min(MOST_PARTS, max(PARTS, 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = F.expr(f"cast(split('{','.join(str(i / parts) for i in range(1, parts))}', ',') as array<double>)")  # folded into one constant
    cuts = values.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(20 * parts)))).alias("__cuts"))
    steps = ", ".join(str(1 << b) for b in reversed(range(parts.bit_length())))
    part = F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(get(__cuts, at + step - 1) <= cast(`{value}` as double), at + step, at))")
    return values.crossJoin(F.broadcast(cuts)).withColumn("__part", part).drop("__cuts")  # one row


def same(a: DataFrame, b: DataFrame, names: list[str], prefix: str) -> Column:
    """Rows of a and b alike in all of the names, which stand under a prefix in b; null is like null."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[prefix + n])
    return out


def running(values: DataFrame, value: str, counts: list[str], groups: list[str] | None = None) -> DataFrame:
    """Adds before_<c>, the sum of c over smaller values of the group, to a table of one row a group and value."""
    groups = groups or []
    rows = ranged(values, value)
    keys = [*groups, "__part"]
    down = Window.partitionBy(*groups).orderBy("__part")  # one row a range
    parts = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"__all_{c}") for c in counts])
    parts = parts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[(F.sum(f"__all_{c}").over(down) - F.col(f"__all_{c}")).alias(f"__start_{c}") for c in counts])
    inside = Window.partitionBy(*keys).orderBy(value)
    joined = rows.join(parts if groups else F.broadcast(parts), same(rows, parts, keys, "__of_"))  # without groups a row a range
    return joined.select(*[rows[c] for c in values.columns], *[(F.col(f"__start_{c}") + F.sum(c).over(inside) - F.col(c)).alias(f"before_{c}") for c in counts])


def quantiles(df: DataFrame, groups: list[str], wanted: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """One row a group: under each name the exact quantile, with linear interpolation, of a column's known values.

    wanted: name -> (column, share). Groups are few and large; a group without a known value has no row, and its
    missing quantiles are null. Without groups there is one row in any case.
    """
    columns: list[Column] = []
    asked: list[tuple[int, str, float]] = []
    for name, (c, q) in wanted.items():
        at = next((i for i, x in enumerate(columns) if x is c or isinstance(c, str) and str(x) == str(F.col(c))), len(columns))
        if at == len(columns):
            columns.append(col(c))
        asked.append((at, name, q))
    each = F.array(*[F.struct(F.lit(i).alias("__m"), c.cast("double").alias("__v")) for i, c in enumerate(columns)])
    long = df.select(*groups, F.inline(each)).filter(known("__v"))
    counts = stored(long.groupBy(*groups, "__m", "__v").agg(F.count("*").alias("__c")))
    keys = [*groups, "__m"]
    cell = [*keys, "__part"]
    rows = ranged(counts, "__v")
    down, all_ = Window.partitionBy(*keys).orderBy("__part"), Window.partitionBy(*keys)  # one row a range
    sums = rows.groupBy(*cell).agg(F.sum("__c").alias("__k"))
    sums = sums.withColumn("__start", F.sum("__k").over(down) - F.col("__k")).withColumn("__n", F.sum("__k").over(all_))
    # where a quantile's neighbours stand, as places inside the ranges that hold them
    asks = F.array(*[F.struct(F.lit(m).alias("of"), F.lit(name).alias("name"), F.lit(q).alias("q")) for m, name, q in asked])
    sums = sums.withColumn("__ask", F.explode(asks)).filter("__ask.of = __m").withColumn("__pos", F.col("__ask.q") * (F.col("__n") - 1))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("__pos").alias("at")), F.struct(F.lit(1).alias("end"), F.ceil("__pos").alias("at")))
    sums = sums.withColumn("__end", F.explode(ends)).filter("__end.at >= __start AND __end.at < __start + __k")
    place = F.struct(F.col("__ask.name").alias("name"), F.col("__end.end").alias("end"), (F.col("__end.at") - F.col("__start")).alias("at"), (F.col("__pos") - F.floor("__pos")).alias("share"))
    places = sums.groupBy(*cell).agg(F.collect_list(place).alias("__places")).select(*[F.col(c).alias(f"__of_{c}") for c in cell], "__places")  # two a name at most
    upto = F.sum("__c").over(Window.partitionBy(*cell).orderBy("__v"))
    held = rows.join(places, same(rows, places, cell, "__of_")).withColumn("__upto", upto)
    hit = held.select(*groups, "__v", F.inline(F.filter("__places", lambda p: (p["at"] < F.col("__upto")) & (p["at"] >= F.col("__upto") - F.col("__c")))))
    low = {n: F.max(F.when((F.col("name") == n) & (F.col("end") == 0), F.col("__v"))) for n in wanted}
    high = {n: F.max(F.when((F.col("name") == n) & (F.col("end") == 1), F.col("__v"))) for n in wanted}
    share = {n: F.max(F.when(F.col("name") == n, F.col("share"))) for n in wanted}
    return hit.groupBy(*groups).agg(*[(low[n] + (high[n] - low[n]) * share[n]).alias(n) for n in wanted])


def beside(base: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """base with the columns that more has for the same groups, null where it has no row; null groups meet."""
    other = more.withColumnsRenamed({g: f"__of_{g}" for g in groups})
    return base.join(other, same(base, other, groups, "__of_"), "left").drop(*[f"__of_{g}" for g in groups])
