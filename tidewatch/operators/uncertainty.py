"""Summaries over scenarios and posterior draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import quantile, sigmoid
from ..functions.special import normal_quantile
from ..sources.scratch import stored
from .order import known, quantiles, running
from .spells import exceedance, spell_lengths

SCENARIO = ["hf_id", "scenario_id"]


def monthly_frequency(df: DataFrame) -> DataFrame:
    """Observed: mean occurrence by month."""
    return df.groupBy(F.month("date").alias("month")).agg(F.avg("occurrence").alias("freq"))


def monthly_frequency_syn(df: DataFrame) -> DataFrame:
    """Synthetic: the median and percentiles over scenarios of their monthly means."""
    means = df.groupBy("scenario_id", F.month("date").alias("month")).agg(F.avg("occurrence").alias("freq"))
    return means.groupBy("month").agg(*[quantile("freq", q).alias(f"q{round(q * 100):02d}") for q in (0.5, 0.05, 0.25, 0.75, 0.95)])


def spell_exceedance(df: DataFrame, most: int = 30) -> DataFrame:
    """For k = 1..most: median, p05, p95 over scenarios of the share of spells of k days and more."""
    lengths = spell_lengths(df, SCENARIO).filter("length > 0")
    shares = lengths.groupBy("scenario_id").agg(*[exceedance(F.col("length"), k).alias(str(k)) for k in range(1, most + 1)])
    long = shares.unpivot(["scenario_id"], [str(k) for k in range(1, most + 1)], "k", "p")
    return long.groupBy(F.col("k").cast("int").alias("k")).agg(F.median("p").alias("median"), quantile("p", 0.05).alias("p05"), quantile("p", 0.95).alias("p95"))


def facility_mean_frequency(observed: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Facilities of both pools: observed mean, and median over scenarios of the synthetic means."""
    obs = observed.groupBy("hf_id").agg(F.avg("occurrence").alias("observed"))
    syn = synthetic.groupBy("hf_id", "scenario_id").agg(F.avg("occurrence").alias("m")).groupBy("hf_id").agg(F.median("m").alias("synthetic"))
    return obs.join(syn, "hf_id")


def scenario_metrics(df: DataFrame, days: int = 10) -> DataFrame:
    """By scenario: mean annual days, frequency, share of spells of `days` and more, mean wet share in per cent."""
    by_facility = df.groupBy("scenario_id", "hf_id").agg(F.sum("occurrence").alias("wet"), F.count("occurrence").alias("n"), F.sum(F.when(F.col("occurrence") == 1, F.col("pct_flooded"))).alias("pct"))
    sums = by_facility.groupBy("scenario_id").agg(F.avg("wet").alias("annual_days"), (F.sum("wet") / F.sum("n")).alias("flood_freq"), F.coalesce(F.sum("pct") / F.nullif(F.sum("wet"), F.lit(0)) * 100, F.lit(0.0)).alias("mean_pct_wet"))
    long = spell_lengths(df, SCENARIO).groupBy("scenario_id").agg(exceedance(F.col("length"), days).alias("p"))
    return sums.join(long, "scenario_id", "left").select("scenario_id", "annual_days", "flood_freq", F.coalesce("p", F.lit(0.0)).alias(f"p_spell_ge{days}"), "mean_pct_wet")


def credible_interval(df: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """By facility: median, q05, q95 and width of annual days over scenarios; with the observed days of the last year."""
    days = df.groupBy("hf_id", "scenario_id").agg(F.sum("occurrence").alias("d"))
    out = days.groupBy("hf_id").agg(F.median("d").alias("median"), quantile("d", 0.05).alias("q05"), quantile("d", 0.95).alias("q95")).withColumn("ci_width", F.col("q95") - F.col("q05"))
    if observed is None:
        return out
    last = observed.agg(F.max("year").alias("year"))
    seen = observed.join(F.broadcast(last), "year").groupBy("hf_id").agg(F.sum("occurrence").alias("obs_days"))  # one row
    return out.join(seen, "hf_id", "left")


def uncertainty_summary(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "scenario_id"]
    v = "value"
    long = metrics.unpivot(["scenario_id"], [F.col(c).cast("double").alias(c) for c in names], "metric", v)
    out = long.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), quantile(v, 0.05).alias("p5"), F.median(v).alias("p50"), quantile(v, 0.95).alias("p95"))
    return out.withColumn("width", F.col("p95") - F.col("p5")).withColumn("cv_pct", F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100))


def breakpoint_sensitivity(draws: DataFrame, grid=tuple(round(0.80 + 0.05 * i, 2) for i in range(11))) -> DataFrame:
    """For each scaled year: mean, p05, p95 over draws of the facilities' mean contribution delta * sigmoid(kappa (t - t_break))."""
    key = ["chain", "draw"]
    part = lambda p, *c: draws.filter(F.col("param") == p).select(*key, *c, F.col("value").alias(p))
    rows = part("t_break", "idx").join(part("delta", "idx"), [*key, "idx"]).join(part("kappa"), key)
    rows = rows.withColumn("t_year", F.explode(F.array(*[F.lit(t) for t in grid])))
    means = rows.groupBy(*key, "t_year").agg(F.avg(F.col("delta") * sigmoid(F.col("kappa") * (F.col("t_year") - F.col("t_break")))).alias("m"))
    base = means.groupBy("t_year").agg(F.avg("m").alias("mean"))
    return base.join(quantiles(means, ["t_year"], {"p05": ("m", 0.05), "p95": ("m", 0.95)}), "t_year")


def posterior_summary(draws: DataFrame, mass: float = 0.90) -> DataFrame:
    """Mean, deviation and the narrowest interval of the given mass for each parameter.

    A parameter's draws are numbered by value, by ranges of values, and each meets the one that ends its interval, so
    none are gathered and no task orders a parameter.
    """
    draws = draws.withColumn("value", F.when(known("value"), F.col("value")))
    moments = draws.groupBy("param", "idx").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    counts = stored(draws.filter("value IS NOT NULL").groupBy("param", "idx", "value").agg(F.count("*").alias("c")))
    rows = running(counts, "value", ["c"], ["param", "idx"])
    rows = rows.select("param", "idx", "value", F.explode(F.sequence(F.col("before_c") + 1, F.col("before_c") + F.col("c"))).alias("i"))
    rows = stored(rows.join(moments.select("param", "idx", "n"), ["param", "idx"]))
    ends = rows.select("param", "idx", F.col("value").alias("high"), (F.col("i") - F.floor(F.col("n") * mass)).alias("i"))
    spans = rows.join(ends, ["param", "idx", "i"]).groupBy("param", "idx").agg(F.min(F.struct((F.col("high") - F.col("value")).alias("w"), F.col("value").alias("lo"), F.col("high").alias("hi"))).alias("b"))
    return moments.join(spans, ["param", "idx"], "left").select("param", "idx", "mean", "sd", F.col("b.lo").alias("hdi_low"), F.col("b.hi").alias("hdi_high"))


def split_rhat(draws: DataFrame) -> DataFrame:
    """Potential scale reduction of each parameter over its chains' halves, from their means and variances."""
    half = draws.withColumn("n", F.count("*").over(Window.partitionBy("param", "idx", "chain"))).withColumn("i", F.row_number().over(Window.partitionBy("param", "idx", "chain").orderBy("draw")))
    half = half.withColumn("h", F.floor(F.col("n") / 2)).filter((F.col("i") <= F.col("h")) | (F.col("i") > F.col("n") - F.col("h"))).withColumn("part", (F.col("i") <= F.col("h")).cast("int"))
    parts = half.groupBy("param", "idx", "chain", "part").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("k"))
    out = parts.groupBy("param", "idx").agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.max("k").alias("k"))
    return out.select("param", "idx", F.sqrt(((F.col("k") - 1) / F.col("k") * F.col("w") + F.col("b")) / F.col("w")).alias("rhat"))


#: Draws of one array in the sums of products over lags, and so lags of one step.
BLOCK = 128


def _scores(draws: DataFrame) -> DataFrame:
    """param, idx, part (half of a chain), i, n (draws of each half), s (of all halves), z: normal scores of the draws' ranks."""
    rows = stored(draws.filter(known("value")).select("param", "idx", "chain", "draw", F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("c")))
    lengths = rows.groupBy("param", "idx", "chain").agg(F.count("*").alias("len"))
    halves = lengths.groupBy("param", "idx").agg(F.floor(F.min("len") / 2).alias("n"))
    lengths = lengths.join(halves, ["param", "idx"]).filter("n > 1")
    first, i = F.col("i") <= F.col("n"), F.col("before_c") + 1
    rows = running(rows, "draw", ["c"], ["param", "idx", "chain"]).withColumn("i", i).join(lengths, ["param", "idx", "chain"]).filter(first | (F.col("i") > F.col("len") - F.col("n")))
    rows = rows.select("param", "idx", (F.col("chain") * 2 + (~first).cast("int")).alias("part"), F.when(first, F.col("i")).otherwise(F.col("i") - F.col("len") + F.col("n")).alias("i"), "n", "value")
    rows = stored(rows)
    counts = rows.groupBy("param", "idx", "value").agg(F.count("*").alias("c"))
    ranks = running(counts, "value", ["c"], ["param", "idx"]).select("param", "idx", "value", (F.col("before_c") + (F.col("c") + 1) / 2).alias("r"))
    sizes = rows.groupBy("param", "idx").agg(F.count("*").alias("s"))
    scored = rows.join(ranks, ["param", "idx", "value"]).join(sizes, ["param", "idx"])
    return scored.select("param", "idx", "part", "i", "n", "s", normal_quantile((F.col("r") - 0.375) / (F.col("s") + 0.25)).alias("z"))


def _padded(arrays: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(arrays), size))
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _lagged(x: pd.Series, ys: pd.Series) -> pd.Series:
    """Of each block the sums of the products of its draws and those 0 to BLOCK - 1 places on; there are none behind the last."""
    windows = np.lib.stride_tricks.sliding_window_view(_padded(ys, 2 * BLOCK), BLOCK, axis=1)[:, :BLOCK]
    return pd.Series(list(np.einsum("bj,boj->bo", _padded(x, BLOCK), windows)))


def _products(blocks: DataFrame, params: DataFrame, steps: range) -> DataFrame:
    """param, idx, t, ac: sums over all halves of the products of draws t apart, for the lags of the given steps of BLOCK.

    Lags of step r take the draws of a block to those of the r-th block after it and the one behind that.
    """
    some = blocks.join(params, ["param", "idx"], "left_semi")
    a = some.select("param", "idx", "part", F.col("b").alias("own"), F.col("xs").alias("x"), F.explode(F.array(*[F.lit(r) for r in steps])).alias("r")).withColumn("b", F.col("own") + F.col("r"))
    near = some.select("param", "idx", "part", "b", F.col("xs").alias("y"))
    after = some.select("param", "idx", "part", (F.col("b") - 1).alias("b"), F.col("xs").alias("y2"))
    keys = ["param", "idx", "part", "b"]
    both = a.join(near, keys).join(after, keys, "left").withColumn("ys", F.concat("y", F.coalesce("y2", F.array().cast("array<double>"))))
    rows = both.select("param", "idx", "r", F.posexplode(_lagged("x", "ys")).alias("o", "ac"))
    return rows.groupBy("param", "idx", (F.col("r") * BLOCK + F.col("o")).alias("t")).agg(F.sum("ac").alias("ac"))


def rhat_ess(draws: DataFrame) -> DataFrame:
    """Rank-normalised split R-hat and bulk effective size of each parameter, flagged above 1.05 or below 400.

    Draws of a chain are told apart by their numbers. Ranks and places come from ranges of values; autocovariances are
    summed from blocks of BLOCK draws, for so many lags as are needed until the sum of a pair of autocorrelations is
    negative: twice as many more in each round, and only for the parameters that are not there yet. So no task holds a
    parameter or a chain. Null and NaN draws are left out; parameters of fewer than four draws a chain, and those whose
    draws are all alike, have no figures and no flag.
    """
    z = stored(_scores(draws))
    keys = ["param", "idx"]
    parts = stored(z.groupBy(*keys, "part", "n", "s").agg(F.avg("z").alias("m"), F.var_samp("z").alias("v")))
    within = parts.groupBy(*keys, "n", "s").agg(F.count("*").alias("parts"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    within = stored(within.filter("w > 0 OR b > 0").withColumn("var", (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")).drop("b"))
    place = F.floor((F.col("i") - 1) / BLOCK).cast("int")
    centred = z.join(parts.select(*keys, "part", "m"), [*keys, "part"]).select(*keys, "part", place.alias("b"), "i", (F.col("z") - F.col("m")).alias("x"))
    blocks = stored(centred.groupBy(*keys, "part", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("xs")))  # BLOCK draws

    def least(lags: DataFrame) -> DataFrame:
        """k, the pair's number, and the least sum of pairs up to there."""
        rho = F.when(F.col("t") == 0, 1.0).otherwise(1 - F.try_divide(F.col("w") - F.col("ac") / F.col("n") / F.col("parts"), F.col("var")))
        pairs = lags.join(within, keys).filter(F.col("t") < F.col("n") - F.col("n") % 2).withColumn("rho", rho).groupBy(*keys, "n", F.floor(F.col("t") / 2).alias("k")).agg(F.sum("rho").alias("pair"))
        return pairs.withColumn("least", F.min("pair").over(Window.partitionBy(*keys).orderBy("k")))

    lags, done, span = None, 0, 1
    pending = within.select(*keys)
    while not pending.isEmpty():
        found = stored(_products(blocks, pending, range(done, done + span)))
        lags = found if lags is None else lags.unionByName(found)
        done, span = done + span, 2 * span
        open_ = least(lags).groupBy(*keys, "n").agg(F.min("least").alias("low")).filter((F.col("low") >= 0) & (F.col("n") > done * BLOCK))
        pending = stored(open_.select(*keys))
    everything = draws.select(*keys).distinct()
    if lags is None:
        none = F.lit(None).cast("double")
        return everything.select(*keys, none.alias("rhat"), none.alias("ess"), F.lit(False).alias("flagged"))
    total = least(lags).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("least") >= 0, F.col("least"))), F.lit(0.0)).alias("total"))
    size = F.col("s") / F.greatest(-1 + 2 * F.col("total"), 1 / F.log10("s"))
    out = within.join(total, keys).select(*keys, F.sqrt(F.try_divide(F.col("var"), F.col("w"))).alias("rhat"), size.alias("ess"))
    flagged = F.coalesce((F.col("rhat") > 1.05) | (F.col("ess") < 400), F.lit(False))
    return everything.join(out, keys, "left").select(*keys, "rhat", "ess", flagged.alias("flagged"))


def subsample_stability(metrics: DataFrame, sizes=tuple(range(5, 51, 5)), reps: int = 200) -> DataFrame:
    """Mean width p95 - p5 of each metric over `reps` subsamples of each size, drawn by hashed order.

    metrics has one row a scenario; sizes above their number take all of them.
    """
    names = [c for c in metrics.columns if c != "scenario_id"]
    rows = metrics.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    key = F.md5(F.concat_ws("#", "scenario_id", "rep", "size", F.lit("42")).cast("binary"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("size", "rep").orderBy(key))).filter("n <= size")
    widths = rows.groupBy("size", "rep").agg(*[(quantile(c, 0.95) - quantile(c, 0.05)).alias(c) for c in names])
    return widths.groupBy("size").agg(*[F.avg(c).alias(f"width_{c}") for c in names])
