"""Spells and streaks of floods maintained as days arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_spells(wet_days: DataFrame, gap: int = 4, delay: str = "10 days") -> DataFrame:
    """Merged spells over a stream (or a table) of wet days: hf_id, ts. Days further apart than gap + 1 start a new spell.

    A spell is given out once the watermark, `delay` behind the latest day, has passed its end; later days are dropped.
    """
    rows = wet_days.withWatermark("ts", delay) if wet_days.isStreaming else wet_days
    out = rows.groupBy("hf_id", F.session_window("ts", f"{gap + 1} days")).agg(F.count("*").alias("wet_days"), F.max("ts").alias("last"))
    start = F.col("session_window.start")
    return out.select("hf_id", F.to_date(start).alias("start_date"), F.to_date("last").alias("end_date"), (F.datediff("last", start) + 1).alias("length"), "wet_days")


def advance(state: tuple, values: np.ndarray, gap: int, pixel: np.ndarray | None = None) -> tuple:
    """(valid, wet, streak, longest, missing days in a row) after further days: 1 flood, 0 clear, -1 no data.

    A clear day ends a streak, and so does the day that makes more than `gap` without data in a row. The state is five
    numbers, or five arrays with an entry a pixel; then `pixel` has each day's entry, in rising order.
    """
    if not len(values):
        return state
    valid, wet, now, most, missing = (np.atleast_1d(x) for x in state)
    pixel = np.zeros(len(values), np.int64) if pixel is None else pixel
    days = np.bincount(pixel, minlength=len(valid))
    first = np.cumsum(days) - days
    at, start = np.arange(len(values)), first[pixel]
    known = np.maximum.accumulate(np.where(values >= 0, at, -1))
    unknown = at - np.where(known >= start, known, start - 1 - missing[pixel])
    ends = (values == 0) | (unknown > gap)
    floods = np.cumsum(values == 1)
    end, before = np.maximum.accumulate(np.where(ends, at, -1)), floods[start] - (values[start] == 1)
    streak = floods - np.where(end >= start, floods[end], before - now[pixel])
    some = days > 0
    tail, now, most, missing = (first + days - 1)[some], now.copy(), most.copy(), missing.copy()
    now[some], missing[some] = streak[tail], unknown[tail]
    most[some] = np.maximum(most[some], np.maximum.reduceat(streak, first[some]))
    return valid + np.bincount(pixel[values >= 0], minlength=len(days)), wet + np.bincount(pixel[values == 1], minlength=len(days)), now, most, missing


DAY_MS = 86_400_000
#: Rows and columns of a square of pixels that share a state.
SIDE = 32
#: Before any time.
NEVER = -(2**62)


def incremental_streak(days: DataFrame, gap: int = 2, delay: str = "30 days", idle_days: int = 3650) -> DataFrame:
    """By pixel: valid and flooded counts, current and longest held streak, updated by each batch of days.

    days: ts, row, col, value (null: no data). Days may come in any order as long as the watermark, `delay` behind the
    latest day of all pixels, has not passed them; those behind it are dropped. The state is five numbers for the days that
    the watermark has passed, and a list of those that it has not; what comes out counts both. Of a day that comes twice
    the first counts. A pixel without a day for `idle_days` goes when the watermark has passed that time, and starts anew
    should it come again. Pixels of a square of SIDE rows and columns share a state and are moved on together; a pixel
    comes out in the batches that bring days of its own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() or NEVER  # 0: none yet
        old, until, last, *sums, held_at, held, values = (np.array(x, np.int64) for x in (state.get if state.exists else [[]] * 11))
        rows = pd.DataFrame({"ts": [], "at": [], "value": []}) if state.hasTimedOut else pd.concat(list(batches))
        came_at, came = rows["at"].to_numpy().astype(np.int64), rows["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        stays = (until >= mark) | np.isin(old, came_at)
        pixels = np.union1d(old[stays], came_at)
        if not len(pixels):
            state.remove()
            return
        place = np.searchsorted(pixels, old[stays])

        def kept(x: np.ndarray, new: int) -> np.ndarray:
            out = np.full(len(pixels), new, np.int64)
            out[place] = x[stays]
            return out

        until, last, sums, touched = kept(until, 0), kept(last, NEVER), tuple(kept(x, 0) for x in sums), np.isin(pixels, came_at)
        still, new = np.isin(held_at, pixels), came > mark
        pixel = np.searchsorted(pixels, np.concatenate([held_at[still], came_at[new]]))
        ts = np.concatenate([held[still], came[new]])
        value = np.concatenate([values[still], rows["value"].fillna(-1).to_numpy().astype(np.int64)[new]])
        order = np.lexsort((ts, pixel))  # of equal days the first comes first
        pixel, ts, value = pixel[order], ts[order], value[order]
        counts = ts > last[pixel]
        counts[1:] &= (pixel[1:] != pixel[:-1]) | (ts[1:] != ts[:-1])
        pixel, ts, value = pixel[counts], ts[counts], value[counts]
        latest = np.full(len(pixels), NEVER)
        np.maximum.at(latest, pixel, ts)
        passed = (ts <= mark) & touched[pixel]
        settled = advance(sums, value[passed], gap, pixel[passed])
        np.maximum.at(last, pixel[passed], ts[passed])
        latest = np.where(latest > NEVER, latest, np.maximum(last, mark))
        until = np.where(touched, np.maximum(latest + idle_days * DAY_MS, max(mark + 1, 1)), until)
        pixel, ts, value = pixel[~passed], ts[~passed], value[~passed]
        state.update(tuple(x.tolist() for x in (pixels, until, last, *settled, pixels[pixel], ts, value)))
        state.setTimeoutTimestamp(max(int(until.min()), mark + 1, 1))
        valid, wet, now, most, _ = (x[touched] for x in advance(settled, value, gap, pixel))
        if touched.any():
            row, col = (None if k is None else k * SIDE + x for k, x in zip(key, np.divmod(pixels[touched], SIDE), strict=True))
            yield pd.DataFrame({"row": row, "col": col, "valid_obs": valid, "flood_duration": wet, "streak": now, "max_consecutive": most})

    side = F.lit(SIDE)
    block = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"block_{c}")
    at = F.coalesce(F.pmod("row", side), F.lit(0)) * side + F.coalesce(F.pmod("col", side), F.lit(0))
    return days.withWatermark("ts", delay).select("ts", block("row"), block("col"), at.alias("at"), "value").groupBy("block_row", "block_col").applyInPandasWithState(
        step,
        "row int, col int, valid_obs long, flood_duration long, streak long, max_consecutive long",
        ", ".join(f"{c} array<long>" for c in ("at", "until", "last", "valid", "wet", "now", "most", "missing", "held_at", "held", "held_values")),
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything there is now, through an in-memory sink, as a table: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def written(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything there is now, written batch by batch as Parquet and read again; `seen` is the batch's number.

    A batch that is repeated after a failure replaces its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("seen", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = df.sparkSession.read.parquet(f"{path}/out").drop("batch")
    return rows if mode == "update" else rows.drop("seen")
