"""Two-level sliding rate limit over recorded requests.

A request is allowed while fewer than ``burst`` accepted requests of its key
lie in the short window and fewer than the sustained limit in the long one;
rejected requests leave no trace. That is a sequential fold per key, but most
of a key's life does not need it: time is cut into buckets of the long window
and cells no shorter than the short one. In a bucket where arrivals, together
with the bucket before, stay within the sustained limit, and arrivals of every
two adjacent cells within the burst, every request is allowed whatever happened
before. Those rows are settled by a join against counts. Only contended stretches
are folded, each on its own, seeded with the settled bucket before it, in a
sorted stream that holds no more than the limit's worth of timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presence.config import DEFAULTS, Settings

MICROS = 1_000_000


class Stamps:
    """Accepted arrival times of one key, oldest first, never above the limit."""

    def __init__(self, s: Settings, stamps: list[int] | None = None) -> None:
        self.burst, self.sustained = s.burst, s.sustained_limit
        self.long = int(s.sustained_window_s * MICROS)
        # older stamps are forgotten, so no window reaches past the long one
        self.short = min(int(s.burst_window_s * MICROS), self.long)
        self.keep = max(self.burst, self.sustained)
        self.stamps = list(stamps or [])

    def blocked_until(self) -> int | None:
        """Latest instant at which the next request would still be refused."""
        out, n = None, len(self.stamps)
        if n >= self.burst:
            out = self.stamps[-self.burst] + self.short
        if n >= self.sustained:
            later = self.stamps[-self.sustained] + self.long
            out = later if out is None else max(out, later)
        return out

    def accept(self, t: int) -> None:
        self.stamps.append(t)
        if len(self.stamps) > self.keep:
            del self.stamps[0]

    def run(self, times: np.ndarray) -> np.ndarray:
        """Decide a sorted run of arrivals; refused runs are skipped at once."""
        allowed = np.zeros(len(times), dtype=bool)
        i, n = 0, len(times)
        while i < n:
            until = self.blocked_until()
            if until is not None and times[i] <= until:
                i += int(np.searchsorted(times[i:], until, side="right"))
                continue
            allowed[i] = True
            self.accept(int(times[i]))
            i += 1
        return allowed


def rate_limit(
    requests: DataFrame, key: str, ts: str, order: str, s: Settings = DEFAULTS
) -> DataFrame:
    """``key, order`` and ``allowed`` for every request."""
    long_us = int(s.sustained_window_s * MICROS)
    per_bucket = max(1, long_us // int(s.burst_window_s * MICROS))
    cell_us = long_us // per_bucket
    rows = requests.select(key, order, F.unix_micros(ts).alias("_us")).withColumn(
        "_bucket", F.expr(f"_us div {long_us}")
    )

    # arrivals per cell, and per cell with the one before it
    inner = F.least(F.expr(f"(_us % {long_us}) div {cell_us}"), F.lit(per_bucket - 1))
    cells = rows.groupBy(key, (F.col("_bucket") * per_bucket + inner).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_own")
    )
    nothing = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("_cell").alias("_cell"), F.col("_own").alias("_own"), F.col("_own").alias("_near")),
        F.struct((F.col("_cell") + 1).alias("_cell"), nothing.alias("_own"), F.col("_own").alias("_near")),
    )
    pairs = cells.select(key, F.inline(both)).groupBy(key, "_cell").agg(
        F.sum("_own").alias("_own"), F.sum("_near").alias("_near")
    )
    counts = (
        pairs.where(F.col("_own") > 0)
        .groupBy(key, F.expr(f"_cell div {per_bucket}").alias("_bucket"))
        .agg(F.sum("_own").alias("_n"), F.max("_near").alias("_peak"))
    )
    by_time = Window.partitionBy(key).orderBy("_bucket")
    before = F.when(
        F.lag("_bucket").over(by_time) == F.col("_bucket") - 1, F.lag("_n").over(by_time)
    ).otherwise(F.lit(0))
    counts = counts.withColumn(
        "_busy", (F.col("_n") + before > s.sustained_limit) | (F.col("_peak") > s.burst)
    )
    # a stretch is a run of adjacent busy buckets; its seed is the bucket before
    starts = F.col("_busy") & ~F.coalesce(
        (F.lag("_bucket").over(by_time) == F.col("_bucket") - 1) & F.lag("_busy").over(by_time),
        F.lit(False),
    )
    next_busy = (F.lead("_bucket").over(by_time) == F.col("_bucket") + 1) & F.lead("_busy").over(
        by_time
    )
    marked = counts.withColumns({"_start": starts, "_seeds": ~F.col("_busy") & next_busy})
    stretch = F.sum(F.col("_start").cast("long")).over(by_time)
    contended = (
        marked.withColumn("_stretch", stretch + F.col("_seeds").cast("long"))
        .where(F.col("_busy") | F.coalesce(F.col("_seeds"), F.lit(False)))
        .select(key, "_bucket", "_stretch", "_busy")
    )

    joined = rows.join(contended, [key, "_bucket"], "left")
    settled = joined.where(~F.coalesce(F.col("_busy"), F.lit(False))).select(
        key, order, F.lit(True).alias("allowed")
    )
    schema = T.StructType(
        [
            requests.schema[key],
            requests.schema[order],
            T.StructField("allowed", T.BooleanType()),
        ]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Stamps(s)
        for batch in batches:
            keys, runs = batch[key].to_numpy(), batch["_stretch"].to_numpy()
            times, busy = batch["_us"].to_numpy(), batch["_busy"].to_numpy(dtype=bool)
            allowed = np.zeros(len(batch), dtype=bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if lo == hi:
                    continue
                if current != (keys[lo], runs[lo]):
                    current, state = (keys[lo], runs[lo]), Stamps(s)
                # the seed bucket sorts first and is wholly accepted
                seeds = lo + int(np.count_nonzero(~busy[lo:hi]))
                for t in times[lo:seeds]:
                    state.accept(int(t))
                allowed[seeds:hi] = state.run(times[seeds:hi])
            out = batch[[key, order]].assign(allowed=allowed)
            yield out[busy]

    folded = (
        joined.where(F.col("_busy").isNotNull())
        .select(key, order, "_stretch", "_us", "_busy")
        .repartition(key, "_stretch")
        .sortWithinPartitions(key, "_stretch", "_us", order)
        .mapInPandas(fold, schema)
    )
    return settled.unionByName(folded)


def window_pressure(
    requests: DataFrame, key: str, ts: str, order: str, s: Settings = DEFAULTS
) -> DataFrame:
    """Arrivals per window at each request, refused ones included.

    An upper bound on what the limiter counts. The long window is summed from
    bucket counts, so it covers up to one bucket more than the window.
    """
    long_us = int(s.sustained_window_s * MICROS)
    rows = requests.select(key, order, F.unix_micros(ts).alias("_us")).withColumn(
        "bucket", F.expr(f"_us div {long_us}")
    )
    by_time = Window.partitionBy(key).orderBy("bucket").rangeBetween(-1, 0)
    counts = rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("at_most", F.sum("n").over(by_time))
