"""Streams that need no custom state: guards, duplicates, scoring, monitors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS, Settings
from presence.operators import gates
from presence.sources import sinks


def replay_guard_stream(
    requests: DataFrame, header: str, arrival_s: Column | None = None, s: Settings = DEFAULTS
) -> DataFrame:
    """Flag requests whose time header is outside the window around arrival;
    without an arrival column that is the trigger's clock."""
    now = F.unix_micros(F.current_timestamp()) / 1e6 if arrival_s is None else arrival_s
    return gates.replay_guard(requests, header, now, s)


def _computed_once(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keep a micro-batch while its several tables are written, so that its
    scores are not computed for each of them."""

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(batch, batch_id)
        finally:
            batch.unpersist()

    return kept


def split_batches(reject: str, accepted: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """Batch function: accepted rows to one table, refused ones to another.
    Paths carry the batch id, so a replayed batch replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for path, rows in (
            (accepted, batch.where(F.col(reject).isNull())),
            (rejected, batch.where(F.col(reject).isNotNull())),
        ):
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _computed_once(write)


def drop_repeats(events: DataFrame, ts: str, delay: str, *ids: str) -> DataFrame:
    """First delivery of each event from an at-least-once source."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def record_batches(folder: str, *ids: str, s: Settings = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """Batch function of the scoring stream: audit lines, evidence ids and
    security events of one micro-batch, replaced when the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"batch_id={batch_id}"
        sinks.write_lines(sinks.pad_audit_lines(batch, s), f"{folder}/audit/{part}", "overwrite")
        kept = batch.where("save_frame").select(*ids, "verdict", "reason")
        kept.write.mode("overwrite").parquet(f"{folder}/evidence/{part}")
        faults = sinks.security_events(batch).select(*ids, "verdict", "reason")
        faults.write.mode("overwrite").parquet(f"{folder}/events/{part}")

    return _computed_once(write)


def monitor_stream(
    decisions: DataFrame, delay: str, ts: str = "ts", width: str = "5 minutes"
) -> DataFrame:
    """Counts per closed time window, endpoint, verdict and reason."""
    return (
        decisions.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "endpoint", "verdict", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "endpoint", "verdict", "reason", "n")
    )
