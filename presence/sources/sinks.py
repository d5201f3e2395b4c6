"""Sinks: audit lines, evidence ids, security events. No pixel leaves here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence import schema
from presence.config import DEFAULTS, REAL_CLASS, Settings
from presence.functions.numeric import round_dp

KEEP_NULLS = {"ignoreNullFields": "false"}
MAX_RECORDS = 200_000


def _stamp(ts: str) -> Column:
    return F.date_format(ts, schema.AUDIT_TIME).alias("timestamp")


def pad_audit_lines(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``date`` and one JSON ``value`` per photo decision, live ones included.

    The three score fields appear only when signals were computed.
    """
    base = [
        _stamp("ts"),
        F.col("correlation_id"),
        F.col("transaction_type"),
        F.col("transaction_ref"),
        F.col("verdict"),
        F.col("reason"),
        round_dp(F.col("score"), 4).alias("score"),
        F.lit(s.model_version).alias("model_version"),
        round_dp(F.col("processing_ms"), 1).alias("processing_ms"),
        F.col("save_frame"),
    ]
    scored = [
        F.col("signal_scores"),
        F.when(F.col("nn_label") == REAL_CLASS, F.lit("real")).otherwise(F.lit("spoof")).alias("nn_label"),
        round_dp(F.col("nn_score"), 4).alias("nn_score"),
    ]
    return df.select(
        F.to_date("ts").alias("date"),
        F.when(
            F.col("signal_scores").isNotNull(), F.to_json(F.struct(*base, *scored), KEEP_NULLS)
        )
        .otherwise(F.to_json(F.struct(*base), KEEP_NULLS))
        .alias("value"),
    )


def session_audit_lines(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    fields = [
        _stamp("ts"),
        F.lit("liveness_verdict").alias("endpoint"),
        F.col("correlation_id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("transaction_type"),
        F.col("transaction_ref"),
        F.col("verdict"),
        F.col("reason"),
        F.col("frame_consistency_score"),
        F.col("n_frames_received"),
        F.col("n_frames_valid"),
        F.lit(s.model_version).alias("model_version"),
        round_dp(F.col("processing_ms"), 1).alias("processing_ms"),
    ]
    return df.select(
        F.to_date("ts").alias("date"), F.to_json(F.struct(*fields), KEEP_NULLS).alias("value")
    )


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines by date. Rebalancing on the date gives each day a few files
    of even size, however many tasks wrote and however busy the day was;
    ``maxRecordsPerFile`` bounds a file."""
    even = lines.hint("rebalance", "date")
    even.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS).partitionBy("date").text(path)


def write_audit_log(df: DataFrame, path: str, s: Settings = DEFAULTS) -> None:
    write_lines(pad_audit_lines(df, s), path)


def write_session_audit(df: DataFrame, path: str, s: Settings = DEFAULTS) -> None:
    write_lines(session_audit_lines(df, s), path)


def write_evidence(df: DataFrame, path: str, *ids: str) -> None:
    """Ids of frames to keep, never the frames."""
    df.where("save_frame").select(*ids, "verdict", "reason").write.mode("append").parquet(path)


def security_events(df: DataFrame) -> DataFrame:
    """Service faults that let a transaction proceed."""
    return df.where(F.col("reason").isin("TIMEOUT", "INTERNAL_ERROR"))


def write_security_events(df: DataFrame, path: str, *ids: str) -> None:
    security_events(df).select(*ids, "verdict", "reason").write.mode("append").parquet(path)
