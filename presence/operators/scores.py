"""Detections, ensembles and signal sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS, REAL_CLASS, SIGNAL_WEIGHTS, Settings
from presence.functions.numeric import first_argmax3, round_dp


def best_detection(detections: DataFrame, key: str = "frame_id") -> DataFrame:
    """Most confident candidate per frame, lowest candidate index on ties.

    ``max_by`` keeps one row per frame on the map side, so a frame with many
    candidates shuffles no more than any other.
    """
    payload = F.struct("cand", "conf", "l", "t", "r", "b")
    order = F.struct(F.col("conf"), -F.col("cand"))
    return (
        detections.groupBy(key)
        .agg(F.max_by(payload, order).alias("best"), F.count(F.lit(1)).alias("n_candidates"))
        .select(key, "best.*", "n_candidates")
    )


def best_face_and_count(faces: DataFrame, key: str = "frame_id") -> DataFrame:
    """Best-scored face, the number of faces, and a pose that is never NULL."""
    payload = F.struct("cand", "det_score", "pitch", "yaw", "roll")
    order = F.struct(F.col("det_score"), -F.col("cand"))
    best = faces.groupBy(key).agg(
        F.max_by(payload, order).alias("best"), F.count(F.lit(1)).alias("n_faces")
    )
    zero = F.lit(0.0)
    return best.select(
        key,
        F.col("best.cand").alias("cand"),
        F.col("best.det_score").alias("det_score"),
        F.coalesce("best.pitch", zero).alias("pitch"),
        F.coalesce("best.yaw", zero).alias("yaw"),
        F.coalesce("best.roll", zero).alias("roll"),
        "n_faces",
    )


def attach_detection(frames: DataFrame, best: DataFrame, key: str = "frame_id") -> DataFrame:
    """Frames with their best detection; a miss keeps the frame's row."""
    return frames.join(best, key, "left")


def vote(p0: Column, p1: Column, p2: Column, s: Settings = DEFAULTS) -> dict[str, Column]:
    """Winner and score of summed class probabilities."""
    return {
        "nn_label": first_argmax3(p0, p1, p2),
        "nn_score": F.greatest(p0, p1, p2) / F.lit(float(s.n_models)),
    }


def ensemble_vote(probs: DataFrame, key: str = "frame_id", s: Settings = DEFAULTS) -> DataFrame:
    """Sum the models' class probabilities per frame and pick the winner."""
    summed = probs.groupBy(key).agg(
        F.sum("p0").alias("s0"), F.sum("p1").alias("s1"), F.sum("p2").alias("s2")
    )
    out = summed.withColumns(vote(F.col("s0"), F.col("s1"), F.col("s2"), s))
    return out.withColumn(
        "nn_call", F.when(F.col("nn_label") == REAL_CLASS, F.lit("real")).otherwise(F.lit("spoof"))
    )


def weighted_signal_sum(df: DataFrame) -> DataFrame:
    """Normalised weighted sum of the signals present in a row.

    Reads one column per signal; ``recapture`` may be NULL and then drops out
    of both sums; without any signal the sum is 0. Triggers compare unrounded
    scores, the published ones carry 4 decimals.
    """
    total, weights = F.lit(0.0), F.lit(0.0)
    for name, weight in SIGNAL_WEIGHTS.items():
        present = F.col(name).isNotNull()
        total = total + F.when(present, F.col(name) * weight).otherwise(F.lit(0.0))
        weights = weights + F.when(present, F.lit(weight)).otherwise(F.lit(0.0))
    fired = F.array_compact(
        F.array(*[F.when(F.col(n) > 0.1, F.lit(n)) for n in SIGNAL_WEIGHTS])
    )
    return df.withColumns(
        {
            "signal_scores": F.struct(
                *[round_dp(F.col(n), 4).alias(n) for n in SIGNAL_WEIGHTS]
            ),
            "spoof_probability": round_dp(F.when(weights > 0, total / weights).otherwise(F.lit(0.0)), 4),
            "signals_triggered": fired,
        }
    )
