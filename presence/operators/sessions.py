"""Challenge sessions: one-shot use, and judging the frames of an attempt.

Malformed attempts are refused before they touch a session. An accepted one
holds at most ``max_frames`` frames, so its frames are gathered into one
sorted array and every layer is a column expression over that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.config import CHALLENGE_STEPS, DEFAULTS, Settings
from presence.functions import vector
from presence.functions.numeric import round_dp
from presence.functions.text import challenge_steps

MICROS = 1_000_000


# -- session lookup and one-time use ----------------------------------------


def lookup_session(
    attempts: DataFrame, sessions: DataFrame, s: Settings = DEFAULTS
) -> DataFrame:
    """Attempts with their session, when it exists and is still retained.

    Adds ``session_found`` and ``age_us``. A plain equi-join: the planner
    broadcasts small session tables and splits hot session ids.
    """
    renamed = sessions.select(
        "session_id",
        F.col("created_at").alias("session_created_at"),
        F.col("correlation_id").alias("session_correlation_id"),
        *[c for c in ("steps",) if c in sessions.columns],
    )
    age = F.unix_micros("attempted_at") - F.unix_micros("session_created_at")
    return (
        attempts.join(renamed, "session_id", "left")
        .withColumn("age_us", age)
        .withColumn(
            "session_found",
            F.coalesce(
                (F.col("age_us") >= 0) & (F.col("age_us") <= s.session_retention_s * MICROS),
                F.lit(False),
            ),
        )
    )


def consume_once(looked_up: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Outcome of using each session once: the first in-time attempt wins.

    The winner is a partially aggregated minimum joined back, not a window,
    so a session hit by a flood of attempts is never gathered in one task.
    Attempts with a ``shape_reject`` (where that column exists) are refused
    before the lookup: they neither use the session nor learn its state.
    """
    ttl = int(s.session_ttl_s * MICROS)
    turn = F.struct("attempted_at", "attempt_id")
    shaped = F.col("shape_reject").isNull() if "shape_reject" in looked_up.columns else F.lit(True)
    winners = (
        looked_up.where(shaped & F.col("session_found") & (F.col("age_us") <= ttl))
        .groupBy("session_id")
        .agg(F.min(turn).alias("winner"))
    )
    return (
        looked_up.join(winners, "session_id", "left")
        .withColumn(
            "session_error",
            F.when(~shaped, F.lit(None).cast("string"))
            .when(~F.col("session_found"), F.lit("SESSION_NOT_FOUND"))
            .when(turn > F.col("winner"), F.lit("SESSION_ALREADY_USED"))
            .when(F.col("age_us") > ttl, F.lit("SESSION_EXPIRED")),
        )
        .drop("winner")
    )


def bind_correlation(consumed: DataFrame) -> DataFrame:
    """A used session must carry the caller's correlation id; the check comes
    after consumption, so a mismatch still burns the session. Attempts of a
    bad shape were never looked up and carry no error."""
    shaped = F.col("shape_reject").isNull() if "shape_reject" in consumed.columns else F.lit(True)
    return consumed.withColumn(
        "session_error",
        F.when(F.col("session_error").isNotNull(), F.col("session_error")).when(
            shaped & ~F.col("session_correlation_id").eqNullSafe(F.col("correlation_id")),
            F.lit("SESSION_CORRELATION_MISMATCH"),
        ),
    )


def issue_challenges(
    requests: DataFrame, s: Settings = DEFAULTS, random: bool = False
) -> DataFrame:
    """Challenge sessions for requests: ordered steps, bounds and expiry.

    Session ids are a digest of the request's own ids, so a retried task
    issues the same session again.
    """
    sid = F.sha2(F.concat_ws("|", "correlation_id", "transaction_ref", F.unix_micros("requested_at")), 256)
    return requests.withColumn("session_id", sid).select(
        "session_id",
        "correlation_id",
        "transaction_type",
        "transaction_ref",
        challenge_steps(F.col("session_id"), s.challenge_pool, s.challenge_step_count, random).alias(
            "steps"
        ),
        F.lit(s.min_frames).alias("min_frames"),
        F.lit(s.max_frames).alias("max_frames"),
        F.col("requested_at").alias("created_at"),
        F.timestamp_micros(F.unix_micros("requested_at") + int(s.session_ttl_s * MICROS)).alias(
            "expires_at"
        ),
    )


# -- frames of one attempt --------------------------------------------------

FRAME_FIELDS = (
    "seq",
    "qc_reason",
    "is_document",
    "area_ratio",
    "yaw",
    "min_ear",
    "sharpness",
    "embedding",
    "pad_label",
    "pad_score",
    "qc_metrics",
    "fault",
    "took_ms",
)


def attempt_shapes(frames: DataFrame, key: str = "attempt_id", s: Settings = DEFAULTS) -> DataFrame:
    """``n_received`` and ``shape_reject`` of every attempt that has frames.

    Rows are counted per (attempt, sequence number) first, so an attempt of
    any size is combined before it meets in one task.
    """
    per_seq = frames.groupBy(key, "seq").agg(F.count(F.lit(1)).alias("n"))
    counts = per_seq.groupBy(key).agg(
        F.sum("n").alias("n_received"),
        F.max("n").alias("most"),
        F.bool_or(F.col("seq").isNull() | (F.col("seq") < 0)).alias("negative"),
    )
    return counts.select(
        key,
        F.col("n_received").cast("int").alias("n_received"),
        F.when(F.col("n_received") > s.max_frames, F.lit("FRAME_COUNT"))
        .when(F.col("negative"), F.lit("NEGATIVE_SEQ"))
        .when(F.col("most") > 1, F.lit("DUPLICATE_SEQ"))
        .alias("shape_reject"),
    )


def guard_shapes(
    attempts: DataFrame, frames: DataFrame, key: str = "attempt_id", s: Settings = DEFAULTS
) -> DataFrame:
    """Attempts with ``n_received`` and ``shape_reject``; no frames is a
    FRAME_COUNT. To be applied before ``consume_once``."""
    missing = F.when(F.col("n_received").isNull(), F.lit("FRAME_COUNT"))
    return attempts.join(attempt_shapes(frames, key, s), key, "left").withColumns(
        {
            "shape_reject": F.coalesce(missing, F.col("shape_reject")),
            "n_received": F.coalesce("n_received", F.lit(0)),
        }
    )


def _frame_arrays(frames: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    present = [c for c in FRAME_FIELDS if c in frames.columns]
    return (
        frames.select(key, *present)
        .join(accepted.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(*present))).alias("frames"))
    )


def gather_frames(frames: DataFrame, key: str = "attempt_id", s: Settings = DEFAULTS) -> DataFrame:
    """One row per attempt: its shape, and ``frames`` sorted by sequence
    number. Refused attempts keep their true count and have NULL frames, so
    no array holds more than ``max_frames``."""
    shapes = attempt_shapes(frames, key, s)
    accepted = shapes.where(F.col("shape_reject").isNull())
    return shapes.join(_frame_arrays(frames, accepted, key), key, "left")


def valid_frames(frames: str = "frames") -> Column:
    return F.filter(frames, lambda f: f["qc_reason"].isNull())


def frame_counts(frames: str = "frames") -> dict[str, Column]:
    """Received and valid counts, and failures per quality reason, of rows
    that carry ``n_received``."""
    reasons = F.filter(F.col(f"{frames}.qc_reason"), lambda r: r.isNotNull())
    return {
        "n_received": F.col("n_received"),
        "n_valid": F.size(valid_frames(frames)),
        "failed": F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(reasons)),
                lambda r: F.struct(r, F.size(F.filter(reasons, lambda q: q == r))),
            )
        ),
    }


def document_hits(frames: str = "frames") -> dict[str, Column]:
    """Frames over the document ratio, whether or not they passed quality."""
    hits = F.filter(frames, lambda f: f["is_document"])
    return {
        "document_hit": F.size(hits) > 0,
        "document_ratios": F.map_from_entries(
            F.transform(hits, lambda f: F.struct(f["seq"], round_dp(f["area_ratio"], 4)))
        ),
    }


def challenge_check(valid: Column, steps: Column, s: Settings = DEFAULTS) -> dict[str, Column]:
    """Evidence for every requested step somewhere in the valid frames."""
    known = F.array(*[F.lit(c) for c in CHALLENGE_STEPS])
    frontal = F.exists(valid, lambda f: F.abs(f["yaw"]) <= s.yaw_frontal_max)
    seen = F.array_compact(
        F.array(
            F.when(F.exists(valid, lambda f: f["yaw"] >= s.yaw_turn_min), F.lit("TURN_LEFT")),
            F.when(F.exists(valid, lambda f: f["yaw"] <= -s.yaw_turn_min), F.lit("TURN_RIGHT")),
            F.when(
                F.exists(
                    valid,
                    lambda f: F.coalesce(round_dp(f["min_ear"], 3) <= s.ear_blink_max, F.lit(False)),
                ),
                F.lit("BLINK"),
            ),
        )
    )
    missing = F.array_except(steps, seen)
    reason = (
        F.when(F.size(F.array_except(steps, known)) > 0, F.lit("UNSUPPORTED_STEP"))
        .when(~frontal, F.lit("NO_FRONTAL_REFERENCE"))
        .when(F.size(missing) > 0, F.lit("STEP_NOT_DETECTED"))
    )
    return {"challenge_reason": reason, "missing_steps": missing}


def identity_consistency(valid: Column, s: Settings = DEFAULTS) -> dict[str, Column]:
    """Similarity of every valid frame to the first one (unit embeddings)."""
    first = F.get(valid, F.lit(0))
    others = F.filter(valid, lambda f: f["seq"] != first["seq"])
    sims = F.transform(
        others,
        lambda f: F.struct(
            f["seq"].alias("seq"), vector.dot(first["embedding"], f["embedding"]).alias("sim")
        ),
    )
    return {"reference_seq": F.coalesce(first["seq"], F.lit(-1)), "_sims": sims}


def identity_outcome(sims: str = "_sims", n_valid: str = "n_valid", s: Settings = DEFAULTS):
    lowest = F.array_min(F.col(f"{sims}.sim"))
    return {
        "identity_passed": F.when(F.col(n_valid) == 0, F.lit(False))
        .when(F.col(n_valid) == 1, F.lit(True))
        .otherwise(lowest >= s.identity_min),
        "min_similarity": F.when(F.col(n_valid) == 0, F.lit(-1.0))
        .when(F.col(n_valid) == 1, F.lit(1.0))
        .otherwise(round_dp(lowest, 4)),
        "pairwise": F.map_from_entries(
            F.transform(sims, lambda e: F.struct(e["seq"], round_dp(e["sim"], 4)))
        ),
    }


def passive_spoof(valid: Column) -> Column:
    """Any valid frame called spoof; frames without a face are ignored."""
    return F.exists(valid, lambda f: F.coalesce(f["pad_label"] == "spoof", F.lit(False)))


def best_frame(valid: Column, s: Settings = DEFAULTS) -> Column:
    """Frontal first, then sharpest as published, then earliest."""
    ranked = F.transform(
        valid,
        lambda f: F.struct(
            (F.abs(f["yaw"]) <= s.yaw_frontal_max).cast("int").alias("frontal"),
            round_dp(f["sharpness"], 1).alias("sharp"),
            (-f["seq"]).alias("order"),
        ),
    )
    return -F.array_max(ranked)["order"]


# -- whole-session verdict --------------------------------------------------


def session_layers(gathered: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """All layer outcomes of gathered attempts that carry ``steps``."""
    valid = F.col("_valid")
    out = gathered.withColumns(
        {**frame_counts(), **document_hits(), "_valid": valid_frames()}
    )
    out = out.withColumns(
        {
            **challenge_check(valid, F.col("steps"), s),
            **identity_consistency(valid, s),
            "best_seq": best_frame(valid, s),
        }
    )
    return out.withColumns(identity_outcome(s=s)).drop("_sims")


def _early_reason(s: Settings) -> Column:
    """Reasons decided before passive scoring, in priority order."""
    return (
        F.when(F.col("session_error").isNotNull(), F.col("session_error"))
        .when(F.col("document_hit"), F.lit("DOCUMENT_PHOTO"))
        .when(F.coalesce(F.col("n_valid"), F.lit(0)) < s.min_frames, F.lit("LOW_QUALITY_FRAMES"))
        .when(F.col("challenge_reason") == "UNSUPPORTED_STEP", F.lit("ACTIVE_CHALLENGE_NOT_IMPLEMENTED"))
        .when(F.col("challenge_reason") == "NO_FRONTAL_REFERENCE", F.lit("NO_FRONTAL_REFERENCE"))
        .when(F.col("challenge_reason").isNotNull(), F.lit("CHALLENGE_FAILED"))
        .when(~F.col("identity_passed"), F.lit("IDENTITY_SWAP_MID_SESSION"))
    )


_SPOOF_REASONS = (
    "DOCUMENT_PHOTO",
    "CHALLENGE_FAILED",
    "IDENTITY_SWAP_MID_SESSION",
    "PASSIVE_PAD_SPOOF",
)


def fault_reason(frames: str = "frames", s: Settings = DEFAULTS) -> Column:
    """Why an attempt could not be judged: its frames took longer than the
    budget together, or one of them failed for a reason of the service."""
    took = F.aggregate(F.col(f"{frames}.took_ms"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(took > s.session_budget_ms, F.lit("TIMEOUT")).when(
        F.exists(frames, lambda f: f["fault"].isNotNull()), F.lit("INTERNAL_ERROR")
    )


def session_verdict(
    attempts: DataFrame,
    frames: DataFrame,
    s: Settings = DEFAULTS,
    label_frames: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Verdict per attempt.

    ``attempts`` come from ``bind_correlation`` (with ``steps``, and the
    columns of ``guard_shapes``, which went first). Attempts of a bad shape
    have no verdict and no layer columns. ``frames`` carry the columns of ``FRAME_FIELDS``. Without a ``pad_label`` column,
    ``label_frames`` is called on the valid frames of attempts that are still
    undecided: Python scorers see no row whose outcome is already known.
    """
    gathered = _frame_arrays(frames, attempts.where(F.col("shape_reject").isNull()), "attempt_id")
    layered = session_layers(attempts.join(gathered, "attempt_id", "left"), s)
    layered = layered.withColumn("_early", _early_reason(s))
    if label_frames is None:
        layered = layered.withColumn("_passive", passive_spoof(F.col("_valid")))
    else:
        open_frames = (
            layered.where(F.col("_early").isNull() & F.col("shape_reject").isNull())
            .select("attempt_id", F.explode(F.col("_valid.seq")).alias("seq"))
        )
        labels = label_frames(frames.join(open_frames, ["attempt_id", "seq"], "left_semi"))
        hits = (
            labels.groupBy("attempt_id")
            .agg(F.bool_or(F.col("pad_label") == "spoof").alias("_passive"))
        )
        layered = layered.join(hits, "attempt_id", "left")
    return decide(layered, s)


def judge_frames(attempts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Verdict per attempt that carries its own sorted ``frames`` with every
    layer's outcome on them, faults included, beside the columns that
    ``bind_correlation`` leaves. Adds ``frame_signals``: each frame's quality
    reason and metrics, document ratio, and the passive label and score where
    that layer was reached."""
    layered = session_layers(attempts, s)
    early = F.coalesce(F.col("session_error"), fault_reason(s=s), _early_reason(s))
    layered = layered.withColumn("_early", early).withColumn("_passive", passive_spoof(F.col("_valid")))
    layered = layered.withColumn("_faulty", F.col("_early").isin("TIMEOUT", "INTERNAL_ERROR"))
    for c in ("n_valid", "failed", "document_ratios", "missing_steps", "pairwise"):
        layered = layered.withColumn(c, F.when(~F.coalesce("_faulty", F.lit(False)), F.col(c)))
    judged = F.col("session_error").isNull() & ~F.coalesce("_faulty", F.lit(False)) & F.col("shape_reject").isNull()
    signals = F.transform(
        "frames",
        lambda f: F.struct(
            f["seq"].alias("seq"),
            f["qc_reason"].isNull().alias("valid"),
            f["qc_reason"].alias("reason"),
            f["qc_metrics"].alias("metrics"),
            F.when(f["is_document"], round_dp(f["area_ratio"], 4)).alias("document_ratio"),
            F.when(F.col("_early").isNull() & f["qc_reason"].isNull(), f["pad_label"]).alias("label"),
            F.when(F.col("_early").isNull() & f["qc_reason"].isNull(), round_dp(f["pad_score"], 4)).alias("score"),
        ),
    )
    return decide(layered.withColumn("frame_signals", F.when(judged, signals)), s, "frame_signals")


def decide(layered: DataFrame, s: Settings = DEFAULTS, *more: str) -> DataFrame:
    """Reason, verdict and published columns of attempts whose layers are
    known (``_early`` and ``_passive``)."""
    reason = F.coalesce(
        F.col("_early"),
        F.when(F.coalesce(F.col("_passive"), F.lit(False)), F.lit("PASSIVE_PAD_SPOOF")),
    )
    judged = layered.withColumn("reason", F.when(F.col("shape_reject").isNull(), reason))
    verdict = (
        F.when(F.col("shape_reject").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("reason").isNull(), F.lit("live"))
        .when(F.col("reason").isin(*_SPOOF_REASONS), F.lit("spoof"))
        .otherwise(F.lit("incomplete"))
    )
    compared = F.col("reason").isNull() | F.col("reason").isin(
        "IDENTITY_SWAP_MID_SESSION", "PASSIVE_PAD_SPOOF"
    )
    return judged.withColumn("verdict", verdict).select(
        "attempt_id",
        "session_id",
        "correlation_id",
        "shape_reject",
        "verdict",
        "reason",
        F.when(compared & F.col("verdict").isNotNull(), F.col("min_similarity"))
        .otherwise(F.lit(-1.0))
        .alias("frame_consistency_score"),
        F.when(F.col("verdict") == "live", F.col("best_seq")).alias("best_frame_seq"),
        F.col("n_received").alias("n_frames_received"),
        F.when(F.col("session_error").isNull(), F.coalesce("n_valid", F.lit(0)))
        .otherwise(F.lit(0))
        .alias("n_frames_valid"),
        "failed",
        "document_ratios",
        "missing_steps",
        "pairwise",
        *more,
    )
