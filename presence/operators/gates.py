"""Row-wise gates and decisions. Every function adds columns, none shuffles.

Inputs follow one naming scheme: ``x, y, w, h`` is a face box in pixels,
``frame_w, frame_h`` the frame, ``*_score``/``*_prob`` doubles in 0..1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS, Settings
from presence.functions import text
from presence.functions.numeric import round_dp


# -- input limits -----------------------------------------------------------


def guard_payload_size(df: DataFrame, payload: str, s: Settings = DEFAULTS) -> DataFrame:
    """Flag payloads above the byte limit (the limit itself is allowed)."""
    return df.withColumn(
        "size_reject",
        F.when(F.octet_length(F.col(payload)) > s.max_payload_bytes, F.lit("PAYLOAD_TOO_LARGE")),
    )


def guard_dimensions(
    df: DataFrame, height: str, width: str, s: Settings = DEFAULTS
) -> DataFrame:
    return df.withColumn(
        "dimension_reject",
        F.when(
            (F.col(height) > s.max_dimension) | (F.col(width) > s.max_dimension),
            F.lit("DIMENSIONS_TOO_LARGE"),
        ),
    )


def guard_upload(df: DataFrame, content_type: str, payload: str) -> DataFrame:
    """Uploads that are no image or empty keep their row with an error text."""
    kind = F.coalesce(F.col(content_type), F.lit(""))
    return df.withColumn(
        "upload_error",
        F.when(~kind.startswith("image/"), F.lit("not an image")).when(
            F.coalesce(F.octet_length(F.col(payload)), F.lit(0)) == 0, F.lit("empty file")
        ),
    )


def guard_attempt_shape(df: DataFrame, seqs: str, s: Settings = DEFAULTS) -> DataFrame:
    """1..max frames, distinct sequence numbers, none negative."""
    arr = F.col(seqs)
    n = F.coalesce(F.size(arr), F.lit(0))
    return df.withColumn(
        "shape_reject",
        F.when((n < 1) | (n > s.max_frames), F.lit("FRAME_COUNT"))
        .when(F.exists(arr, lambda q: q.isNull() | (q < 0)), F.lit("NEGATIVE_SEQ"))
        .when(F.size(F.array_distinct(arr)) != n, F.lit("DUPLICATE_SEQ")),
    )


# -- boxes and geometry -----------------------------------------------------


def face_bbox(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Relative detector corners to a pixel box; weak detections give NULLs.

    Needs ``conf, l, t, r, b, frame_w, frame_h``; truncates toward zero and
    counts both edge pixels.
    """
    hit = F.col("conf") >= s.detector_confidence

    def px(corner: str, extent: str) -> Column:
        return (F.col(corner) * F.col(extent)).try_cast("int")

    left, top = px("l", "frame_w"), px("t", "frame_h")
    right, bottom = px("r", "frame_w"), px("b", "frame_h")
    return df.withColumns(
        {
            "face_detected": F.coalesce(hit, F.lit(False)),
            "x": F.when(hit, left),
            "y": F.when(hit, top),
            "w": F.when(hit, right - left + 1),
            "h": F.when(hit, bottom - top + 1),
        }
    )


def bbox_xyxy_to_xywh(df: DataFrame, box: str = "box") -> DataFrame:
    """Corner struct ``x1,y1,x2,y2`` to truncated integer ``x,y,w,h``."""
    c = F.col(box)
    return df.withColumns(
        {
            "x": c["x1"].try_cast("int"),
            "y": c["y1"].try_cast("int"),
            "w": (c["x2"] - c["x1"]).try_cast("int"),
            "h": (c["y2"] - c["y1"]).try_cast("int"),
        }
    )


def face_px(df: DataFrame) -> DataFrame:
    """Face area in native pixels, never negative."""
    zero = F.lit(0).cast("long")
    return df.withColumn(
        "face_px", F.greatest(zero, F.col("w").cast("long")) * F.greatest(zero, F.col("h").cast("long"))
    )


def crop_window(df: DataFrame, scale: float | None) -> DataFrame:
    """Scaled box around the face, shifted back inside the frame.

    Adds inclusive corners ``ltx, lty, rbx, rby``; ``scale`` None takes the
    whole frame. Boxes without area give NULL corners.
    """
    fw, fh = F.col("frame_w"), F.col("frame_h")
    if scale is None:
        return df.withColumns(
            {"ltx": F.lit(0), "lty": F.lit(0), "rbx": fw - 1, "rby": fh - 1}
        )
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    usable = (F.col("w") > 0) & (F.col("h") > 0)
    s = F.least(
        F.try_divide((fh - 1).cast("double"), h),
        F.try_divide((fw - 1).cast("double"), w),
        F.lit(float(scale)),
    )
    half_w, half_h = w * s / 2, h * s / 2
    cx, cy = w / 2 + F.col("x"), h / 2 + F.col("y")
    out = df.withColumns(
        {
            "_l": F.when(usable, (cx - half_w).try_cast("int")),
            "_t": F.when(usable, (cy - half_h).try_cast("int")),
            "_r": F.when(usable, (cx + half_w).try_cast("int")),
            "_b": F.when(usable, (cy + half_h).try_cast("int")),
        }
    )

    def inside(lo: str, hi: str, extent: Column) -> tuple[Column, Column]:
        # first push right/down to the origin, then back from the far edge
        # (greatest skips NULLs, so unusable boxes are kept NULL by addition)
        shift = F.greatest(-F.col(lo), F.lit(0))
        lo1, hi1 = F.col(lo) + shift, F.col(hi) + shift
        over = F.greatest(hi1 - (extent - 1), F.lit(0))
        return lo1 - over, hi1 - over

    ltx, rbx = inside("_l", "_r", fw)
    lty, rby = inside("_t", "_b", fh)
    return out.withColumns({"ltx": ltx, "lty": lty, "rbx": rbx, "rby": rby}).drop(
        "_l", "_t", "_r", "_b"
    )


def geometry_gate(
    df: DataFrame, s: Settings = DEFAULTS, width_threshold: float | None = None
) -> DataFrame:
    """Face-to-frame ratios and the document-photo flag.

    The flag compares unrounded ratios; the published ones have 4 decimals.
    Unusable dimensions give ``geometry_ran`` false and no flag (fail safe).
    """
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    fw, fh = F.col("frame_w").cast("double"), F.col("frame_h").cast("double")
    ran = F.coalesce((w > 0) & (h > 0) & (fw > 0) & (fh > 0), F.lit(False))
    area, width = F.try_divide(w * h, fw * fh), F.try_divide(w, fw)
    hit = area >= s.face_ratio_reject
    if width_threshold is not None:
        hit = hit | (width >= width_threshold)
    return df.withColumns(
        {
            "geometry_ran": ran,
            "is_document": ran & F.coalesce(hit, F.lit(False)),
            "face_area_ratio": F.when(ran, round_dp(area, 4)).otherwise(F.lit(0.0)),
            "face_width_ratio": F.when(ran, round_dp(width, 4)).otherwise(F.lit(0.0)),
            "frame_aspect_ratio": F.when(ran, round_dp(F.try_divide(fw, fh), 4)).otherwise(
                F.lit(0.0)
            ),
        }
    )


# -- frame quality ----------------------------------------------------------


def qc_reason(s: Settings = DEFAULTS) -> Column:
    """First failing quality test over ``face_detected, n_faces, face_edge,
    sharpness, brightness`` (unrounded); NULL when the frame is usable."""
    return (
        F.when(~F.coalesce(F.col("face_detected"), F.lit(False)), F.lit("NO_FACE"))
        .when(F.col("n_faces") > 1, F.lit("MULTIPLE_FACES"))
        .when(F.col("face_edge") < s.min_face_edge, F.lit("TOO_SMALL"))
        .when(F.col("sharpness") < s.min_sharpness, F.lit("BLURRY"))
        .when(F.col("brightness") < s.min_brightness, F.lit("TOO_DARK"))
        .when(F.col("brightness") > s.max_brightness, F.lit("TOO_BRIGHT"))
    )


def frame_qc(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Quality verdict plus the metrics as published: none without a face,
    the head count with several, else the face edge, and what was measured on
    an edge that is long enough (1 decimal; detection score 3)."""
    reason = qc_reason(s)
    single = F.col("face_detected") & (F.col("n_faces") <= 1)
    measured = single & (F.col("face_edge") >= s.min_face_edge)
    more = {"det_score": ("det_score", 3), "pose_yaw": ("yaw", 1), "pose_pitch": ("pitch", 1)}
    return df.withColumns(
        {
            "qc_reason": reason,
            "qc_valid": reason.isNull(),
            "qc_metrics": F.struct(
                F.when(F.col("face_detected") & (F.col("n_faces") > 1), F.col("n_faces")).alias("n_faces_detected"),
                F.when(single, round_dp(F.col("face_edge"), 1)).alias("face_edge_px"),
                F.when(measured, round_dp(F.col("sharpness"), 1)).alias("sharpness"),
                F.when(measured, round_dp(F.col("brightness"), 1)).alias("brightness"),
                *[F.when(measured, round_dp(F.col(c), d)).alias(n) for n, (c, d) in more.items() if c in df.columns],
            ),
        }
    )


# -- fusion and verdicts ----------------------------------------------------


def fuse_verdict(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Combine the model call with the image signals.

    Needs ``nn_label, nn_score, spoof_probability`` and a ``signal_scores``
    struct whose values already carry their published 4 decimals. Branch
    order is part of the contract.
    """
    zero = F.lit(0.0)
    recapture = F.coalesce(F.col("signal_scores.recapture"), zero)
    lbp = F.coalesce(F.col("signal_scores.lbp"), zero)
    moire = F.coalesce(F.col("signal_scores.moire"), zero)
    p, nn = F.col("spoof_probability"), F.col("nn_score")
    confirmed = (lbp > s.confirm_min) | (moire > s.confirm_min)
    recaptured = recapture >= s.recapture_spoof
    called_spoof = F.col("nn_label") != 1
    overridable = (
        (nn < s.weak_spoof_max) & (p < s.override_real_max) & ~confirmed & ~recaptured
    )

    def verdict(label: str, score: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), score.alias("score"))

    fused = (
        F.when(recaptured & confirmed, verdict("spoof", F.greatest(recapture, p)))
        .when(called_spoof & overridable, verdict("real", F.lit(1.0) - p))
        .when(called_spoof, verdict("spoof", F.greatest(nn, p)))
        .when(p > 0.6, verdict("spoof", p))
        .when((p > 0.35) & (nn < 0.7), verdict("spoof", F.greatest(nn * 0.5, p)))
        .when((p > 0.1) & (nn < 0.6), verdict("spoof", F.greatest(nn * 0.4, p)))
        .otherwise(verdict("real", nn))
    )
    return df.withColumn("_fused", fused).withColumns(
        {"label": F.col("_fused.label"), "score": F.col("_fused.score")}
    ).drop("_fused")


def is_real(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return df.withColumn(
        "is_real", (F.col("label") == "real") & (F.col("score") >= s.liveness_threshold)
    )


def final_label(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Merge early exits over the fused label: no face, then document.

    Needs ``face_detected, is_document, face_area_ratio, label, score``.
    """
    no_face = ~F.coalesce(F.col("face_detected"), F.lit(False))
    document = F.coalesce(F.col("is_document"), F.lit(False))
    return df.withColumns(
        {
            "label": F.when(no_face, F.lit("no_face"))
            .when(document, F.lit("document_photo"))
            .otherwise(F.col("label")),
            "score": F.when(no_face, F.lit(0.0))
            .when(document, F.col("face_area_ratio"))
            .otherwise(F.col("score")),
            "threshold": F.when(~no_face & document, F.lit(s.face_ratio_reject)).otherwise(
                F.lit(s.liveness_threshold)
            ),
        }
    )


def _verdict(s: Settings) -> Column:
    label = F.col("label")
    return (
        F.when(label.isin("document_photo", "spoof"), F.lit("spoof"))
        .when((label == "no_face") | (F.col("score") < s.liveness_threshold), F.lit("low_quality"))
        .otherwise(F.lit("live"))
    )


def _reason(s: Settings) -> Column:
    label = F.col("label")
    return (
        F.when(label == "document_photo", F.lit("DOCUMENT_PHOTO"))
        .when(label == "no_face", F.lit("NO_FACE"))
        .when(label == "spoof", F.lit("PASSIVE_PAD_SPOOF"))
        .when(F.col("score") < s.liveness_threshold, F.lit("LOW_QUALITY"))
    )


def pad_verdict(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Label and score to the three-way verdict and its reason."""
    return df.withColumns({"verdict": _verdict(s), "reason": _reason(s)})


def legacy_verdict(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Same mapping plus the 0/1 flag older callers read."""
    out = is_real(pad_verdict(df, s), s)
    return out.withColumn("is_spoof", F.when(F.col("is_real"), F.lit(0)).otherwise(F.lit(1)))


def document_reject(df: DataFrame, reply: str, s: Settings = DEFAULTS) -> DataFrame:
    """Confident "document" replies reject; everything else falls through."""
    parsed = text.parse_document_replies(df, reply, "reply_")
    confident = (
        F.col("reply_ran") & F.col("reply_is_document") & (F.col("reply_confidence") >= s.document_reject)
    )
    return parsed.withColumn("document_reject", F.coalesce(confident, F.lit(False)))


def error_default(df: DataFrame, endpoint: str = "endpoint", error: str = "error") -> DataFrame:
    """Fail policy per endpoint for rows that carry an error."""
    failed, where = F.col(error).isNotNull(), F.col(endpoint)
    session = where == "session"
    return df.withColumns(
        {
            "default_verdict": F.when(failed & session, F.lit("incomplete")).when(
                failed, F.lit("low_quality")
            ),
            "default_reason": F.when(failed, F.lit("INTERNAL_ERROR")),
            "default_score": F.when(failed & session, F.lit(-1.0)).when(failed, F.lit(0.0)),
            "default_is_spoof": F.when(failed & (where == "legacy"), F.lit(1)),
        }
    )


def timeout_default(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Classify recorded ``processing_ms`` against the endpoint's budget."""
    session = F.col("endpoint") == "session"
    budget = F.when(session, F.lit(s.session_budget_ms)).otherwise(F.lit(s.pad_budget_ms))
    late = F.col("processing_ms") > budget
    return df.withColumns(
        {
            "timed_out": late,
            "timeout_verdict": F.when(late & session, F.lit("incomplete")).when(
                late, F.lit("low_quality")
            ),
            "timeout_reason": F.when(late, F.lit("TIMEOUT")),
        }
    )


def action_for(
    df: DataFrame, match_score: str | None = None, s: Settings = DEFAULTS
) -> DataFrame:
    """Caller policy: what to do with a verdict, and whether it is an incident
    or an event worth recording. A failed identity match stops earlier."""
    service_fault = F.coalesce(F.col("reason").isin("TIMEOUT", "INTERNAL_ERROR"), F.lit(False))
    action = (
        F.when(service_fault, F.lit("proceed"))
        .when(F.col("verdict") == "live", F.lit("continue"))
        .when(F.col("verdict") == "spoof", F.lit("reject"))
        .otherwise(F.lit("retake"))
    )
    if match_score is not None:
        matched = F.coalesce(F.col(match_score) >= s.match_score_min, F.lit(False))
        action = F.when(~matched, F.lit("reject_identity")).otherwise(action)
    return df.withColumn("action", action).withColumns(
        {
            "incident": F.col("action") == "reject",
            "security_event": service_fault & (F.col("action") == "proceed"),
        }
    )


def route_save_frame(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Evidence flag: configured verdicts and every document hit; never for
    failed or faceless requests."""
    reason = F.coalesce(F.col("reason"), F.lit(""))
    return df.withColumn(
        "save_frame",
        F.when(reason == "DOCUMENT_PHOTO", F.lit(True))
        .when(reason.isin("NO_FACE", "TIMEOUT", "INTERNAL_ERROR"), F.lit(False))
        .otherwise(F.col("verdict").isin(*s.save_frame_verdicts)),
    )


# -- request admission ------------------------------------------------------


def replay_guard(
    df: DataFrame, header: str, now_s: Column, s: Settings = DEFAULTS
) -> DataFrame:
    """Reject reason for the request-time header, NULL inside the window.

    The tolerance itself is still accepted. Not-a-number and infinities are
    ruled out before comparing, since Spark orders NaN above everything.
    """
    raw = F.col(header)
    seconds = text.header_seconds(raw)
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return df.withColumn(
        "replay_reject",
        F.when(raw.isNull() | (raw == ""), F.lit("MISSING"))
        .when(~finite, F.lit("INVALID"))
        .when(F.abs(now_s - seconds) > s.replay_tolerance_s, F.lit("OUTSIDE_WINDOW")),
    )


def resolve_client(
    df: DataFrame, peer: str, forwarded: str, s: Settings = DEFAULTS
) -> DataFrame:
    return df.withColumn(
        "client_ip", text.effective_ip(F.col(peer), F.col(forwarded), s.trust_proxy_headers)
    )


def ip_allowlist(df: DataFrame, ip: str = "client_ip", s: Settings = DEFAULTS) -> DataFrame:
    """Admission by network.

    The networks are a handful of settings, so the range join folds into one
    generated predicate: no broadcast, no nested-loop join. Addresses of the
    other family match nothing; text that is no address skips the check.
    """
    inside = F.lit(False)
    for lo, hi in network_ranges(s.allowed_networks):
        inside = inside | F.col("_number").between(lo, hi)
    numbered = df.withColumn("_v4", F.coalesce(F.col(ip).rlike(text.IPV4_PATTERN), F.lit(False))).withColumn(
        "_number", F.when(F.col("_v4"), text.ipv4_number(F.col(ip)))
    )
    no_address = ~F.coalesce(F.col(ip).rlike(text.IPV6_PATTERN), F.lit(False))
    return numbered.withColumn("admitted", F.when(F.col("_v4"), inside).otherwise(no_address)).drop(
        "_v4", "_number"
    )


def network_ranges(networks: tuple[str, ...]) -> list[tuple[int, int]]:
    out = []
    for network in networks:
        base, bits = network.split("/")
        number = 0
        for octet in base.split("."):
            number = number * 256 + int(octet)
        size = 1 << (32 - int(bits))
        lo = number - number % size
        out.append((lo, lo + size - 1))
    return out
